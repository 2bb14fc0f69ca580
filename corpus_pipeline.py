"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.llm import decontaminate, near_dup, packing, suffix_dedup, toxicity
from scenegrid.llm.store import Scratch
from scenegrid.llm.tables import fresh, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject, as they are."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "_toxicity")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), into=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that stand earlier in the corpus."""
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained and hashed stages aren't expressible in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The texts that are left, as they are packed, and their bins: a row's words are those from ``start`` on of its document. Both are tables that stay
    until the session ends; those of the stages before are dropped."""
    scratch = Scratch(spark, "pipeline")
    texts = docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        texts, docs = docs, scratch.table(stage(spark, docs, sf_dir), name)
        if 0 < i < len(STAGES) - 1:
            scratch.drop(STAGES[i - 1][0])
    return texts, docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins."""
    return packed(spark, sf_dir)[1]
