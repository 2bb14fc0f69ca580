"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text without its white space is cut into blocks of BLOCK_BYTES bytes. The distinct blocks are sorted, and a block's place in
that order is its integer name; then adjacent names are paired, the distinct pairs sorted and named alike, and so on until one
name is left of each document. Two documents have the same name of the same round exactly if their blocks are equal
byte by byte: names stand for contents that were compared, no hash decides.

Blocks and pairs are counted before they are sorted. One that only one document holds isn't named: that document
equals no other, so it's left alone with all that is above it. What goes on to the next round are documents that could still
have an equal. Blocks travel twice, once to be counted (added up before the shuffle, so thousands of copies cost a row a task) and once to
meet their names, in a join of two written tables that adaptive execution can split where one block is hot. After that only numbers travel. A document of n
blocks takes log2(n) rounds.

Null texts count as empty; all texts of white space only are equal. Of equal texts the one with the most code points in the original stays,
then the one with the smallest doc_id (null last), then any one of rows that are alike in both. Every row is a document of its own, whatever ids
repeat. An empty table gives an empty result; other columns, of any name, are kept by ``deduplicate`` and ignored otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.llm.quality_rules import SPACES, let, text_of
from scenegrid.llm.store import Scratch

BLOCK_BYTES = 2048


def without_space(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def blocks_of(text: Column, size: int = BLOCK_BYTES) -> Column:
    """The bytes of a text in blocks of ``size``, the last one shorter; an empty text has one empty block."""

    def cut(b: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.octet_length(b) / size).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * size + 1, F.lit(size)))

    return let(text.cast("binary"), cut)


def _names(held: DataFrame, content: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The integer names of the contents that two documents or more hold, by their order."""
    shared = held.groupBy(*content).agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high").select(*content)
    # ranges are drawn from the beginning and a hash of contents, so that only these come to the driver; what is equal in both is told apart by the sort
    where = [*[F.substring(c, 1, 16) if dict(held.dtypes)[c] == "binary" else F.col(c) for c in content], F.xxhash64(*content)]
    ordered = shared.repartitionByRange(*where).sortWithinPartitions(*where, *content)
    return scratch.table(ordered.withColumn("name", F.monotonically_increasing_id()), name)


def identities(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, level and name of the documents of ``rows`` (uid, blocks) that equal another; the others have no row."""
    held = rows.select("uid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
    named = held.join(_names(held, ["block"], scratch, "names-0"), "block").select("uid", "n", "at", "name")
    done, level = [], 0
    while True:
        named = scratch.table(named, f"named-{level}")
        done.append(named.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        if named.where("n > 1").isEmpty():
            return reduce(DataFrame.union, done)
        # a pair whose half has no name is held by one document only
        half = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("name")))
        pairs = named.where("n > 1").groupBy("uid", "n", F.expr("at div 2").cast("int").alias("pair")).agg(half(0).alias("left"), half(1).alias("right"))
        whole = F.col("left").isNotNull() & (F.col("right").isNotNull() | (F.col("pair") * 2 + 1 == F.col("n")))
        pairs = pairs.where(whole).select("uid", F.expr("CAST((n + 1) div 2 AS INT)").alias("n"), F.col("pair").alias("at"), "left", F.coalesce("right", F.lit(-1)).alias("right"))
        level += 1
        pairs = scratch.table(pairs, f"pairs-{level}")
        named = pairs.join(_names(pairs, ["left", "right"], scratch, f"names-{level}"), ["left", "right"]).select("uid", "n", "at", "name")


def _grouped(docs: DataFrame, text: str, size: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with a number each, and (uid, keep_uid, keep_id, group_size) of all of them."""
    scratch = Scratch(docs.sparkSession, "exact")
    bare = docs.select(F.col("doc_id"), F.length(text_of(text)).cast("long").alias("points"), without_space(text_of(text)).alias("bare"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []))
    rows = bare.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "points", F.sha2("bare", 256).alias("text_sha256"), blocks_of(F.col("bare"), size).alias("blocks"), *(["row"] if whole else []))
    rows = scratch.table(rows, "rows", compression="zstd")
    found = rows.select("uid", "doc_id", "points", "text_sha256").join(identities(rows, scratch), "uid", "left")
    found = scratch.table(found, "identities")
    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    groups = found.where("name IS NOT NULL").groupBy("level", "name").agg(first.alias("keep"), F.count("*").alias("group_size"))
    groups = scratch.table(groups.select("level", "name", F.col("keep.uid").alias("keep_uid"), F.col("keep.doc_id").alias("keep_id"), "group_size"), "groups")
    alone = found.where("name IS NULL").select("uid", "doc_id", "text_sha256", F.col("uid").alias("keep_uid"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    met = found.join(groups, ["level", "name"]).select("uid", "doc_id", "text_sha256", "keep_uid", "keep_id", "group_size")
    return rows, met.union(alone)


def exact_duplicates(docs: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    _, found = _grouped(docs, text, size, whole=False)
    return found.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, found = _grouped(docs, text, size, whole=True)
    kept = found.where("uid = keep_uid").select("uid")
    return rows.select("uid", "row").join(kept, "uid", "left_semi").select("row.*")
