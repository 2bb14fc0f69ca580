"""Ranked lexical search: postings by term, joined with the terms of the items, scored in integers.

Terms are the runs of characters other than ASCII ones that are neither letter nor digit; A-Z count as a-z, nothing else is folded. ``postings``
is the index: one row per document and term with the bucket of the term, so a table of it is sorted by bucket and
term within each file and a reader of a few buckets skips the rest. Documents are numbered as they are written, each row one of its own,
whatever ids repeat. ``rank`` joins the terms of the items, scores each match, adds up by item and document and numbers the best.

A match's points don't depend on the item, so they're computed once per posting. Postings then go to tasks by document, and there
meet the items of their term: sums by item and document need no further shuffle, and only the best k per item and task leave a task. The
number of tasks follows the exact count of matches. Lists of terms are broadcast only below BROADCAST_BYTES, which is checked; beyond
it they are joined by shuffles.

Null and empty texts have no term: they count neither in N nor in any result. Rows of one item_id (null too) are one item with the terms of all of them.
Items without a term, or with no match above 0, have no rows. Equal scores go by doc_id, null last. Sums are 64-bit: 90 * n * N must stay below
2**63. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.llm import textkit as K
from scenegrid.llm.store import Scratch

BUCKETS = 64
#: Of the filter over asked terms: a fixed size, whatever the number of items. A term too many does no harm.
FILTER_BITS = 20
BROADCAST_BYTES = 16 << 20
#: Matches that one task adds up.
TASK_MATCHES = 8_000_000
#: Documents have a row without a term in this bucket, for their number and lengths.
LENGTHS = -1

_FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_FOLD[65:91] += 32


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(text number, code, terms, their hashes, occurrences): each text's distinct terms, by text."""
    raw, off = K.buffers(texts)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(_FOLD[raw]))
    parts = pc.split_pattern(folded, " ")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(there).dictionary_encode()
    doc, code = doc[there.to_numpy(zero_copy_only=False)], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(1, len(coded.dictionary))
    key, tf = np.unique(doc * size + code, return_counts=True)
    bytes_, at = K.buffers(coded.dictionary)
    return key // size, key % size, coded.dictionary, K.byte_spans(K.byte_sums(bytes_), at[:-1], at[1:]), tf


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", only: np.ndarray | None = None) -> DataFrame:
    """bucket, term, the key, uid, n (terms of the document with repeats), tf; and a row without a term per document that has any.
    ``only``: a filter of ``asked``, to leave out terms that nobody asks for."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for b in K.chunks(batch):
                doc, code, terms, hashes, tf = _terms(b.column("text"))
                if not len(doc):
                    continue
                n = np.bincount(doc, weights=tf, minlength=b.num_rows).astype(np.int64)
                having = np.flatnonzero(n)
                bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)
                if only is not None:
                    keep = only[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)][code]
                    doc, code, tf = doc[keep], code[keep], tf[keep]
                all_docs = np.concatenate([having, doc])
                none = np.zeros(len(having), np.int64)
                term = pa.concat_arrays([pa.nulls(len(having), pa.string()), terms.cast(pa.string()).take(pa.array(code))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([none + LENGTHS, bucket[code]]).astype(np.int32)),
                        term,
                        b.column("key").take(pa.array(all_docs)),
                        b.column("uid").take(pa.array(all_docs)),
                        pa.array(n[all_docs]),
                        pa.array(np.concatenate([none, tf])),
                    ],
                    ["bucket", "term", "key", "uid", "n", "tf"],
                )

    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"bucket int, term string, key {kind}, uid bigint, n bigint, tf bigint")


def index(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", only: np.ndarray | None = None, name: str = "postings") -> DataFrame:
    """The postings as a table whose files are sorted by bucket and term."""
    return scratch.table(postings(docs, key, text, only).sortWithinPartitions("bucket", "term"), name)


def asked(wanted: DataFrame) -> np.ndarray:
    """A filter of fixed size that every term of ``wanted`` passes."""

    def places(batches):
        for b in batches:
            raw, off = K.buffers(b.column("term"))
            h = K.byte_spans(K.byte_sums(raw), off[:-1], off[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64))], ["place"])

    out = np.zeros(1 << FILTER_BITS, bool)
    out[[r.place for r in wanted.select("term").mapInArrow(places, "place bigint").distinct().collect()]] = True
    return out


def wanted_terms(items: DataFrame, scratch: Scratch, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, bucket and term, each once."""
    found = postings(items, item, text).where(F.col("bucket") != LENGTHS).select(F.col("key").alias("item_id"), "bucket", "term")
    return scratch.table(found.distinct(), "wanted")


def _small(df: DataFrame, *strings: str) -> DataFrame:
    """The written table, to be broadcast if its measured size allows."""
    n, more = df.agg(F.count("*"), sum((F.sum(F.octet_length(s)) for s in strings), F.lit(0))).first()
    return F.broadcast(df) if 64 * n + (more or 0) <= BROADCAST_BYTES else df


def rank(terms: DataFrame, wanted: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item: ``terms`` from ``index``, ``wanted`` from ``wanted_terms``."""
    n_docs, n_terms = terms.where(F.col("bucket") == LENGTHS).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked_for = scratch.table(wanted.groupBy("bucket", "term").agg(F.count("*").alias("items")), "asked")
    df = terms.join(_small(asked_for, "term"), ["bucket", "term"]).groupBy("bucket", "term").agg(F.count("*").alias("df"), F.first("items").alias("items"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = scratch.table(df.select("bucket", "term", F.monotonically_increasing_id().alias("term_id"), weight.alias("w"), (F.col("df") * F.col("items")).alias("matches")), "weights")
    matches = weights.agg(F.coalesce(F.sum("matches"), F.lit(0))).first()[0]
    m = F.lit(10) + F.expr(f"(90 * n * {n_docs}L) div {max(1, n_terms)}L")
    points = F.col("w") * F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")
    scored = terms.join(_small(weights.drop("matches"), "term"), ["bucket", "term"]).withColumn("m", m).select("uid", F.col("key").alias("doc_id"), "term_id", points.alias("points")).where("points > 0")
    of_items = _small(scratch.table(wanted.join(weights, ["bucket", "term"]).select("term_id", "item_id"), "of-items"))
    tasks = max(1, -(-matches // TASK_MATCHES))
    found = scored.repartition(max(tasks, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uid").join(of_items, "term_id")
    sums = found.groupBy("item_id", "uid", "doc_id").agg(F.sum("points").alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    """The k best documents of ``docs`` for each item, over postings of the terms that the items hold."""
    scratch = Scratch(docs.sparkSession, "lexical")
    wanted = wanted_terms(items, scratch, text=text)
    return rank(index(docs, scratch, text=text, only=asked(wanted)), wanted, scratch, k)
