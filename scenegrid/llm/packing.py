"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

A bin carries a bitmap of the sources and one of the duplicate clusters that it holds; a piece fits a bin
if there is room and neither its source nor its cluster is there yet. Bins are kept in the order of
their residual: the search begins at the smallest residual that has room and goes on to the successor until
a bin is compatible, so it finds the tightest compatible bin; without one a new bin is opened. Pieces are
taken by falling size (best-fit decreasing).

Documents of over ``capacity`` words are cut into pieces of that size and a rest. Pieces are dealt by a
hash into shards of about SHARD_PIECES, which are packed each on its own: a hot source or cluster is spread evenly, and so
are equal rows, which are numbered first; no task grows with the input, and within a shard a search passes over
SHARD_PIECES bins at most. What sharding costs in bins is in the README. Only ids and sizes travel, never texts.

A text without words is one piece of no words. A null source, and a null cluster, conflict with nothing.
Ties are taken by doc_id and piece. Rows with a null doc_id are packed as well.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.llm.quality_rules import SPLIT
from scenegrid.llm.store import Scratch

CAPACITY = 2048
SHARD_PIECES = 2048
#: Bins of a shard are numbered below this.
BINS = 1 << 20


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece, in the given order; bins are numbered as they are opened."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    held_sources: list[int] = []
    held_clusters: list[int] = []
    by_room: list[tuple[int, int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(by_room, (size, -1))
        while at < len(by_room) and (held_sources[by_room[at][1]] & s or held_clusters[by_room[at][1]] & c):
            at += 1
        if at < len(by_room):
            room, number = by_room.pop(at)
        else:
            room, number = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[number] |= s
        held_clusters[number] |= c
        insort(by_room, (room - size, number))
        out.append(number)
    return out


def _pack(capacity: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["n_words", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        # only clusters that come twice in the shard can conflict
        again = pieces["cluster"].duplicated(keep=False) & pieces["cluster"].notna()
        clusters = [c if a else None for c, a in zip(pieces["cluster"], again, strict=True)]
        sources = [None if pd.isna(s) else s for s in pieces["source"]]
        number = best_fit(pieces["n_words"].tolist(), sources, clusters, capacity)
        out = pieces[["doc_id", "piece", "start", "n_words"]].copy()
        out.insert(0, "bin_id", pieces["shard"] * BINS + pd.Series(number, dtype="int64"))
        out.insert(1, "slot", out.groupby("bin_id").cumcount())
        out["bin_words"] = out.groupby("bin_id")["n_words"].transform("sum")
        return out

    return pack


def same_text(text: str = "text") -> Column:
    """A duplicate cluster for where none is given: texts with equal words, whatever case and spacing."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPLIT), "")
    return F.xxhash64(words)


def best_fit_pack(docs: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """bin_id, slot, doc_id, piece, start (its first word in the document), n_words, bin_words: one row per piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPLIT), "")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), (same_text() if cluster is None else cluster).cast("long").alias("cluster"), F.size(words).cast("long").alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    start = F.col("piece").cast("long") * capacity
    pieces = scratch.table(rows.select("doc_id", "source", "cluster", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("n_words")), "pieces")
    shards = max(1, round(pieces.count() / SHARD_PIECES))
    # equal rows are added up first and numbered, so that they don't all fall into one shard
    numbered = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "copy"), F.lit(shards))).drop("copies", "copy")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(_pack(capacity), f"bin_id bigint, slot bigint, doc_id {kind}, piece int, start bigint, n_words bigint, bin_words bigint")
