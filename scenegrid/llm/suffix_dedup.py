"""Repeated passages by a sparse suffix array.

Suffixes are retained only where content selects them: at the minimisers, the positions whose
GRAM-word hash is the smallest (the leftmost of equals) of some REACH consecutive ones inside a window of
MIN_WORDS. Two equal windows of MIN_WORDS words select the same place in both, so a passage of that length
that comes twice always has a retained suffix in common, with its first MIN_WORDS - REACH + 1 words equal.

1. Retained suffixes are sorted over the whole cluster, by the hash of those words and then by place (a range
   partition and a sort within it, so the suffixes of a frequent passage spread over many tasks); each is compared
   with its neighbours, across the ends of partitions too, and one without an equal neighbour goes.
2. The rest are extended left and right to the whole neighbourhood (REACH - 1 words to the left, the window to
   the right) and grouped by it. Where all equal suffixes have one neighbourhood, every window in it
   repeats, and the earliest occurrence, by doc_id and position, is the one that stays.
3. Where neighbourhoods differ, the match ends nearby. One occurrence of each neighbourhood is extended
   window by window: it hashes each of its windows of MIN_WORDS words, and equal windows meet.

The result is exact up to collisions of 64-bit hashes: a word is repeated if it lies in a MIN_WORDS window that
comes twice or more in the corpus (the same document included), and to be removed if such a window
has an earlier occurrence. The earliest occurrence of every window stays.

Null and empty texts and texts under MIN_WORDS words have no window. Rows without a doc_id are left out.
A document is a doc_id with a text: different texts of one doc_id are different documents, in the order of a hash of
the text; rows equal in both are one, count as one place each window stands at, and never remove each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.llm import textkit as K
from scenegrid.llm.store import Scratch
from scenegrid.llm.tables import fresh

MIN_WORDS = 50
REACH = 24
GRAM = 8
SUFFIX = MIN_WORDS - REACH + 1

#: The low bits of a minimiser's rank: its place in the text, so that the leftmost of equals is chosen.
_LOCAL = np.uint64((1 << 32) - 1)


def minimisers(w: K.Words, sums: np.ndarray) -> np.ndarray:
    """The retained positions, as word numbers of the batch."""
    n = len(w.hash)
    if n < MIN_WORDS:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    local = (at - w.first[w.doc[at]]).astype(np.uint64) & _LOCAL
    low = (K.spans(sums, at, at + GRAM) & ~_LOCAL) | local
    width = 1
    while 2 * width <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < REACH:
        low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    start = np.arange(n - MIN_WORDS + 1)
    start = start[w.doc[start] == w.doc[start + MIN_WORDS - 1]]
    mine = (start - w.first[w.doc[start]]).astype(np.uint64) & _LOCAL
    chosen = np.zeros(n, bool)
    chosen[start + (((low[start] & _LOCAL) - mine) & _LOCAL).astype(np.int64)] = True
    return np.flatnonzero(chosen)


#: What tells documents apart.
DOCUMENT = ("doc_id", "text_key")
_SUFFIXES = "key bigint, around bigint, doc_id bigint, text_key bigint, pos int, upto int"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.chunks(batch):
            w = K.words(part.column("text"))
            sums = K.prefix(w.hash)
            p = minimisers(w, sums)
            first, n = w.first[w.doc[p]], w.counts[w.doc[p]]
            left = np.maximum(first, p - REACH + 1)
            right = np.minimum(p, first + n - MIN_WORDS) + MIN_WORDS
            sides = ((p - left) * 256 + (right - p)).astype(np.uint64)
            around = K.mix(K.spans(sums, left, right) + K.mix(sides))
            ids = [part.column(c).to_numpy()[w.doc[p]] for c in DOCUMENT]
            yield pa.RecordBatch.from_arrays(K.arrays(K.signed(K.spans(sums, p, p + SUFFIX)), K.signed(around), *ids, (p - first).astype(np.int32), (right - first).astype(np.int32)), ["key", "around", *DOCUMENT, "pos", "upto"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes, those equal to a neighbour, and the first and the last one of the partition."""
    held: pa.RecordBatch | None = None  # the last row, until its next neighbour is known
    first, twin = True, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        same = key[1:] == key[:-1]
        alike = np.zeros(len(key), bool)
        alike[1:] |= same
        alike[:-1] |= same
        alike[0] |= twin
        border = np.zeros(len(key), bool)
        border[0] = first
        keep = np.flatnonzero((alike | border)[:-1])
        if len(keep):
            yield _marked(rows, keep, alike, border)
            first = False
        elif len(key) > 1:
            first = False
        held, twin = rows.slice(len(key) - 1), bool(alike[-1])
    if held is not None:
        yield _marked(held, np.array([0]), np.array([twin]), np.array([True]))


def _marked(rows: pa.RecordBatch, keep: np.ndarray, alike: np.ndarray, border: np.ndarray) -> pa.RecordBatch:
    taken = rows.take(pa.array(keep))
    return pa.RecordBatch.from_arrays([*taken.columns, pa.array(alike[keep]), pa.array(border[keep])], [*rows.schema.names, "twin", "border"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows around the positions ``at`` of each text, each once."""
    for batch in batches:
        for part in K.chunks(batch):
            w = K.words(part.column("text"))
            sums = K.prefix(w.hash)
            at = part.column("at")
            doc = np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
            p = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            last = w.counts[doc] - MIN_WORDS
            own = (last >= 0) & (p >= 0) & (p - REACH + 1 <= last)  # all of them, unless two texts share a hash
            doc, p, last = doc[own], p[own], last[own]
            low, high = w.first[doc] + np.maximum(0, p - REACH + 1), w.first[doc] + np.minimum(p, last)
            opened = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(opened, low, 1)
            np.add.at(opened, high + 1, -1)
            start = np.flatnonzero(np.cumsum(opened) > 0)
            ids = [part.column(c).to_numpy()[w.doc[start]] for c in DOCUMENT]
            yield pa.RecordBatch.from_arrays(K.arrays(K.signed(K.spans(sums, start, start + MIN_WORDS)), *ids, (start - w.first[w.doc[start]]).astype(np.int32)), ["window", *DOCUMENT, "start"])


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > top[:-1]
    at = np.flatnonzero(new)
    return lo[at], top[np.append(at[1:], len(lo)) - 1]


_SPAN = "array<struct<start:int,end:int>>"
_MERGED = f"doc_id bigint, text_key bigint, n_repeated_words bigint, n_removed_words bigint, repeated {_SPAN}, removed {_SPAN}"


def _merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        rows = batch.column("spans")
        off = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))])
        flat = rows.flatten()
        lo, hi, gone = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        counts, lists = [], []
        for kept_only in (False, True):
            starts, ends, sizes, totals = [], [], [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                pick = gone[a:b] if kept_only else slice(None)
                s, e = merge(lo[a:b][pick], hi[a:b][pick])
                starts.append(s)
                ends.append(e)
                sizes.append(len(s))
                totals.append(int((e - s).sum()))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32()) for x in (starts, ends)], fields=list(kind))
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), spans))
            counts.append(pa.array(totals, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DOCUMENT), *counts, *lists], [*DOCUMENT, "n_repeated_words", "n_removed_words", "repeated", "removed"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document with a repeated passage: doc_id, the numbers of repeated and of removed words,
    and the spans of both as word positions. A document whose passages all stand there first has none removed."""
    return found_spans(docs).drop("text_key")


def found_spans(docs: DataFrame) -> DataFrame:
    """``repeated_passages`` with the ``text_key`` (a hash of the text) that tells documents of one doc_id apart."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    place = F.struct(*DOCUMENT, "pos")
    suffixes = scratch.table(docs.mapInArrow(_suffixes, _SUFFIXES), "suffixes")
    order = ("key", *DOCUMENT, "pos")
    marked = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"{_SUFFIXES}, twin boolean, border boolean")
    marked = scratch.table(marked, "marked")
    scratch.drop("suffixes")
    # two rows of each partition at most: an equal one may stand at the end of another partition
    met = marked.where("border").groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    held = marked.where("twin").unionByName(marked.where("NOT twin").join(met, "key", "left_semi")).drop("twin", "border")

    around = scratch.table(held.groupBy("key", "around").agg(F.count("*").alias("c"), F.min(place).alias("first")), "around")
    split = scratch.table(around.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "split")
    ends = scratch.table(around.join(split, "key", "left_semi").select("first.*").groupBy(*DOCUMENT).agg(F.collect_list("pos").alias("at")), "ends")
    many = scratch.table(around.where("c > 1").select("key", "around", "first"), "many")
    whole = held.join(many, ["key", "around"]).select(*DOCUMENT, F.greatest(F.lit(0), F.col("pos") - REACH + 1).alias("lo"), F.col("upto").alias("hi"), (place != F.col("first")).alias("gone"))
    whole = scratch.table(whole, "whole")
    scratch.drop("marked", "around", "many", "split")

    windows = scratch.table(docs.hint("merge").join(ends, list(DOCUMENT)).mapInArrow(_windows, "window bigint, doc_id bigint, text_key bigint, start int"), "windows")
    twice = scratch.table(windows.groupBy("window").agg(F.count("*").alias("c"), F.min(F.struct(*DOCUMENT, "start")).alias("first")).where("c > 1").select("window", "first"), "twice")
    single = windows.join(twice, "window").select(*DOCUMENT, F.col("start").alias("lo"), (F.col("start") + MIN_WORDS).alias("hi"), (F.struct(*DOCUMENT, "start") != F.col("first")).alias("gone"))
    spans = whole.union(single).groupBy(*DOCUMENT).agg(F.collect_list(F.struct("lo", "hi", "gone")).alias("spans"))
    found = scratch.table(spans.mapInArrow(_merge_lists, _MERGED), "merged")
    scratch.drop("windows", "twice", "whole", "ends")
    return found


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of the spans (and the white space after them)."""
    w = K.words(texts)
    lengths = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(lengths)])
    flat = spans.flatten()
    lo, hi = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
    out = []
    for i, text in enumerate(texts):
        if off[i] == off[i + 1]:
            out.append(text.as_py())
            continue
        keep, at, end = [], w.text_start[i], w.text_start[i + 1]
        for a, b in zip(lo[off[i] : off[i + 1]], hi[off[i] : off[i + 1]], strict=True):
            keep.append(w.raw[at : w.start[w.first[i] + a]].tobytes())
            next_ = w.first[i] + b
            at = w.start[next_] if next_ < w.first[i + 1] else end
        keep.append(w.raw[at:end].tobytes())
        out.append(b"".join(keep).decode())
    return pa.array(out, texts.type)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their removed passages; ``n_chars``, where there is one, follows the text.
    Documents that have no word left go; those that had none to begin with stay."""
    own, key, removed, was_cut = (fresh(docs, c) for c in ("_id", "_key", "_removed", "_cut"))
    spans = found_spans(docs).where("n_removed_words > 0").select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("removed").alias(removed))
    same = (docs["doc_id"].cast("long") == spans[own]) & (F.xxhash64(docs["text"]) == spans[key])
    joined = docs.hint("merge").join(spans, same, "left").drop(own, key)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                text = cut(part.column("text"), part.column(removed))
                gone = part.column(removed).is_valid()
                yield pa.RecordBatch.from_arrays([*(text if c == "text" else part.column(c) for c in names), gone], [*names, was_cut])

    out = joined.mapInArrow(run, joined.drop(removed).withColumn(was_cut, F.lit(True)).schema)
    out = out.where(~F.col(was_cut) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(was_cut)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
