"""Benchmark decontamination by SimHash windows, Hamming blocks and exact overlap.

Every benchmark item has a window size from a ladder, just under its own length, and the SimHash
fingerprints (64 bits: the majority of its words' hash bits) of all its windows of that size. Every
document is covered by windows of each size at a step of STEP words; the sizes leave every copy of an item
at least one window in step with one of the item's own.

A text that is shorter than an item's window may still be the item cut short, and a copy with words changed in
the middle may be further than RADIUS away. Both are met by a second, shorter window (``run_size``) that lies
inside words which both share; its fingerprint must be equal.

Fingerprints are compared through a multi-index: 64 bits are BLOCKS blocks, and two fingerprints within
RADIUS bits have a block in which they differ by RADIUS // BLOCKS bits at most. Tables of all block values
that near an item's find every pair within the radius; the Hamming distance then decides.

A hit lays the item over the document; the weighted Jaccard of five-word shingles of the two
stretches, multiplicities included, must be THRESHOLD or more.

The document side is a map without a shuffle. The different texts of items go to the executors in blocks of about ITEM_BLOCK texts
and ITEM_BYTES bytes (only one text that is longer makes a larger block), one pass over the documents per block, so what is
broadcast never grows beyond that.

Null and empty texts and items match nothing. An item of 1 to 4 words has one shingle, all of it. Repeated
items and documents each have their own rows. Items without an item_id count. ``contaminated`` leaves out documents without
a doc_id; ``decontaminate`` goes by texts, so it screens them too, and rows of one doc_id each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.llm import textkit as K
from scenegrid.llm.store import Scratch
from scenegrid.llm.tables import fresh

STEP = 4
RADIUS = 7
BLOCKS = 4
THRESHOLD = 0.8
SHINGLE = 5
ITEM_BLOCK, ITEM_BYTES = 2000, 4 << 20
#: Items shorter than this are covered at every word.
SHORT = 2 * STEP

_BITS = 64 // BLOCKS
_NEAR = RADIUS // BLOCKS


def _add(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of bit-sliced numbers: plane i holds bit i of 64 counters in one word."""
    out, carry = [], None
    for i in range(max(len(x), len(y))):
        a, b = (x[i] if i < len(x) else None), (y[i] if i < len(y) else None)
        if a is None or b is None:
            a = a if b is None else b
            out.append(a if carry is None else a ^ carry)
            carry = None if carry is None else a & carry
            continue
        half = a ^ b
        out.append(half if carry is None else half ^ carry)
        carry = (a & b) if carry is None else (a & b) | (half & carry)
    return out if carry is None else [*out, carry]


def _above(x: list[np.ndarray], limit: int) -> np.ndarray:
    """The bits whose counter is over ``limit``."""
    over, equal = np.zeros_like(x[0]), np.full_like(x[0], ~np.uint64(0))
    for i in reversed(range(max(len(x), limit.bit_length()))):
        bit = x[i] if i < len(x) else np.zeros_like(over)
        if limit >> i & 1:
            equal = equal & bit
        else:
            over = over | (equal & bit)
            equal = equal & ~bit
    return over


class Windows:
    """SimHash of all windows of a row of hashes, a multiple of ``step`` long and that far apart."""

    def __init__(self, hashes: np.ndarray, step: int):
        self.step = step
        self.n = len(hashes) // step
        units = hashes[: self.n * step].reshape(self.n, step)
        planes = [[units[:, j].copy()] for j in range(step)]
        while len(planes) > 1:
            planes = [_add(planes[i], planes[i + 1]) if i + 1 < len(planes) else planes[i] for i in range(0, len(planes), 2)]
        self.runs = {1: planes[0]}

    def _run(self, k: int) -> list[np.ndarray]:
        """Counters of each k consecutive units."""
        if k not in self.runs:
            left = 1 << (k.bit_length() - 1)
            left = left // 2 if left == k else left
            a, b = self._run(left), self._run(k - left)
            self.runs[k] = _add([p[: self.n - k + 1] for p in a], [p[left : left + self.n - k + 1] for p in b])
        return self.runs[k]

    def fingerprints(self, size: int) -> np.ndarray:
        """One per unit at which a window of ``size`` hashes begins."""
        k = size // self.step
        return _above(self._run(k), size // 2) if self.n >= k else np.zeros(0, np.uint64)


def window_size(n: int) -> tuple[int, int]:
    """(size, step) of the windows for an item of n words."""
    if n < SHORT:
        return n, 1
    room, size = n - STEP + 1, STEP
    while True:
        wider = max(size + STEP, int(size * 1.15) // STEP * STEP)
        if wider > room:
            return size, STEP
        size = wider


def run_size(n: int) -> int:
    """Size of the shorter windows for an item of n words: a stretch that reaches THRESHOLD shares so long a run of
    words with the item that a window in step lies inside. A break inside a stretch costs at least SHINGLE - 1
    shingles, as long as shingles follow one another in one way only."""
    own, least = n - SHINGLE + 1, n
    for there in range(-(-4 * own // 5), own + 1):
        met = -(-4 * (own + there) // 9)
        breaks = (there - met) // (SHINGLE - 1)
        least = min(least, -(-met // (breaks + 1)) + SHINGLE - 1)
    return (least - STEP + 1) // STEP * STEP


def near_values(value: np.ndarray) -> np.ndarray:
    """Block values up to _NEAR bits from each value, one row per value."""
    out = [value[:, None]]
    for _ in range(_NEAR):
        flips = out[-1][:, :, None] ^ (1 << np.arange(_BITS))
        out.append(flips.reshape(len(value), -1))
    return np.concatenate(out, 1)


@dataclass
class SizeIndex:
    """The item windows of one size."""

    size: int
    step: int
    item: np.ndarray
    offset: np.ndarray
    print_: np.ndarray
    marked: list[np.ndarray] = field(default_factory=list)
    starts: list[np.ndarray] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)

    def build(self) -> SizeIndex:
        for b in range(BLOCKS):
            value = (self.print_ >> np.uint64(b * _BITS) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            near = near_values(value)
            pairs = np.unique(np.column_stack([near.ravel(), np.repeat(np.arange(len(value)), near.shape[1])]), axis=0)
            count = np.bincount(pairs[:, 0], minlength=1 << _BITS)
            self.marked.append(count > 0)
            self.starts.append(np.concatenate([[0], np.cumsum(count)]))
            self.members.append(pairs[:, 1])
        return self

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all pairs within RADIUS."""
        found = []
        for b in range(BLOCKS):
            value = (prints >> np.uint64(b * _BITS)).astype(np.uint16)
            at = np.flatnonzero(self.marked[b][value])
            low = self.starts[b][value[at]]
            count = self.starts[b][value[at].astype(np.int64) + 1] - low
            window = np.repeat(at, count)
            inside = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
            other = self.members[b][np.repeat(low, count) + inside]
            close = np.bitwise_count(prints[window] ^ self.print_[other]) <= RADIUS
            found.append(np.column_stack([window[close], other[close]]))
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]


@dataclass
class EqualIndex(SizeIndex):
    """The shorter item windows of one size, sorted; only equal fingerprints meet."""

    def build(self) -> EqualIndex:
        order = np.argsort(self.print_, kind="stable")
        self.item, self.offset, self.print_ = self.item[order], self.offset[order], self.print_[order]
        known = np.zeros(1 << _BITS, bool)
        known[(self.print_ >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.marked.append(known)
        return self

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.marked[0][(prints >> np.uint64(64 - _BITS)).astype(np.int64)])
        low = np.searchsorted(self.print_, prints[at])
        count = np.searchsorted(self.print_, prints[at], "right") - low
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), np.repeat(low, count) + inside


@dataclass
class Items:
    """A block of benchmark items, ready to be sent."""

    ids: list
    hashes: np.ndarray
    first: np.ndarray
    sizes: list[SizeIndex]

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Items:
        w = K.words(pa.array(texts, pa.string()))
        by: dict[tuple[int, int, bool], list[tuple[int, np.ndarray]]] = {}
        for i in range(len(ids)):
            own = w.hash[w.first[i] : w.first[i + 1]]
            if len(own):
                size, step = window_size(len(own))
                windows = Windows(own, 1)
                by.setdefault((size, step, False), []).append((i, windows.fingerprints(size)))
                if step == STEP and (run := run_size(len(own))) < size:
                    by.setdefault((run, step, True), []).append((i, windows.fingerprints(run)))
        sizes = []
        for (size, step, shorter), rows in sorted(by.items()):
            item = np.concatenate([np.full(len(p), i) for i, p in rows])
            offset = np.concatenate([np.arange(len(p)) for _, p in rows])
            kind = EqualIndex if shorter else SizeIndex
            sizes.append(kind(size, step, item, offset, np.concatenate([p for _, p in rows])).build())
        return Items(ids, w.hash, w.first, sizes)

    def matches(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start, similarity) of every verified place."""
        laid: list[np.ndarray] = []
        for step in sorted({s.step for s in self.sizes}):
            # each text begins at a multiple of the step, so its windows do too
            counts = w.counts
            room = -(-counts // step) * step
            base = np.concatenate([[0], np.cumsum(room)])
            padded = np.zeros(int(base[-1]), np.uint64)
            place = base[w.doc] + np.arange(len(w.hash)) - w.first[w.doc]
            padded[place] = w.hash
            windows = Windows(padded, step)
            unit_doc = np.repeat(np.arange(w.n_docs), room // step)
            for index in (s for s in self.sizes if s.step == step):
                prints = windows.fingerprints(index.size)
                at, other = index.hits(prints)
                doc = unit_doc[at]
                start = at * step - base[doc]
                fits = start + index.size <= counts[doc]
                doc, start, other = doc[fits], start[fits], other[fits]
                item = index.item[other]
                length = self.first[item + 1] - self.first[item]
                start = np.clip(start - index.offset[other], 0, np.maximum(0, counts[doc] - length))
                laid.append(np.column_stack([doc, item, start]))
        places = np.unique(np.concatenate(laid), axis=0) if laid else np.zeros((0, 3), np.int64)
        doc, item, start = places.T
        sim = self.overlap(w, doc, item, start)
        good = sim >= THRESHOLD
        return doc[good], item[good], start[good], sim[good]

    def overlap(self, w: K.Words, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of the shingles of each item and the stretch of its length."""
        n = len(doc)
        if not n:
            return np.zeros(0)
        length = self.first[item + 1] - self.first[item]
        begin = w.first[doc] + start
        end = np.minimum(begin + length, w.first[doc + 1])
        sides = [_stretches(w.hash, begin, end), _stretches(self.hashes, self.first[item], self.first[item + 1])]
        bags = [K.bags(*side) for side in sides]
        d, h, c = (np.concatenate([b[i] for b in bags]) for i in range(3))
        union = np.bincount(d, c, n)
        order = K._by_doc(d, h)
        d, h, c = d[order], h[order], c[order]
        pair = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
        both = np.bincount(d[pair], np.minimum(c[pair], c[pair + 1]), n)
        return both / np.maximum(union - both, 1)


def _stretches(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the stretch, shingle hash) of stretches of a row of word hashes."""
    sums = K.prefix(hashes)
    k = np.minimum(SHINGLE, end - begin)
    count = np.maximum(end - begin - k + 1, 0)
    owner = np.repeat(np.arange(len(begin)), count)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, K.spans(sums, at, at + k[owner])


def _search(docs: DataFrame, items: Items) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches:
            for part in K.chunks(batch):
                doc, item, start, sim = have.matches(K.words(part.column("text")))
                if len(doc):
                    # the best place of each document and item, the first of equals
                    order = np.lexsort((start, -sim, item, doc))
                    doc, item, start, sim = doc[order], item[order], start[order], sim[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                    doc, item, start, sim = doc[new], item[new], start[new], sim[new]
                    keys = pa.array([have.ids[i] for i in item], pa.int64())
                    yield pa.RecordBatch.from_arrays(K.arrays(part.column("doc_id").take(pa.array(doc)), keys, start, sim), ["doc_id", "item_key", "start", "similarity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_key bigint, start bigint, similarity double")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_key (a hash of the item's text), start and similarity."""
    key = F.xxhash64("text")
    items = benchmark.where(F.col("text").isNotNull()).select(key.alias("item_key"), "text").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEM_BLOCK), -(-size // ITEM_BYTES))
    passes = []
    for b in range(blocks):
        rows = items.where(F.pmod("item_key", F.lit(blocks)) == b).orderBy("item_key").collect()
        passes.append(_search(docs, Items.of([r["item_key"] for r in rows], [r["text"] for r in rows])))
    return reduce(DataFrame.unionByName, passes)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, the word at which the item stands and the similarity, for each item found in a document."""
    found = _found(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), benchmark)
    ids = benchmark.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("item_key"), "item_id")
    return found.join(ids, "item_key").select("doc_id", "item_id", "start", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found."""
    key = fresh(docs, "_key")
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("doc_id"), "text")
    hit = Scratch(docs.sparkSession, "contaminated").table(_found(texts, benchmark).select(F.col("doc_id").alias(key)).distinct(), "texts")
    return docs.hint("merge").join(hit, F.xxhash64("text") == F.col(key), "left_anti")
