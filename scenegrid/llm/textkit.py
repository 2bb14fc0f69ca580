"""Vectorised text kernels used inside Arrow tasks: words, hashes, shingles, windows.

Words are the runs of bytes other than ASCII white space (``\\x20 \\x09-\\x0D``). Everything works on the
UTF-8 buffer of a batch at once; ``chunks`` keeps the temporaries of a task at a few dozen MB however
long the texts are (a single text longer than the chunk is taken whole).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 19
_MASK = (1 << 64) - 1


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 2**63, dtype=np.uint64)) * 2 + 1 & _MASK


_BASE, _STEP = _odd(11), _odd(12)
_BYTE = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For terms: every ASCII byte but letters and digits separates; bytes of other scripts belong to terms.
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.cumprod(out)
    return have[:n]


_INV_BASE, _INV_STEP = pow(_BASE, -1, 1 << 64), pow(_STEP, -1, 1 << 64)


def prefix(values: np.ndarray, base: int = _STEP) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any run of values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = _INV_STEP) -> np.ndarray:
    """Hashes of the runs [start, end): equal runs have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix((sums[end] - sums[start]) * powers(inverse, int(start.max()) + 1)[start])


@dataclass
class Words:
    """The words of a batch of texts, in order."""

    n_docs: int
    raw: np.ndarray  #: bytes of all texts
    text_start: np.ndarray  #: per text, its first byte
    doc: np.ndarray  #: per word, its text's number
    start: np.ndarray  #: per word, its first byte
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: per text, its first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    n, at = len(texts), texts.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[at : at + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(texts: pa.Array, separator: np.ndarray = SPACE, breaks=None) -> Words:
    """``breaks``, of the bytes, marks where a word ends and another begins without a separator."""
    raw, off = buffers(texts)
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(len(texts), raw, off, z, z, z, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    inside = ~separator[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if breaks is not None:
        begins |= inside & breaks(raw)
    edge = off[1:-1]  # a text begins a word even if the one before ends in one
    edge = edge[edge < n]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    last = off[1:] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, n), out=sums[1:])
    h = spans(sums, start, end, _INV_BASE)
    first = np.searchsorted(start, off)
    return Words(len(texts), raw, off, np.repeat(np.arange(len(texts)), np.diff(first)), start, end, h, first)


def byte_sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums over bytes; ``byte_spans`` takes hashes of byte runs from them."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(_BASE, len(raw)), out=sums[1:])
    return sums


def byte_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans(sums, start, end, _INV_BASE)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of k words; a text of 1 to k-1 words has one shingle, all of it."""
    n = len(w.hash)
    sums = prefix(w.hash)
    counts = w.counts
    start = np.arange(max(0, n - k + 1))
    if len(start):
        start = start[w.doc[start] == w.doc[start + k - 1]]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return w.doc[start], spans(sums, start, start + k)
    doc = np.concatenate([w.doc[start], short])
    h = np.concatenate([spans(sums, start, start + k), spans(sums, w.first[short], w.first[short + 1])])
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def bags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, multiplicity) of the distinct hashes of each text, by text."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc)) if len(h) < 64 else _by_doc(doc, h)
    d, x = doc[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], x[at], np.diff(np.append(at, len(x)))


def _by_doc(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    return order[np.argsort(doc[order], kind="stable")]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1), at + 4096)
        yield batch.slice(at, to - at)
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)


def arrays(*columns) -> list[pa.Array]:
    return [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and counts per row."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))
