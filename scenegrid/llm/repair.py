"""Re-Pair grammar compression of blocks of token-id sequences, with random access.

Each round counts all neighbouring pairs of symbols, takes those that come LEAST times, and replaces every one of their
occurrences, left to right, by a nonterminal; pairs never span two documents. It goes on until no pair comes so
often. What a round leaves of the pairs it counted comes less often, so the next counts only pairs with a new symbol.
The grammar keeps for each rule its two symbols and the length of its expansion, so a position in a document is found,
and any stretch decoded, from the compressed symbols of that document alone.

Layout of a block, little-endian: magic, 5 x u32 (documents, rules, symbols, different symbols, first nonterminal), i64
ids of the documents, then numbers of seven bits a byte, the high bit on all but the last byte: symbols of
each document, two symbols of each rule, the expansion length of each rule, the different symbols from the most
frequent on, and the symbols as places in that list.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"RPG2"
LEAST = 8
_HEAD = struct.Struct("<4s5I")
_FILTER_BITS = 22


def _keys(s: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """The pairs at places as numbers; 32 bits hold two symbols while all are below 2**16."""
    half = 16 if top <= 1 << 16 else 32
    kind = np.uint32 if half == 16 else np.uint64
    key = s[at].astype(kind)
    key <<= kind(half)
    key |= s[at + 1].astype(kind)
    return key, half


def _frequent(key: np.ndarray, least: int) -> np.ndarray:
    """The keys that come ``least`` times, sorted."""
    run = np.sort(key)
    at = np.flatnonzero(run[1:] != run[:-1]) + 1
    count = np.diff(at, prepend=0, append=len(run))
    return run[np.concatenate([[0], at])[count >= least]] if len(run) else run


def _members(key: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number among the chosen) of the keys that are chosen."""
    salt, shift = key.dtype.type(0x9E3779B97F4A7C15 & (1 << 8 * key.itemsize) - 1), key.dtype.type(8 * key.itemsize - _FILTER_BITS)
    known = np.zeros(1 << _FILTER_BITS, bool)
    known[(chosen * salt) >> shift] = True
    maybe = np.flatnonzero(known[(key * salt) >> shift])
    at = np.minimum(np.searchsorted(chosen, key[maybe]), len(chosen) - 1)
    hit = chosen[at] == key[maybe]
    return maybe[hit], at[hit]


def compress(ids: np.ndarray, lengths: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rules) of concatenated documents; nonterminals are numbered from ``first``."""
    s = ids.astype(np.uint32)
    doc_end = np.zeros(len(s), bool)
    doc_end[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    top, born = first, 0
    while len(s) > 1:
        new = s >= born
        place = np.flatnonzero((new[:-1] | new[1:]) & ~doc_end[:-1])
        key, half = _keys(s, place, top)
        chosen = _frequent(key, least)
        if not len(chosen):
            break
        hit, which = _members(key, chosen)
        # of neighbours that overlap, every second one from the left
        at = place[hit]
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        run = np.flatnonzero(begins)
        inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        taken = inside % 2 == 0
        at, which = at[taken], which[taken]
        used = np.flatnonzero(np.bincount(which, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.uint32)
        number[used] = top + np.arange(len(used))
        rules.append(np.column_stack([chosen[used] >> chosen.dtype.type(half), chosen[used] & chosen.dtype.type((1 << half) - 1)]).astype(np.int64))
        s[at] = number[which]
        born, top = top, top + len(used)
        doc_end[at] = doc_end[at + 1]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s, doc_end = s[stay], doc_end[stay]
    ends = np.flatnonzero(doc_end) + 1
    counts = np.zeros(len(lengths), np.int64)
    counts[lengths > 0] = np.diff(np.concatenate([[0], ends]))
    return s, counts, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def pack(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2**35 as bytes of seven bits each."""
    n = numbers.astype(np.uint64)
    size = np.ones(len(n), np.int64)
    for k in range(1, 5):
        size += n >= 1 << (7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint8)
    for k in range(5):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        more = np.where(size[at] > k + 1, 128, 0)
        out[ends[at] - size[at] + k] = (n[at] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out


def unpack(data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(the first n numbers, bytes read)."""
    if not n:
        return np.zeros(0, np.int64), 0
    ends = np.flatnonzero(data[: 5 * n] < 128)[:n]
    begins = np.concatenate([[0], ends[:-1] + 1])
    out = (data[begins] & 127).astype(np.int64)
    for k in range(1, 5):
        at = np.flatnonzero(begins + k <= ends)
        if not len(at):
            break
        out[at] |= (data[begins[at] + k] & 127).astype(np.int64) << (7 * k)
    return out, int(ends[-1]) + 1


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat terminals of all rules, length of each). A rule's symbols are terminals or earlier rules; rules that need no
    other unknown one are filled in together."""
    n = len(rules)
    sizes = np.zeros(n, np.int64)
    open_ = np.arange(n)
    waves = []
    while len(open_):
        parts = rules[open_]
        size = np.where(parts < first, 1, sizes[np.maximum(parts - first, 0)])
        ready = (size > 0).all(1)
        sizes[open_[ready]] = size[ready].sum(1)
        waves.append(open_[ready])
        open_ = open_[~ready]
        if not ready.any():
            raise ValueError("rules that go round in a circle")
    begin = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.int64)
    for wave in waves:
        to = begin[wave]
        for side in range(2):
            part = rules[wave, side]
            plain = part < first
            flat[to[plain]] = part[plain]
            of = part[~plain] - first
            size = sizes[of]
            ends = np.cumsum(size)
            inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
            flat[np.repeat(to[~plain], size) + inside] = flat[np.repeat(begin[of], size) + inside]
            to = to + np.where(plain, 1, sizes[np.maximum(part - first, 0)])
    return flat, sizes


def encode(doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray, first: int, **options) -> bytes:
    symbols, counts, rules = compress(ids, lengths, first, **options)
    _, sizes = expansions(rules, first)
    times = np.bincount(symbols, minlength=1)
    used = np.flatnonzero(times)
    listed = used[np.argsort(-times[used], kind="stable")]
    place = np.zeros(len(times), np.int64)
    place[listed] = np.arange(len(listed))
    head = _HEAD.pack(MAGIC, len(doc_ids), len(rules), len(symbols), len(listed), first)
    body = (pack(x).tobytes() for x in (counts, rules.ravel(), sizes, listed, place[symbols]))
    return head + doc_ids.astype("<i8").tobytes() + b"".join(body)


@dataclass
class Block:
    """A block as read; decodes documents or stretches of them."""

    doc_ids: np.ndarray
    counts: np.ndarray
    rules: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray
    first: int

    @staticmethod
    def read(data: bytes) -> Block:
        magic, docs, n_rules, n_symbols, n_listed, first = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        doc_ids = np.frombuffer(data, "<i8", docs, _HEAD.size)
        rest = np.frombuffer(data, np.uint8, offset=_HEAD.size + doc_ids.nbytes)
        found = []
        for n in (docs, 2 * n_rules, n_rules, n_listed, n_symbols):
            numbers, read = unpack(rest, n)
            found.append(numbers)
            rest = rest[read:]
        counts, rules, sizes, listed, places = found
        return Block(doc_ids, counts, rules.reshape(-1, 2), sizes, listed[places], first)

    def __post_init__(self):
        self.begin = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.flat, lengths = expansions(self.rules.astype(np.int64), self.first)
        if not np.array_equal(lengths, self.sizes):
            raise ValueError("expansion lengths don't match the rules")
        # terminals stand for themselves: one table of expansions for all symbols
        self.flat = np.concatenate([np.arange(self.first), self.flat]).astype(np.int32)
        self.size_of = np.concatenate([np.ones(self.first, np.int64), lengths])
        self.place = np.cumsum(self.size_of) - self.size_of

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size_of[symbols]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place[symbols] - ends + size, size)]

    def lengths(self) -> np.ndarray:
        """Tokens of each document, from the expansion lengths alone."""
        sums = np.concatenate([[0], np.cumsum(self.size_of[self.symbols])])
        return sums[self.begin[1:]] - sums[self.begin[:-1]]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.begin[i] : self.begin[i + 1]])

    def stretch(self, i: int, start: int, end: int) -> np.ndarray:
        """Tokens [start, end) of document i; only the symbols that hold them are expanded."""
        s = self.symbols[self.begin[i] : self.begin[i + 1]]
        ends = np.cumsum(self.size_of[s])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left")
        skipped = ends[a - 1] if a else 0
        return self.expand(s[a : b + 1])[start - skipped : end - skipped]
