"""Hashed terms of texts, as the classifiers use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scenegrid.llm import textkit as K

BITS = 20
BUCKETS = 1 << BITS
#: Beginnings of terms, in bytes, that count as terms of their own: inflected forms share them.
PREFIXES = (5, 6, 7, 8)


def bucket(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def distinct(doc: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, id) once, by text."""
    key = np.unique(doc * size + ids)
    return key // size, key % size


def term_hits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every lower-case term and of its beginnings; a pair may come again."""
    w = K.words(pc.utf8_lower(texts), K.NOT_TERM)
    sums = K.byte_sums(w.raw)
    docs, ids = [w.doc], [bucket(w.hash)]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        docs.append(w.doc[long])
        ids.append(bucket(K.byte_spans(sums, w.start[long], w.start[long] + k) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(ids)
