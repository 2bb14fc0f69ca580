"""Quality by ordinal cumulative-link regression on graded ratings.

``P(grade <= j) = sigmoid(threshold_j - x.w)``: one weight vector over hashed text is shared by all
grades and the thresholds are kept in order, so grades differ only by where they cut the same line. A
text gets its expected grade and, for selection, the tail probability of the grade wanted or better.

Features of a text: its distinct hashed terms (as in ``hashed``) that the grades depend on most; the
hashed shapes of its words ("Aa," "A!!" "a%") by the root of their share; and the shares of
5-word windows that come again and of words equal to the word before.

Fitted on at most MAX_TRAINING_ROWS rated documents that aren't held out; grades outside the scale count as its
nearest end. Terms are chosen from counts that are added up on the cluster. Scoring is a map over whole texts; the
model is of fixed size. Null and empty texts have no features and get what the thresholds alone
give; repeated rows score alike; without any rated row every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.llm import hashed
from scenegrid.llm import textkit as K
from scenegrid.llm.store import Scratch
from scenegrid.llm.tables import held_out
from scenegrid.llm.toxicity import BATCH, EPOCHS, STEPS, TELLING, _top, bucket_counts, labelled, matrix, sigmoid, telling

MAX_TRAINING_ROWS = 12_000
SHAPE_BITS = 9
SHAPES = 1 << SHAPE_BITS
EXTRA = 2
GRADES = 3
#: Terms that are chosen for each step of the scale.
LEVEL_TERMS = 512
#: Select documents that reach this grade with at least this probability.
SELECT_GRADE, SELECT_TAIL = 1, 0.5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n x SHAPES shares of word shapes, share of repeated windows, share of words equal to the one before)."""
    w = K.words(texts)
    n = w.n_docs
    counts = np.maximum(w.counts, 1)
    out = np.zeros((n, SHAPES))
    repeated, same = np.zeros(n), np.zeros(n)
    if not len(w.hash):
        return out, repeated, same
    kinds = _CLASS[w.raw]
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[w.start] = True
    # runs of a class count once: hash the classes with repeats left out
    at = np.cumsum(new) - 1
    ids = hashed.bucket(K.byte_spans(K.byte_sums(kinds[new]), at[w.start], at[w.end - 1] + 1), SHAPE_BITS)
    out += np.bincount(w.doc * SHAPES + ids, minlength=n * SHAPES).reshape(n, SHAPES) / counts[:, None]
    d, _, times = K.bags(*K.shingles(w))
    repeated = np.bincount(d, np.where(times > 1, times, 0), n) / counts
    same = np.bincount(w.doc[1:], (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]), n) / counts
    return np.sqrt(out), repeated, same


@dataclass
class Ordinal:
    slot: np.ndarray  #: per bucket, its term's number or -1
    weight: np.ndarray  #: terms, then shapes, then the two shares
    thresholds: np.ndarray

    @property
    def n_terms(self) -> int:
        return len(self.weight) - SHAPES - EXTRA

    def line(self, texts: pa.Array) -> np.ndarray:
        n, k = len(texts), self.n_terms
        doc, ids = hashed.term_hits(texts)
        term = self.slot[ids]
        hit = np.flatnonzero(term >= 0)
        doc, term = hashed.distinct(doc[hit], term[hit].astype(np.int64), k or 1)
        share, repeated, same = shapes(texts)
        return np.bincount(doc, self.weight[term], n) + share @ self.weight[k:-EXTRA] + repeated * self.weight[-2] + same * self.weight[-1]

    def tails(self, line: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return sigmoid(line[:, None] - self.thresholds)


def fit(x: np.ndarray, terms: np.ndarray, grades: np.ndarray, *, n_grades: int = GRADES, epochs: int = EPOCHS, seed: int = 1) -> Ordinal:
    """Adam on the ordinal log loss. x: which of ``terms`` (buckets) each text has, then shapes and shares; grades: 0 to n_grades-1."""
    slot = np.full(hashed.BUCKETS, -1, np.int16)
    n = len(x)
    if not n:
        return Ordinal(slot, np.zeros(SHAPES + EXTRA), np.full(n_grades - 1, 40.0) + np.arange(n_grades - 1))
    slot[terms] = np.arange(len(terms))
    grades = np.clip(grades, 0, n_grades - 1)
    above = np.array([np.clip((grades >= j).mean(), 1e-3, 1 - 1e-3) for j in range(1, n_grades)])
    cuts = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    w, low, steps = np.zeros(x.shape[1]), np.array([cuts[0]]), gaps
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, low, steps)]
    epochs = max(epochs, -(-STEPS * BATCH // n))
    rng, t = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        rate = 0.03 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            i = order[at : at + BATCH]
            xb, y = x[i], grades[i].astype(int)
            th = np.concatenate([low, low + np.cumsum(np.exp(steps))])
            edges = np.concatenate([[-1e3], th, [1e3]])
            f = xb @ w
            hi, lo = sigmoid(edges[y + 1] - f), sigmoid(edges[y] - f)
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p / len(i), lo * (1 - lo) / p / len(i)  # of log p, by the edges
            dth = np.array([dlo[y == j + 1].sum() - dhi[y == j].sum() for j in range(n_grades - 1)])
            grads = [xb.T @ (dhi - dlo) + 1e-4 * w, np.array([dth.sum()]), np.exp(steps) * np.cumsum(dth[::-1])[::-1][1:]]
            t += 1
            for q, d, s in zip((w, low, steps), grads, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * d
                s[1] = 0.999 * s[1] + 0.001 * d * d
                q -= rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)
    return Ordinal(slot, w, np.concatenate([low, low + np.cumsum(np.exp(steps))]))


def _dense(texts: pa.Array) -> np.ndarray:
    return np.column_stack(shapes(texts)).astype(np.float32)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 poor, 1 good but toxic, 2 good. An unknown toxicity counts as none. One scale for use as
    training text: a good text that can't be used as it is stands between the two ends."""
    good = F.when(F.coalesce("toxic", F.lit(0)) >= 1, 1).otherwise(2)
    return labels.select("doc_id", F.when(F.col("quality") >= 1, good).when(F.col("quality").isNotNull(), 0).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, limit: int = MAX_TRAINING_ROWS, n_grades: int = GRADES) -> Ordinal:
    """ratings: doc_id, grade."""
    scratch = Scratch(docs.sparkSession, "rated")
    rows = labelled(docs, ratings, "grade", limit).withColumn("label", F.greatest(F.lit(0), F.least(F.col("label"), F.lit(n_grades - 1))))
    rows = scratch.table(rows, "rows")
    levels = range(1, n_grades)
    n, *above = rows.agg(F.count("*"), *(F.count_if(F.col("label") >= j) for j in levels)).first()
    if not n:
        return fit(np.zeros((0, 0)), np.zeros(0, np.int64), np.zeros(0), n_grades=n_grades)
    counts = scratch.table(bucket_counts(rows, n_grades - 1), "counts")
    chosen = [_top(counts, F.abs(telling(f"n_{j}", n, above[j - 1] / n)), LEVEL_TERMS, TELLING) for j in levels]
    terms = np.unique(np.array([b for row in chosen for b in row], np.int64))
    y, x, dense = matrix(rows, terms, _dense, SHAPES + EXTRA)
    scratch.drop("rows", "counts")
    return fit(np.concatenate([x.astype(np.float32), dense], 1), terms, y, n_grades=n_grades)


def score(docs: DataFrame, model: Ordinal, grade: int = SELECT_GRADE, tail: float = SELECT_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of ``grade`` or better) and selected, for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                tails = sent.value.tails(sent.value.line(part.column("text")))
                yield pa.RecordBatch.from_arrays(K.arrays(part.column("doc_id"), tails.sum(1), tails[:, grade - 1]), ["doc_id", "expected_grade", "tail_probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double")
    return scored.withColumns({"held_out": held_out(), "selected": F.col("tail_probability") >= tail})


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, graded(labels)))
