"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct hashed terms (words and their beginnings). The score is
``sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2))``: besides a weight for each term, every
pair of terms interacts through the product of their factor vectors, such as an insult beside a mention
of a group, which additive weights can't tell from either alone.

Fitted on at most MAX_TRAINING_ROWS labelled documents that aren't held out (a hash of the id picks them). Terms are
chosen in two ways: the MAX_TERMS buckets that the labels depend on most, and the buckets of the PAIRS pairs of terms
whose meeting tells more about the label than either of them does, so a term that says nothing alone has its factors
too. Candidates for pairs are the CANDIDATES buckets that divide the documents most evenly. Counts of buckets are added up on the
cluster; only counts of chosen buckets, and for each learned document which of them it has, come to the driver: at
most (MAX_TERMS + CANDIDATES) bits a document, however long its text. The model is of fixed size and goes to the
executors as a broadcast. Scoring is a map over whole texts without a shuffle.

Null and empty texts have no terms and score as the prior; repeated rows score alike, and of texts of one doc_id the
smallest is learned from; rows without a label, or labels without a document, aren't learned from; with no labelled row
at all the score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.llm import hashed
from scenegrid.llm import textkit as K
from scenegrid.llm.store import Scratch
from scenegrid.llm.tables import held_out

MAX_TRAINING_ROWS = 12_000
MAX_TERMS = 1024
CANDIDATES, PAIRS = 1024, 128
#: A chosen term comes in so many documents and is so many standard deviations off; a pair among half a million has to be further off.
LEAST_ROWS, TELLING, PAIR_TELLING = 3, 2.5, 6.0
FACTORS = 8
#: Passes over the training rows; as many more as STEPS batches take.
EPOCHS, STEPS, BATCH = 30, 600, 256
THRESHOLD = 0.3


@dataclass
class Machine:
    slot: np.ndarray  #: per bucket, its term's number or -1
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The score before the sigmoid, from (text number, term number) pairs, each once."""
        linear = np.bincount(doc, self.weight[term], n)
        both = np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            both += np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n)
        return self.bias + linear + both / 2

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, ids = hashed.term_hits(texts)
        term = self.slot[ids]
        hit = np.flatnonzero(term >= 0)
        doc, term = hashed.distinct(doc[hit], term[hit].astype(np.int64), len(self.weight) or 1)
        return sigmoid(self.margins(doc, term, len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bucket_counts(rows: DataFrame, levels: int = 1) -> DataFrame:
    """bucket, seen and n_1 .. n_levels: in how many texts of ``rows`` (label, text) it comes, and in how many whose label is
    that or more. Each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((levels + 1, hashed.BUCKETS), np.int64)
        for batch in batches:
            for part in K.chunks(batch):
                doc, ids = hashed.distinct(*hashed.term_hits(part.column("text")), hashed.BUCKETS)
                label = part.column("label").to_numpy()[doc]
                for level in range(levels + 1):
                    sums[level] += np.bincount(ids[label >= level], minlength=hashed.BUCKETS)
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays(K.arrays(at, *(row[at] for row in sums)), ["bucket", *names])

    names = ["seen", *(f"n_{j}" for j in range(1, levels + 1))]
    found = rows.select("label", "text").mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} bigint" for n in names))
    return found.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).where(F.col("seen") >= LEAST_ROWS)


def telling(level: str, n: int, share: float) -> Column:
    """How far, in standard deviations, the labels of the texts that have a bucket are off the share of all."""
    expected = F.col("seen") * share
    return (F.col(level) - expected) / F.sqrt(expected * (1 - share) * (1 - F.col("seen") / (n + 1)) + 0.5)


def _top(counts: DataFrame, by: Column, limit: int, least: float) -> list[int]:
    """The buckets that are largest by a measure; ties by bucket."""
    best = counts.select("bucket", by.alias("by")).where(F.col("by") > least).orderBy(F.desc("by"), "bucket").limit(limit)
    return [r["bucket"] for r in best.collect()]


def matrix(rows: DataFrame, terms: np.ndarray, dense=None, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels; per document, which terms it has, as 0 and 1; ``dense`` features of its text) of the bounded ``rows`` (label, text), in
    an order that doesn't depend on the tasks'."""
    slot = np.full(hashed.BUCKETS, -1, np.int32)
    slot[terms] = np.arange(len(terms))
    sent = rows.sparkSession.sparkContext.broadcast(slot)
    k = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                doc, ids = hashed.term_hits(part.column("text"))
                has = np.zeros((part.num_rows, k), np.uint8)
                term = sent.value[ids]
                hit = term >= 0
                has[doc[hit], term[hit]] = 1
                more = dense(part.column("text")) if dense else np.zeros((part.num_rows, 0), np.float32)
                bits = [row.tobytes() for row in np.packbits(has, axis=1)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(bits, pa.binary()), pa.array([row.tobytes() for row in more], pa.binary())], ["label", "terms", "dense"])

    found = rows.select("label", "text").mapInArrow(run, "label int, terms binary, dense binary").toArrow().to_pydict()
    each = sorted(zip(found["label"], found["terms"], found["dense"], strict=True))
    packed = np.frombuffer(b"".join(x[1] for x in each), np.uint8).reshape(len(each), -(-k // 8))
    more = np.frombuffer(b"".join(x[2] for x in each), np.float32).reshape(len(each), width)
    return np.array([x[0] for x in each], float), np.unpackbits(packed, axis=1, count=k), more


def pair_terms(x: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, block: int = 2000) -> np.ndarray:
    """The columns of the pairs whose meeting is further off the share of label 1 than what its two terms, each on its own and
    both added up, would have it."""
    n, k = x.shape
    if not n or k < 2 or labels.min() == labels.max():
        return np.zeros(0, np.int64)
    both, positive = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for at in range(0, n, block):
        part = x[at : at + block].astype(np.float32)
        both += part.T @ part
        positive += (part * labels[at : at + block, None].astype(np.float32)).T @ part
    share = float(labels.mean())
    seen = np.maximum(np.diag(both), 1)
    # the share that either term alone gives, and what both would give if they only added up
    lift = np.diag(positive) / seen - share
    alone = np.clip(share + lift[:, None] + lift[None, :], 0.5 / n, 1 - 0.5 / n)
    rate = np.clip(np.maximum(np.maximum(lift[:, None], lift[None, :]) + share, alone), 0.5 / n, 1 - 0.5 / n)
    low = np.clip(np.minimum(np.minimum(lift[:, None], lift[None, :]) + share, alone), 0.5 / n, 1 - 0.5 / n)
    over = (positive - both * rate) / np.sqrt(both * rate * (1 - rate) + 0.5)
    under = (both * low - positive) / np.sqrt(both * low * (1 - low) + 0.5)
    z = np.triu(np.maximum(over, under), 1)
    z[both < LEAST_ROWS] = 0
    i, j = np.nonzero(z > PAIR_TELLING)
    best = np.lexsort((j, i, -z[i, j]))[:pairs]
    return np.unique(np.concatenate([i[best], j[best]]))


def fit(x: np.ndarray, terms: np.ndarray, labels: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 1) -> Machine:
    """Adam on the logistic loss with weight decay. x: which of ``terms`` (buckets) each text has."""
    slot = np.full(hashed.BUCKETS, -1, np.int16)
    slot[terms] = np.arange(len(terms))
    n, k = x.shape
    share = min(max(labels.mean() if n else 0.0, 1e-9), 1 - 1e-9)
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(k), rng.normal(0, 0.05, (k, factors))
    if not n or not k or labels.min() == labels.max():
        return Machine(slot, bias if n else -40.0, w, np.zeros((k, factors)))
    epochs = max(epochs, -(-STEPS * BATCH // n))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1))]
    b, step = np.array([bias]), 0
    for epoch in range(epochs):
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows_of = order[at : at + BATCH]
            xb = x[rows_of].astype(float)
            sums = xb @ v
            margin = b[0] + xb @ w + 0.5 * ((sums**2).sum(1) - (xb @ (v * v)).sum(1))
            g = (sigmoid(margin) - labels[rows_of]) / len(rows_of)
            grads = [xb.T @ g + 1e-4 * w, xb.T @ (g[:, None] * sums) - (xb.T @ g)[:, None] * v + 2e-4 * v, np.array([g.sum()])]
            step += 1
            for p, d, s in zip((w, v, b), grads, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * d
                s[1] = 0.999 * s[1] + 0.001 * d * d
                p -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    return Machine(slot, float(b[0]), w, v)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, label and text of at most ``limit`` labelled documents that aren't held out, one row a doc_id. The chosen labels
    are at most ``limit`` small rows, hence the broadcast: only their texts are shuffled."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_TRAINING_ROWS) -> Machine:
    scratch = Scratch(docs.sparkSession, "labelled")
    rows = scratch.table(labelled(docs, labels, label, limit), "rows")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("label") >= 1).cast("long")), F.lit(0))).first()
    if not n:
        return fit(np.zeros((0, 0), np.uint8), np.zeros(0, np.int64), np.zeros(0))
    counts = scratch.table(bucket_counts(rows), "counts")
    alone = _top(counts, F.abs(telling("n_1", n, positive / n)), MAX_TERMS, TELLING)
    even = _top(counts, (F.col("seen") * (n - F.col("seen"))).cast("double"), CANDIDATES, 0)
    terms = np.unique(np.array(alone + even, np.int64))
    y, x, _ = matrix(rows, terms)
    y = (y >= 1).astype(float)
    scratch.drop("rows", "counts")
    candidates = np.flatnonzero(np.isin(terms, even))
    together = candidates[pair_terms(x[:, candidates], y)]
    keep = np.union1d(np.flatnonzero(np.isin(terms, alone)), together).astype(np.int64)
    return fit(x[:, keep], terms[keep], y)


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """``keep`` columns and the score of every whole text, as column ``into``."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.chunks(batch):
                scores = pa.array(model.value.score(part.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), scores], [*keep, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    read = docs.select(*keep, *([] if "text" in keep else ["text"]))
    return read.mapInArrow(run, f"{schema}, `{into}` double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
