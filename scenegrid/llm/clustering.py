"""Centroid clustering in integers with adaptive bounds.

Vectors are integers, floor(SCALE * x) of each component, so distances, means and ties are exact. Each vector keeps upper bounds on its distance from
its centroid, lower bounds on its distances from the BOUNDS centroids that come next, and one lower bound on all the rest. When
centroids move, bounds move by as much. A vector whose upper bound is below every lower bound stays where it is, unread; else its own
distance is taken anew; if then the bounds from some place on lie above it, only the centroids before that place are measured and put into order; and where
no place can be certified all centroids are measured. Bounds are doubles with a margin for rounding and certify only strictly,
so the result, ties by the smaller number included, is that of measuring everything.

A round is one map over the table of vectors and bounds, which is written anew, and one sum over those vectors that changed their centroid,
read by that column: what they add to one cluster and take from another. Only k * dim sums come to the driver, and k centroids go out with
the tasks. Tables lie in the shared folder; the one before is deleted.

Kept are vectors of exactly ``dim`` components, none null, NaN or infinite; a component beyond 2**17 in size counts as not finite, as its square wouldn't fit a long.
Rows of one vec_id are vectors of their own; a null id comes last in the choice of first centroids. Fewer vectors than k give as many centroids; no vector gives an empty
result. Equal vectors may be several first centroids: the smaller number takes all. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.llm.store import Scratch

SCALE = 1024
LARGEST = 1 << 17
BOUNDS = 3
#: Relative margin of bounds: many times the rounding of a square root and of one addition a round.
MARGIN = 1e-12


def integer_vectors(vectors: DataFrame, dim: int, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """key and v (array of long) of the vectors that are kept."""
    v = F.col(values).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return vectors.where((F.size(values) == dim) & fit).select(F.col(key).alias("key"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v from the rows of c (as many, or one each)."""
    d = v - c
    return np.einsum("...i,...i->...", d, d)


def to_all(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([squared(v, c) for c in centroids], axis=1)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)


def measure(v: np.ndarray, centroids: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, next, lower, rest) from all distances."""
    d2 = to_all(v, centroids)
    order = np.argsort(d2, axis=1, kind="stable")
    sorted_ = np.take_along_axis(d2, order, axis=1)
    rest = _below(sorted_[:, bounds + 1]) if len(centroids) > bounds + 1 else np.full(len(v), np.inf)
    return order[:, 0], _above(sorted_[:, 0]), order[:, 1 : bounds + 1], _below(sorted_[:, 1 : bounds + 1]), rest


def reassign(v, cluster, upper, near, lower, rest, centroids, moved) -> tuple[np.ndarray, ...]:
    """The state after centroids moved by ``moved`` (upper bounds of the distances), and how many distances were measured."""
    n, b = near.shape
    cluster, upper, near, lower, rest = cluster.copy(), upper + moved[cluster], near.copy(), lower - moved[near], rest - moved.max(initial=0.0)
    # the least bound from each place on; the last is that of the rest
    tail = np.minimum.accumulate(np.concatenate([lower, rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    open_ = np.flatnonzero(upper >= tail[:, 0])
    measured = len(open_)
    upper[open_] = _above(squared(v[open_], centroids[cluster[open_]]))
    open_ = open_[upper[open_] >= tail[open_, 0]]
    # the first place from which on every bound lies above; b + 1: none
    certified = tail[open_] > upper[open_][:, None]
    place = np.where(certified.any(axis=1), certified.argmax(axis=1), b + 1)
    for p in range(1, b + 1):
        rows = open_[place == p]
        if not len(rows):
            continue
        some = np.concatenate([cluster[rows][:, None], near[rows, :p]], axis=1)
        d2 = np.stack([squared(v[rows], centroids[some[:, i]]) for i in range(p + 1)], axis=1)
        measured += d2.size
        order = np.lexsort((some, d2), axis=1)
        some, d2 = np.take_along_axis(some, order, axis=1), np.take_along_axis(d2, order, axis=1)
        cluster[rows], upper[rows], near[rows, :p], lower[rows, :p] = some[:, 0], _above(d2[:, 0]), some[:, 1:], _below(d2[:, 1:])
    rows = open_[place == b + 1]
    if len(rows):
        measured += len(rows) * len(centroids)
        cluster[rows], upper[rows], near[rows], lower[rows], rest[rows] = measure(v[rows], centroids, b)
    return cluster, upper, near, lower, rest, measured


def _matrix(column: pa.Array, rows: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.reshape(-1), kind))


def _round(state: DataFrame, kind: str, centroids: np.ndarray, before: np.ndarray | None, bounds: int) -> DataFrame:
    """The state of every vector under ``centroids``; ``before``: the ones of the last round, None in the first."""
    moved = None if before is None else _above(squared(centroids, before))

    def step(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), b.num_rows, np.int64)
            if moved is None:
                was = np.full(b.num_rows, -1, np.int64)
                cluster, upper, near, lower, rest = measure(v, centroids, bounds)
                measured = len(v) * len(centroids)
            else:
                was = b.column("cluster").to_numpy().astype(np.int64)
                args = (b.column("upper").to_numpy(), _matrix(b.column("near"), b.num_rows, np.int64), _matrix(b.column("lower"), b.num_rows, np.float64), b.column("rest").to_numpy())
                cluster, upper, near, lower, rest, measured = reassign(v, was, *args, centroids, moved)
            counted = np.zeros(b.num_rows, np.int64)
            counted[0] = measured
            columns = [b.column("key"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(was != cluster), pa.array(upper), _lists(near, pa.int32()), _lists(lower, pa.float64()), pa.array(rest), pa.array(counted)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "v", "cluster", "was", "moved", "upper", "near", "lower", "rest", "measured"])

    return state.mapInArrow(step, f"key {kind}, v array<bigint>, cluster int, was int, moved boolean, upper double, near array<int>, lower array<double>, rest double, measured bigint")


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the last round adds to the sums and to the counts of each cluster."""

    def add(batches):
        sums = np.zeros((k, dim + 1), np.int64)
        for b in batches:
            if b.num_rows:
                v = np.concatenate([_matrix(b.column("v"), b.num_rows, np.int64), np.ones((b.num_rows, 1), np.int64)], axis=1)
                now, was = b.column("cluster").to_numpy(), b.column("was").to_numpy()
                np.add.at(sums, now, v)
                np.subtract.at(sums, was[was >= 0], v[was >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), _lists(sums, pa.int64())], ["cluster", "sums"])

    parts = state.where("moved").select("cluster", "was", "v").mapInArrow(add, "cluster bigint, sums array<bigint>")
    total = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((k, dim + 1), np.int64)
    for r in total.collect():
        out[r.cluster, r.at] = r.x
    return out[:, :dim], out[:, dim]


def centroid_digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3", bounds: int = BOUNDS, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    scratch = Scratch(vectors.sparkSession, "clusters")
    kind = vectors.schema[key].dataType.simpleString()
    state = scratch.table(integer_vectors(vectors, dim, key, values), "round--1")
    centroids, before = first_centroids(state, k, seed), None
    k = len(centroids)
    if not k:
        return state.select(F.col("key").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    bounds = min(bounds, k - 1)
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for i in range(rounds + 1):
        state = scratch.table(_round(state, kind, centroids, before, bounds), f"round-{i}")
        scratch.drop(f"round-{i - 1}")
        if i < rounds:
            more, counted = _changes(state, k, dim)
            sums, counts = sums + more, counts + counted
            before, centroids = centroids, np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)

    def distances(batches):
        for b in batches:
            v = _matrix(b.column("v"), b.num_rows, np.int64) if b.num_rows else np.zeros((0, dim), np.int64)
            d2 = squared(v, centroids[b.column("cluster").to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("cluster"), pa.array(d2)], ["key", "cluster", "distance"])

    found = scratch.table(state.select("key", "cluster", "v").mapInArrow(distances, f"key {kind}, cluster int, distance bigint"), "distances")
    scratch.drop(f"round-{rounds}")
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a cluster
    of_cluster = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    return found.select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        of_cluster([inertia.get(i, 0) for i in range(k)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster([centroid_digest(c) for c in centroids]).alias("centroid_sha256"),
    )
