import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenegrid.llm import clustering


def brute(rows, k=8, rounds=10, dim=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) in plain integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = assign()
    inertia = [sum(d for d, c in own if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, own, strict=True)), key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int") if not hasattr(rows, "schema") else rows
    out = clustering.cluster_vectors(df, **more)
    assert dict(out.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    return sorted((tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def vectors(seed, n, spread, dim=64, around=6):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(around, dim))
    return [(i, [float(np.float32(x)) for x in middle[i % around] + spread * r.normal(size=dim)], 0) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_equals_brute_force(spark, spread):
    rows = vectors(1, 160, spread)
    assert found(spark, rows) == brute([(i, v) for i, v, _ in rows])


def test_rows_that_arent_vectors(spark):
    rows = vectors(2, 30, 0.4)
    rows += [(100, None, 0), (101, [], 0), (102, [1.0] * 63, 0), (103, [1.0] * 65, 0), (104, [None] + [1.0] * 63, 0), (105, [float("nan")] * 64, 0), (106, [float("inf")] + [0.0] * 63, 0), (107, [-0.0005] * 64, 0), (108, [3e38] * 64, 0), (None, [0.25] * 64, 0), (3, rows[3][1], 0), (3, rows[4][1], 0)]
    assert found(spark, rows) == brute([(i, v) for i, v, _ in rows if i != 108])


def test_ties_and_equal_vectors(spark):
    """On a coarse grid most distances are equal, and many vectors are the same."""
    r = np.random.default_rng(3)
    rows = [(i, [float(x) / 1024 for x in r.integers(0, 2, 4)] * 16, 0) for i in range(200)] + [(1000 + i, [0.5] * 64, 0) for i in range(200)]
    assert found(spark, rows) == brute([(i, v) for i, v, _ in rows])


def test_few_vectors_and_none(spark):
    rows = vectors(4, 3, 1.0)
    for n in (1, 2, 3):
        assert found(spark, rows[:n]) == brute([(i, v) for i, v, _ in rows[:n]])
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert found(spark, empty) == []
    assert found(spark, [(1, [1.0], 0)]) == []


def test_other_sizes_and_columns(spark):
    rows = vectors(5, 90, 1.0, dim=5)
    want = brute([(i, v) for i, v, _ in rows], k=20, rounds=4, dim=5)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("v", "key", "cluster", "moved", "upper", "was")})
    assert found(spark, df, k=20, rounds=4, dim=5) == want
    assert found(spark, df, k=20, rounds=4, dim=5, bounds=1) == want


def test_bounds_spare_most_distances():
    """Bounds must certify, not only be right: of far fewer vectors than all every distance is measured."""
    r = np.random.default_rng(6)
    v = (1024 * (r.normal(size=(12, 64))[np.arange(3000) % 12] + 0.2 * r.normal(size=(3000, 64)))).astype(np.int64)
    c = v[:12] + 5
    state = clustering.measure(v, c, 3)
    total = 0
    for _ in range(6):
        after = np.stack([v[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(12)])
        *state, measured = clustering.reassign(v, *state, after, clustering._above(clustering.squared(after, c)))
        total += measured
        c = after
        d2 = clustering.to_all(v, c)
        assert (state[0] == d2.argmin(1)).all()
        lower = np.take_along_axis(d2, state[2], 1)
        assert (state[3] ** 2 <= lower + 1e-3).all() and (state[1] ** 2 >= d2.min(1) - 1e-3).all()
    assert total < 0.3 * 6 * v.shape[0] * 12
