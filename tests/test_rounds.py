"""Operators that work in rounds, against one step after another."""

import random

import pytest

from scenegrid.operators import graph, layout, raster, relations, rules


def placed(labels, boxes, n=4):
    """{label: (place, x, y)} by going through the labels in order."""
    meets = lambda a, b: a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
    done, out = {}, {}
    for scene, i, x, y, w, h in sorted(labels, key=lambda r: r[1]):
        taken = done.setdefault(scene, [b[1:] for b in boxes if b[0] == scene])
        spots = [(k, x + 30 * k, y - 25 * k) for k in range(n)]
        pick = next((s for s in spots if not any(meets((s[1], s[2], w, h), t) for t in taken)), None)
        out[i] = pick or (None, None, None)
        if pick:
            taken.append((pick[1], pick[2], w, h))
    return out


LABELS, BOXES = "scene_id bigint, label_id bigint, x double, y double, width double, height double", "scene_id bigint, x double, y double, width double, height double"


@pytest.mark.parametrize("side", [120, 500])
def test_labels_are_placed_as_in_order(spark, side):
    r = random.Random(side)
    labels = [(i % 2, i, float(r.randint(0, side)), float(r.randint(0, side)), float(r.randint(10, 60)), float(r.randint(8, 20))) for i in range(80)]
    boxes = [(i % 2, float(r.randint(0, side)), float(r.randint(0, side)), float(r.randint(1, 150)), float(r.randint(1, 40))) for i in range(14)]
    found = layout.label_places(spark.createDataFrame(labels, LABELS), spark.createDataFrame(boxes, BOXES)).collect()
    assert {x.label_id: (x.place, x.x, x.y) for x in found} == placed(labels, boxes)


def test_two_labels_never_overlap(spark):
    labels = [(1, 1, 0.0, 0.0, 40.0, 15.0), (1, 2, 5.0, 5.0, 40.0, 15.0), (2, 3, 0.0, 0.0, 40.0, 15.0)] + [(3, 10 + i, 0.0, 0.0, 40.0, 15.0) for i in range(6)]
    none = spark.createDataFrame([], BOXES)
    found = {r.label_id: r.place for r in layout.label_places(spark.createDataFrame(labels, LABELS), none).collect()}
    assert found == {1: 0, 2: 1, 3: 0, 10: 0, 11: 1, 12: 2, 13: 3, 14: None, 15: None}
    assert layout.label_places(spark.createDataFrame([], LABELS), none).collect() == []


def folded(costs, budget):
    used, taken = 0.0, 0
    for c in costs:
        if c is not None and c >= 0 and used + c <= budget:
            used, taken = used + c, taken + 1
    return taken, len(costs) - taken, used


def test_budget_equals_the_fold(spark):
    r = random.Random(2)
    scenes = {i: [float(r.choice((0, 1, 2, 5, 30, 90, 100, 101, 400))) for _ in range(r.randint(1, 60))] for i in range(40)}
    scenes[100] = [float(r.randint(0, 99)) for _ in range(20_000)]  # a scene with most of the rows
    scenes[101] = [99.5 - i / 2 if i % 2 else 0.5 for i in range(60)]
    scenes[102], scenes[103], scenes[104] = [500.0, 600.0], [None, -5.0, 50.0, 50.0, 0.0, 1.0], [100.0]
    rows = [(s, i, c) for s, cs in scenes.items() for i, c in enumerate(cs)]
    table = spark.createDataFrame(rows, "s bigint, i bigint, c double")
    for size in (0, 30, 10_000, 1_000_000):  # all by rounds, some, the largest, none
        found = rules.greedy_budget(table, "s", "i", "c", 100.0, folded=size).collect()
        assert {x.s: (x.n_taken, x.n_skipped, x.used) for x in found} == {s: folded(c, 100.0) for s, c in scenes.items()}


def flooded(pixels):
    left, out = set(pixels), []
    while left:
        todo = [left.pop()]
        part = list(todo)
        while todo:
            x, y = todo.pop()
            near = [p for p in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) if p in left]
            left.difference_update(near)
            part += near
            todo += near
        xs, ys = [p[0] for p in part], [p[1] for p in part]
        out.append((min(xs), min(ys), max(xs), max(ys), len(part)))
    return sorted(out)


def test_components_equal_a_flood_fill(spark):
    r = random.Random(3)
    images = {i: {(x, y) for x in range(30) for y in range(30) if r.random() < share} for i, share in enumerate((0.1, 0.3, 0.4, 0.6))}
    images[10] = {(x, 0) for x in range(300)} | {(x, 1) for x in range(0, 300, 2)} | {(x, 3) for x in range(63, 66)} | {(62, 4), (66, 4), (128, 5), (127, 6)}
    spiral, x, y, dx, dy = set(), 0, 0, 1, 0
    for n in range(40, 0, -2):
        for _ in range(2):
            for _ in range(n):
                spiral.add((x, y))
                x, y = x + dx, y + dy
            dx, dy = -dy, dx
    images[11] = spiral
    images[12] = {(0, y) for y in range(400)}
    rows = [(i, x, y) for i, ps in images.items() for x, y in ps] + [(12, 0, 7)]
    mask = spark.createDataFrame(rows, "image_id bigint, x bigint, y bigint")
    got = {}
    for p in raster.components(mask).collect():
        got.setdefault(p.image_id, []).append((p.left, p.top, p.right, p.bottom, p.area))
    assert {i: sorted(ps) for i, ps in got.items()} == {i: flooded(ps) for i, ps in images.items()}
    assert raster.components(mask.where("image_id = 10"), 200).count() == 1 and raster.components(mask.limit(0)).collect() == []


def test_graph_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5), (7, 9), (9, 7)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {v: root(v) for v in parent}


def embedded(w, f, tolerance):
    """Places of the earliest matching."""
    out, at = [], 0
    for v in w:
        while at < len(f) and abs(f[at] - v) > tolerance:
            at += 1
        if at == len(f):
            return out
        out.append(at)
        at += 1
    return out


def test_ordered_matches_with_ties(spark):
    r = random.Random(5)
    cases = {}
    for s in range(60):
        f = [float(r.randint(0, 4)) for _ in range(r.randint(1, 12))]
        cases[s] = ([v for v in f if r.random() < 0.5] if s % 3 else [float(r.randint(0, 4)) for _ in range(4)]) or [0.0], f
    cases[100] = ([float(i % 7) for i in range(3000)], [float(i % 7) for i in range(4000)])
    rows = lambda k: spark.createDataFrame([(s, i, v) for s, c in cases.items() for i, v in enumerate(c[k])], "s bigint, place bigint, value double")
    got = {x.s: (x.n, x.n_matched, x.unique) for x in layout.match_in_order(rows(0), rows(1), "s", 0.1).collect()}
    for s, (w, f) in cases.items():
        early, late = embedded(w, f, 0.1), embedded(w[::-1], f[::-1], 0.1)
        assert got[s] == (len(w), len(early), len(early) == len(w) and early == [len(f) - 1 - j for j in late][::-1])


def test_only_pairs_of_two_kinds(spark):
    rows = [(1, i, float(i), 0.0, 10.0, 10.0) for i in range(6)]
    boxes = spark.createDataFrame(rows, "scene_id bigint, object_id bigint, x double, y double, width double, height double")
    from pyspark.sql import functions as F

    odd = relations.overlaps(boxes, only=F.col("p.object_id") % 2 != F.col("q.object_id") % 2).collect()
    assert {(r.a_id, r.b_id) for r in odd} == {(a, b) for a in range(6) for b in range(a + 1, 6) if (a + b) % 2}
