import math
import random

import pytest

from scenegrid.operators import paths

SCHEMA = "path_id bigint, seq bigint, op string, x double, y double"


def walked(commands, pattern, phase):
    """[(subpath, closed or seam, [(x, y), ...])] of the dashes by a plain walk along each subpath."""
    pattern = pattern * 2 if len(pattern) % 2 else pattern
    subpaths, points, start = [], [], None
    for op, x, y in commands:
        if op == "M":
            subpaths.append((points, False))
            points = [(x, y)]
        elif op == "Z":
            subpaths.append((points + [points[0]], True))
            points = [points[0]]
        else:
            points.append((x, y))
    subpaths.append((points, False))
    out = []
    for points, closed in [s for s in subpaths if len(s[0]) > 1 and any(a != b for a, b in zip(s[0], s[0][1:]))]:
        i, left = 0, phase % sum(pattern)
        while left >= pattern[i]:
            left -= pattern[i]
            i = (i + 1) % len(pattern)
        left = pattern[i] - left
        begins_on, runs, run = i % 2 == 0, [], []
        for a, b in zip(points, points[1:]):
            length, at = math.dist(a, b), 0.0
            while length - at > 1e-9:
                take = min(left, length - at)
                if i % 2 == 0:
                    place = lambda s: (a[0] + (b[0] - a[0]) * s / length, a[1] + (b[1] - a[1]) * s / length)  # noqa: B023, E731
                    run.append((place(at), place(at + take)))
                at, left = at + take, left - take
                if left <= 1e-9:
                    if run:
                        runs.append(run)
                        run = []
                    i = (i + 1) % len(pattern)
                    left = pattern[i]
        ends_on = bool(run) or bool(runs) and i % 2 == 1 and abs(left - pattern[i]) < 1e-9
        if run:
            runs.append(run)
        kind = [False] * len(runs)
        if closed and begins_on and ends_on:
            if len(runs) > 1:
                runs = [runs[-1] + runs[0], *runs[1:-1]]
                kind = [False] * len(runs)
            kind[0] = True
        out.append([(k, [tuple(round(v, 6) for p in piece for v in p) for piece in r]) for k, r in zip(kind, runs)])
    return out


@pytest.mark.parametrize(("pattern", "phase"), [([5.0, 3.0], 0.0), ([4.0], 2.5), ([7.0, 1.0, 2.0], -3.0), ([1000.0, 1.0], 0.0), ([3.0, 500.0], 1.0)])
def test_equal_to_a_plain_walk(spark, pattern, phase):
    rng = random.Random(len(pattern))
    all_paths = {0: [("M", 0.0, 0.0), ("L", 10.0, 0.0), ("L", 10.0, 6.0), ("L", 0.0, 6.0), ("Z", 0.0, 0.0)], 1: [("M", 0.0, 0.0), ("L", 0.0, 0.0), ("L", 0.0, 20.0), ("M", 5.0, 5.0)], 2: [("M", 1.0, 1.0)]}
    for i in range(3, 30):
        c = []
        for k in range(rng.randint(2, 12)):
            op = "M" if not k else rng.choice("LLLLMZ") if c[-1][0] == "L" else "L"
            c.append((op, float(rng.randint(0, 40)), float(rng.randint(0, 40))))
        all_paths[i] = c
    rows = [(i, s, *c) for i, cs in all_paths.items() for s, c in enumerate(cs)]
    got = {}
    for r in paths.dashes_along(spark.createDataFrame(rows, SCHEMA), pattern, phase).orderBy("path_id", "subpath", "dash", "piece").collect():
        dashes = got.setdefault(r.path_id, {}).setdefault(r.subpath, {})
        kind, pieces = dashes.setdefault(r.dash, (r.closed or r.seam, []))
        assert r.piece == len(pieces) + 1
        pieces.append(tuple(round(v, 6) for v in (r.x0, r.y0, r.x1, r.y1)))
    for i, c in all_paths.items():
        want = [w for w in walked(c, pattern, phase) if w]
        assert [list(d.values()) for _, d in sorted(got.get(i, {}).items())] == [[(k, p) for k, p in w] for w in want], (i, c)


def test_bad_patterns(spark):
    for pattern in ([], [1.0, 0.0], [-1.0]):
        with pytest.raises(ValueError, match="positive"):
            paths.dashes_along(spark.createDataFrame([], SCHEMA), pattern)
