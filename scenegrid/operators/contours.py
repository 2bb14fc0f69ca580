"""Operators over closed integer contours: hulls, probes, relations to boxes, encodings. Signs are exact on integers.

Contours are tables of path_id, seq, x, y, closed from the last point to the first. Edges of one contour meet
each other by path_id, so a contour costs the square of its own edges and no contour meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.operators.paths import area2, convexity, turns, winding
from scenegrid.operators.rules import ring

#: Halvings of the probes of ``fill_rules``, as in its SQL.
HALVINGS = 6


def _side(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    return f"signum(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def _sides(p: tuple[str, ...], q: tuple[str, ...]) -> tuple[str, str]:
    """Products of the signs of the ends of each segment about the other; a segment: x, y, nx, ny."""
    return tuple(f"{_side(*s, t[0], t[1])} * {_side(*s, t[2], t[3])}" for s, t in ((p, q), (q, p)))


def _meet(p: tuple[str, ...], q: tuple[str, ...]) -> Column:
    """Whether closed segments have a point in common."""
    boxes = " AND ".join(f"greatest({p[i]}, {p[i + 2]}) >= least({q[i]}, {q[i + 2]}) AND greatest({q[i]}, {q[i + 2]}) >= least({p[i]}, {p[i + 2]})" for i in (0, 1))
    a, b = _sides(p, q)
    return F.expr(f"{boxes} AND {a} <= 0 AND {b} <= 0")


def _cross(p: tuple[str, ...], q: tuple[str, ...]) -> Column:
    """Whether segments cross properly."""
    a, b = _sides(p, q)
    return F.expr(f"{a} < 0 AND {b} < 0")


def _of(alias: str) -> tuple[str, ...]:
    return tuple(f"{alias}.{c}" for c in ("x", "y", "nx", "ny"))


def convex_hull(points: DataFrame) -> DataFrame:
    """path_id, place, x, y: the corners of the hull, without points inside an edge. A chain is a fold over the sorted
    points of one contour: the corners that a new point makes reflex are the last of the chain."""

    def turn(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def chain(p: Column) -> Column:
        none = F.array().cast("array<struct<x:bigint,y:bigint>>")
        return F.aggregate(p, none, lambda s, q: F.concat(F.filter(s, lambda v, i: (i == 0) | (turn(F.get(s, i - 1), v, q) > 0)), F.array(q)))

    sets = points.groupBy("path_id").agg(F.sort_array(F.collect_set(F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))).alias("p"))
    chains = sets.select("path_id", "p", chain(F.col("p")).alias("low"), chain(F.reverse("p")).alias("high"))
    cut = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    hull = F.when(F.size("p") <= 2, F.col("p")).otherwise(F.concat(cut(F.col("low")), cut(F.col("high"))))
    return chains.select("path_id", F.posexplode(hull).alias("place", "v")).select("path_id", "place", "v.x", "v.y")


def crossings(points: DataFrame) -> DataFrame:
    """path_id, a_seq, b_seq of edges that cross properly."""
    e = ring(points)
    near = (F.col("a.path_id") == F.col("b.path_id")) & F.expr("a.seq + 1 < b.seq")
    return e.alias("a").join(e.alias("b"), near & _cross(_of("a"), _of("b"))).select("a.path_id", F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"))


def domains(points: DataFrame) -> DataFrame:
    """path_id and domain: transverse if edges cross properly, contact if edges that aren't neighbours touch, isolated otherwise."""
    e = ring(points)
    last = e.groupBy("path_id").agg(F.max("seq").alias("last"))
    far = e.alias("a").join(e.alias("b"), F.expr("a.path_id = b.path_id AND a.seq + 1 < b.seq")).join(last.alias("l"), F.expr("a.path_id = l.path_id")).where("NOT (a.seq = 1 AND b.seq = last)")
    found = far.groupBy("a.path_id").agg(F.bool_or(_cross(_of("a"), _of("b"))).alias("crossed"), F.bool_or(_meet(_of("a"), _of("b"))).alias("touched"))
    return last.select("path_id").join(found, "path_id", "left").select("path_id", F.when(F.col("crossed"), "transverse").when(F.col("touched"), "contact").otherwise("isolated").alias("domain"))


def side_probes(points: DataFrame) -> DataFrame:
    """path_id, seq, x, y, nx, ny, halvings: how often the distance of the probes at both sides of an edge's middle is halved
    until no other edge lies between; null if the middle is on another edge, as no probe is then free. The distance begins at one over the larger
    extent, times the normal. Seen from the middle, in halves, another edge runs from p to q; s is along the edge and h along its normal. It meets the
    normal at a distance of apart / over, so the halvings are the binary digits of the whole part of over / (extent * apart): 64 bits hold
    all numbers exactly for coordinates under 2 ** 29, and larger ones fail."""
    e = ring(points).where("x <> nx OR y <> ny")
    pair = e.alias("a").join(e.alias("b"), "path_id").select("path_id", "a.seq", "a.x", "a.y", "a.nx", "a.ny", F.expr("(a.x = b.x AND a.y = b.y AND a.nx = b.nx AND a.ny = b.ny) OR (a.x = b.nx AND a.y = b.ny AND a.nx = b.x AND a.ny = b.y)").alias("same"), *[F.expr(f"2 * b.{n}{c} - a.{c} - a.n{c}").alias(f"{'q' if n else 'p'}{c}") for n in ("", "n") for c in "xy"])
    pair = pair.withColumns({"dx": F.expr("nx - x"), "dy": F.expr("ny - y")})
    pair = pair.withColumns({f"{to}{end}": F.expr(f"dx * {end}{u} {sign} dy * {end}{v}") for to, u, sign, v in (("s", "x", "+", "y"), ("h", "y", "-", "x")) for end in "pq"})
    pair = pair.withColumns({
        "met": F.expr("NOT same AND signum(sp) * signum(sq) <= 0"),
        "apart": F.expr("CASE WHEN sp <> sq THEN abs(px * qy - py * qx) WHEN signum(hp) * signum(hq) <= 0 THEN 0 ELSE least(abs(hp), abs(hq)) END"),
        "over": F.expr("2 * CASE WHEN sp <> sq THEN abs(sp - sq) ELSE dx * dx + dy * dy END"),
    })
    ratio = pair.withColumn("ratio", F.expr("over div greatest(abs(dx), abs(dy)) div nullif(apart, 0)"))
    k = F.when(F.col("met"), F.expr("CASE WHEN ratio = 0 THEN 0 ELSE length(bin(ratio)) END"))
    free = F.when(~F.bool_or(F.expr("met AND apart = 0")), F.coalesce(F.max(k), F.lit(0)))
    return ratio.groupBy("path_id", "seq", "x", "y", "nx", "ny").agg(free.alias("halvings"))


def fill_rules(points: DataFrame) -> DataFrame:
    """path_id and code: equal if the contour is simple (both fill rules then agree), differ if a point beside an edge's middle has
    an even winding number other than 0, undecided otherwise. Edges whose probes are halved more than HALVINGS times prove nothing."""
    scale = F.expr("greatest(abs(nx - x), abs(ny - y)) * shiftleft(1L, halvings)")
    near = side_probes(points).where(F.col("halvings") <= HALVINGS).withColumn("s", scale).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    probes = near.select("path_id", (F.col("seq") * F.col("sign")).alias("probe_id"), (F.col("s") * 2).alias("by"), F.expr("(x + nx) * s - sign * 2 * (ny - y)").alias("px"), F.expr("(y + ny) * s + sign * 2 * (nx - x)").alias("py"))
    # each probe has a scale of its own, at which it and all corners are integers
    edges = ring(points).join(probes, "path_id").withColumns({c: F.col(c) * F.col("by") for c in ("x", "y", "nx", "ny")})
    around = edges.groupBy("path_id", "probe_id").agg(F.sum(turns()).alias("winding"))
    even = around.groupBy("path_id").agg(F.bool_or((F.col("winding") != 0) & (F.col("winding") % 2 == 0)).alias("even"))
    code = F.when(F.col("even"), "differ").when(F.col("domain") == "isolated", "equal").otherwise("undecided")
    return domains(points).join(even, "path_id", "left").select("path_id", code.alias("code"))


def box_relation(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """path_id and relation of a box (path_id, x0, y0, x1, y1; even extents) to the fill of its contour: inside or outside if no edge
    comes to it, by the winding number of its centre; undecided otherwise."""
    e = ring(points).join(boxes, "path_id")
    corners = ", ".join(_side("x", "y", "nx", "ny", *c) for c in (("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1")))
    apart = f"greatest(x, nx) < x0 OR least(x, nx) > x1 OR greatest(y, ny) < y0 OR least(y, ny) > y1 OR least({corners}) > 0 OR greatest({corners}) < 0"
    touched = e.groupBy("path_id").agg(F.bool_or(F.expr(f"NOT ({apart})")).alias("touched"))
    centre = winding(points, boxes.selectExpr("path_id", "0L AS probe_id", "(x0 + x1) div 2 AS px", "(y0 + y1) div 2 AS py"))
    code = F.when(F.col("touched"), "undecided").when(F.col("winding") != 0, "inside").otherwise("outside")
    return touched.join(centre, "path_id").select("path_id", code.alias("relation"))


def half_planes(points: DataFrame) -> DataFrame:
    """path_id, seq, a, b, c of convex contours: a x + b y + c >= 0 for points on the inner side of an edge."""
    turned = convexity(points).where("orientation <> 0")
    side = lambda e: F.expr(f"orientation * ({e})")
    return ring(points).join(turned, "path_id").select("path_id", "seq", side("y - ny").alias("a"), side("nx - x").alias("b"), side("x * ny - nx * y").alias("c"))


def grid_encoding(points: DataFrame, step: int) -> DataFrame:
    """path_id, worst, code of contours put on a grid, half up: the largest error, and whether the same edges cross and the area keeps its sign."""
    put = lambda c: (F.floor((F.col(c) * 2 + step) / (2 * step)) * step).alias(c)
    coded = points.select("path_id", "seq", put("x"), put("y"))
    both = points.alias("p").join(coded.alias("q"), ["path_id", "seq"])
    worst = both.groupBy("path_id").agg(F.max(F.expr("greatest(abs(p.x - q.x), abs(p.y - q.y))")).alias("worst"))
    key = ["path_id", "a_seq", "b_seq"]
    before, after = crossings(points), crossings(coded)
    changed = before.join(after, key, "left_anti").union(after.join(before, key, "left_anti")).select("path_id").distinct().withColumn("changed", F.lit(True))
    signs = area2(points).alias("p").join(area2(coded).alias("q"), "path_id").select("path_id", F.expr("signum(p.area2) <> signum(q.area2)").alias("turned"))
    code = F.when(F.col("changed"), "topology").when(F.col("turned"), "area").otherwise("ok")
    return worst.join(signs, "path_id").join(changed, "path_id", "left").select("path_id", "worst", code.alias("code"))


def closed_under(points: DataFrame, m: tuple[int, ...]) -> DataFrame:
    """Contours under a matrix of six integers, with the first point once more at the end unless it is there."""
    a, b, c, d, e, f = m
    moved = points.select("path_id", "seq", F.expr(f"{a} * x + {c} * y + {e}").alias("x"), F.expr(f"{b} * x + {d} * y + {f}").alias("y"))
    ends = moved.groupBy("path_id").agg(F.max("seq").alias("last"), F.min_by(F.struct("x", "y"), "seq").alias("first"), F.max_by(F.struct("x", "y"), "seq").alias("final"))
    return moved.union(ends.where("first <> final").select("path_id", F.col("last") + 1, "first.x", "first.y"))
