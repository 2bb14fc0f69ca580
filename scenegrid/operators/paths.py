"""Operators over tables of path commands: parsing, bounds, areas, winding, flattening, dashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.operators.rules import ring

def write_lines(commands: DataFrame) -> DataFrame:
    """path_id and path data of M and L commands in order."""
    step = F.transform(F.sort_array(F.collect_list(F.struct("seq", "op", "x", "y"))), lambda c: F.concat(c["op"], c["x"].cast("string"), F.lit(","), c["y"].cast("string")))
    return commands.groupBy("path_id").agg(F.array_join(step, " ").alias("data"))


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("path_id").agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"), F.count("*").alias("n"))


def area2(points: DataFrame) -> DataFrame:
    """Twice the signed area of each ring, exact on integers."""
    return ring(points).groupBy("path_id").agg(F.sum(F.expr("x * ny - nx * y")).alias("area2"))


def turns() -> Column:
    """What an edge (x, y, nx, ny) adds to the winding number of (px, py)."""
    side = F.expr("(nx - x) * (py - y) - (px - x) * (ny - y)")
    return F.when(F.expr("y <= py AND ny > py") & (side > 0), 1).when(F.expr("y > py AND ny <= py") & (side < 0), -1).otherwise(0)


def winding(points: DataFrame, probes: DataFrame) -> DataFrame:
    """path_id, probe_id and winding number of the probes of each path (joined by path_id): signed crossings of the
    ray to the right, exact on integers."""
    return ring(points).join(probes, "path_id").groupBy("path_id", "probe_id").agg(F.sum(turns()).alias("winding"))


def edge_multiplicity(points: DataFrame) -> DataFrame:
    """Signed count of each undirected edge; edges that cancel are gone."""
    e = ring(points).where("x <> nx OR y <> ny")
    forward = F.expr("x < nx OR (x = nx AND y < ny)")
    end = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return e.groupBy("path_id", end("x", "nx").alias("ax"), end("y", "ny").alias("ay"), end("nx", "x").alias("bx"), end("ny", "y").alias("by")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("m")).where("m <> 0")


def convexity(points: DataFrame) -> DataFrame:
    """1 or -1 for rings that turn one way only, 0 otherwise: exact signs, no tolerance."""
    e = ring(points)
    w = Window.partitionBy("path_id").orderBy("seq")
    head = Window.partitionBy("path_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    nn = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(head))
    turned = e.withColumns({"nnx": nn("nx"), "nny": nn("ny")}).withColumn("turn", F.signum(F.expr("(nx - x) * (nny - ny) - (ny - y) * (nnx - nx)")))
    return turned.groupBy("path_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n")).select("path_id", F.when((F.col("lo") == F.col("hi")) & (F.col("n") > 2), F.col("lo")).otherwise(0).cast("long").alias("orientation"))


def dashes(segments: DataFrame, on: float, off: float) -> DataFrame:
    """Dashes of axis-parallel or slanted segments of scene_id, segment_id, x1, y1, x2, y2: each starts anew."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / (on + off)).cast("int") - 1)))
    cut = segments.withColumn("length", length).where("length > 0").withColumn("k", at)
    begin = F.col("k") * (on + off)
    end = F.least(begin + on, F.col("length"))
    place = lambda a, b, s: F.col(a) + (F.col(b) - F.col(a)) * s / F.col("length")
    return cut.select("scene_id", "segment_id", F.col("k").cast("long").alias("k"), place("x1", "x2", begin).alias("x1"), place("y1", "y2", begin).alias("y1"), place("x1", "x2", end).alias("x2"), place("y1", "y2", end).alias("y2"))


def dashes(segments: DataFrame, on: float, off: float) -> DataFrame:
    """Dashes of axis-parallel or slanted segments of scene_id, segment_id, x1, y1, x2, y2: each starts anew."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / (on + off)).cast("int") - 1)))
    cut = segments.withColumn("length", length).where("length > 0").withColumn("k", at)
    begin = F.col("k") * (on + off)
    end = F.least(begin + on, F.col("length"))
    place = lambda a, b, s: F.col(a) + (F.col(b) - F.col(a)) * s / F.col("length")
    return cut.select("scene_id", "segment_id", F.col("k").cast("long").alias("k"), place("x1", "x2", begin).alias("x1"), place("y1", "y2", begin).alias("y1"), place("x1", "x2", end).alias("x2"), place("y1", "y2", end).alias("y2"))


def edges(lines: DataFrame) -> DataFrame:
    """Edges of M, L and Z commands (path_id, seq, op, x, y; after a Z a subpath begins at the same start): path_id, subpath, seq, x0, y0, x1, y1, closed, the distances from_s and
    to_s along the subpath, and total. Edges of no length are left out."""
    order = Window.partitionBy("path_id").orderBy("seq")
    head = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("op").over(order)
    rows = lines.withColumn("begins", (F.col("op") == "M") | (before == "Z") | before.isNull())
    rows = rows.withColumns({"subpath": F.sum(F.col("begins").cast("int")).over(head).cast("long"), **{f"s{a}": F.last(F.when(F.col("op") == "M", F.col(a)), ignorenulls=True).over(head) for a in "xy"}})
    rows = rows.withColumns({f"{a}1": F.when(F.col("op") == "Z", F.col(f"s{a}")).otherwise(F.col(a)) for a in "xy"})
    own = Window.partitionBy("path_id", "subpath")
    e = rows.withColumns({**{f"{a}0": F.lag(f"{a}1").over(order) for a in "xy"}, "closed": F.max(F.col("op") == "Z").over(own)}).where("op <> 'M'")
    e = e.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("length > 0")
    to = F.sum("length").over(own.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumns({"to_s": to, "total": F.sum("length").over(own)}).select("path_id", "subpath", "seq", "x0", "y0", "x1", "y1", "closed", (F.col("to_s") - F.col("length")).alias("from_s"), "to_s", "total")


def dashes_along(lines: DataFrame, pattern: list[float], phase: float = 0.0) -> DataFrame:
    """Dashes of whole subpaths: path_id, subpath, dash, piece (from 1, along the dash), x0, y0, x1, y1, from_s, to_s, closed (the dash is all of a closed subpath) and seam (it runs over
    the point where a closed subpath begins). A dash goes on around corners; the pattern, doubled where it is odd, begins ``phase`` into itself at every subpath. Each edge finds the marks
    over it from its distances along the subpath, so the cost is the edges and the pieces. Curves are flattened before (``path_data.flatten``)."""
    if not pattern or min(pattern) <= 0:
        raise ValueError("dash lengths must be positive")
    whole = pattern if len(pattern) % 2 == 0 else pattern * 2
    starts = [sum(whole[:i]) for i in range(len(whole) + 1)]
    cycle, marks = starts[-1], len(whole) // 2
    phase %= cycle
    on = F.array(*[F.struct(F.lit(i).cast("long").alias("j"), F.lit(float(starts[2 * i])).alias("a"), F.lit(float(starts[2 * i + 1])).alias("b")) for i in range(marks)])
    turn = lambda s: F.floor((F.col(s) + phase) / cycle)
    rows = edges(lines).withColumn("n", F.explode(F.sequence(turn("from_s"), turn("to_s")))).withColumn("m", F.explode(on))
    mark = lambda c: F.col("n") * cycle + F.col(f"m.{c}") - phase
    rows = rows.withColumns({"u": F.greatest("from_s", mark("a")), "v": F.least("to_s", mark("b")), "dash": F.col("n") * marks + F.col("m.j")})
    # rounding must leave no dash where two marks meet
    slack = 1e-9 * F.greatest(F.lit(1.0), F.col("total"))
    rows = rows.where(F.col("v") - F.col("u") > slack)
    own = Window.partitionBy("path_id", "subpath")
    rows = rows.withColumns({"first": F.min("dash").over(own), "final": F.max("dash").over(own), "begun": F.min("u").over(own), "ended": F.max("v").over(own)})
    meets = F.col("closed") & (F.col("begun") <= 0) & (F.col("ended") >= F.col("total") - slack)
    late = meets & (F.col("dash") == F.col("final")) & (F.col("first") < F.col("final"))
    rows = rows.withColumns({"joined": meets & F.col("dash").isin(F.col("first"), F.col("final")), "late": late, "dash": F.when(late, F.col("first")).otherwise(F.col("dash"))})
    piece = F.row_number().over(Window.partitionBy("path_id", "subpath", "dash").orderBy(F.desc("late"), "u"))
    part = lambda s, a: F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * (F.col(s) - F.col("from_s")) / (F.col("to_s") - F.col("from_s"))
    out = rows.withColumns({"piece": piece.cast("long"), "number": F.dense_rank().over(own.orderBy("dash")).cast("long"), "px": part("u", "x"), "py": part("u", "y"), "qx": part("v", "x"), "qy": part("v", "y")})
    alone = F.col("joined") & (F.col("first") == F.col("final"))
    return out.select("path_id", "subpath", F.col("number").alias("dash"), "piece", F.col("px").alias("x0"), F.col("py").alias("y0"), F.col("qx").alias("x1"), F.col("qy").alias("y1"), F.col("u").alias("from_s"), F.col("v").alias("to_s"), alone.alias("closed"), (F.col("joined") & ~alone).alias("seam"))


def native_markup(commands: DataFrame) -> DataFrame:
    """path_id and markup of an integer path: a moveTo, then lnTo."""
    point = F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "x", "y"))),
        lambda c, i: F.concat(F.when(i == 0, "<a:moveTo>").otherwise("<a:lnTo>"), F.lit('<a:pt x="'), c["x"], F.lit('" y="'), c["y"], F.lit('"/>'), F.when(i == 0, "</a:moveTo>").otherwise("</a:lnTo>")),
    )
    return commands.groupBy("path_id").agg(F.concat(F.lit("<a:path>"), F.array_join(point, ""), F.lit("</a:path>")).alias("xml"))


def decode_native(paths: DataFrame, xml: str) -> DataFrame:
    """Commands of integer paths; where a coordinate of a path doesn't fit 32 bits none of it is read."""
    marks = F.regexp_extract_all(xml, F.lit(r'<a:(moveTo|lnTo)><a:pt x="(-?[0-9]+)" y="(-?[0-9]+)"/>'), 0)
    number = lambda m, a: F.regexp_extract(m, f'{a}="(-?[0-9]+)"', 1).cast("long")
    points = F.transform(marks, lambda m: F.struct(F.regexp_extract(m, "<a:([A-Za-z]+)>", 1).alias("op"), number(m, "x").alias("x"), number(m, "y").alias("y")))
    wide = F.exists("p", lambda p: (F.abs(p["x"]) > 2**31 - 1) | (F.abs(p["y"]) > 2**31 - 1))
    rows = paths.select("path_id", points.alias("p")).select("path_id", wide.alias("wide"), F.posexplode("p").alias("i", "p"))
    keep = lambda c: F.when(~F.col("wide"), F.col(f"p.{c}")).alias(c)
    return rows.select("path_id", (F.col("i") + 1).cast("long").alias("seq"), "p.op", keep("x"), keep("y"), F.when(F.col("wide"), "range").otherwise("ok").alias("code"))
