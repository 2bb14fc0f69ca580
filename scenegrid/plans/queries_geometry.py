"""Queries over paths, boxes, texts and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrid.functions import geometry, scalar
from scenegrid.operators import path_data, paths, raster, text
from scenegrid.operators.rules import ring
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_RING = ", r AS (SELECT path_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM commands WINDOW w AS (PARTITION BY path_id ORDER BY seq))"


@query(cte("commands") + " SELECT path_id, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, count(*) AS n FROM commands GROUP BY path_id")
def path_bounds(spark, sf_dir):
    """A1 (lines), A5: bounds of paths."""
    return paths.bounds(fixture(spark, sf_dir, "commands"))


_CURVES = "SELECT p_partkey AS id, (p_partkey * 37 % 1000)::DOUBLE AS p0, (p_partkey * 91 % 1000)::DOUBLE AS p1, (p_partkey * 53 % 1000)::DOUBLE AS p2, (p_size * 20)::DOUBLE AS p3 FROM part"


def _curves(spark, sf_dir):
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "double(p_partkey * 37 % 1000) AS p0", "double(p_partkey * 91 % 1000) AS p1", "double(p_partkey * 53 % 1000) AS p2", "double(p_size * 20) AS p3")


@query(
    f"""WITH c AS ({_CURVES}), d AS (SELECT *, -p0 + 3 * p1 - 3 * p2 + p3 AS a, 2 * (p0 - 2 * p1 + p2) AS b, p1 - p0 AS g FROM c),
t AS (SELECT *, unnest(CASE WHEN abs(a) < 1e-12 THEN CASE WHEN abs(b) < 1e-12 THEN [0.0] ELSE [-g / b] END WHEN b * b - 4 * a * g < 0 THEN [0.0] ELSE [(-b - sqrt(b * b - 4 * a * g)) / (2 * a), (-b + sqrt(b * b - 4 * a * g)) / (2 * a)] END) AS t FROM d),
v AS (SELECT id, p0, p3, CASE WHEN t > 0 AND t < 1 THEN (1 - t) ** 3 * p0 + 3 * (1 - t) ** 2 * t * p1 + 3 * (1 - t) * t ** 2 * p2 + t ** 3 * p3 END AS e FROM t)
SELECT id, round(min(least(p0, p3, coalesce(e, p0))), 6) AS low, round(max(greatest(p0, p3, coalesce(e, p0))), 6) AS high FROM v GROUP BY id"""
)
def cubic_bounds(spark, sf_dir):
    """A1, A2: the range of a cubic from the roots of its derivative."""
    low, high = geometry.cubic_range(*(F.col(f"p{i}") for i in range(4)))
    return _curves(spark, sf_dir).select("id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"WITH c AS ({_CURVES}) SELECT id, least(p0, p1, p2, p3) AS low, greatest(least(p0, p1, p2, p3) + 0.01, greatest(p0, p1, p2, p3)) AS high FROM c")
def hull_bounds(spark, sf_dir):
    """A3, A4: the range of the control points, never empty."""
    p = [F.col(f"p{i}") for i in range(4)]
    return _curves(spark, sf_dir).select("id", F.least(*p).alias("low"), F.greatest(F.least(*p) + 0.01, F.greatest(*p)).alias("high"))


@query(f"WITH c AS ({_CURVES}), t AS (SELECT id, k, k / 16.0::DOUBLE AS t, p0, p1, p2, p3 FROM c, (SELECT unnest(range(0, 17)) AS k)) SELECT id, k, round((1 - t) ** 3 * p0 + 3 * (1 - t) ** 2 * t * p1 + 3 * (1 - t) * t ** 2 * p2 + t ** 3 * p3, 6) AS v FROM t")
def flatten_curves(spark, sf_dir):
    """Curves as chords at even parameters."""
    t = F.col("k") / F.lit(16.0)
    k = F.explode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: i.cast("long")))
    return _curves(spark, sf_dir).withColumn("k", k).select("id", "k", F.round(geometry.cubic(*(F.col(f"p{i}") for i in range(4)), t), 6).alias("v"))


@query(cte("commands") + _RING + " SELECT path_id, sum(x * ny - nx * y)::BIGINT AS area2 FROM r GROUP BY path_id")
def shoelace(spark, sf_dir):
    """Exact signed areas."""
    return paths.area2(fixture(spark, sf_dir, "commands"))


@query(
    f"WITH c AS ({_CURVES}), d AS (SELECT id, p0 AS x0, p1 AS y0, p1 AS x1, p2 AS y1, p2 AS x2, p3 AS y2, p3 AS x3, p0 AS y3 FROM c) SELECT id, round((3 * ((x1 * y2 - x2 * y1) + 2 * (x0 * y1 - x1 * y0) + (x0 * y2 - x2 * y0) + (x1 * y3 - x3 * y1) + 2 * (x2 * y3 - x3 * y2)) + (x0 * y3 - x3 * y0)) / 20, 4) AS area FROM d"
)
def contour_integral(spark, sf_dir):
    """The signed area that a cubic sweeps from the origin, in closed form."""
    x, y = [F.col(f"p{i}") for i in range(4)], [F.col(f"p{(i + 1) % 4}") for i in range(4)]
    c = lambda i, j: x[i] * y[j] - x[j] * y[i]
    area = (3 * (c(1, 2) + 2 * c(0, 1) + c(0, 2) + c(1, 3) + 2 * c(2, 3)) + c(0, 3)) / 20
    return _curves(spark, sf_dir).select("id", F.round(area, 4).alias("area"))


@query(
    cte("commands")
    + _RING
    + ", e AS (SELECT path_id, x < nx OR (x = nx AND y < ny) AS f, * EXCLUDE (path_id) FROM r WHERE x <> nx OR y <> ny) SELECT path_id, CASE WHEN f THEN x ELSE nx END AS ax, CASE WHEN f THEN y ELSE ny END AS ay, CASE WHEN f THEN nx ELSE x END AS bx, CASE WHEN f THEN ny ELSE y END AS by, sum(CASE WHEN f THEN 1 ELSE -1 END)::BIGINT AS m FROM e GROUP BY ALL HAVING m <> 0"
)
def edge_multiplicity(spark, sf_dir):
    """Signed multiplicities of edges; cancelled ones are gone."""
    return paths.edge_multiplicity(fixture(spark, sf_dir, "commands"))


@query(
    cte("commands")
    + _RING
    + ", q AS (SELECT path_id, k AS probe_id, k * 230 + 20 AS px, (path_id * 7 + k * 131) % 900 AS py FROM (SELECT DISTINCT path_id FROM commands), (SELECT unnest(range(0, 4)) AS k)) SELECT path_id, probe_id, sum(CASE WHEN y <= py AND ny > py AND (nx - x) * (py - y) - (px - x) * (ny - y) > 0 THEN 1 WHEN y > py AND ny <= py AND (nx - x) * (py - y) - (px - x) * (ny - y) < 0 THEN -1 ELSE 0 END)::BIGINT AS winding FROM r JOIN q USING (path_id) GROUP BY ALL"
)
def winding_numbers(spark, sf_dir):
    """Winding numbers of probes."""
    points = fixture(spark, sf_dir, "commands")
    probes = points.select("path_id").distinct().withColumn("probe_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return paths.winding(points, probes.selectExpr("path_id", "probe_id", "probe_id * 230 + 20 AS px", "(path_id * 7 + probe_id * 131) % 900 AS py"))


@query(
    cte("commands")
    + _RING
    + ", s AS (SELECT path_id, sign((nx - x) * (coalesce(lead(ny) OVER w, first_value(ny) OVER w) - ny) - (ny - y) * (coalesce(lead(nx) OVER w, first_value(nx) OVER w) - nx)) AS turn FROM r WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, (CASE WHEN min(turn) = max(turn) AND count(*) > 2 THEN min(turn) ELSE 0 END)::BIGINT AS orientation FROM s GROUP BY path_id"
)
def convex_orientation(spark, sf_dir):
    """Rings that turn one way only."""
    return paths.convexity(fixture(spark, sf_dir, "commands"))


@query(
    cte("commands")
    + _RING
    + """ SELECT a.path_id, a.seq AS a_seq, b.seq AS b_seq FROM r a JOIN r b ON a.path_id = b.path_id AND a.seq + 1 < b.seq
 AND ((a.nx - a.x) * (b.y - a.y) - (a.ny - a.y) * (b.x - a.x)) * ((a.nx - a.x) * (b.ny - a.y) - (a.ny - a.y) * (b.nx - a.x)) < 0
 AND ((b.nx - b.x) * (a.y - b.y) - (b.ny - b.y) * (a.x - b.x)) * ((b.nx - b.x) * (a.ny - b.y) - (b.ny - b.y) * (a.nx - b.x)) < 0"""
)
def self_crossings(spark, sf_dir):
    """Proper crossings of edges of one ring, by exact signs."""
    e = ring(fixture(spark, sf_dir, "commands"))
    a, b = e.alias("a"), e.alias("b")
    side = lambda p, q, o: f"signum(({p}.nx - {p}.x) * ({q}.{o}y - {p}.y) - ({p}.ny - {p}.y) * ({q}.{o}x - {p}.x))"
    proper = F.expr(f"{side('a', 'b', '')} * {side('a', 'b', 'n')} < 0 AND {side('b', 'a', '')} * {side('b', 'a', 'n')} < 0")
    return a.join(b, (F.col("a.path_id") == F.col("b.path_id")) & F.expr("a.seq + 1 < b.seq") & proper).select("a.path_id", F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"))


@query(
    cte("commands")
    + ", l AS (SELECT path_id, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny, count(*) AS n, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM (SELECT path_id, x // 250 AS x, y // 250 AS y, seq FROM commands WHERE seq <= 4) GROUP BY path_id), j AS (SELECT path_id, count(*) AS bad FROM (SELECT path_id, seq, x // 250 AS x, y // 250 AS y, coalesce(lead(x // 250) OVER w, first_value(x // 250) OVER w) AS qx, coalesce(lead(y // 250) OVER w, first_value(y // 250) OVER w) AS qy FROM commands WHERE seq <= 4 WINDOW w AS (PARTITION BY path_id ORDER BY seq)) WHERE (x = qx) = (y = qy) GROUP BY path_id) SELECT path_id, n = 4 AND nx = 2 AND ny = 2 AND bad IS NULL AS is_rectangle FROM l LEFT JOIN j USING (path_id)"
)
def rectangle_paths(spark, sf_dir):
    """Paths that are one upright rectangle, not only their bounds."""
    p = fixture(spark, sf_dir, "commands").where("seq <= 4").selectExpr("path_id", "seq", "x div 250 AS x", "y div 250 AS y")
    slanted = F.expr("(x = nx) = (y = ny)")
    g = ring(p).groupBy("path_id").agg(F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"), F.count("*").alias("n"), F.bool_or(slanted).alias("bad"))
    return g.select("path_id", F.expr("n = 4 AND kx = 2 AND ky = 2 AND NOT bad").alias("is_rectangle"))


@query(cte("boxes") + " SELECT scene_id, group_id, max(x) AS x0, max(y) AS y0, min(x + width + 400) AS x1, min(y + height + 400) AS y1, max(x) < min(x + width + 400) AND max(y) < min(y + height + 400) AS visible FROM boxes GROUP BY ALL")
def effective_clip(spark, sf_dir):
    """The rectangle that all clips of a group leave."""
    g = fixture(spark, sf_dir, "boxes").groupBy("scene_id", "group_id").agg(F.max("x").alias("x0"), F.max("y").alias("y0"), F.min(F.expr("x + width + 400")).alias("x1"), F.min(F.expr("y + height + 400")).alias("y1"))
    return g.withColumn("visible", F.expr("x0 < x1 AND y0 < y1"))


@query(cte("boxes") + " SELECT a.object_id, bool_or(a.x + a.width / 2 > b.x AND a.x + a.width / 2 < b.x + b.width * 8 AND a.y + a.height / 2 > b.y AND a.y + a.height / 2 < b.y + b.height * 8) AS inside, count(*) AS n FROM boxes a JOIN boxes b ON a.scene_id = b.scene_id AND b.kind = 'image' GROUP BY a.object_id")
def clip_membership(spark, sf_dir):
    """Whether a paint's centre lies in the union of the clips of its scene."""
    boxes = fixture(spark, sf_dir, "boxes")
    clips = boxes.where("kind = 'image'").select("scene_id", F.struct("x", "y", "width", "height").alias("c"))
    inside = F.expr("x + width / 2 > c.x AND x + width / 2 < c.x + c.width * 8 AND y + height / 2 > c.y AND y + height / 2 < c.y + c.height * 8")
    return boxes.join(clips, "scene_id").groupBy("object_id").agg(F.bool_or(inside).alias("inside"), F.count("*").alias("n"))


@query(
    cte("boxes")
    + " SELECT object_id, floor(x + width / 2 - (width * abs(cos(radians(rotation))) + height * abs(sin(radians(rotation)))) / 2 - 2 * stroke_width + 1e-6)::BIGINT AS \"left\", floor(y + height / 2 - (width * abs(sin(radians(rotation))) + height * abs(cos(radians(rotation)))) / 2 - 2 * stroke_width + 1e-6)::BIGINT AS top, ceil(x + width / 2 + (width * abs(cos(radians(rotation))) + height * abs(sin(radians(rotation)))) / 2 + 2 * stroke_width - 1e-6)::BIGINT AS \"right\", ceil(y + height / 2 + (width * abs(sin(radians(rotation))) + height * abs(cos(radians(rotation)))) / 2 + 2 * stroke_width - 1e-6)::BIGINT AS bottom FROM boxes"
)
def visual_bounds(spark, sf_dir):
    """Rotated boxes with their strokes, outward to integers."""
    b = fixture(spark, sf_dir, "boxes")
    hull = geometry.rotated_hull(*(F.col(c) for c in ("x", "y", "width", "height", "rotation")))
    reach = geometry.stroke_reach(F.col("stroke_width"), F.lit("butt"), F.lit("miter"), F.lit(4.0))
    low = [F.floor(hull[c] - reach + 1e-6).alias(c) for c in ("left", "top")]
    return b.select("object_id", *low, *[F.ceil(hull[c] + reach - 1e-6).alias(c) for c in ("right", "bottom")])


@query(cte("boxes") + " SELECT object_id, round(least(x, x + width) * 2 + 5, 9) AS \"left\", round(3 * y - x - width + 7, 9) AS top, round((x + width) * 2 + 5, 9) AS \"right\", round(3 * (y + height) - x + 7, 9) AS bottom FROM boxes")
def affine_boxes(spark, sf_dir):
    """Hulls of boxes under a matrix."""
    m = [F.lit(float(v)) for v in (2, -1, 0, 3, 5, 7)]
    hull = geometry.box_under(m, *(F.col(c) for c in ("x", "y", "width", "height")))
    return fixture(spark, sf_dir, "boxes").select("object_id", *[F.round(c, 9).alias(n) for n, c in hull.items()])


@query(
    cte("boxes")
    + ", a AS (SELECT *, CASE WHEN rotation = 90 OR rotation = 270 THEN 0 WHEN rotation = 0 THEN 1 WHEN rotation = 180 THEN -1 ELSE cos(radians(rotation)) END AS dx, CASE WHEN rotation = 0 OR rotation = 180 THEN 0 WHEN rotation = 90 THEN 1 WHEN rotation = 270 THEN -1 ELSE sin(radians(rotation)) END AS dy FROM boxes) SELECT object_id, round(x + width / 2 - dx * (abs(dx) * width + abs(dy) * height) / 2, 6) AS ax, round(y + height / 2 - dy * (abs(dx) * width + abs(dy) * height) / 2, 6) AS ay, round(x + width / 2 + dx * (abs(dx) * width + abs(dy) * height) / 2, 6) AS bx, round(y + height / 2 + dy * (abs(dx) * width + abs(dy) * height) / 2, 6) AS by FROM a"
)
def gradient_axes(spark, sf_dir):
    """Axes of linear gradients."""
    axis = geometry.gradient_axis(F.col("rotation"), *(F.col(c) for c in ("x", "y", "width", "height")))
    return fixture(spark, sf_dir, "boxes").select("object_id", *[F.round(c, 6).alias(n) for n, c in axis.items()])


@query(
    cte("boxes")
    + " SELECT object_id, round(CASE WHEN width * width + height * height = 0 THEN 0 ELSE sqrt((500 - (x + t * width)) ** 2 + (400 - (y + t * height)) ** 2) END, 6) AS distance FROM (SELECT *, greatest(0, least(1, ((500 - x) * width + (400 - y) * height) / (width * width + height * height))) AS t FROM boxes)"
)
def point_distances(spark, sf_dir):
    """Distances of a point from segments."""
    d = geometry.point_segment(F.lit(500.0), F.lit(400.0), F.col("x"), F.col("y"), F.expr("x + width"), F.expr("y + height"))
    return fixture(spark, sf_dir, "boxes").select("object_id", F.round(d, 6).alias("distance"))


@query(
    cte("boxes")
    + ", s AS (SELECT scene_id, object_id AS segment_id, x AS x1, y AS y1, x + width AS x2, y AS y2, width AS l FROM boxes), k AS (SELECT *, unnest(range(0, greatest(1, ceil(l / 12)::BIGINT))) AS k FROM s WHERE l > 0) SELECT scene_id, segment_id, k, round(x1 + k * 12, 6) AS x1, y1, round(x1 + least(k * 12 + 6, l), 6) AS x2, y2 FROM k"
)
def dash_segments(spark, sf_dir):
    """E24 (straight lines), E25, Z27: dashes of six on, six off."""
    s = fixture(spark, sf_dir, "boxes").selectExpr("scene_id", "object_id AS segment_id", "x AS x1", "y AS y1", "x + width AS x2", "y AS y2")
    return paths.dashes(s, 6.0, 6.0).withColumns({"x1": F.round("x1", 6), "x2": F.round("x2", 6)})


@query(cte("boxes") + " SELECT object_id, CASE WHEN x + width <= 300 OR x >= 700 OR y + stroke_width / 2 <= 200 OR y - stroke_width / 2 >= 800 THEN 'outside' WHEN x >= 300 AND x + width <= 700 AND y - stroke_width / 2 >= 200 AND y + stroke_width / 2 <= 800 THEN 'inside' ELSE 'cut' END AS code, greatest(x, 300) AS from_x, least(x + width, 700) AS to_x FROM boxes WHERE stroke_width > 0")
def butt_stroke_clip(spark, sf_dir):
    """Level butt strokes against a rectangle, by intervals."""
    s = fixture(spark, sf_dir, "boxes").where("stroke_width > 0")
    code = F.expr("CASE WHEN x + width <= 300 OR x >= 700 OR y + stroke_width / 2 <= 200 OR y - stroke_width / 2 >= 800 THEN 'outside' WHEN x >= 300 AND x + width <= 700 AND y - stroke_width / 2 >= 200 AND y + stroke_width / 2 <= 800 THEN 'inside' ELSE 'cut' END")
    return s.select("object_id", code.alias("code"), F.greatest("x", F.lit(300.0)).alias("from_x"), F.least(F.expr("x + width"), F.lit(700.0)).alias("to_x"))


@query(cte("boxes") + " SELECT object_id, floor(x * 1.37 * 9525 + 0.5)::BIGINT AS x, floor(y * 1.37 * 9525 + 0.5)::BIGINT AS y, floor(width * 1.37 * 9525 + 0.5)::BIGINT AS w, floor(height * 1.37 * 9525 + 0.5)::BIGINT AS h, floor(stroke_width * 1.37 * 9525 + 0.5)::BIGINT AS line FROM boxes")
def scaled_shapes(spark, sf_dir):
    """Shapes scaled alike, in EMU."""
    b = fixture(spark, sf_dir, "boxes")
    return b.select("object_id", *[scalar.emu(F.col(c) * 1.37).alias(n) for c, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"), ("stroke_width", "line"))])


@query(
    cte("edges", "boxes")
    + """ SELECT edge_id, CASE WHEN route = 'straight' THEN 'straight' WHEN from_site IN ('left', 'right') AND to_site IN ('left', 'right') THEN 'bent3' WHEN from_site IN ('left', 'right') OR to_site IN ('left', 'right') THEN 'bent2' ELSE 'bent4' END AS preset, CASE WHEN b.x >= a.x + a.width THEN 'right' WHEN b.x + b.width <= a.x THEN 'left' WHEN b.y >= a.y + a.height THEN 'bottom' ELSE 'top' END AS port
FROM edges JOIN boxes a ON a.object_id = from_id JOIN boxes b ON b.object_id = to_id"""
)
def connector_presets(spark, sf_dir):
    """The preset of a connector and the port that faces its other end."""
    box = F.struct("x", "y", "width", "height")
    boxes = fixture(spark, sf_dir, "boxes")
    e = fixture(spark, sf_dir, "edges").join(boxes.select(F.col("object_id").alias("from_id"), box.alias("a")), "from_id").join(boxes.select(F.col("object_id").alias("to_id"), box.alias("b")), "to_id")
    level = lambda c: F.col(c).isin("left", "right")
    preset = F.when(F.col("route") == "straight", "straight").when(level("from_site") & level("to_site"), "bent3").when(level("from_site") | level("to_site"), "bent2").otherwise("bent4")
    port = F.expr("CASE WHEN b.x >= a.x + a.width THEN 'right' WHEN b.x + b.width <= a.x THEN 'left' WHEN b.y >= a.y + a.height THEN 'bottom' ELSE 'top' END")
    return e.select("edge_id", preset.alias("preset"), port.alias("port"))


@query(
    cte("commands")
    + " SELECT path_id, seq, CASE WHEN seq % 4 = 1 THEN 'M' ELSE 'L' END AS op, x::DOUBLE AS x, y::DOUBLE AS y FROM commands"
)
def path_round_trip(spark, sf_dir):
    """Paths written as path data and parsed back."""
    c = fixture(spark, sf_dir, "commands").withColumn("op", F.expr("CASE WHEN seq % 4 = 1 THEN 'M' ELSE 'L' END"))
    return path_data.parse_lines(paths.write_lines(c), "data")


@query(
    """SELECT p_partkey AS path_id, k AS seq, ['M', 'L', 'L', 'L', 'Z'][k] AS op, (p_size + [0, 10, 10, 0, 0][k])::DOUBLE AS x, (p_partkey % 50 + [0, 0, 5, 5, 0][k])::DOUBLE AS y FROM part, (SELECT unnest(range(1, 6)) AS k)"""
)
def shape_paths(spark, sf_dir):
    """Rectangles as relative path data, parsed."""
    data = F.concat(F.lit("M"), F.col("p_size").cast("string"), F.lit(" "), F.expr("string(p_partkey % 50)"), F.lit("h10v5h-10z"))
    return path_data.parse_lines(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path_id"), data.alias("data")), "data")


@query("SELECT p_partkey AS id, round(least(640 / (p_size + 10.0), 480 / (p_size % 7 + 5.0)), 9)::DOUBLE AS a, round((640 - (p_size + 10) * least(640 / (p_size + 10.0), 480 / (p_size % 7 + 5.0))) * CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END, 6)::DOUBLE AS e FROM part")
def view_boxes(spark, sf_dir):
    """viewBox and alignment as a matrix."""
    w, h = F.expr("double(p_size + 10)"), F.expr("double(p_size % 7 + 5)")
    a = F.least(640 / w, 480 / h)
    align = F.expr("CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 0D WHEN 1 THEN 0.5D ELSE 1D END")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(a, 9).alias("a"), F.round((640 - w * a) * align, 6).alias("e"))


@query("SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*'))::BIGINT AS n_tags, len(list_distinct(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x))))::BIGINT AS n_names, len(regexp_extract_all(html, 'href=\"[^\"]*\"'))::BIGINT AS n_links, regexp_matches(html, '(?i)<script|<!doctype|<!entity') AS forbidden FROM pages")
def markup_scan(spark, sf_dir):
    """Tags, references and forbidden constructs of markup."""
    all_ = lambda p, g: F.regexp_extract_all("html", F.lit(p), g)
    names = F.transform(all_("<([a-zA-Z][a-zA-Z0-9]*)", 1), lambda x: F.lower(x))
    return _table(spark, sf_dir, "pages").select("page_id", F.size(names).cast("long").alias("n_tags"), F.size(F.array_distinct(names)).cast("long").alias("n_names"), F.size(all_('href="([^"]*)"', 1)).cast("long").alias("n_links"), F.col("html").rlike("(?i)<script|<!doctype|<!entity").alias("forbidden"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'count' WHEN p_partkey % 7 = 0 THEN 'scalar' ELSE 'ok' END AS code FROM part")
def cmap_grammar(spark, sf_dir):
    """A bfchar block: the declared count must match and each code has one scalar."""
    block = F.concat(F.expr("string(2 + int(p_partkey % 5 = 0))"), F.lit(" beginbfchar <0041> <0061> <0042> <"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN '00620063' ELSE '0062' END"), F.lit("> endbfchar"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.bfchar_code(block).alias("code"))


@query(
    cte("boxes")
    + """, o AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(z_index, ordinal), ordinal) AS slot, '<rect id="' || object_id || '" x="' || x::BIGINT || '" y="' || y::BIGINT || '" fill="' || fill || '"/>' AS e FROM boxes WHERE kind = 'path')
SELECT scene_id, '<svg>' || string_agg(e, '' ORDER BY slot) || '</svg>' AS svg FROM o GROUP BY scene_id"""
)
def svg_sink(spark, sf_dir):
    """Scenes as SVG in the order of painting."""
    o = fixture(spark, sf_dir, "boxes").where("kind = 'path'")
    slot = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.coalesce("z_index", "ordinal"), "ordinal"))
    mark = F.concat(F.lit('<rect id="'), F.col("object_id"), F.lit('" x="'), F.col("x").cast("long"), F.lit('" y="'), F.col("y").cast("long"), F.lit('" fill="'), F.col("fill"), F.lit('"/>'))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("slot", "e"))), lambda p: p["e"])
    return o.select("scene_id", slot.alias("slot"), mark.alias("e")).groupBy("scene_id").agg(F.concat(F.lit("<svg>"), F.array_join(parts, ""), F.lit("</svg>")).alias("svg"))


@query("SELECT 'a' || o_custkey AS path, count(DISTINCT o_orderkey % 2) AS n_hashes, count(*) AS n, CASE WHEN count(DISTINCT o_orderkey % 2) > 1 THEN 'conflict' ELSE 'ok' END AS code FROM orders GROUP BY o_custkey")
def asset_freeze(spark, sf_dir):
    """Declared assets by path; two digests for one path conflict."""
    assets = _table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), F.col("o_custkey")).alias("path"), F.sha2(F.expr("string(o_orderkey % 2)"), 256).alias("sha"))
    g = assets.groupBy("path").agg(F.countDistinct("sha").alias("n_hashes"), F.count("*").alias("n"))
    return g.withColumn("code", F.when(F.col("n_hashes") > 1, "conflict").otherwise("ok"))


# texts


@query(
    r"""WITH RECURSIVE w AS (SELECT doc_id AS item_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT item_id, 1 AS i, len(w[1]) AS used, 1 AS line FROM w UNION ALL
SELECT r.item_id, i + 1, CASE WHEN used + 1 + len(w[i + 1]) <= 40 THEN used + 1 + len(w[i + 1]) ELSE len(w[i + 1]) END, CASE WHEN used + 1 + len(w[i + 1]) <= 40 THEN line ELSE line + 1 END FROM r JOIN w USING (item_id) WHERE i < len(w))
SELECT item_id AS doc_id, line::BIGINT AS line, string_agg(w.w[i], ' ' ORDER BY i) AS text FROM r JOIN w USING (item_id) GROUP BY item_id, line"""
)
def word_wrap(spark, sf_dir):
    """Greedy wrap at forty advances, of every whole document."""
    return text.wrap(_table(spark, sf_dir, "documents"), "doc_id", "text", 40)


@query("SELECT p_partkey AS id, i, substr(p_name, i, 1) AS ch, (i - 1) * 7 + coalesce((i - 1) * (p_size % 5), 0) AS at FROM (SELECT *, unnest(range(1, length(p_name) + 1)) AS i FROM part)")
def spaced_text(spark, sf_dir):
    """Where each character stands with spacing between characters."""
    chars = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("s"), F.posexplode(F.split("p_name", "")).alias("i", "ch")).where("ch <> ''")
    at = F.sum(F.lit(7) + F.col("s")).over(Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return chars.select("id", (F.col("i") + 1).cast("long").alias("i"), "ch", F.coalesce(at, F.lit(0)).alias("at"))


@query("SELECT p_partkey AS id, floor(p_size * 0.75 * 100 + 0.5)::BIGINT AS centipoints, round(p_size * 1.2, 6)::DOUBLE AS pitch, round(p_size * 1.2 * (p_partkey % 6 + 1), 6)::DOUBLE AS height, p_size * 1.2 * (p_partkey % 6 + 1) > 100.001 AS overflow FROM part")
def text_fit(spark, sf_dir):
    """Line pitch, height and overflow of fitted text."""
    pitch = F.col("p_size") * F.lit(1.2)
    height = pitch * F.expr("p_partkey % 6 + 1")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalar.half_up(F.col("p_size") * F.lit(0.75) * 100).alias("centipoints"), F.round(pitch, 6).alias("pitch"), F.round(height, 6).alias("height"), (height > 100.001).alias("overflow"))


@query("SELECT source, count(DISTINCT ch)::BIGINT AS n_points, min(ch) AS first_point, max(ch) AS last_point FROM (SELECT source, unnest(list_distinct(list_transform(string_split(text, ''), lambda c: unicode(c)))) AS ch FROM documents WHERE text <> '') GROUP BY source")
def embedding_plan(spark, sf_dir):
    """The code points of each face that must be embedded."""
    chars = _table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''")
    points = chars.select("source", F.expr("ascii(c)").alias("ch"))
    return points.groupBy("source").agg(F.countDistinct("ch").alias("n_points"), F.min("ch").alias("first_point"), F.max("ch").alias("last_point"))


# pixels


_PIXELS = "p AS (SELECT vec_id AS image_id, i - 1 AS x, floor(abs(embedding[i]) * 1000)::BIGINT % 256 AS v, (vec_id * 7 + i * 13) % 256 AS a FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@query(f"WITH {_PIXELS} SELECT image_id, x, (v * a + 255 * (255 - a) + 127) // 255 AS v FROM p")
def composite_on_white(spark, sf_dir):
    """Alpha over white, in integers."""
    return raster.on_white(raster.pixels(_table(spark, sf_dir, "embeddings")))


@query(f"WITH {_PIXELS}, q AS (SELECT image_id, x, CASE WHEN a < 32 THEN 255 ELSE v END AS v, a FROM p) SELECT image_id, count(*) FILTER (WHERE q.v <> p.v) AS n_changed, bool_and(q.v = p.v OR p.a < 32) AS only_clear FROM p JOIN q USING (image_id, x) GROUP BY image_id")
def whiten_clear(spark, sf_dir):
    """Colour under clear pixels made white; nothing else may change."""
    p = raster.pixels(_table(spark, sf_dir, "embeddings"))
    q = p.withColumn("w", F.when(F.col("a") < 32, 255).otherwise(F.col("v")))
    return q.groupBy("image_id").agg(F.count_if(F.col("w") != F.col("v")).alias("n_changed"), F.bool_and((F.col("w") == F.col("v")) | (F.col("a") < 32)).alias("only_clear"))


@query(f"WITH {_PIXELS} SELECT a // 16 AS bin, count(*) AS n, min(CASE WHEN a > 0 THEN x END) AS low, max(CASE WHEN a > 0 THEN x END) AS high FROM p GROUP BY bin")
def alpha_histogram(spark, sf_dir):
    """Alpha by bins, with the extent of what isn't clear."""
    p = raster.pixels(_table(spark, sf_dir, "embeddings"))
    seen = F.when(F.col("a") > 0, F.col("x"))
    return p.groupBy(F.expr("a div 16").alias("bin")).agg(F.count("*").alias("n"), F.min(seen).alias("low"), F.max(seen).alias("high"))


@query(f"WITH {_PIXELS} SELECT p.image_id, sum(abs(p.v - q.v))::DOUBLE / 64 AS mae, max(abs(p.v - q.v)) AS worst FROM p JOIN p q ON q.image_id = p.image_id + 1 AND q.x = p.x GROUP BY p.image_id")
def colour_error(spark, sf_dir):
    """Mean absolute error of consecutive images."""
    p = raster.pixels(_table(spark, sf_dir, "embeddings"))
    return raster.error(p, p.withColumn("image_id", F.col("image_id") - 1))


@query(
    "WITH e AS (SELECT vec_id AS image_id, i - 1 AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE abs(embedding[i]) > 0.15), b AS (SELECT image_id - 1 AS image_id, x FROM e), "
    "h AS (SELECT image_id, count(*) FILTER (WHERE b.x IS NOT NULL) AS hit FROM e LEFT JOIN b USING (image_id, x) GROUP BY image_id), n AS (SELECT image_id, count(*) AS n FROM e GROUP BY image_id), m AS (SELECT image_id, count(*) AS m FROM b GROUP BY image_id) "
    "SELECT image_id, hit, n, m, round(2.0 * hit / (n + m), 9)::DOUBLE AS f1 FROM h JOIN n USING (image_id) JOIN m USING (image_id)"
)
def edge_agreement(spark, sf_dir):
    """Precision and recall of edge pixels as counts and F1."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("x", "v")).where("abs(v) > CAST(0.15 AS FLOAT)").select("image_id", "x")
    b = e.select((F.col("image_id") - 1).alias("image_id"), "x", F.lit(1).alias("there"))
    h = e.join(b, ["image_id", "x"], "left").groupBy("image_id").agg(F.count("there").alias("hit"), F.count("*").alias("n"))
    m = b.groupBy("image_id").agg(F.count("*").alias("m"))
    return h.join(m, "image_id").withColumn("f1", F.round(2 * F.col("hit") / (F.col("n") + F.col("m")), 9))


@query(f"WITH {_PIXELS}, t AS (SELECT image_id, x, v > 200 AS f FROM p), g AS (SELECT image_id, x, x - row_number() OVER (PARTITION BY image_id ORDER BY x) AS run FROM t WHERE f) SELECT image_id, min(x) AS low, max(x) AS high, count(*) AS area FROM g GROUP BY image_id, run HAVING count(*) >= 2")
def foreground_runs(spark, sf_dir):
    """Foreground runs of a row over a threshold, with a least size."""
    return raster.runs(raster.pixels(_table(spark, sf_dir, "embeddings")), 200, 2)


@query("SELECT p_partkey AS image_id, tx * 128 AS x, ty * 128 AS y, least(128, p_size * 20 - tx * 128) AS w, least(128, (p_partkey % 40 + 1) * 20 - ty * 128) AS h FROM (SELECT *, unnest(range(0, ceil(p_size * 20 / 128.0)::BIGINT)) AS tx FROM part), LATERAL (SELECT unnest(range(0, ceil((p_partkey % 40 + 1) * 20 / 128.0)::BIGINT)) AS ty)")
def source_tiles(spark, sf_dir):
    """Images as tiles of 128 pixels."""
    return raster.tiles(_table(spark, sf_dir, "part").selectExpr("p_partkey AS image_id", "p_size * 20 AS width", "(p_partkey % 40 + 1) * 20 AS height"), 128)


@query(cte("boxes") + " SELECT scene_id, count(*) FILTER (WHERE kind = 'path') AS paths, count(*) FILTER (WHERE kind = 'text') AS texts, count(*) FILTER (WHERE kind = 'image') AS images, count(*) FILTER (WHERE kind = 'image') = 0 AS fully_native, count(DISTINCT group_id) AS groups FROM boxes GROUP BY scene_id")
def kind_counts(spark, sf_dir):
    """What a scene is made of."""
    count = lambda k: F.count_if(F.col("kind") == k)
    return fixture(spark, sf_dir, "boxes").groupBy("scene_id").agg(count("path").alias("paths"), count("text").alias("texts"), count("image").alias("images"), (count("image") == 0).alias("fully_native"), F.countDistinct("group_id").alias("groups"))


@query(cte("commands") + ", a AS (SELECT path_id, seq, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, x, y FROM commands WINDOW w AS (PARTITION BY path_id)) SELECT path_id, seq, row_number() OVER (PARTITION BY path_id ORDER BY round(atan2(dy, dx), 6), seq) AS place FROM a")
def angular_order(spark, sf_dir):
    """Points of a path by their angle around its middle."""
    w = Window.partitionBy("path_id")
    c = fixture(spark, sf_dir, "commands").withColumn("turn", F.round(F.atan2(F.col("y") - F.avg("y").over(w), F.col("x") - F.avg("x").over(w)), 6))
    return c.select("path_id", "seq", F.row_number().over(w.orderBy("turn", "seq")).cast("long").alias("place"))


@query(cte("commands") + " SELECT path_id, min(x) AS x, min(y) FILTER (WHERE x = m) AS y FROM (SELECT *, min(x) OVER (PARTITION BY path_id) AS m FROM commands) GROUP BY path_id")
def ring_start(spark, sf_dir):
    """The point at which a ring's tracing begins: the leftmost, then the highest."""
    return fixture(spark, sf_dir, "commands").groupBy("path_id").agg(F.min(F.struct("x", "y")).alias("p")).select("path_id", "p.x", "p.y")
