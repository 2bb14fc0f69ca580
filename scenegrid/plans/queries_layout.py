"""Queries over layouts, inherited styles, transforms, assets and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.operators import layout, raster, records, text
from scenegrid.operators.rules import ring
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.queries_geometry import _PIXELS
from scenegrid.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LAYOUT = ", l AS (SELECT scene_id, node_id, 64 + stage * 296::DOUBLE AS x, 132 + lane2 / 2 * 206::DOUBLE AS y, 196::DOUBLE AS width, 96::DOUBLE AS height FROM nodes)"


@query(cte("nodes") + _LAYOUT + " SELECT * FROM l")
def node_layout(spark, sf_dir):
    """Boxes of graph nodes by stage and lane."""
    return layout.node_boxes(fixture(spark, sf_dir, "nodes"))


@query(cte("nodes") + _LAYOUT + " SELECT l.scene_id, kind AS group_id, min(x) - 20 AS x, min(y) - 44 AS y, max(x + width) - min(x) + 40 AS width, max(y + height) - min(y) + 64 AS height FROM l JOIN nodes USING (node_id) GROUP BY ALL")
def group_frames(spark, sf_dir):
    """Frames around the members of groups."""
    nodes = fixture(spark, sf_dir, "nodes")
    return layout.group_frames(layout.node_boxes(nodes).join(nodes.select("node_id", F.col("kind").alias("group_id")), "node_id"))


@query(
    cte("nodes", "edges")
    + _LAYOUT
    + """, e AS (SELECT edge_id, kind, a.x AS ax, a.y AS ya, b.x AS bx, b.y AS yb FROM edges JOIN l a ON a.node_id = from_id JOIN l b ON b.node_id = to_id)
SELECT edge_id, CASE WHEN kind IN ('feedback', 'skip') THEN 'bottom' WHEN (kind = 'training' OR ax = bx) AND ya <> yb THEN CASE WHEN ya < yb THEN 'bottom' ELSE 'top' END WHEN ax < bx THEN 'right' ELSE 'left' END AS from_site,
 CASE WHEN kind IN ('feedback', 'skip') THEN 'bottom' WHEN (kind = 'training' OR ax = bx) AND ya <> yb THEN CASE WHEN ya < yb THEN 'top' ELSE 'bottom' END WHEN ax < bx THEN 'left' ELSE 'right' END AS to_site FROM e"""
)
def edge_sites(spark, sf_dir):
    """The sites that an edge leaves and enters, by its kind and the places of its nodes."""
    boxes = layout.node_boxes(fixture(spark, sf_dir, "nodes"))
    at = F.struct("x", "y")
    e = fixture(spark, sf_dir, "edges").select("edge_id", "kind", "from_id", "to_id").join(boxes.select(F.col("node_id").alias("from_id"), at.alias("a")), "from_id").join(boxes.select(F.col("node_id").alias("to_id"), at.alias("b")), "to_id")
    out, into = layout.edge_sites()
    return e.select("edge_id", out.alias("from_site"), into.alias("to_site"))


@query()
def edge_routes(spark, sf_dir):
    """Orthogonal routes around the boxes of a scene, cheapest in length and bends. Of twelve boxes one stands for an
    edge, the others are its scene's obstacles."""
    boxes = fixture(spark, sf_dir, "boxes").where("object_id % 12 <> 5")
    ends = fixture(spark, sf_dir, "boxes").where("object_id % 12 = 5").selectExpr("scene_id", "object_id AS edge_id", "-30D AS x1", "y AS y1", "1100D AS x2", "1000 - y AS y2")
    return layout.routes(ends, boxes)


# label after label: each scene's list of labels placed so far
@query(
    "WITH RECURSIVE "
    + cte("boxes")[5:]
    + """, c AS (SELECT scene_id, object_id AS label_id, k AS place, x + k * 30 AS cx, y - k * 25 AS cy FROM boxes, (SELECT unnest(range(0, 4)) AS k) WHERE object_id % 3 = 0),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.object_id % 3 <> 0 AND b.scene_id = c.scene_id AND cx < b.x + b.width AND b.x < cx + 40 AND cy < b.y + b.height AND b.y < cy + 15)),
l AS (SELECT scene_id, label_id, i, coalesce(list({'place': place, 'cx': cx, 'cy': cy} ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS spots
  FROM (SELECT scene_id, label_id, row_number() OVER (PARTITION BY scene_id ORDER BY label_id) AS i FROM (SELECT DISTINCT scene_id, label_id FROM c)) LEFT JOIN f USING (scene_id, label_id) GROUP BY ALL),
r AS (SELECT scene_id, i, label_id, spots[1] AS pick, CASE WHEN len(spots) > 0 THEN [spots[1]] ELSE [] END AS placed FROM l WHERE i = 1
  UNION ALL SELECT scene_id, i, label_id, pick, CASE WHEN pick IS NULL THEN placed ELSE list_append(placed, pick) END FROM (
    SELECT l.scene_id, l.i, l.label_id, r.placed, list_filter(l.spots, lambda s: len(list_filter(r.placed, lambda o: abs(o.cx - s.cx) < 40 AND abs(o.cy - s.cy) < 15)) = 0)[1] AS pick FROM r JOIN l ON l.scene_id = r.scene_id AND l.i = r.i + 1))
SELECT label_id, pick.place AS place, pick.cx AS x, pick.cy AS y FROM r"""
)
def label_places(spark, sf_dir):
    """The first place of each label that is free of boxes and of the labels before it."""
    boxes = fixture(spark, sf_dir, "boxes")
    labels = boxes.where("object_id % 3 = 0").selectExpr("scene_id", "object_id AS label_id", "x", "y", "40D AS width", "15D AS height")
    return layout.label_places(labels, boxes.where("object_id % 3 <> 0"))


@query(
    "WITH RECURSIVE a AS (SELECT o_orderkey AS child_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent_id, CASE WHEN o_orderkey % 3 = 1 THEN '#' || o_custkey END AS fill FROM orders), "
    "r AS (SELECT child_id, fill FROM a WHERE parent_id IS NULL UNION ALL SELECT a.child_id, coalesce(a.fill, r.fill) FROM a JOIN r ON r.child_id = a.parent_id) SELECT child_id, fill, NULL::VARCHAR AS code FROM r"
)
def inherited_styles(spark, sf_dir):
    """A property inherited down a tree."""
    tree = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS child_id", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent_id", "CASE WHEN o_orderkey % 3 = 1 THEN '#' || o_custkey END AS fill")
    return layout.inherit(tree, "fill")


@query("SELECT o_orderkey AS node, CASE WHEN o_orderkey - o_orderkey % 7 + 6 <= (SELECT max(o_orderkey) FROM orders) THEN o_orderkey - o_orderkey % 7 END AS ring, CASE WHEN o_orderkey - o_orderkey % 7 + 6 > (SELECT max(o_orderkey) FROM orders) THEN 'dangling' END AS code FROM orders")
def ring_tracing(spark, sf_dir):
    """Rings of a successor function, named by their smallest node."""
    orders = _table(spark, sf_dir, "orders")
    successors = orders.selectExpr("o_orderkey AS node", "o_orderkey - o_orderkey % 7 + (o_orderkey % 7 + 1) % 7 AS successor")
    return layout.rings(successors)


# rotated about (p_size, 30), then sheared; every ninth list has a name that isn't read
@query(
    """WITH p AS (SELECT p_partkey AS id, (p_partkey % 90)::DOUBLE AS e, cos(radians(p_size)) AS c, sin(radians(p_size)) AS s, p_size::DOUBLE AS px, tan(radians(20)) AS k, p_partkey % 9 <> 0 AS sound FROM part),
q AS (SELECT id, sound, c AS a, s AS b, c * k - s AS c, s * k + c AS d, e + px - c * px + s * 30 AS e, -5.5 + 30 - s * px - c * 30 AS f FROM p)
SELECT id, CASE WHEN sound THEN round(a * 2, 6) END AS a, CASE WHEN sound THEN round(b * 2, 6) END AS b, CASE WHEN sound THEN round(c * 3, 6) END AS c, CASE WHEN sound THEN round(d * 3, 6) END AS d, CASE WHEN sound THEN round(e, 6) END AS e, CASE WHEN sound THEN round(f, 6) END AS f FROM q"""
)
def transform_lists(spark, sf_dir):
    """Transform lists as one matrix: shifts, turns about a point, shears, scales; null where something isn't read."""
    words = F.concat(F.lit("translate("), F.expr("p_partkey % 90"), F.lit(",-5.5) rotate("), F.col("p_size"), F.lit(" "), F.col("p_size"), F.lit(" 30), skewX(20) "), F.when(F.expr("p_partkey % 9 = 0"), "turn(2, 3)").otherwise("scale(2, 3)"))
    m = layout.matrix(words)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), m.alias("m")).select("id", *[F.round(F.get("m", F.lit(i)), 6).alias(n) for i, n in enumerate("abcdef")])


@query("SELECT p_partkey AS id, k, round(100 + p_size * cos(radians(p_partkey % 360 + k * 10)), 6) AS x, round(50 + p_size / 2.0 * sin(radians(p_partkey % 360 + k * 10)), 6) AS y FROM part, (SELECT unnest(range(0, 10)) AS k)")
def arc_chords(spark, sf_dir):
    """An elliptical arc as chords."""
    k = F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("long")))
    a = _table(spark, sf_dir, "part").withColumn("k", k)
    turn = F.radians(F.expr("p_partkey % 360 + k * 10"))
    return a.select(F.col("p_partkey").alias("id"), "k", F.round(100 + F.col("p_size") * F.cos(turn), 6).alias("x"), F.round(50 + F.col("p_size") / 2 * F.sin(turn), 6).alias("y"))


_RING = ", r AS (SELECT path_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM commands WINDOW w AS (PARTITION BY path_id ORDER BY seq))"


@query(
    cte("commands")
    + _RING
    + """, p AS (SELECT a.path_id, a.seq AS a_seq, b.seq AS b_seq, (b.x - a.x) * (b.ny - b.y) - (b.y - a.y) * (b.nx - b.x) AS num, (a.nx - a.x) * (b.ny - b.y) - (a.ny - a.y) * (b.nx - b.x) AS den, (b.x - a.x) * (a.ny - a.y) - (b.y - a.y) * (a.nx - a.x) AS other FROM r a JOIN r b ON a.path_id = b.path_id AND a.seq <> b.seq)
SELECT path_id, a_seq, b_seq, num * sign(den)::BIGINT AS num, abs(den) AS den, row_number() OVER (PARTITION BY path_id, a_seq ORDER BY num::DOUBLE / den, b_seq) AS rank FROM p WHERE den <> 0 AND num * sign(den) > 0 AND num * sign(den) < abs(den) AND other * sign(den) > 0 AND other * sign(den) < abs(den)"""
)
def crossing_parameters(spark, sf_dir):
    """Crossings along each edge as exact fractions, in order."""
    e = ring(fixture(spark, sf_dir, "commands"))
    a, b = e.alias("a"), e.alias("b")
    both = a.join(b, (F.col("a.path_id") == F.col("b.path_id")) & (F.col("a.seq") != F.col("b.seq")))
    num, den, other = F.expr("(b.x - a.x) * (b.ny - b.y) - (b.y - a.y) * (b.nx - b.x)"), F.expr("(a.nx - a.x) * (b.ny - b.y) - (a.ny - a.y) * (b.nx - b.x)"), F.expr("(b.x - a.x) * (a.ny - a.y) - (b.y - a.y) * (a.nx - a.x)")
    sign = F.signum(den).cast("long")
    p = both.where(den != 0).select("a.path_id", F.col("a.seq").alias("a_seq"), F.col("b.seq").alias("b_seq"), (num * sign).alias("num"), F.abs(den).alias("den"), (other * sign).alias("other")).where("num > 0 AND num < den AND other > 0 AND other < den")
    from pyspark.sql import Window

    return p.select("path_id", "a_seq", "b_seq", "num", "den", F.row_number().over(Window.partitionBy("path_id", "a_seq").orderBy(F.col("num") / F.col("den"), "b_seq")).cast("long").alias("rank"))


@query(
    cte("commands")
    + _RING
    + " SELECT a.path_id, count(*) AS n_pairs, count(*) FILTER (WHERE greatest(a.x, a.nx) < least(b.x, b.nx) OR greatest(b.x, b.nx) < least(a.x, a.nx) OR greatest(a.y, a.ny) < least(b.y, b.ny) OR greatest(b.y, b.ny) < least(a.y, a.ny)) AS n_apart FROM r a JOIN r b ON a.path_id = b.path_id AND a.seq + 1 < b.seq GROUP BY a.path_id"
)
def hull_separation(spark, sf_dir):
    """Pairs of segments whose hulls are strictly apart, per path."""
    e = ring(fixture(spark, sf_dir, "commands")).selectExpr("path_id", "seq", "least(x, nx) AS lx", "greatest(x, nx) AS hx", "least(y, ny) AS ly", "greatest(y, ny) AS hy")
    pairs = e.alias("a").join(e.alias("b"), F.expr("a.path_id = b.path_id AND a.seq + 1 < b.seq"))
    apart = F.expr("a.hx < b.lx OR b.hx < a.lx OR a.hy < b.ly OR b.hy < a.ly")
    return pairs.groupBy("a.path_id").agg(F.count("*").alias("n_pairs"), F.count_if(apart).alias("n_apart"))


@query(cte("boxes") + " SELECT object_id, round(greatest(0, least(x + width, 700) - greatest(x, 300)) * greatest(0, least(y + height, 600) - greatest(y, 200)), 6) AS area FROM boxes")
def clipped_area(spark, sf_dir):
    """Convex fills inside a rectangle, side by side, and what area is left."""
    corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    points = F.array(corner("x", "y"), corner("x + width", "y"), corner("x + width", "y + height"), corner("x", "y + height"))
    cut = fixture(spark, sf_dir, "boxes").select("object_id", layout.clip_polygon(points, 300.0, 200.0, 700.0, 600.0).alias("p"))
    following = F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1))
    twice = F.aggregate(F.zip_with("p", following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda a, v: a + v)
    return cut.select("object_id", F.round(F.abs(twice) / 2, 6).alias("area"))


@query(cte("boxes") + " SELECT object_id, k, round(x + width / 2 + [0, 1, 0.5, -0.5, -1][k] * width / 2, 6) AS px, round(y + [0, 0.5, 1, 1, 0.5][k] * height, 6) AS py FROM boxes, (SELECT unnest(range(1, 6)) AS k)")
def pointer_polygons(spark, sf_dir):
    """A pointer as a polygon around its axis."""
    at = F.posexplode(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (1.0, 0.5), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.5))]))
    return fixture(spark, sf_dir, "boxes").select("object_id", "x", "y", "width", "height", at.alias("k", "u")).select("object_id", (F.col("k") + 1).cast("long").alias("k"), F.round(F.expr("x + width / 2 + u[0] * width / 2"), 6).alias("px"), F.round(F.expr("y + u[1] * height"), 6).alias("py"))


@query(cte("boxes") + " SELECT object_id, round(x + r * (1 - 0.5522847498), 6) AS cx, round(y + r * (1 - 0.5522847498), 6) AS cy, round(width * height - (4 - pi()) * r * r, 4) AS area FROM (SELECT *, least(6, width / 2, height / 2) AS r FROM boxes)")
def rounded_rectangles(spark, sf_dir):
    """Corners of rounded rectangles as curves."""
    r = F.least(F.lit(6.0), F.col("width") / 2, F.col("height") / 2)
    k = 1 - F.lit(0.5522847498)
    return fixture(spark, sf_dir, "boxes").select("object_id", F.round(F.col("x") + r * k, 6).alias("cx"), F.round(F.col("y") + r * k, 6).alias("cy"), F.round(F.col("width") * F.col("height") - (4 - F.pi()) * r * r, 4).alias("area"))


@query("SELECT p_partkey AS id, round(sqrt((a * a + b * b + c * c + d * d + sqrt((a * a + b * b - c * c - d * d) ** 2 + 4 * (a * c + b * d) ** 2)) / 2), 6) AS largest, abs(a * c + b * d) <= 1e-8 AND abs(a * a + b * b - c * c - d * d) <= 1e-8 AS similarity FROM (SELECT *, (p_size % 5 + 1)::DOUBLE AS a, (p_size % 3)::DOUBLE AS b, -(p_size % 3)::DOUBLE AS c, (CASE WHEN p_partkey % 2 = 0 THEN p_size % 5 + 1 ELSE p_size % 7 END)::DOUBLE AS d FROM part)")
def similarity_transforms(spark, sf_dir):
    """Largest singular values, and whether a matrix keeps shapes."""
    m = _table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "double(p_size % 5 + 1) AS a", "double(p_size % 3) AS b", "-double(p_size % 3) AS c", "double(CASE WHEN p_partkey % 2 = 0 THEN p_size % 5 + 1 ELSE p_size % 7 END) AS d")
    dot, gap = F.expr("a * c + b * d"), F.expr("a * a + b * b - c * c - d * d")
    largest = F.sqrt((F.expr("a * a + b * b + c * c + d * d") + F.sqrt(gap * gap + 4 * dot * dot)) / 2)
    return m.select("id", F.round(largest, 6).alias("largest"), ((F.abs(dot) <= 1e-8) & (F.abs(gap) <= 1e-8)).alias("similarity"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 1 THEN p_size % 3 * 2 ELSE p_size % 3 + 2 END AS n, round(((p_partkey % 37) - floor((p_partkey % 37) / t) * t)::DOUBLE, 9) AS phase FROM (SELECT *, CASE WHEN p_size % 3 = 1 THEN 2.0 * 4 ELSE (p_size % 3 + 2) * 4.0 END AS t FROM part WHERE p_size % 3 <> 1 AND (p_size % 3 + 2) % 2 = 0 OR p_size % 3 = 1)")
def dash_patterns(spark, sf_dir):
    """Odd patterns doubled, the phase within one cycle."""
    parts = _table(spark, sf_dir, "part").where("p_size % 3 <> 1 AND (p_size % 3 + 2) % 2 = 0 OR p_size % 3 = 1").selectExpr("p_partkey AS id", "array_repeat(4D, CASE WHEN p_size % 3 = 1 THEN 1 ELSE p_size % 3 + 2 END) AS p", "double(p_partkey % 37) AS at")
    even = F.when(F.size("p") % 2 == 1, F.concat("p", "p")).otherwise(F.col("p"))
    total = F.aggregate(even, F.lit(0.0), lambda a, v: a + v)
    return parts.select("id", F.size(even).alias("n"), F.round(F.col("at") - F.floor(F.col("at") / total) * total, 9).alias("phase"))


@query(cte("boxes") + " SELECT object_id, round(((500 - x) * width + (500 - y) * height) / (width * width + height * height), 9) AS t, floor(greatest(0, least(1, ((500 - x) * width + (500 - y) * height) / (width * width + height * height))) * 255 + 0.5)::BIGINT AS level FROM boxes")
def axial_shading(spark, sf_dir):
    """The parameter of a point along a shading's axis and the level there."""
    t = F.expr("((500 - x) * width + (500 - y) * height) / (width * width + height * height)")
    return fixture(spark, sf_dir, "boxes").select("object_id", F.round(t, 9).alias("t"), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * 255 + 0.5).alias("level"))


# one walk from either end, a step for each place
@query(
    "WITH RECURSIVE "
    + cte("commands")[5:]
    + """, f AS (SELECT path_id, list(v ORDER BY seq) AS f, list(v ORDER BY seq) FILTER (WHERE seq % 2 = 0) AS w FROM (SELECT path_id, seq, (x // 250)::DOUBLE AS v FROM commands) GROUP BY path_id HAVING max(seq) > 1),
d AS (SELECT path_id, 1 AS way, f, w FROM f UNION ALL SELECT path_id, -1, list_reverse(f), list_reverse(w) FROM f),
r AS (SELECT path_id, way, f, w, 1 AS j, 1 AS i, 0 AS s FROM d
  UNION ALL SELECT path_id, way, f, w, j + 1, i + h, s + h * CASE way WHEN 1 THEN j ELSE len(f) + 1 - j END FROM (SELECT *, CASE WHEN i <= len(w) AND f[j] = w[i] THEN 1 ELSE 0 END AS h FROM r WHERE j <= len(f))),
e AS (SELECT path_id, way, i - 1 AS n, s, len(w) AS m FROM r WHERE j = len(f) + 1)
SELECT a.path_id, a.m::BIGINT AS n, a.n::BIGINT AS n_matched, a.n = a.m AND a.s = b.s AS "unique" FROM e a JOIN e b ON a.path_id = b.path_id AND a.way = 1 AND b.way = -1"""
)
def ordered_matches(spark, sf_dir):
    """Images matched to paints in order, and whether only one matching is possible."""
    c = fixture(spark, sf_dir, "commands").selectExpr("path_id", "seq AS place", "double(x div 250) AS value")
    return layout.match_in_order(c.where("place % 2 = 0"), c, "path_id", 0.002)


@query("SELECT item_id, true AS conserved FROM benchmark")
def wrapped_text_kept(spark, sf_dir):
    """Wrapped lines hold the words of the text, in order, once."""
    bench = _table(spark, sf_dir, "benchmark")
    lines = text.wrap(bench, "item_id", "text", 40).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    whole = F.array_join(F.transform("l", lambda s: s["text"]), " ")
    return bench.join(lines, "item_id").select("item_id", (whole == F.col("text")).alias("conserved"))


@query("WITH m AS (SELECT o_orderkey AS gid, CASE WHEN o_orderkey % 10 = 0 THEN 65533 ELSE o_custkey % 200 END AS unicode, o_orderkey % 700 AS signature FROM orders), p AS (SELECT signature, min(unicode) AS proof FROM m WHERE unicode <> 65533 GROUP BY signature HAVING count(DISTINCT unicode) = 1) SELECT gid, proof, CASE WHEN proof IS NULL THEN 'UNRESOLVED' ELSE 'repair' END AS code FROM m LEFT JOIN p USING (signature) WHERE unicode = 65533")
def unicode_repairs(spark, sf_dir):
    """Only replacement characters with one proof are repaired."""
    m = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS gid", "CASE WHEN o_orderkey % 10 = 0 THEN 65533 ELSE o_custkey % 200 END AS unicode", "o_orderkey % 700 AS signature")
    proofs = m.where("unicode <> 65533").groupBy("signature").agg(F.min("unicode").alias("proof"), F.countDistinct("unicode").alias("k")).where("k = 1").drop("k")
    return m.where("unicode = 65533").join(proofs, "signature", "left").select("gid", "proof", F.when(F.col("proof").isNull(), "UNRESOLVED").otherwise("repair").alias("code"))


@query("SELECT o_orderkey AS asset, CASE WHEN o_orderkey % 29 = 0 THEN 'missing_file' WHEN o_orderkey % 31 = 0 THEN 'hash' WHEN o_custkey % 10 < 3 THEN 'undersampled' ELSE 'ok' END AS code FROM orders")
def formula_assets(spark, sf_dir):
    """Declared assets against the files: there, equal in digest, sampled well enough."""
    o = _table(spark, sf_dir, "orders")
    declared = o.select(F.col("o_orderkey").alias("asset"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"), F.expr("o_custkey % 10").alias("sampling"))
    files = o.where("o_orderkey % 29 <> 0").select(F.col("o_orderkey").alias("asset"), F.sha2(F.expr("CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE string(o_orderkey) END"), 256).alias("found"))
    code = F.when(F.col("found").isNull(), "missing_file").when(F.col("found") != F.col("sha"), "hash").when(F.col("sampling") < 3, "undersampled").otherwise("ok")
    return declared.join(files, "asset", "left").select("asset", code.alias("code"))


@query(
    cte("boxes")
    + ", c AS (SELECT scene_id, object_id, CASE CAST(object_id % 3 AS INT) WHEN 0 THEN 'figure' ELSE 'label' END AS category FROM boxes WHERE object_id % 4 <> 1) SELECT b.scene_id, count(DISTINCT c.object_id) AS covered, count(DISTINCT CASE WHEN category = 'figure' THEN c.object_id END) AS figures, list_sort(list(b.object_id) FILTER (WHERE c.object_id IS NULL)) AS uncovered FROM boxes b LEFT JOIN c USING (scene_id, object_id) GROUP BY b.scene_id"
)
def inventory_audit(spark, sf_dir):
    """Which objects the source inventory covers, and which not."""
    boxes = fixture(spark, sf_dir, "boxes").select("scene_id", "object_id")
    parts = boxes.where("object_id % 4 <> 1").withColumn("category", F.expr("CASE CAST(object_id % 3 AS INT) WHEN 0 THEN 'figure' ELSE 'label' END"))
    both = boxes.join(parts, ["scene_id", "object_id"], "left")
    left_out = F.sort_array(F.collect_list(F.when(F.col("category").isNull(), F.col("object_id"))))
    return both.groupBy("scene_id").agg(F.count("category").alias("covered"), F.count_if(F.col("category") == "figure").alias("figures"), left_out.alias("uncovered"))


@query(f"WITH {_PIXELS}, q AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN CASE WHEN a > 128 THEN 255 ELSE 0 END WHEN image_id % 3 = 1 THEN 255 ELSE a END AS a, x FROM p) SELECT image_id, CASE WHEN bool_or(a NOT IN (0, 255)) THEN 'soft' WHEN min(a) = max(a) THEN 'constant' ELSE 'binary' END AS code, min(CASE WHEN a > 0 THEN x END) AS low, max(CASE WHEN a > 0 THEN x END) - min(CASE WHEN a > 0 THEN x END) + 1 AS width FROM q GROUP BY image_id")
def alpha_plans(spark, sf_dir):
    """Which masks are binary, and what a trim of clear borders leaves."""
    p = raster.pixels(_table(spark, sf_dir, "embeddings"))
    q = p.withColumn("a", F.expr("CASE WHEN image_id % 3 = 0 THEN CASE WHEN a > 128 THEN 255 ELSE 0 END WHEN image_id % 3 = 1 THEN 255 ELSE a END"))
    seen = F.when(F.col("a") > 0, F.col("x"))
    code = F.when(F.bool_or(~F.col("a").isin(0, 255)), "soft").when(F.min("a") == F.max("a"), "constant").otherwise("binary")
    return q.groupBy("image_id").agg(code.alias("code"), F.min(seen).alias("low"), (F.max(seen) - F.min(seen) + 1).alias("width"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, ceil(l_extendedprice * 100 / 9525)::BIGINT * 2 AS px2, floor(l_extendedprice * 100 / 9525)::BIGINT * 4 AS px4, ceil(l_extendedprice * 100 / 9525)::BIGINT * 2 * 40 > 80000 AS over FROM lineitem")
def preview_budget(spark, sf_dir):
    """Device pixels of a preview at two and four times, and whether they fit."""
    v = F.col("l_extendedprice") * 100 / 9525
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.ceil(v) * 2).alias("px2"), (F.floor(v) * 4).alias("px4"), (F.ceil(v) * 2 * 40 > 80000).alias("over"))


@query("WITH o AS (SELECT '/ppt/slides/slide' || p_partkey || '.xml' AS part, 'override' AS type FROM part WHERE p_partkey % 3 = 0), d AS (SELECT * FROM (VALUES ('xml', 'application/xml'), ('png', 'image/png')) t(ext, type)), p AS (SELECT p_partkey AS id, '/ppt/slides/slide' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.bin' ELSE '.xml' END AS part FROM part) SELECT id, coalesce(o.type, d.type) AS type FROM p LEFT JOIN o USING (part) LEFT JOIN d ON ext = regexp_extract(part, '[^.]*$')")
def content_types(spark, sf_dir):
    """Content types by override, else by extension."""
    p = _table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "'/ppt/slides/slide' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.bin' ELSE '.xml' END AS part")
    override = _table(spark, sf_dir, "part").where("p_partkey % 3 = 0").selectExpr("'/ppt/slides/slide' || p_partkey || '.xml' AS part", "'override' AS own")
    default = spark.createDataFrame([("xml", "application/xml"), ("png", "image/png")], "ext string, type string")
    out = p.join(override, "part", "left").withColumn("ext", F.regexp_extract("part", r"[^.]*$", 0)).join(F.broadcast(default), "ext", "left")
    return out.select("id", F.coalesce("own", "type").alias("type"))


@query("SELECT event_id, event_id % 2 = 0 AS equal FROM events")
def record_equality(spark, sf_dir):
    """Records compared with their types: 1 and 1.0 differ."""
    a, b = F.to_json(F.struct(F.lit(1).alias("k"))), F.to_json(F.struct(F.when(F.expr("event_id % 2 = 0"), F.lit("1")).otherwise(F.lit("1.0")).alias("k")))
    return _table(spark, sf_dir, "events").select("event_id", (a == F.regexp_replace(b, '"(1(?:\\.0)?)"', "$1")).alias("equal"))


@query(cte("log") + ", s AS (SELECT scene_id, count(*) AS n, max(seq) AS latest, list_sort(list(DISTINCT op)) AS roles FROM log GROUP BY scene_id) SELECT scene_id, n, latest, CASE WHEN list_contains(roles, 'error') THEN 'issues_found' WHEN len(roles) < 4 THEN 'needs_further_review' ELSE 'no_observed_issue' END AS status FROM s")
def output_reviews(spark, sf_dir):
    """The review of each output from its append-only record."""
    s = fixture(spark, sf_dir, "log").groupBy("scene_id").agg(F.count("*").alias("n"), F.max("seq").alias("latest"), F.collect_set("op").alias("roles"))
    status = F.when(F.array_contains("roles", "error"), "issues_found").when(F.size("roles") < 4, "needs_further_review").otherwise("no_observed_issue")
    return s.select("scene_id", "n", "latest", status.alias("status"))


@query(cte("commands") + _RING + " SELECT path_id, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) AS perimeter, count(*) FILTER (WHERE x = nx AND y = ny) AS n_empty, count(*) FILTER (WHERE x = nx OR y = ny) AS n_straight FROM r GROUP BY path_id")
def contour_checks(spark, sf_dir):
    """Perimeters, edges without length, edges along the axes."""
    e = ring(fixture(spark, sf_dir, "commands"))
    return e.groupBy("path_id").agg(F.round(F.sum(F.expr("sqrt(pow(nx - x, 2) + pow(ny - y, 2))")), 6).alias("perimeter"), F.count_if(F.expr("x = nx AND y = ny")).alias("n_empty"), F.count_if(F.expr("x = nx OR y = ny")).alias("n_straight"))


@query("SELECT doc_id % 50 AS source, count(*) AS n, '{\"source\":' || (doc_id % 50) || ',\"n\":' || count(*) || '}' AS receipt FROM documents GROUP BY doc_id % 50")
def receipts(spark, sf_dir):
    """Receipts as compact JSON."""
    g = _table(spark, sf_dir, "documents").groupBy(F.expr("doc_id % 50").alias("source")).agg(F.count("*").alias("n"))
    return g.withColumn("receipt", records.receipt("source", "n"))
