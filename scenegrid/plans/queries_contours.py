"""Queries over closed contours, enclosures of numbers, clips and matches of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.functions import geometry, scalar
from scenegrid.operators import contours, raster
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.queries_geometry import _CURVES, _PIXELS, _RING, _curves
from scenegrid.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sign(p: str, q: str, x: str, y: str) -> str:
    return f"sign(({p}.nx - {p}.x) * ({q}.{y} - {p}.y) - ({p}.ny - {p}.y) * ({q}.{x} - {p}.x))"


def _product(p: str, q: str) -> str:
    return f"{_sign(p, q, 'x', 'y')} * {_sign(p, q, 'nx', 'ny')}"


_CROSS = f"({_product('a', 'b')} < 0 AND {_product('b', 'a')} < 0)"
_MEET = (
    "(" + " AND ".join(f"greatest({p}.{c}, {p}.n{c}) >= least({q}.{c}, {q}.n{c})" for c in "xy" for p, q in ("ab", "ba")) + f" AND {_product('a', 'b')} <= 0 AND {_product('b', 'a')} <= 0)"
)
_DOMAINS = (
    f", l AS (SELECT path_id, max(seq) AS last FROM r GROUP BY path_id), m AS (SELECT a.path_id, bool_or({_CROSS}) AS crossed, bool_or({_MEET}) AS touched FROM r a JOIN r b ON a.path_id = b.path_id AND a.seq + 1 < b.seq JOIN l ON l.path_id = a.path_id WHERE NOT (a.seq = 1 AND b.seq = last) GROUP BY a.path_id)"
    ", dom AS (SELECT path_id, CASE WHEN crossed THEN 'transverse' WHEN touched THEN 'contact' ELSE 'isolated' END AS domain FROM l LEFT JOIN m USING (path_id))"
)


@query(
    cte("commands")
    + ", p AS (SELECT DISTINCT path_id, x, y FROM commands), n AS (SELECT path_id, count(*) AS n FROM p GROUP BY path_id) SELECT path_id, x, y FROM p JOIN n USING (path_id) WHERE n = 1 UNION SELECT v.path_id, v.x, v.y FROM p v JOIN p u ON u.path_id = v.path_id AND (u.x <> v.x OR u.y <> v.y) JOIN p w ON w.path_id = v.path_id GROUP BY v.path_id, v.x, v.y, u.x, u.y HAVING min((u.x - v.x) * (w.y - v.y) - (u.y - v.y) * (w.x - v.x)) >= 0 AND NOT bool_or((u.x - v.x) * (w.y - v.y) = (u.y - v.y) * (w.x - v.x) AND (w.x - v.x) * (v.x - u.x) + (w.y - v.y) * (v.y - u.y) > 0)"
)
def convex_hulls(spark, sf_dir):
    """Corners of exact convex hulls."""
    return contours.convex_hull(fixture(spark, sf_dir, "commands")).drop("place")


@query(cte("commands") + _RING + _DOMAINS + " SELECT path_id, domain FROM dom")
def curve_domains(spark, sf_dir):
    """E38, E11 (polygons): whether edges cross, only touch, or do neither."""
    return contours.domains(fixture(spark, sf_dir, "commands"))


_PROBE = {s: ("(mx)", "(my)", f"(mx {s} -2 * (a.ny - a.y))", f"(my {s} 2 * (a.nx - a.x))") for s in "+-"}


def _meets(p: tuple[str, ...], q: tuple[str, ...]) -> str:
    side = lambda s, x, y: f"sign(({s[2]} - {s[0]}) * ({y} - {s[1]}) - ({s[3]} - {s[1]}) * ({x} - {s[0]}))"
    boxes = " AND ".join(f"greatest({a[i]}, {a[i + 2]}) >= least({b[i]}, {b[i + 2]})" for i in (0, 1) for a, b in ((p, q), (q, p)))
    return f"({boxes} AND {side(p, q[0], q[1])} * {side(p, q[2], q[3])} <= 0 AND {side(q, p[0], p[1])} * {side(q, p[2], p[3])} <= 0)"


_EDGE = tuple(f"(2 * b.{c} * s)" for c in ("x", "y", "nx", "ny"))
_PROBES = f""", e AS (SELECT * FROM r WHERE x <> nx OR y <> ny), ks AS (SELECT unnest(range(0, {contours.HALVINGS + 1})) AS k),
sc AS (SELECT a.*, k, greatest(abs(nx - x), abs(ny - y)) * (1 << k::INT) AS s, (x + nx) * greatest(abs(nx - x), abs(ny - y)) * (1 << k::INT) AS mx, (y + ny) * greatest(abs(nx - x), abs(ny - y)) * (1 << k::INT) AS my FROM e a, ks),
tried AS (SELECT a.path_id, a.seq, a.k, bool_or(NOT ((a.x = b.x AND a.y = b.y AND a.nx = b.nx AND a.ny = b.ny) OR (a.x = b.nx AND a.y = b.ny AND a.nx = b.x AND a.ny = b.y)) AND ({_meets(_PROBE['+'], _EDGE)} OR {_meets(_PROBE['-'], _EDGE)})) AS hit FROM sc a JOIN e b ON a.path_id = b.path_id GROUP BY ALL),
clear AS (SELECT path_id, seq, (min(k) FILTER (WHERE NOT hit))::INT AS halvings FROM tried GROUP BY ALL)"""


_SAME = "((a.x = b.x AND a.y = b.y AND a.nx = b.nx AND a.ny = b.ny) OR (a.x = b.nx AND a.y = b.ny AND a.nx = b.x AND a.ny = b.y))"
_ON = " AND ".join(f"a.{c} + a.n{c} BETWEEN 2 * least(b.{c}, b.n{c}) AND 2 * greatest(b.{c}, b.n{c})" for c in "xy")


@query(
    cte("commands").replace("WITH ", "WITH RECURSIVE ", 1)
    + _RING
    + f""", e AS (SELECT path_id, seq, x::HUGEINT AS x, y::HUGEINT AS y, nx::HUGEINT AS nx, ny::HUGEINT AS ny FROM r WHERE x <> nx OR y <> ny),
stuck AS (SELECT DISTINCT a.path_id, a.seq FROM e a JOIN e b ON a.path_id = b.path_id AND NOT {_SAME} AND {_ON} AND (b.nx - b.x) * (a.y + a.ny - 2 * b.y) = (b.ny - b.y) * (a.x + a.nx - 2 * b.x)),
t AS (SELECT e.*, 0 AS k, greatest(abs(nx - x), abs(ny - y)) AS s FROM e ANTI JOIN stuck USING (path_id, seq)
 UNION ALL SELECT DISTINCT a.path_id, a.seq, a.x, a.y, a.nx, a.ny, a.k + 1, a.s * 2 FROM (SELECT *, (x + nx) * s AS mx, (y + ny) * s AS my FROM t) a JOIN e b ON a.path_id = b.path_id AND NOT {_SAME} AND ({_meets(_PROBE['+'], _EDGE)} OR {_meets(_PROBE['-'], _EDGE)}))
SELECT path_id, seq, max(k) AS halvings FROM t GROUP BY path_id, seq UNION ALL SELECT path_id, seq, NULL FROM stuck"""
)
def side_probes(spark, sf_dir):
    """Probes at both sides of an edge, halved until no other edge lies between, however often that is."""
    return contours.side_probes(fixture(spark, sf_dir, "commands")).select("path_id", "seq", "halvings")


@query(
    cte("commands")
    + _RING
    + _DOMAINS
    + _PROBES
    + """, n AS (SELECT e.*, greatest(abs(nx - x), abs(ny - y)) * (1 << halvings) AS s FROM e JOIN clear USING (path_id, seq) WHERE halvings IS NOT NULL),
q AS (SELECT path_id, seq * g AS probe_id, 2 * s AS c, (x + nx) * s - g * 2 * (ny - y) AS px, (y + ny) * s + g * 2 * (nx - x) AS py FROM n, (SELECT unnest([1, -1]) AS g)),
f AS (SELECT path_id, probe_id, px, py, x * c AS x, y * c AS y, nx * c AS nx, ny * c AS ny FROM r JOIN q USING (path_id)),
wn AS (SELECT path_id, probe_id, sum(CASE WHEN y <= py AND ny > py AND (nx - x) * (py - y) - (px - x) * (ny - y) > 0 THEN 1 WHEN y > py AND ny <= py AND (nx - x) * (py - y) - (px - x) * (ny - y) < 0 THEN -1 ELSE 0 END) AS winding FROM f GROUP BY ALL),
ev AS (SELECT path_id, bool_or(winding <> 0 AND winding % 2 = 0) AS even FROM wn GROUP BY path_id)
SELECT path_id, CASE WHEN even THEN 'differ' WHEN domain = 'isolated' THEN 'equal' ELSE 'undecided' END AS code FROM dom LEFT JOIN ev USING (path_id)"""
)
def fill_rules(spark, sf_dir):
    """E9 (polygons): where even-odd and nonzero filling agree."""
    return contours.fill_rules(fixture(spark, sf_dir, "commands"))


_CORNERS = ", ".join(f"sign((nx - x) * ({b} - y) - (ny - y) * ({a} - x))" for a in ("x0", "x1") for b in ("y0", "y1"))


@query(
    cte("commands")
    + _RING
    + f""", bx AS (SELECT DISTINCT path_id, path_id * 7 % 900 AS x0, path_id * 131 % 900 AS y0, path_id * 7 % 900 + 40 AS x1, path_id * 131 % 900 + 40 AS y1 FROM commands),
h AS (SELECT path_id, bool_or(NOT (greatest(x, nx) < x0 OR least(x, nx) > x1 OR greatest(y, ny) < y0 OR least(y, ny) > y1 OR least({_CORNERS}) > 0 OR greatest({_CORNERS}) < 0)) AS touched,
 sum(CASE WHEN y <= y0 + 20 AND ny > y0 + 20 AND (nx - x) * (y0 + 20 - y) - (x0 + 20 - x) * (ny - y) > 0 THEN 1 WHEN y > y0 + 20 AND ny <= y0 + 20 AND (nx - x) * (y0 + 20 - y) - (x0 + 20 - x) * (ny - y) < 0 THEN -1 ELSE 0 END) AS winding FROM r JOIN bx USING (path_id) GROUP BY path_id)
SELECT path_id, CASE WHEN touched THEN 'undecided' WHEN winding <> 0 THEN 'inside' ELSE 'outside' END AS relation FROM h"""
)
def box_relations(spark, sf_dir):
    """E17, E29 (polygons): whole boxes inside or outside a contour's fill."""
    p = fixture(spark, sf_dir, "commands")
    boxes = p.select("path_id").distinct().selectExpr("path_id", "path_id * 7 % 900 AS x0", "path_id * 131 % 900 AS y0", "path_id * 7 % 900 + 40 AS x1", "path_id * 131 % 900 + 40 AS y1")
    return contours.box_relation(p, boxes)


@query(
    cte("commands")
    + _RING
    + """, s AS (SELECT path_id, sign((nx - x) * (coalesce(lead(ny) OVER w, first_value(ny) OVER w) - ny) - (ny - y) * (coalesce(lead(nx) OVER w, first_value(nx) OVER w) - nx)) AS turn FROM r WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
o AS (SELECT path_id, min(turn)::BIGINT AS o FROM s GROUP BY path_id HAVING min(turn) = max(turn) AND min(turn) <> 0 AND count(*) > 2)
SELECT path_id, seq, o * (y - ny) AS a, o * (nx - x) AS b, o * (x * ny - nx * y) AS c FROM r JOIN o USING (path_id)"""
)
def half_planes(spark, sf_dir):
    """The half-planes of convex contours."""
    return contours.half_planes(fixture(spark, sf_dir, "commands"))


@query(
    cte("commands")
    + _RING
    + f""", k AS (SELECT path_id, seq, ((2 * x + 8) // 16) * 8 AS x, ((2 * y + 8) // 16) * 8 AS y, ((2 * nx + 8) // 16) * 8 AS nx, ((2 * ny + 8) // 16) * 8 AS ny FROM r),
c1 AS (SELECT a.path_id, a.seq AS i, b.seq AS j FROM r a JOIN r b ON a.path_id = b.path_id AND a.seq + 1 < b.seq AND {_CROSS}), c2 AS (SELECT a.path_id, a.seq AS i, b.seq AS j FROM k a JOIN k b ON a.path_id = b.path_id AND a.seq + 1 < b.seq AND {_CROSS}),
ch AS (SELECT DISTINCT path_id, true AS changed FROM ((SELECT * FROM c1 EXCEPT SELECT * FROM c2) UNION ALL (SELECT * FROM c2 EXCEPT SELECT * FROM c1))),
g AS (SELECT path_id, max(greatest(abs(r.x - k.x), abs(r.y - k.y)))::BIGINT AS worst, sign(sum(r.x * r.ny - r.nx * r.y)) <> sign(sum(k.x * k.ny - k.nx * k.y)) AS turned FROM r JOIN k USING (path_id, seq) GROUP BY path_id)
SELECT path_id, worst, CASE WHEN changed THEN 'topology' WHEN turned THEN 'area' ELSE 'ok' END AS code FROM g LEFT JOIN ch USING (path_id)"""
)
def grid_encodings(spark, sf_dir):
    """E8, Z3, Z12, E33, E39 (polygons): contours on a grid, their error, and whether they keep their topology."""
    return contours.grid_encoding(fixture(spark, sf_dir, "commands"), 8)


@query(
    cte("commands")
    + ", m AS (SELECT path_id, seq, 2 * x - y + 5 AS x, x + 3 * y + 7 AS y FROM commands), z AS (SELECT path_id, max(seq) + 1 AS seq, arg_min(x, seq) AS x, arg_min(y, seq) AS y, arg_max(x, seq) AS ex, arg_max(y, seq) AS ey FROM m GROUP BY path_id) SELECT * FROM m UNION ALL SELECT path_id, seq, x, y FROM z WHERE x <> ex OR y <> ey"
)
def closed_contours(spark, sf_dir):
    """Contours under a matrix, closed."""
    return contours.closed_under(fixture(spark, sf_dir, "commands"), (2, 1, -1, 3, 5, 7))


@query(
    "WITH v AS (SELECT p_partkey AS id, (p_partkey + 1) / 7.0::DOUBLE AS x FROM part), f AS (SELECT id, x, x::FLOAT::DOUBLE AS f FROM v), u AS (SELECT *, 2.0 ** (floor(log2(f)) - 23) AS u, 2.0 ** floor(log2(f)) AS p FROM f) SELECT id, CASE WHEN f <= x THEN f WHEN f = p THEN f - u / 2 ELSE f - u END AS low, CASE WHEN f >= x THEN f ELSE f + u END AS high FROM u"
)
def float_enclosures(spark, sf_dir):
    """The single-precision numbers that enclose a double."""
    low, high = scalar.float_enclosure((F.col("p_partkey") + 1) / F.lit(7.0))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), low.alias("low"), high.alias("high"))


@query("WITH v AS (SELECT o_orderkey AS id, o_orderkey * 65536 AS n FROM orders), r AS (SELECT id, n, floor(sqrt(n))::BIGINT AS r FROM v) SELECT id, (CASE WHEN (r - 1) * (r - 1) >= n AND r > 0 THEN r - 1 WHEN r * r >= n THEN r ELSE r + 1 END) / 256.0::DOUBLE AS bound FROM r")
def sqrt_bounds(spark, sf_dir):
    """The least multiple of 1/256 whose square isn't below a number."""
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scalar.sqrt_upper(F.col("o_orderkey"), 8).alias("bound"))


_AT = "((1 - t) ** 3 * p0 + 3 * (1 - t) ** 2 * t * p1 + 3 * (1 - t) * t ** 2 * p2 + t ** 3 * p3 - 500)"


@query(
    f"""WITH RECURSIVE c AS ({_CURVES}), s AS (SELECT * FROM c WHERE (p0 - 500) * (p3 - 500) < 0 AND (p1 > p0 AND p2 > p1 AND p3 > p2 OR p1 < p0 AND p2 < p1 AND p3 < p2)),
b AS (SELECT *, 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM s UNION ALL SELECT id, p0, p1, p2, p3, k + 1, CASE WHEN sign({_AT}) = sign(p0 - 500) THEN t ELSE lo END, CASE WHEN sign({_AT}) = sign(p0 - 500) THEN hi ELSE t END FROM (SELECT *, (lo + hi) / 2 AS t FROM b WHERE k < 24))
SELECT id, lo AS low, hi AS high FROM b WHERE k = 24"""
)
def crossing_brackets(spark, sf_dir):
    """Where a coordinate that runs one way crosses a level, by bisection on the sign."""
    p = [F.col(f"p{i}") for i in range(4)]
    one_way = F.expr("(p0 - 500) * (p3 - 500) < 0 AND (p1 > p0 AND p2 > p1 AND p3 > p2 OR p1 < p0 AND p2 < p1 AND p3 < p2)")
    held = geometry.bracket(p, 500.0, 24)
    return _curves(spark, sf_dir).where(one_way).select("id", held.alias("b")).select("id", "b.low", "b.high")


_CLIPS = """concat('<clipPath id="c', p_partkey, '" clipPathUnits="', CASE WHEN p_partkey % 5 = 0 THEN 'objectBoundingBox' ELSE 'userSpaceOnUse' END, '"><', CASE WHEN p_partkey % 7 = 0 THEN 'circle' ELSE 'rect' END, ' x="', p_partkey % 300, '" y="', p_partkey % 200, '" width="', p_size % 9, '" height="', p_size, '"/>', CASE WHEN p_partkey % 4 = 0 THEN '<rect/>' ELSE '' END, '</clipPath>')"""


@query(
    f"""WITH m AS (SELECT p_partkey AS id, {_CLIPS} AS t FROM part), k AS (SELECT *, regexp_extract(t, 'clipPathUnits="([A-Za-z]+)"', 1) AS units, len(regexp_extract_all(t, '<[a-z]+[ /]')) AS n, t LIKE '%<rect x=%' AS rect, regexp_extract(t, ' x="([0-9]+)"', 1)::BIGINT AS x, regexp_extract(t, ' y="([0-9]+)"', 1)::BIGINT AS y, regexp_extract(t, ' width="([0-9]+)"', 1)::BIGINT AS w, regexp_extract(t, ' height="([0-9]+)"', 1)::BIGINT AS h FROM m),
c AS (SELECT *, CASE WHEN units <> 'userSpaceOnUse' THEN 'units' WHEN n <> 1 THEN 'children' WHEN NOT rect THEN 'shape' WHEN w <= 0 OR h <= 0 THEN 'degenerate' ELSE 'ok' END AS code FROM k)
SELECT id, code, CASE WHEN code = 'ok' THEN x END AS x0, CASE WHEN code = 'ok' THEN y END AS y0, CASE WHEN code = 'ok' THEN x + w END AS x1, CASE WHEN code = 'ok' THEN y + h END AS y1 FROM c"""
)
def rect_clips(spark, sf_dir):
    """Clips that are one rectangle in the user's space; the first reason against any other."""
    markup = _table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_CLIPS} AS t")
    value = lambda a: F.regexp_extract("t", f' {a}="([0-9]+)"', 1).try_cast("long")
    read = markup.select("id", F.regexp_extract("t", 'clipPathUnits="([A-Za-z]+)"', 1).alias("units"), F.size(F.regexp_extract_all("t", F.lit("<[a-z]+[ /]"), 0)).alias("n"), F.col("t").contains("<rect x=").alias("rect"), value("x").alias("x"), value("y").alias("y"), value("width").alias("w"), value("height").alias("h"))
    code = F.when(F.col("units") != "userSpaceOnUse", "units").when(F.col("n") != 1, "children").when(~F.col("rect"), "shape").when(F.expr("w <= 0 OR h <= 0"), "degenerate").otherwise("ok")
    ok = lambda e, c: F.when(F.col("code") == "ok", F.expr(e)).alias(c)
    return read.withColumn("code", code).select("id", "code", ok("x", "x0"), ok("y", "y0"), ok("x + w", "x1"), ok("y + h", "y1"))


@query(
    f"WITH {_PIXELS}, s AS (SELECT image_id, sha256(string_agg(v::VARCHAR, ',' ORDER BY x)) AS digest FROM p GROUP BY image_id), d AS (SELECT image_id, sha256(string_agg((CASE WHEN x = 0 AND image_id % 3 = 0 THEN v + 1 ELSE v END)::VARCHAR, ',' ORDER BY x)) AS digest FROM p GROUP BY image_id UNION ALL SELECT image_id + 100000, digest FROM s WHERE image_id % 10 = 1), n AS (SELECT digest, count(*) AS n, min(image_id) AS target_id FROM d GROUP BY digest) SELECT image_id, CASE WHEN n = 1 THEN target_id END AS target_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS code FROM s LEFT JOIN n USING (digest)"
)
def photo_matches(spark, sf_dir):
    """Opaque photos matched by equal pixels; one target or none is taken."""
    p = raster.pixels(_table(spark, sf_dir, "embeddings"))
    source = raster.digests(p)
    changed = raster.digests(p.withColumn("v", F.expr("CASE WHEN x = 0 AND image_id % 3 = 0 THEN v + 1 ELSE v END")))
    targets = changed.union(source.where("image_id % 10 = 1").selectExpr("image_id + 100000", "digest"))
    return raster.match_digests(source, targets)


@query(
    """WITH v AS (SELECT event_id AS id, (event_id % 41 - 20)::DOUBLE * 2 AS pdx, (event_id % 37 - 18)::DOUBLE AS pdy, (event_id % 41 - 20)::DOUBLE * 2 + event_id % 6 AS dx, (event_id % 37 - 18)::DOUBLE AS dy, (event_id % 20)::DOUBLE / 20 AS response, (event_id % 11)::DOUBLE / 10 AS corr, (event_id % 7)::DOUBLE / 6 AS f1, event_id % 50 AS edges FROM events)
SELECT id, CASE WHEN edges < 24 THEN 'insufficient_edges' WHEN abs(pdx) > 32 OR abs(pdy) > 32 THEN 'max_shift_exceeded' WHEN response < 0.15 THEN 'weak_phase_response' WHEN abs(dx) > 32 OR abs(dy) > 32 THEN 'max_shift_exceeded' WHEN (dx - pdx) ** 2 + (dy - pdy) ** 2 > 16 THEN 'phase_ecc_disagreement'
 WHEN greatest(0, 1 - abs(dx) / 200) * greatest(0, 1 - abs(dy) / 100) < 0.85 THEN 'low_canvas_overlap' WHEN corr < 0.65 OR f1 < 0.4 THEN 'insufficient_matching_structure' ELSE 'phase_and_ecc_agree' END AS reason FROM v"""
)
def registration_gates(spark, sf_dir):
    """R2 (its gates): the first reason not to trust an estimated shift."""
    v = _table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "double(event_id % 41 - 20) * 2 AS phase_dx", "double(event_id % 37 - 18) AS phase_dy", "double(event_id % 41 - 20) * 2 + event_id % 6 AS dx", "double(event_id % 37 - 18) AS dy",
        "double(event_id % 20) / 20 AS response", "double(event_id % 11) / 10 AS correlation", "double(event_id % 7) / 6 AS f1", "event_id % 50 AS edges", "200D AS width", "100D AS height",
    )
    return v.select("id", raster.shift_reason().alias("reason"))
