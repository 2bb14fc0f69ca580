"""Queries over the smaller steps: curve splits, hits, strings of styles, audits put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.functions import geometry, scalar
from scenegrid.operators import raster, records, relations, text
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.queries_geometry import _CURVES, _curves
from scenegrid.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(
    cte("boxes")
    + """, s AS (SELECT scene_id, object_id AS segment_id, x AS x1, y AS y1, CASE WHEN object_id % 2 = 0 THEN x + 90 ELSE x END AS x2, CASE WHEN object_id % 2 = 0 THEN y ELSE y + 90 END AS y2 FROM boxes)
SELECT s.scene_id, segment_id, count(*) AS n FROM s JOIN boxes b ON b.scene_id = s.scene_id AND b.object_id <> segment_id AND (x1 = x2 AND b.x < x1 AND x1 < b.x + b.width AND y2 > b.y AND y1 < b.y + b.height OR y1 = y2 AND b.y < y1 AND y1 < b.y + b.height AND x2 > b.x AND x1 < b.x + b.width) GROUP BY ALL"""
)
def segment_hits(spark, sf_dir):
    """Route segments through the inside of boxes, by cells."""
    boxes = fixture(spark, sf_dir, "boxes")
    s = boxes.selectExpr("scene_id", "object_id AS segment_id", "x", "y", "CASE WHEN object_id % 2 = 0 THEN 90D ELSE 0D END AS width", "CASE WHEN object_id % 2 = 0 THEN 0D ELSE 90D END AS height")
    return relations.segments_through(s, boxes).groupBy("scene_id", "segment_id").agg(F.count("*").alias("n"))


@query(cte("boxes") + ", m AS (SELECT object_id, x * 9525 AS fx FROM boxes WHERE object_id % 6 <> 0 UNION ALL SELECT object_id, y FROM boxes WHERE object_id % 10 = 0), c AS (SELECT object_id, count(*) AS n, min(fx) AS fx FROM m GROUP BY object_id) SELECT object_id, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN fx END AS fx, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'ok' END AS code FROM boxes LEFT JOIN c USING (object_id)")
def frame_lookup(spark, sf_dir):
    """The mapped frame of each object, which must be one."""
    boxes = fixture(spark, sf_dir, "boxes")
    frames = boxes.where("object_id % 6 <> 0").selectExpr("object_id", "x * 9525 AS fx").union(boxes.where("object_id % 10 = 0").selectExpr("object_id", "y"))
    c = frames.groupBy("object_id").agg(F.count("*").alias("n"), F.min("fx").alias("fx"))
    out = boxes.select("object_id").join(c, "object_id", "left")
    code = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("ok")
    return out.select("object_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("fx")).alias("fx"), code.alias("code"))


@query(f"WITH c AS ({_CURVES}) SELECT id, (p0 + p1) / 2 AS a, (p0 + 2 * p1 + p2) / 4 AS b, (p0 + 3 * p1 + 3 * p2 + p3) / 8 AS m, (p1 + 2 * p2 + p3) / 4 AS c, (p2 + p3) / 2 AS d FROM c")
def split_curves(spark, sf_dir):
    """Curves cut in the middle, exact on dyadic numbers."""
    a, b, m, c, d = geometry.halves(*(F.col(f"p{i}") for i in range(4)))
    return _curves(spark, sf_dir).select("id", a.alias("a"), b.alias("b"), m.alias("m"), c.alias("c"), d.alias("d"))


@query(f"WITH c AS ({_CURVES}) SELECT id, CASE WHEN p1 >= p0 AND p2 >= p1 AND p3 >= p2 AND greatest(p1 - p0, p2 - p1, p3 - p2) > 0 THEN 1 WHEN p1 <= p0 AND p2 <= p1 AND p3 <= p2 AND least(p1 - p0, p2 - p1, p3 - p2) < 0 THEN -1 ELSE 0 END::BIGINT AS direction FROM c")
def monotone_curves(spark, sf_dir):
    """Coordinates that run one way only, by the coefficients of the derivative."""
    return _curves(spark, sf_dir).select("id", geometry.monotone(*(F.col(f"p{i}") for i in range(4))).alias("direction"))


@query(f"WITH c AS ({_CURVES}) SELECT id, CASE WHEN greatest(p0, p1, p2, p3) <= 200 OR least(p0, p1, p2, p3) >= 600 THEN 'outside' WHEN least(p0, p1, p2, p3) >= 200 AND greatest(p0, p1, p2, p3) <= 600 THEN 'inside' ELSE 'undecided' END AS code FROM c")
def hull_decisions(spark, sf_dir):
    """What the hull of the control points decides about a region; the rest stays undecided."""
    p = [F.col(f"p{i}") for i in range(4)]
    code = F.when((F.greatest(*p) <= 200) | (F.least(*p) >= 600), "outside").when((F.least(*p) >= 200) & (F.greatest(*p) <= 600), "inside").otherwise("undecided")
    return _curves(spark, sf_dir).select("id", code.alias("code"))


@query(cte("boxes") + " SELECT object_id, '<a:ln w=\"' || floor(stroke_width * 9525 + 0.5)::BIGINT || '\" cap=\"' || CASE CAST(object_id % 3 AS INT) WHEN 0 THEN 'flat' WHEN 1 THEN 'rnd' ELSE 'sq' END || '\"><a:solidFill><a:srgbClr val=\"' || substr(fill, 2) || '\"/></a:solidFill></a:ln>' AS xml FROM boxes WHERE stroke_width > 0 AND fill <> 'none'")
def stroke_markup(spark, sf_dir):
    """Strokes as markup."""
    b = fixture(spark, sf_dir, "boxes").where("stroke_width > 0 AND fill <> 'none'")
    cap = F.expr("CASE CAST(object_id % 3 AS INT) WHEN 0 THEN 'butt' WHEN 1 THEN 'round' ELSE 'square' END")
    return b.select("object_id", scalar.stroke_xml(F.col("stroke_width"), cap, F.col("fill")).alias("xml"))


@query(cte("boxes") + " SELECT object_id, CASE WHEN stroke_width <> 0 THEN 'not_hairline' WHEN fill = 'none' THEN 'no_paint' WHEN opacity <= 0 THEN 'invisible' ELSE 'ok' END AS code FROM boxes WHERE kind = 'path'")
def hairline_audit(spark, sf_dir):
    """Hairlines of the final deck: no width, paint, and visible."""
    code = F.when(F.col("stroke_width") != 0, "not_hairline").when(F.col("fill") == "none", "no_paint").when(F.col("opacity") <= 0, "invisible").otherwise("ok")
    return fixture(spark, sf_dir, "boxes").where("kind = 'path'").select("object_id", code.alias("code"))


@query("WITH r AS (SELECT DISTINCT s_nationkey AS family, CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'regular' WHEN 1 THEN 'bold' WHEN 2 THEN 'italic' ELSE 'boldItalic' END AS role FROM supplier) SELECT family, count(*) AS n_roles, CASE WHEN count(*) = 4 THEN 'PASS' WHEN bool_or(role = 'regular') THEN 'REVIEW' ELSE 'FAIL' END AS status FROM r GROUP BY family")
def font_profiles(spark, sf_dir):
    """Families whose roles are all there; without a regular face a family fails."""
    role = F.expr("CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN 'regular' WHEN 1 THEN 'bold' WHEN 2 THEN 'italic' ELSE 'boldItalic' END")
    r = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), role.alias("role")).distinct()
    return r.groupBy("family").agg(F.count("*").alias("n_roles"), F.when(F.count("*") == 4, "PASS").when(F.bool_or(F.col("role") == "regular"), "REVIEW").otherwise("FAIL").alias("status"))


@query(cte("boxes") + " SELECT object_id, floor(x / 7)::BIGINT AS x0, floor(y / 7)::BIGINT AS y0, ceil((x + width) / 7)::BIGINT AS x1, ceil((y + height) / 7)::BIGINT AS y1, x >= 0 AND x + width <= 1000 AND y >= 0 AND y + height <= 1000 AS inside FROM boxes")
def crop_regions(spark, sf_dir):
    """Regions rounded outward to pixels, and whether the image holds them."""
    low, high = lambda e: F.floor(F.expr(e) / 7), lambda e: F.ceil(F.expr(e) / 7)
    inside = F.expr("x >= 0 AND x + width <= 1000 AND y >= 0 AND y + height <= 1000")
    return fixture(spark, sf_dir, "boxes").select("object_id", low("x").alias("x0"), low("y").alias("y0"), high("x + width").alias("x1"), high("y + height").alias("y1"), inside.alias("inside"))


@query(cte("boxes") + " SELECT object_id, CASE WHEN kind <> 'image' THEN 'kind' WHEN rotation <> 0 THEN 'rotated' WHEN opacity < 1 THEN 'opacity' ELSE 'eligible' END AS code FROM boxes")
def picture_eligibility(spark, sf_dir):
    """Plain pictures only; the first reason against each other object."""
    code = F.when(F.col("kind") != "image", "kind").when(F.col("rotation") != 0, "rotated").when(F.col("opacity") < 1, "opacity").otherwise("eligible")
    return fixture(spark, sf_dir, "boxes").select("object_id", code.alias("code"))


@query(cte("boxes", "log") + ", e AS (SELECT scene_id, count(*) AS n FROM log WHERE op = 'error' GROUP BY scene_id), b AS (SELECT scene_id, count(*) FILTER (WHERE opacity = 0) AS hidden, count(*) AS n FROM boxes GROUP BY scene_id) SELECT b.scene_id, b.n AS objects, hidden, coalesce(e.n, 0) AS errors, CASE WHEN coalesce(e.n, 0) > 0 THEN 'FAIL' WHEN hidden > 0 THEN 'UNRESOLVED' ELSE 'VERIFIED_IN_DECLARED_SCOPE' END AS status FROM b LEFT JOIN e USING (scene_id)")
def fidelity_audit(spark, sf_dir):
    """What was replayed, what is hidden and what failed, as one status per scene."""
    errors = fixture(spark, sf_dir, "log").where("op = 'error'").groupBy("scene_id").agg(F.count("*").alias("errors"))
    b = fixture(spark, sf_dir, "boxes").groupBy("scene_id").agg(F.count("*").alias("objects"), F.count_if(F.col("opacity") == 0).alias("hidden"))
    n = F.coalesce("errors", F.lit(0))
    out = b.join(errors, "scene_id", "left").withColumn("errors", n)
    return out.withColumn("status", records.audit_status(F.col("errors"), F.col("hidden")))


@query("WITH a AS (SELECT o_orderkey AS xref, md5(o_orderpriority) AS digest FROM orders), b AS (SELECT xref, CASE WHEN xref % 101 = 0 THEN 'x' ELSE digest END AS digest FROM a WHERE xref % 103 <> 0) SELECT count(*) AS n, count(b.xref) AS kept, count(*) FILTER (WHERE a.digest = b.digest) AS identical FROM a LEFT JOIN b USING (xref)")
def object_snapshots(spark, sf_dir):
    """Objects of a document before and after a change to others."""
    a = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("xref"), F.md5("o_orderpriority").alias("before"))
    b = a.where("xref % 103 <> 0").select("xref", F.expr("CASE WHEN xref % 101 = 0 THEN 'x' ELSE before END").alias("after"))
    return a.join(b, "xref", "left").agg(F.count("*").alias("n"), F.count("after").alias("kept"), F.count_if(F.col("before") == F.col("after")).alias("identical"))


@query(cte("commands") + ", f AS (SELECT path_id, list(seq ORDER BY seq) AS s FROM commands GROUP BY path_id) SELECT path_id, CASE WHEN path_id % 3 = 0 THEN false WHEN len(s) = 1 AND path_id % 3 = 1 THEN true ELSE true END AS prefix FROM f WHERE len(s) > 1")
def prefix_requests(spark, sf_dir):
    """Requested ids must be a prefix of the order of painting."""
    order = fixture(spark, sf_dir, "commands").groupBy("path_id").agg(F.sort_array(F.collect_list("seq")).alias("s")).where("size(s) > 1")
    wanted = F.expr("CASE WHEN path_id % 3 = 0 THEN slice(s, 2, 1) ELSE slice(s, 1, size(s) - 1) END")
    return order.withColumn("w", wanted).select("path_id", (F.slice("s", F.lit(1), F.size("w")) == F.col("w")).alias("prefix"))


@query(
    "WITH RECURSIVE m AS (SELECT vec_id AS image_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE floor(abs(embedding[i]) * 1000)::BIGINT % 256 > 140), "
    "r AS (SELECT image_id, x, y, x AS sx, y AS sy FROM m UNION SELECT r.image_id, m.x, m.y, r.sx, r.sy FROM r JOIN m ON m.image_id = r.image_id AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1), "
    "c AS (SELECT image_id, x, y, min(sy * 8 + sx) AS part FROM r GROUP BY ALL) SELECT image_id, min(x) AS \"left\", min(y) AS top, max(x) AS \"right\", max(y) AS bottom, count(*) AS area FROM c GROUP BY image_id, part HAVING count(*) >= 2"
)
def pixel_components(spark, sf_dir):
    """Connected components of foreground pixels, of a least size."""
    p = raster.pixels(_table(spark, sf_dir, "embeddings")).where("v > 140")
    return raster.components(p.selectExpr("image_id", "x % 8 AS x", "x div 8 AS y"), 2)


@query()
def grapheme_wrap(spark, sf_dir):
    """Wrapping that never cuts what a reader sees as one character."""
    return text.wrap_graphemes(_table(spark, sf_dir, "documents"), "doc_id", "text", 60)
