"""Queries over native records: integer paths, ids, content types, ranges, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrid.functions import scalar
from scenegrid.operators import paths, records, relations
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.queries_geometry import _CURVES, _curves
from scenegrid.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(cte("commands") + " SELECT path_id, seq, CASE WHEN seq = 1 THEN 'moveTo' ELSE 'lnTo' END AS op, CASE WHEN path_id % 50 <> 0 THEN x * 9525 END AS x, CASE WHEN path_id % 50 <> 0 THEN y * 9525 END AS y, CASE WHEN path_id % 50 = 0 THEN 'range' ELSE 'ok' END AS code FROM commands")
def native_paths(spark, sf_dir):
    """Integer paths written as markup and decoded; coordinates beyond 32 bits are coded."""
    wide = F.when(F.col("path_id") % 50 == 0, F.lit(3_000_000_000)).otherwise(0)
    c = fixture(spark, sf_dir, "commands").select("path_id", "seq", (F.col("x") * scalar.EMU_PER_PX + wide).alias("x"), (F.col("y") * scalar.EMU_PER_PX).alias("y"))
    return paths.decode_native(paths.native_markup(c), "xml")


@query(cte("commands") + " SELECT path_id, string_agg(CASE WHEN seq = 1 THEN 'M' ELSE 'L' END || x || ',' || y, ' ' ORDER BY seq) AS data, count(*) FILTER (WHERE seq > 1) AS n_lines FROM commands GROUP BY path_id")
def flat_paths(spark, sf_dir):
    """Flat paths as path data."""
    c = fixture(spark, sf_dir, "commands").withColumn("op", F.when(F.col("seq") == 1, "M").otherwise("L"))
    n = c.groupBy("path_id").agg(F.count_if(F.col("seq") > 1).alias("n_lines"))
    return paths.write_lines(c).join(n, "path_id")


@query(f"WITH c AS ({_CURVES}) SELECT id, p0 AS a, round(p0 + (p1 - p0) * 2 / 3, 9) AS b, round(p2 + (p1 - p2) * 2 / 3, 9) AS c, p2 AS d, least(p0, p1, p2) AS low, greatest(p0, p1, p2) AS high FROM c")
def raised_quadratics(spark, sf_dir):
    """Quadratic curves as cubics, and bounds that hold both."""
    p0, p1, p2 = (F.col(f"p{i}") for i in range(3))
    third = lambda p: F.round(p + (p1 - p) * 2 / 3, 9)
    return _curves(spark, sf_dir).select("id", p0.alias("a"), third(p0).alias("b"), third(p2).alias("c"), p2.alias("d"), F.least(p0, p1, p2).alias("low"), F.greatest(p0, p1, p2).alias("high"))


@query(cte("boxes") + " SELECT a.scene_id, a.object_id AS a_id, b.object_id AS b_id FROM boxes a JOIN boxes b ON a.scene_id = b.scene_id AND a.object_id < b.object_id AND a.x - 2 * a.stroke_width < b.x + b.width + 2 * b.stroke_width AND b.x - 2 * b.stroke_width < a.x + a.width + 2 * a.stroke_width AND a.y - 2 * a.stroke_width < b.y + b.height + 2 * b.stroke_width AND b.y - 2 * b.stroke_width < a.y + a.height + 2 * a.stroke_width AND a.opacity > 0 AND b.opacity > 0")
def paint_overlaps(spark, sf_dir):
    """Paints that overlap with their strokes."""
    b = fixture(spark, sf_dir, "boxes").where("opacity > 0")
    grown = b.selectExpr("scene_id", "object_id", "x - 2 * stroke_width AS x", "y - 2 * stroke_width AS y", "width + 4 * stroke_width AS width", "height + 4 * stroke_width AS height")
    return relations.overlaps(grown).select("scene_id", "a_id", "b_id")


@query("WITH u AS (SELECT o_custkey AS package, (o_orderkey % 40 - 1) AS native_id, count(*) AS n FROM orders GROUP BY ALL) SELECT package, native_id, CASE WHEN native_id <= 0 THEN 'not_positive' WHEN n > 1 THEN 'repeated' END AS code FROM u WHERE native_id <= 0 OR n > 1")
def native_ids(spark, sf_dir):
    """Native ids are positive and unique within a slide."""
    return records.id_codes(_table(spark, sf_dir, "orders").selectExpr("o_custkey AS package", "o_orderkey % 40 - 1 AS native_id"), "package", "native_id")


@query("WITH w AS (SELECT DISTINCT lower(substr(o_orderpriority, 1, 1)) AS ext, 'type' || o_orderkey % 3 AS type FROM orders), k AS (SELECT * FROM (VALUES ('1', 'type1'), ('2', 'type2')) t(ext, known)), g AS (SELECT ext, count(*) AS n, min(type) AS type FROM w GROUP BY ext) SELECT ext, n, CASE WHEN n > 1 THEN 'conflict' WHEN known IS NULL THEN 'registered' WHEN known <> type THEN 'conflict' ELSE 'known' END AS code FROM g LEFT JOIN k USING (ext)")
def type_registration(spark, sf_dir):
    """Content types to register for extensions, and conflicts."""
    w = _table(spark, sf_dir, "orders").select(F.lower(F.substring("o_orderpriority", 1, 1)).alias("ext"), F.concat(F.lit("type"), F.expr("o_orderkey % 3")).alias("type"))
    known = spark.createDataFrame([("1", "type1"), ("2", "type2")], "ext string, known string")
    return records.register_types(w, known)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN floor(l_extendedprice * 9525 * 2.5 + 0.5) <= 2147483647 THEN floor(l_extendedprice * 9525 * 2.5 + 0.5)::BIGINT END AS scaled, CASE WHEN floor(l_extendedprice * 9525 * 2.5 + 0.5) > 2147483647 THEN 'range' ELSE 'ok' END AS code FROM lineitem")
def scaled_attributes(spark, sf_dir):
    """Scaled native attributes within 32 bits."""
    v = scalar.half_up(F.col("l_extendedprice") * scalar.EMU_PER_PX * F.lit(2.5))
    fits = v <= 2**31 - 1
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(fits, v).alias("scaled"), F.when(fits, "ok").otherwise("range").alias("code"))


@query("WITH g AS (SELECT p_partkey AS id, p_size * 60000 AS want, p_size * 60000 + p_partkey % 5 - 2 AS found FROM part) SELECT id, CASE WHEN abs(found - want) = 1 THEN want ELSE found END AS angle, CASE WHEN found = want THEN 'ok' WHEN abs(found - want) = 1 THEN 'corrected' ELSE 'mismatch' END AS code FROM g")
def gradient_angles(spark, sf_dir):
    """An angle off by one unit is put right, a larger difference fails."""
    g = _table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "bigint(p_size * 60000) AS want", "p_size * 60000 + p_partkey % 5 - 2 AS found")
    gap = F.abs(F.col("found") - F.col("want"))
    return g.select("id", F.when(gap == 1, F.col("want")).otherwise(F.col("found")).alias("angle"), F.when(gap == 0, "ok").when(gap == 1, "corrected").otherwise("mismatch").alias("code"))


@query("SELECT p_partkey AS id, floor(p_size / 77.0 * 100000 + 0.5)::BIGINT AS units, CASE WHEN floor(p_size / 77.0 * 100000 + 0.5) < 1 THEN 'vanishes' WHEN p_partkey % 4 <> 0 THEN 'width' ELSE 'ok' END AS code FROM part")
def hairline_units(spark, sf_dir):
    """Hairlines: zero width and an opacity that doesn't vanish when quantised."""
    units = scalar.half_up(F.col("p_size") / 77 * scalar.CROP_UNITS)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), units.alias("units"), F.when(units < 1, "vanishes").when(F.expr("p_partkey % 4 <> 0"), "width").otherwise("ok").alias("code"))


@query("SELECT lower(c_mktsegment) AS family, count(*) AS n, count(DISTINCT c_nationkey) AS faces, count(*) > 1 AS repeated FROM customer GROUP BY lower(c_mktsegment)")
def profile_families(spark, sf_dir):
    """Families that a profile names twice, whatever case."""
    name = F.expr("CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE initcap(c_mktsegment) END")
    return records.repeated_families(_table(spark, sf_dir, "customer"), name, "c_nationkey")


@query("WITH p AS (SELECT p_partkey AS pdf, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'CMMI10' WHEN 1 THEN 'ABCDEF+CMR7' WHEN 2 THEN 'Arial' ELSE 'CMSY10' END AS font FROM part) SELECT pdf, CASE WHEN font = 'Arial' THEN ['arial'] ELSE [] END AS unknown FROM p")
def embedded_fonts(spark, sf_dir):
    """Embedded fonts against the ones that may be there."""
    font = F.expr("CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'CMMI10' WHEN 1 THEN 'ABCDEF+CMR7' WHEN 2 THEN 'Arial' ELSE 'CMSY10' END")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pdf"), records.unlisted_fonts(F.array(font), "^cm(mi|r|sy|ex)[0-9]+$").alias("unknown"))


@query(cte("boxes") + " SELECT object_id, greatest(0, floor(x / 3))::BIGINT AS x0, least(300, ceil((x + width) / 3))::BIGINT AS x1, CASE WHEN ceil((x + width) / 3) <= 0 OR floor(x / 3) >= 300 OR least(300, ceil((x + width) / 3)) <= greatest(0, floor(x / 3)) THEN 'empty' ELSE 'ok' END AS code FROM boxes")
def pixel_boxes(spark, sf_dir):
    """Regions as pixel boxes cut to the image."""
    x0, x1 = F.greatest(F.lit(0), F.floor(F.col("x") / 3)), F.least(F.lit(300), F.ceil(F.expr("x + width") / 3))
    return fixture(spark, sf_dir, "boxes").select("object_id", x0.alias("x0"), x1.alias("x1"), F.when(x1 <= x0, "empty").otherwise("ok").alias("code"))


@query(cte("boxes") + " SELECT scene_id, CASE WHEN count(*) FILTER (WHERE rotation <> 0 AND kind = 'image') > 0 THEN 'rotated_picture' WHEN count(DISTINCT group_id) > 24 THEN 'many_groups' ELSE 'ok' END AS rule, count(*) FILTER (WHERE stroke_width > 1) AS heavy FROM boxes GROUP BY scene_id")
def profile_rules(spark, sf_dir):
    """Which rule of a profile a scene breaks first."""
    g = fixture(spark, sf_dir, "boxes").groupBy("scene_id").agg(F.count_if(F.expr("rotation <> 0 AND kind = 'image'")).alias("r"), F.countDistinct("group_id").alias("k"), F.count_if(F.col("stroke_width") > 1).alias("heavy"))
    return g.select("scene_id", records.first_code((F.col("r") > 0, "rotated_picture"), (F.col("k") > 24, "many_groups")).alias("rule"), "heavy")


@query("SELECT event_id, CASE WHEN event_id % 100 > 50 THEN 'unknown_id' WHEN user_id % 7 = 0 THEN 'page' WHEN value < 5 THEN 'bounds' ELSE 'ok' END AS code FROM events")
def recipe_rules(spark, sf_dir):
    """A recipe's ids, pages and bounds."""
    known = spark.range(51).select(F.col("id").alias("wanted"))
    e = _table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 100 AS wanted", "user_id % 7 AS page", "value")
    code = records.first_code((~F.col("listed"), "unknown_id"), (F.col("page") == 0, "page"), (F.col("value") < 5, "bounds"))
    return records.listed(e, known, ["wanted"]).select("event_id", code.alias("code"))


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS n_bytes, CASE WHEN left(text, 1) = '<' THEN 'markup' WHEN text = '' THEN 'empty' ELSE 'text' END AS kind FROM documents")
def ingested_assets(spark, sf_dir):
    """Size, digest and kind of what is taken in."""
    return records.described(_table(spark, sf_dir, "documents"), "doc_id", "text")


@query(cte("attachments") + ", c AS (SELECT parent_id, count(*) AS n, min(child_id) AS child FROM attachments WHERE parent_id IS NOT NULL GROUP BY parent_id) SELECT child_id AS id, a.parent_id IS NULL AS root, coalesce(n, 0) AS n_children, child FROM attachments a LEFT JOIN c ON c.parent_id = a.child_id")
def attachment_records(spark, sf_dir):
    """Each record of an attachment tree with its children."""
    a = fixture(spark, sf_dir, "attachments")
    children = a.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("child_id")).agg(F.count("*").alias("n"), F.min("child_id").alias("child"))
    return a.select("child_id", "parent_id").join(children, "child_id", "left").select(F.col("child_id").alias("id"), F.col("parent_id").isNull().alias("root"), F.coalesce("n", F.lit(0)).alias("n_children"), "child")
