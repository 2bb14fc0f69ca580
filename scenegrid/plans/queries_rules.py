"""Queries over single records and ordered records: predicates as findings, scalars, windows, sets, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrid.functions import scalar
from scenegrid.operators import records, rules
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.registry import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(cte("boxes") + " SELECT scene_id, object_id FROM boxes WHERE opacity > 0 AND NOT (kind = 'text' AND fill = 'none')")
def visible_objects(spark, sf_dir):
    """what is visible at all."""
    return fixture(spark, sf_dir, "boxes").where("opacity > 0 AND NOT (kind = 'text' AND fill = 'none')").select("scene_id", "object_id")


@query(
    cte("boxes")
    + """, f AS (SELECT scene_id, object_id, unnest([CASE WHEN x < -0.001 OR y < -0.001 OR x + width > 1000.001 OR y + height > 1000.001 THEN 'outside_canvas' END,
 CASE WHEN opacity < 0 OR opacity > 0.95 THEN 'bad_opacity' END, CASE WHEN NOT regexp_matches(fill, '^(none|#[0-9A-F]{6})$') THEN 'bad_colour' END,
 CASE WHEN width <= 1 THEN 'empty_box' END, CASE WHEN stroke_width > 0 AND kind = 'image' THEN 'stroked_image' END, CASE WHEN kind NOT IN ('path', 'text', 'image', 'formula') THEN 'unknown_kind' END]) AS code FROM boxes)
SELECT scene_id, object_id, code FROM f WHERE code IS NOT NULL"""
)
def object_findings(spark, sf_dir):
    """every rule of an object as a finding with a code; no row is dropped, nothing raises."""
    return rules.findings(fixture(spark, sf_dir, "boxes"), ["scene_id", "object_id"], rules.object_rules(1000.0, 1000.0, top_opacity=0.95))


@query(
    cte("nodes", "edges")
    + """ SELECT 'duplicate_slot' AS code, min(node_id) AS id FROM nodes GROUP BY scene_id, stage, lane2 HAVING count(*) > 1
UNION ALL SELECT 'unknown_from', edge_id FROM edges WHERE from_id NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'unknown_to', edge_id FROM edges WHERE to_id NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'self_loop', edge_id FROM edges WHERE from_id = to_id
UNION ALL SELECT 'stage_range', node_id FROM nodes WHERE stage > 12 OR stage < 0
UNION ALL SELECT 'lane_range', node_id FROM nodes WHERE lane2 > 15"""
)
def spec_findings(spark, sf_dir):
    """a graph spec: unique slots, known ends, no self loops, ranges."""
    return rules.spec_findings(fixture(spark, sf_dir, "nodes"), fixture(spark, sf_dir, "edges"))


_STOPS = "WITH g AS (SELECT p_partkey AS id, [0.0::DOUBLE, ((p_size % 10) / 10.0)::DOUBLE, ((p_partkey % 11) / 10.0)::DOUBLE, (CASE WHEN p_partkey % 3 = 0 THEN 0.9 ELSE 1.0 END)::DOUBLE] AS o FROM part)"


@query(_STOPS + " SELECT id, CASE WHEN list_min(o) <> 0 OR list_max(o) <> 1 THEN 'span' WHEN NOT (o[1] < o[2] AND o[2] < o[3] AND o[3] < o[4]) THEN 'order' ELSE 'ok' END AS code FROM g")
def gradient_stops(spark, sf_dir):
    """quantised stops grow strictly and span 0 to 1."""
    stops = F.array(F.lit(0.0), F.expr("double(p_size % 10) / 10"), F.expr("double(p_partkey % 11) / 10"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 0.9D ELSE 1.0D END"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rules.gradient_code(stops).alias("code"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'hairline_width' WHEN p_partkey % 6 = 0 THEN 'miter' WHEN p_size % 3 <> 0 THEN 'miter_join' ELSE 'ok' END AS code FROM part")
def stroke_rules(spark, sf_dir):
    """F8: caps, joins, miter limits and hairlines."""
    s = _table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size % 5 = 0 AS hairline", "double(p_size % 7 + 1) AS stroke_width", "CASE WHEN p_size % 3 = 0 THEN 'miter' ELSE 'round' END AS join", "double(p_partkey % 6) AS miterlimit", "'butt' AS cap", "'path' AS kind")
    return s.select("id", rules.stroke_code().alias("code"))


@query("SELECT p_partkey AS id, CASE WHEN NOT regexp_matches(p_name, '^[ -~]*$') THEN 'not_ascii' WHEN length(p_name) - 1 <> length(p_name) - 1 - CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END THEN 'length' WHEN p_size * 21 > 1000 THEN 'range' ELSE 'ok' END AS code FROM part")
def spacing_rules(spark, sf_dir):
    """one character spacing less than characters, ASCII only, bounded."""
    n = F.length("p_name") - 1 - F.expr("CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END")
    s = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.array_repeat(F.col("p_size") * 21, n).alias("spacing"))
    return s.select("id", rules.spacing_code("text", "spacing").alias("code"))


@query(
    r"""WITH m AS (SELECT p_partkey AS id, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '\frac{a}{b}' WHEN 1 THEN '\input{x}' WHEN 2 THEN '{a^^b}' WHEN 3 THEN '{{a}' ELSE '\alpha_{i}+\beta' END AS tex FROM part)
SELECT id, CASE WHEN contains(tex, '^^') THEN 'double_caret' WHEN tex LIKE '%input%' THEN 'command' WHEN length(replace(tex, '{', '')) <> length(replace(tex, '}', '')) THEN 'braces' ELSE 'ok' END AS code FROM m"""
)
def math_rules(spark, sf_dir):
    """only known commands, balanced braces of bounded depth, no double caret."""
    m = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(r"CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '\\frac{a}{b}' WHEN 1 THEN '\\input{x}' WHEN 2 THEN '{a^^b}' WHEN 3 THEN '{{a}' ELSE '\\alpha_{i}+\\beta' END").alias("tex"))
    return m.select("id", rules.math_code("tex").alias("code"))


@query(cte("boxes") + " SELECT object_id, CASE WHEN x >= 100 AND y >= 100 AND x + width <= 600 AND y + height <= 600 THEN 'inside' WHEN x < 600 AND 100 < x + width AND y < 600 AND 100 < y + height THEN 'partial' ELSE 'skipped' END AS status FROM boxes")
def region_split(spark, sf_dir):
    """a region splits objects into inside, partial and skipped; none vanishes."""
    return fixture(spark, sf_dir, "boxes").select("object_id", rules.region_status(100.0, 100.0, 600.0, 600.0).alias("status"))


@query(cte("boxes") + ", w AS (SELECT o_orderkey * 3 AS id FROM orders WHERE o_orderkey % 20 = 0) SELECT id, CASE WHEN object_id IS NULL THEN 'unknown_id' WHEN kind <> 'path' THEN 'wrong_kind' ELSE 'selected' END AS code FROM w LEFT JOIN boxes ON id = object_id")
def paint_selection(spark, sf_dir):
    """a selection by id; unknown ids and wrong kinds are coded."""
    wanted = _table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").selectExpr("o_orderkey * 3 AS object_id")
    code = F.when(F.col("kind").isNull(), "unknown_id").when(F.col("kind") != "path", "wrong_kind").otherwise("selected")
    return wanted.join(fixture(spark, sf_dir, "boxes").select("object_id", "kind"), "object_id", "left").select(F.col("object_id").alias("id"), code.alias("code"))


@query(cte("boxes") + ", l AS (SELECT object_id FROM boxes WHERE object_id % 9 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0) SELECT object_id, object_id IN (SELECT object_id FROM boxes) AS known FROM l")
def locked_objects(spark, sf_dir):
    """locks from objects and from the manifest's list; the list may name unknown ids."""
    boxes = fixture(spark, sf_dir, "boxes")
    locks = boxes.where("object_id % 9 = 0").select("object_id").union(_table(spark, sf_dir, "customer").where("c_custkey % 11 = 0").select("c_custkey")).distinct()
    return locks.join(boxes.select("object_id", F.lit(True).alias("known")), "object_id", "left").select("object_id", F.coalesce("known", F.lit(False)).alias("known"))


_PATHS = "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'media/' || p_name WHEN 1 THEN '../' || p_name WHEN 2 THEN '/abs/' || p_name WHEN 3 THEN 'a/./b' WHEN 4 THEN 'a/../../b' ELSE 'ppt/slides/slide1.xml' END"


@query(f"WITH p AS (SELECT p_partkey AS id, {_PATHS} AS path FROM part) SELECT id, CASE CAST(id % 6 AS INT) WHEN 1 THEN 'escapes' WHEN 2 THEN 'absolute' WHEN 3 THEN 'dot_segment' WHEN 4 THEN 'escapes' ELSE 'ok' END AS code FROM p")
def part_names(spark, sf_dir):
    """paths stay relative and inside; package members have plain names."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_PATHS).alias("path")).select("id", rules.path_code("path").alias("code"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 = 0 THEN 'supported' WHEN o_orderkey % 4 = 2 AND o_orderkey % 3 <> 0 THEN 'supported' ELSE 'unsupported' END AS code FROM orders")
def policy_lookup(spark, sf_dir):
    """Which policy a backend supports, by a table."""
    allowed = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (2, 2)], "backend bigint, policy bigint")
    asked = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 4 AS backend", "o_orderkey % 3 AS policy")
    return records.listed(asked, allowed, ["backend", "policy"]).select("id", F.when(F.col("listed"), "supported").otherwise("unsupported").alias("code"))


@query(
    "WITH r AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS seen FROM conversations GROUP BY conv_id) SELECT conv_id, list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(seen, x)) AS missing, CASE WHEN len(list_filter(['assistant', 'user'], lambda x: NOT list_contains(seen, x))) = 0 THEN 'no_observed_issue' ELSE 'needs_further_review' END AS status FROM r"
)
def review_roles(spark, sf_dir):
    """The roles a review must have seen."""
    return records.missing_roles(_table(spark, sf_dir, "conversations"), "conv_id", "role", ("assistant", "user"), ("assistant", "system", "user"))


@query("SELECT event_id, list_filter(json_keys(replace(props, '{', '{\"id\": 1, ')), lambda k: k <> 'id') AS unknown FROM events")
def unknown_keys(spark, sf_dir):
    """Keys of a JSON record that its schema doesn't have."""
    props = F.regexp_replace("props", r"\{", '{"id": 1, ')
    return _table(spark, sf_dir, "events").select("event_id", F.array_except(F.json_object_keys(props), F.array(F.lit("id"))).alias("unknown"))


_JSON = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN props WHEN 1 THEN props || 'x' WHEN 2 THEN '{\"a\": 1, \"a\": 2}' ELSE '[1, 2' END"


@query("SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'ok' ELSE 'malformed' END AS code FROM events")
def strict_json(spark, sf_dir):
    """Strict records: bad syntax and repeated keys are coded, not raised."""
    return _table(spark, sf_dir, "events").select("event_id", rules.json_code(F.expr(_JSON)).alias("code"))


# scalars


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, floor(l_extendedprice / 7 * 9525 + 0.5)::BIGINT AS emu, (floor(-l_extendedprice / 8) + CASE WHEN -l_extendedprice / 8 - floor(-l_extendedprice / 8) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS rounded FROM lineitem")
def emu_snap(spark, sf_dir):
    """Pixels to EMU and the half-up rounding of negative numbers."""
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", scalar.emu(F.col("l_extendedprice") / 7).alias("emu"), scalar.js_round(-F.col("l_extendedprice") / 8).alias("rounded"))


_LENGTH = "CAST(p_size AS STRING) || CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'px' WHEN 1 THEN 'pt' WHEN 2 THEN 'pc' WHEN 3 THEN 'in' WHEN 4 THEN 'cm' WHEN 5 THEN 'MM' WHEN 6 THEN ' q' WHEN 7 THEN '' ELSE 'em' END"


@query("SELECT p_partkey AS id, round(p_size * CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 96 / 72 WHEN 2 THEN 16 WHEN 3 THEN 96 WHEN 4 THEN 96 / 2.54 WHEN 5 THEN 96 / 25.4 WHEN 6 THEN 96 / 101.6 WHEN 7 THEN 1 END, 9)::DOUBLE AS px FROM part")
def length_units(spark, sf_dir):
    """Lengths with units as pixels; unknown units are null."""
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(scalar.length_px(F.expr(_LENGTH)), 9).alias("px"))


@query(
    "SELECT p_partkey AS id, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '#ff0000' WHEN 1 THEN '#aabbcc' WHEN 2 THEN '#12ab9f' WHEN 3 THEN '#' || lower(printf('%02x%02x%02x', p_size, p_size * 2, 7)) WHEN 4 THEN 'none' END AS colour FROM part"
)
def colours(spark, sf_dir):
    """Colours to one notation; others are null."""
    text = F.expr("CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN ' Red' WHEN 1 THEN '#abc' WHEN 2 THEN '#12ab9f' WHEN 3 THEN 'rgb(' || p_size || ', ' || p_size * 2 || ',7)' WHEN 4 THEN 'none' ELSE 'url(#g)' END")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalar.colour(text).alias("colour"))


@query(
    cte("boxes")
    + """ SELECT object_id, round(least(200 / width, 100 / height), 9) AS scale, round(x + (200 - width * least(200 / width, 100 / height)) / 2, 9) AS fx, round(y + (100 - height * least(200 / width, 100 / height)) / 2, 9) AS fy, round(width * least(200 / width, 100 / height), 9) AS fw, round(height * least(200 / width, 100 / height), 9) AS fh FROM boxes"""
)
def contain_fit(spark, sf_dir):
    """The largest centred box of the same aspect."""
    b = fixture(spark, sf_dir, "boxes")
    fit = scalar.contain(F.col("width"), F.col("height"), F.col("x"), F.col("y"), F.lit(200.0), F.lit(100.0))
    return b.select("object_id", *[F.round(c, 9).alias(n) for n, c in fit.items()])


@query("SELECT p_partkey AS id, floor(p_size / 200.0 * 100000 + 0.5)::BIGINT AS l, floor((p_partkey % 50) / 60.0 * 100000 + 0.5)::BIGINT AS r, CASE WHEN floor(p_size / 200.0 * 100000 + 0.5) + floor((p_partkey % 50) / 60.0 * 100000 + 0.5) >= 100000 THEN 'empty' ELSE 'ok' END AS code FROM part")
def crop_units(spark, sf_dir):
    """Crop fractions as integer units; a crop that leaves nothing is coded."""
    left, right = scalar.half_up(F.col("p_size") / 200 * scalar.CROP_UNITS), scalar.half_up(F.expr("double(p_partkey % 50) / 60") * scalar.CROP_UNITS)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), left.alias("l"), right.alias("r"), F.when(left + right >= scalar.CROP_UNITS, "empty").otherwise("ok").alias("code"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) ELSE lower(p_name) END AS name, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'boldItalic' WHEN 1 THEN 'bold' WHEN 2 THEN 'italic' ELSE 'regular' END AS style FROM part")
def font_names(spark, sf_dir):
    """Font and style names in one form."""
    name = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'ABCDEF+' || p_name ELSE p_name END")
    style = F.expr("CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Bold Oblique' WHEN 1 THEN 'SemiBold' WHEN 2 THEN 'Italic' ELSE 'Book' END")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalar.font_name(name).alias("name"), scalar.style_name(style).alias("style"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_size > 40 THEN NULL ELSE round(p_size / 40.0, 9)::DOUBLE END AS opacity, CASE WHEN p_partkey % 4 = 3 OR p_size > 40 THEN 'invalid' WHEN p_size = 0 THEN 'invisible' ELSE 'ok' END AS code FROM part")
def opacities(spark, sf_dir):
    """Opacities as text; outside 0 to 1 or no number is coded."""
    value = F.expr("CASE WHEN p_partkey % 4 = 3 THEN 'half' ELSE string(double(p_size) / 40) END").try_cast("double")
    good = F.when((value >= 0) & (value <= 1), F.round(value, 9))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), good.alias("opacity"), F.when(good.isNull(), "invalid").when(good == 0, "invisible").otherwise("ok").alias("code"))


@query(
    "WITH RECURSIVE r AS (SELECT p_partkey AS id, p_size / 60.0 AS s, 0 AS n FROM part UNION ALL SELECT id, s * 2, n + 1 FROM r WHERE s <= 0.5 AND n < 16) SELECT id, max(n)::BIGINT AS stages, round(max(s), 9)::DOUBLE AS rest FROM r GROUP BY id"
)
def minification(spark, sf_dir):
    """Halve while the largest singular value is at most a half, sixteen times at most."""
    s = F.col("p_size") / 60
    n = F.least(F.lit(16), F.greatest(F.lit(0), F.when(s > 0, F.floor(-F.log2(s)) + F.when(s > 0.5, 0).otherwise(0)).otherwise(16)))
    n = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0).cast("long"), lambda a, _: F.when(s * F.pow(F.lit(2.0), a) <= 0.5, a + 1).otherwise(a))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), n.alias("stages"), F.round(s * F.pow(F.lit(2.0), n), 9).alias("rest"))


@query("SELECT o_orderkey AS id, o_orderkey * 2 % 100 AS required, CASE WHEN o_custkey % 300 >= o_orderkey * 2 % 100 THEN 'ok' ELSE 'undersampled' END AS code FROM orders")
def delivery_sampling(spark, sf_dir):
    """Stored pixels per shown pixel against the least allowed."""
    need, have = F.expr("o_orderkey * 2 % 100"), F.expr("o_custkey % 300")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), need.alias("required"), F.when(have >= need, "ok").otherwise("undersampled").alias("code"))


@query("SELECT doc_id, sha256(concat_ws('|', doc_id, lang, source, text)) AS digest, 'recognition:' || left(sha256(text), 16) AS unknown_id FROM documents")
def record_digests(spark, sf_dir):
    """Digests of records in a fixed order of fields, and ids for evidence without one."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "doc_id", "lang", "source", "text"), 256).alias("digest"), F.concat(F.lit("recognition:"), F.left(F.sha2("text", 256), F.lit(16))).alias("unknown_id"))


# windows


@query(cte("commands") + " SELECT path_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM commands WINDOW w AS (PARTITION BY path_id ORDER BY seq)")
def ring_edges(spark, sf_dir):
    """Edges of a ring, the last back to the first."""
    return rules.ring(fixture(spark, sf_dir, "commands"))


@query(cte("commands") + ", d AS (SELECT path_id, seq, x // 200 AS x, lag(x // 200) OVER (PARTITION BY path_id ORDER BY seq) AS before FROM commands) SELECT path_id, seq, x FROM d WHERE x IS DISTINCT FROM before")
def collapse_repeats(spark, sf_dir):
    """Consecutive duplicates taken out."""
    c = fixture(spark, sf_dir, "commands").selectExpr("path_id", "seq", "x div 200 AS x")
    return c.withColumn("before", F.lag("x").over(Window.partitionBy("path_id").orderBy("seq"))).where("NOT (x <=> before)").drop("before")


@query(cte("commands") + ", d AS (SELECT path_id, seq, x // 100 AS x, y // 100 AS y FROM commands), e AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM d WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, seq, x, y FROM e WHERE px IS NULL OR nx IS NULL OR (x - px) * (ny - y) <> (y - py) * (nx - x)")
def collinear_middles(spark, sf_dir):
    """Points in line with both neighbours taken out, with exact integer cross products."""
    return rules.drop_collinear(fixture(spark, sf_dir, "commands").selectExpr("path_id", "seq", "x div 100 AS x", "y div 100 AS y"))


@query(cte("commands") + ", d AS (SELECT path_id, seq, x, y, sum(CASE WHEN seq % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY seq) AS subpath FROM commands) SELECT path_id, seq, subpath::BIGINT AS subpath, first_value(x) OVER (PARTITION BY path_id, subpath ORDER BY seq) AS sx, first_value(y) OVER (PARTITION BY path_id, subpath ORDER BY seq) AS sy FROM d")
def subpaths(spark, sf_dir):
    """Numbers of subpaths and the point that closing returns to."""
    return rules.subpaths(fixture(spark, sf_dir, "commands").withColumn("op", F.expr("CASE WHEN seq % 4 = 1 THEN 'M' ELSE 'L' END")))


@query(cte("boxes") + " SELECT scene_id, object_id, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(z_index, ordinal), ordinal) AS slot FROM boxes")
def painter_order(spark, sf_dir):
    """The order of painting; without a z-index the place in the list counts."""
    return rules.painter_order(fixture(spark, sf_dir, "boxes")).select("scene_id", "object_id", "slot")


@query(cte("boxes") + ", s AS (SELECT scene_id, group_id, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(z_index, ordinal), ordinal) AS slot FROM boxes) SELECT scene_id, group_id, count(*) AS n, max(slot) - min(slot) + 1 = count(*) AS contiguous FROM s GROUP BY ALL")
def contiguous_groups(spark, sf_dir):
    """Whether the members of a group are painted one after the other."""
    slots = rules.painter_order(fixture(spark, sf_dir, "boxes"))
    return slots.groupBy("scene_id", "group_id").agg(F.count("*").alias("n"), (F.max("slot") - F.min("slot") + 1 == F.count("*")).alias("contiguous"))


@query(cte("log") + ", d AS (SELECT scene_id, event_id, seq, sum(CASE op WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY seq)::BIGINT AS depth FROM log) SELECT scene_id, event_id, depth, min(depth) OVER (PARTITION BY scene_id ORDER BY seq) < 0 AS broken FROM d")
def event_depth(spark, sf_dir):
    """How deep begin and end events are nested; an end without a begin breaks the log."""
    step = F.expr("CASE op WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END")
    w = Window.partitionBy("scene_id").orderBy("seq")
    deep = fixture(spark, sf_dir, "log").withColumn("depth", F.sum(step).over(w))
    return deep.select("scene_id", "event_id", "depth", (F.min("depth").over(w) < 0).alias("broken"))


@query(cte("commands") + ", d AS (SELECT path_id, seq, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS l FROM commands WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, seq, round(coalesce(sum(l) OVER (PARTITION BY path_id ORDER BY seq), 0), 6) AS at FROM d")
def arc_length(spark, sf_dir):
    """Length along a path up to each point."""
    w = Window.partitionBy("path_id").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return fixture(spark, sf_dir, "commands").withColumn("l", step).select("path_id", "seq", F.round(F.coalesce(F.sum("l").over(w), F.lit(0.0)), 6).alias("at"))


# limits, budgets


@query("WITH f AS (SELECT user_id AS scene_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT scene_id, event_id, CASE WHEN r <= 10 THEN 'shown' ELSE 'limit' END AS code, n FROM f WHERE r <= 11")
def capped_diagnostics(spark, sf_dir):
    """The first ten findings of a scene and one marker for the rest."""
    e = _table(spark, sf_dir, "events").withColumnRenamed("user_id", "scene_id")
    r = F.row_number().over(Window.partitionBy("scene_id").orderBy("ts", "event_id"))
    n = F.count("*").over(Window.partitionBy("scene_id"))
    return e.select("scene_id", "event_id", r.alias("r"), n.alias("n")).where("r <= 11").select("scene_id", "event_id", F.expr("CASE WHEN r <= 10 THEN 'shown' ELSE 'limit' END").alias("code"), "n")


@query(cte("log") + " SELECT scene_id, event_id, sum(dx) OVER (PARTITION BY scene_id ORDER BY seq) AS used, CASE WHEN sum(dx) OVER (PARTITION BY scene_id ORDER BY seq) > 2000 THEN 'budget_exceeded' ELSE 'ok' END AS code FROM log")
def running_budget(spark, sf_dir):
    """A running total against a limit."""
    used = F.sum("dx").over(Window.partitionBy("scene_id").orderBy("seq"))
    return fixture(spark, sf_dir, "log").select("scene_id", "event_id", used.alias("used"), F.when(used > 2000, "budget_exceeded").otherwise("ok").alias("code"))


@query(
    "WITH RECURSIVE "
    + cte("log")[5:]
    + ", r AS (SELECT scene_id, seq, event_id, CASE WHEN dx <= 300 THEN dx ELSE 0 END AS used, dx <= 300 AS taken FROM log WHERE seq = 1 UNION ALL SELECT l.scene_id, l.seq, l.event_id, CASE WHEN used + dx <= 300 THEN used + dx ELSE used END, used + dx <= 300 FROM r JOIN log l ON l.scene_id = r.scene_id AND l.seq = r.seq + 1) SELECT scene_id, count(*) FILTER (WHERE taken) AS n_taken, count(*) FILTER (WHERE NOT taken) AS n_skipped, max(used) AS used FROM r GROUP BY scene_id"
)
def roi_budget(spark, sf_dir):
    """Regions in order while they fit the budget; a skipped region's cost isn't added."""
    return rules.greedy_budget(fixture(spark, sf_dir, "log"), "scene_id", "seq", "dx", 300.0)
