"""Queries over relationships: endpoints, comparisons, spatial joins, graphs, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrid.operators import graph, records, relations
from scenegrid.operators.tables import tasks
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.registry import query

#: Short literals that are broadcast at once.
LITERAL_BLOCK = 2000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(cte("edges", "nodes") + ", e AS (SELECT edge_id, 'from_id' AS \"end\", from_id AS missing_id FROM edges UNION ALL SELECT edge_id, 'to_id', to_id FROM edges) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = e.missing_id)")
def dangling_endpoints(spark, sf_dir):
    """Ends of edges that name no node."""
    return relations.dangling(fixture(spark, sf_dir, "edges"), fixture(spark, sf_dir, "nodes"), "node_id").select("edge_id", "end", "missing_id")


_CONNECT = """, c AS (
  SELECT edge_id, from_id, to_id, route,
    CASE from_site WHEN 'left' THEN a.x WHEN 'right' THEN a.x + a.width ELSE a.x + a.width / 2 END AS x1,
    CASE from_site WHEN 'top' THEN a.y WHEN 'bottom' THEN a.y + a.height ELSE a.y + a.height / 2 END AS y1,
    CASE to_site WHEN 'left' THEN b.x WHEN 'right' THEN b.x + b.width ELSE b.x + b.width / 2 END AS x2,
    CASE to_site WHEN 'top' THEN b.y WHEN 'bottom' THEN b.y + b.height ELSE b.y + b.height / 2 END AS y2
  FROM edges JOIN boxes a ON a.object_id = from_id JOIN boxes b ON b.object_id = to_id)"""


@query(cte("edges", "boxes") + _CONNECT + " SELECT *, CASE WHEN route = 'elbow' THEN (x1 + x2) / 2 END AS mid_x FROM c")
def connector_geometry(spark, sf_dir):
    """Connectors from the sites of their ends."""
    return relations.connect(fixture(spark, sf_dir, "edges"), fixture(spark, sf_dir, "boxes"))


@query(cte("attachments") + " SELECT child_id, child_id - child_id % 7 AS root_id, child_id % 7 AS depth, false AS on_cycle, NULL::VARCHAR AS code FROM attachments")
def attachment_topology(spark, sf_dir):
    """Depth and root of each attachment."""
    return graph.attachment_order(fixture(spark, sf_dir, "attachments"))


@query(
    "WITH RECURSIVE a AS (SELECT o_orderkey AS child_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent_id, (o_custkey % 9)::DOUBLE AS dx, (o_custkey % 5)::DOUBLE AS dy FROM orders), "
    "r AS (SELECT child_id, child_id AS root_id, 0::DOUBLE AS dx, 0::DOUBLE AS dy FROM a WHERE parent_id IS NULL UNION ALL SELECT a.child_id, r.root_id, r.dx + a.dx, r.dy + a.dy FROM a JOIN r ON r.child_id = a.parent_id) SELECT a.child_id, root_id, r.dx, r.dy, CASE WHEN r.child_id IS NULL THEN 'dangling' END AS code FROM a LEFT JOIN r USING (child_id)"
)
def resolved_offsets(spark, sf_dir):
    """Labels placed by the sum of the offsets above them."""
    return graph.resolve_offsets(fixture(spark, sf_dir, "attachments"))


@query(
    cte("attachments")
    + ", ring AS (SELECT child_id, CASE WHEN child_id % 49 < 7 THEN child_id - child_id % 7 + (child_id + 1) % 7 ELSE parent_id END AS parent_id FROM attachments) SELECT child_id FROM ring WHERE child_id % 49 < 7 AND child_id - child_id % 7 + 6 <= (SELECT max(child_id) FROM attachments)"
)
def attachment_cycles(spark, sf_dir):
    """G1: members of cycles. Every seventh run of seven records is closed to a ring."""
    a = fixture(spark, sf_dir, "attachments")
    closed = a.withColumn("parent_id", F.when(F.expr("child_id % 49 < 7"), F.expr("child_id - child_id % 7 + (child_id % 7 + 1) % 7")).otherwise(F.col("parent_id")))
    return graph.attachment_order(closed).where("on_cycle").select("child_id")


@query(
    "WITH RECURSIVE defs AS (SELECT o_orderkey AS def_id, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN NULL WHEN 5 THEN o_orderkey - 2 WHEN 4 THEN o_orderkey + 1 WHEN 3 THEN o_orderkey - 1 WHEN 2 THEN o_orderkey - 1 ELSE o_orderkey - 1 END AS target_id FROM orders), "
    "uses AS (SELECT o_orderkey AS use_id, CASE WHEN o_orderkey % 10 = 9 THEN -o_orderkey ELSE o_orderkey END AS ref_id FROM orders), "
    "r AS (SELECT use_id, ref_id AS at_, 1 AS steps FROM uses UNION ALL SELECT use_id, target_id, steps + 1 FROM r JOIN defs ON def_id = at_ WHERE target_id IS NOT NULL), "
    "l AS (SELECT use_id, arg_max(at_, steps) AS at_, max(steps) AS steps FROM r GROUP BY use_id) "
    "SELECT use_id, CASE WHEN def_id IS NOT NULL THEN at_ END AS final_id, steps::BIGINT AS steps, CASE WHEN def_id IS NULL THEN 'dangling' END AS code FROM l LEFT JOIN defs ON def_id = at_"
)
def reference_chains(spark, sf_dir):
    """Chains of references to their end, dangling ones coded."""
    orders = _table(spark, sf_dir, "orders")
    target = F.expr("CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN NULL WHEN 5 THEN o_orderkey - 2 WHEN 4 THEN o_orderkey + 1 WHEN 3 THEN o_orderkey - 1 WHEN 2 THEN o_orderkey - 1 ELSE o_orderkey - 1 END")
    definitions = orders.select(F.col("o_orderkey").alias("def_id"), target.alias("target_id"))
    uses = orders.select(F.col("o_orderkey").alias("use_id"), F.expr("CASE WHEN o_orderkey % 10 = 9 THEN -o_orderkey ELSE o_orderkey END").alias("ref_id"))
    return graph.expand_references(uses, definitions)


@query(
    cte("boxes")
    + """, g AS (SELECT scene_id, x - 16 AS x0, y - 16 AS y0, x + width + 16 AS x1, y + height + 16 AS y1 FROM boxes),
xs AS (SELECT scene_id, x0 AS x FROM g UNION SELECT scene_id, x1 FROM g), ys AS (SELECT scene_id, y0 AS y FROM g UNION SELECT scene_id, y1 FROM g)
SELECT scene_id, x, y FROM xs JOIN ys USING (scene_id) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.scene_id = xs.scene_id AND x > x0 AND x < x1 AND y > y0 AND y < y1)"""
)
def routing_grid(spark, sf_dir):
    """The orthogonal visibility grid around obstacles."""
    return graph.routing_grid(fixture(spark, sf_dir, "boxes"), 16.0)


@query(
    cte("boxes")
    + """ SELECT a.scene_id, a.object_id AS a_id, b.object_id AS b_id, greatest(a.x, b.x) AS x, greatest(a.y, b.y) AS y,
  least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS width, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS height
FROM boxes a JOIN boxes b ON a.scene_id = b.scene_id AND a.object_id < b.object_id
 AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height"""
)
def box_overlaps(spark, sf_dir):
    """Overlapping boxes of a scene and their intersection, by grid cells."""
    return relations.overlaps(fixture(spark, sf_dir, "boxes"))


@query(
    cte("boxes")
    + """, g AS (SELECT scene_id, group_id, min(x) - 8 AS gx, min(y) - 8 AS gy, max(x + width) + 8 AS gr, max(y + height) + 8 AS gb FROM boxes WHERE object_id % 10 < 3 GROUP BY ALL)
SELECT g.scene_id, g.group_id, object_id FROM g JOIN boxes b ON b.scene_id = g.scene_id AND NOT (b.group_id = g.group_id AND object_id % 10 < 3)
 AND x < gr AND gx < x + width AND y < gb AND gy < y + height"""
)
def group_intrusions(spark, sf_dir):
    """Objects that lie over the frame of a group they don't belong to."""
    boxes = fixture(spark, sf_dir, "boxes")
    frames = boxes.where("object_id % 10 < 3").groupBy("scene_id", "group_id").agg((F.min("x") - 8).alias("gx"), (F.min("y") - 8).alias("gy"), (F.max(F.col("x") + F.col("width")) + 8).alias("gr"), (F.max(F.col("y") + F.col("height")) + 8).alias("gb"))
    others = boxes.select("scene_id", "object_id", F.col("group_id").alias("own"), "x", "y", "width", "height")
    member = (F.col("own") == F.col("group_id")) & (F.col("object_id") % 10 < 3)
    return others.join(frames, "scene_id").where(~member & F.expr("x < gr AND gx < x + width AND y < gb AND gy < y + height")).select("scene_id", "group_id", "object_id")


@query(
    cte("boxes")
    + """, t AS (SELECT scene_id, object_id, substr(group_id, 1, 7) AS label, x, y FROM boxes)
SELECT a.scene_id, a.label, a.object_id AS a_id, b.object_id AS b_id FROM t a JOIN t b ON a.scene_id = b.scene_id AND a.label = b.label AND a.object_id < b.object_id AND abs(a.x - b.x) <= 120 AND abs(a.y - b.y) <= 120"""
)
def duplicate_labels(spark, sf_dir):
    """Equal labels close to one another, by neighbouring cells."""
    return relations.duplicate_texts(fixture(spark, sf_dir, "boxes").withColumn("label", F.substring("group_id", 1, 7)), 120.0)


_SEGMENTS = """, s AS (SELECT path_id % 500 AS scene_id, path_id * 100 + seq AS segment_id, x AS x1, y AS y1,
 CASE WHEN seq % 2 = 0 THEN x + 150 ELSE x END AS x2, CASE WHEN seq % 2 = 0 THEN y ELSE y + 150 END AS y2 FROM commands)"""


@query(
    cte("commands")
    + _SEGMENTS
    + """ SELECT h.scene_id, h.segment_id AS h_id, v.segment_id AS v_id, v.x1 AS x, h.y1 AS y FROM s h JOIN s v ON h.scene_id = v.scene_id AND h.y1 = h.y2 AND v.x1 = v.x2
 AND v.x1 > h.x1 AND v.x1 < h.x2 AND h.y1 > v.y1 AND h.y1 < v.y2"""
)
def route_crossings(spark, sf_dir):
    """Crossings of horizontal and vertical route segments, by cells along each."""
    s = fixture(spark, sf_dir, "commands").selectExpr("path_id % 500 AS scene_id", "path_id * 100 + seq AS segment_id", "x AS x1", "y AS y1", "CASE WHEN seq % 2 = 0 THEN x + 150 ELSE x END AS x2", "CASE WHEN seq % 2 = 0 THEN y ELSE y + 150 END AS y2")
    return relations.crossings(s)


@query(
    "SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'extra' ELSE 'changed' END AS code FROM documents WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0 OR doc_id % 11 = 0 AND doc_id % 13 <> 0 OR doc_id % 7 = 0 AND doc_id % 13 <> 0 AND doc_id % 11 <> 0"
)
def scene_diff(spark, sf_dir):
    """Missing, extra and changed records between two versions."""
    docs = _table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    new = docs.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.expr("CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END"), 256).alias("digest"))
    return relations.compare(old, new, "doc_id", "digest")


@query(
    """WITH a AS (SELECT p_partkey AS object_id, p_size AS size, p_brand AS brand, p_type AS kind FROM part),
b AS (SELECT object_id, CASE WHEN object_id % 9 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN object_id % 4 = 0 THEN NULL ELSE brand END AS brand, kind FROM a)
SELECT a.object_id, field, expected, found FROM a JOIN b USING (object_id), LATERAL (VALUES ('size', a.size::VARCHAR, b.size::VARCHAR), ('brand', a.brand, b.brand), ('kind', a.kind, b.kind)) v(field, expected, found) WHERE expected IS DISTINCT FROM found"""
)
def replay_diff(spark, sf_dir):
    """Fields that differ between a replayed and an actual scene."""
    a = _table(spark, sf_dir, "part").selectExpr("p_partkey AS object_id", "p_size AS size", "p_brand AS brand", "p_type AS kind")
    b = a.selectExpr("object_id", "CASE WHEN object_id % 9 = 0 THEN size + 1 ELSE size END AS size", "CASE WHEN object_id % 4 = 0 THEN NULL ELSE brand END AS brand", "kind")
    return relations.field_diff(a, b, "object_id", ["size", "brand", "kind"])


@query(
    cte("boxes")
    + """, n AS (SELECT 'shape source_id=' || object_id || ' ' || kind AS description, x AS nx FROM boxes WHERE object_id % 8 <> 0)
SELECT object_id, CASE WHEN nx IS NULL THEN 'missing_native' WHEN nx <> x THEN 'moved' ELSE 'verified' END AS status FROM boxes LEFT JOIN n ON object_id = CAST(regexp_extract(description, 'source_id=([0-9]+)', 1) AS BIGINT)"""
)
def native_match(spark, sf_dir):
    """Scene objects with the native shapes that name them in their description."""
    boxes = fixture(spark, sf_dir, "boxes")
    native = boxes.where("object_id % 8 <> 0").select(F.concat(F.lit("shape source_id="), F.col("object_id"), F.lit(" "), F.col("kind")).alias("description"), F.col("x").alias("nx"))
    native = native.select(F.regexp_extract("description", "source_id=([0-9]+)", 1).cast("long").alias("object_id"), "nx")
    status = F.when(F.col("nx").isNull(), "missing_native").when(F.col("nx") != F.col("x"), "moved").otherwise("verified")
    return boxes.join(native, "object_id", "left").select("object_id", status.alias("status"))


@query(
    cte("boxes")
    + """, l AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(z_index, ordinal), ordinal) AS place, kind AS left_name FROM boxes),
r AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY ordinal) AS place, kind AS right_name FROM boxes WHERE ordinal < 97)
SELECT scene_id, place, left_name, right_name, coalesce(left_name = right_name, false) AS agrees FROM l FULL JOIN r USING (scene_id, place)"""
)
def exporter_match(spark, sf_dir):
    """Shapes matched by their place; the names must agree."""
    boxes = fixture(spark, sf_dir, "boxes")
    return relations.match_by_order(boxes, boxes.where("ordinal < 97"), "scene_id", [F.coalesce("z_index", "ordinal"), F.col("ordinal")], [F.col("ordinal")], "kind")


@query("WITH k AS (SELECT lower(regexp_replace(s_name, '^[A-Z]{6}\\+', '')) AS name FROM supplier UNION ALL SELECT lower(s_name) FROM supplier WHERE s_suppkey % 10 = 0), w AS (SELECT n_nationkey, 'supplier#' || lpad((n_nationkey * 5)::VARCHAR, 9, '0') AS name FROM nation), c AS (SELECT name, count(*) AS n FROM k GROUP BY name) SELECT n_nationkey, name, coalesce(n, 0)::BIGINT AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN n = 1 THEN 'verified_match' ELSE 'ambiguous' END AS status FROM w LEFT JOIN c USING (name)")
def font_match(spark, sf_dir):
    """Names looked up in a registry: none, one or many."""
    suppliers = _table(spark, sf_dir, "supplier")
    plain = F.lower(F.regexp_replace("s_name", r"^[A-Z]{6}\+", "")).alias("name")
    registry = suppliers.select(plain).union(suppliers.where("s_suppkey % 10 = 0").select(F.lower("s_name")))
    wanted = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("supplier#"), F.lpad((F.col("n_nationkey") * 5).cast("string"), 9, "0")).alias("name"))
    return relations.lookup_status(wanted, registry, "name")


@query(
    """WITH g AS (SELECT p_partkey AS gid, sha256(concat_ws('|', p_size, substr(p_brand, 1, 8), p_partkey % 40)) AS signature, (p_partkey % 300)::BIGINT AS unicode FROM part),
src AS (SELECT * FROM g WHERE gid % 3 = 0), cand AS (SELECT * FROM g WHERE gid % 3 <> 0),
m AS (SELECT src.gid, count(*) AS n, min(cand.unicode) AS unicode, count(DISTINCT cand.unicode) AS names FROM src JOIN cand USING (signature) GROUP BY src.gid)
SELECT src.gid, CASE WHEN names = 1 THEN m.unicode END AS unicode, CASE WHEN names = 1 THEN 'UNIQUE' ELSE 'UNRESOLVED' END AS status FROM src LEFT JOIN m ON src.gid = m.gid"""
)
def glyph_recovery(spark, sf_dir):
    """Glyphs whose exact signature has one code point among the candidates."""
    g = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gid"), F.sha2(F.concat_ws("|", "p_size", F.substring("p_brand", 1, 8), F.expr("p_partkey % 40")), 256).alias("signature"), F.expr("p_partkey % 300").alias("unicode"))
    candidates = g.where("gid % 3 <> 0").groupBy("signature").agg(F.min("unicode").alias("unicode"), F.countDistinct("unicode").alias("names"))
    one = F.coalesce(F.col("names") == 1, F.lit(False))
    return g.where("gid % 3 = 0").select("gid", "signature").join(candidates, "signature", "left").select("gid", F.when(one, F.col("unicode")).alias("unicode"), F.when(one, "UNIQUE").otherwise("UNRESOLVED").alias("status"))


@query("WITH a AS (SELECT o_orderkey AS gid, o_custkey % 200 AS unicode FROM orders), b AS (SELECT gid, CASE WHEN gid % 17 = 0 THEN unicode + 1 ELSE unicode END AS unicode FROM a WHERE gid % 23 <> 0) SELECT gid, a.unicode AS declared, b.unicode AS found, CASE WHEN b.gid IS NULL THEN 'missing' ELSE 'mismatch' END AS code FROM a LEFT JOIN b USING (gid) WHERE b.unicode IS DISTINCT FROM a.unicode")
def glyph_bindings(spark, sf_dir):
    """Declared and found bindings of glyphs, where they differ."""
    a = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS gid", "o_custkey % 200 AS declared")
    b = a.where("gid % 23 <> 0").selectExpr("gid", "CASE WHEN gid % 17 = 0 THEN declared + 1 ELSE declared END AS found", "true AS _in")
    return a.join(b, "gid", "left").where("NOT (declared <=> found)").select("gid", "declared", "found", F.expr("CASE WHEN _in IS NULL THEN 'missing' ELSE 'mismatch' END").alias("code"))


@query("SELECT o_custkey AS mask_id, list_sort(list(DISTINCT o_orderkey % 50)) AS parents, count(*) AS n FROM orders GROUP BY o_custkey")
def mask_owners(spark, sf_dir):
    """The parents that share each soft mask."""
    return records.owners(_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "mask_id"), "mask_id", F.expr("o_orderkey % 50"))


@query("WITH a AS (SELECT s_suppkey % 7 AS role, s_name AS path, sha256(s_name) AS digest FROM supplier), b AS (SELECT s_suppkey % 7 AS role, s_name AS path, sha256(CASE WHEN s_suppkey % 12 = 0 THEN s_name || 'x' ELSE s_name END) AS digest FROM supplier WHERE s_suppkey % 19 <> 0) (SELECT 'not_found' AS code, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT 'not_declared', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))")
def review_bindings(spark, sf_dir):
    """Bindings (role, path, digest) declared and found must be the same multiset."""
    s = _table(spark, sf_dir, "supplier")
    row = [F.expr("s_suppkey % 7").alias("role"), F.col("s_name").alias("path")]
    a = s.select(*row, F.sha2("s_name", 256).alias("digest"))
    b = s.where("s_suppkey % 19 <> 0").select(*row, F.sha2(F.expr("CASE WHEN s_suppkey % 12 = 0 THEN s_name || 'x' ELSE s_name END"), 256).alias("digest"))
    return a.exceptAll(b).select(F.lit("not_found").alias("code"), "*").union(b.exceptAll(a).select(F.lit("not_declared"), "*"))


@query("WITH u AS (SELECT DISTINCT lang, unnest(string_split(regexp_replace(text, '[\\p{Cc}\\p{Cf}]', '', 'g'), '')) AS ch FROM documents) SELECT lang, ch, count(*) OVER (PARTITION BY lang) AS n FROM u WHERE ch <> '' AND NOT regexp_matches(ch, '^[ -~]$')")
def font_coverage(spark, sf_dir):
    """Visible code points of each role that the face (here: ASCII) doesn't hold."""
    docs = _table(spark, sf_dir, "documents")
    seen = docs.select("lang", F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[\p{Cc}\p{Cf}]", ""), ""))).alias("ch")).where("ch <> ''").distinct()
    cmap = spark.range(32, 127).select(F.char(F.col("id")).alias("ch"))
    return seen.join(cmap, "ch", "left_anti").select("lang", "ch", F.count("*").over(Window.partitionBy("lang")).alias("n"))


@query(
    """WITH k AS (SELECT n_regionkey AS deck, n_nationkey AS id FROM nation), a AS (SELECT n_regionkey AS deck, n_nationkey + d AS id FROM nation, (VALUES (0), (100)) t(d)),
m AS (SELECT deck, max(id) AS top FROM k GROUP BY deck), h AS (SELECT deck, max(id) AS high FROM a GROUP BY deck),
j AS (SELECT a.deck, a.id, k.id IS NOT NULL AS taken, greatest(top, high) AS base FROM a LEFT JOIN k USING (deck, id) JOIN m USING (deck) JOIN h USING (deck))
SELECT deck, id, (CASE WHEN taken THEN base + sum(CASE WHEN taken THEN 1 ELSE 0 END) OVER (PARTITION BY deck ORDER BY id) ELSE id END)::BIGINT AS new_id FROM j"""
)
def merge_ids(spark, sf_dir):
    """Ids of merged shapes remapped past collisions."""
    kept = _table(spark, sf_dir, "nation").selectExpr("n_regionkey AS deck", "n_nationkey AS id")
    added = kept.union(kept.selectExpr("deck", "id + 100"))
    return relations.remap_ids(kept, added, "deck", "id").withColumn("new_id", F.col("new_id").cast("long"))


@query(
    cte("boxes")
    + """, s AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY coalesce(z_index, ordinal), ordinal) AS slot FROM boxes)
SELECT a.scene_id, a.object_id AS owner_id, b.object_id AS between_id FROM s a JOIN s m ON m.scene_id = a.scene_id AND m.object_id = a.object_id + 1
JOIN s b ON b.scene_id = a.scene_id AND b.slot > least(a.slot, m.slot) AND b.slot < greatest(a.slot, m.slot) AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height"""
)
def grouping_paint_overlap(spark, sf_dir):
    """Objects painted between two members of an attachment that overlap it; they forbid grouping."""
    b = fixture(spark, sf_dir, "boxes")
    n = tasks(b, relations.BOXES)
    s = b.repartition(n, "scene_id").withColumn("slot", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.coalesce("z_index", "ordinal"), "ordinal")))
    pair = lambda a, b: F.struct(F.col(a).alias("a_id"), F.col(b).alias("b_id"))
    met = relations.overlaps(s).select("scene_id", F.inline(F.array(pair("a_id", "b_id"), pair("b_id", "a_id")))).repartition(n, "scene_id", "a_id")
    slot = s.select("scene_id", "object_id", "slot")
    owner = met.join(slot.select("scene_id", F.col("object_id").alias("a_id"), F.col("slot").alias("sa")), ["scene_id", "a_id"])
    owner = owner.join(slot.select("scene_id", (F.col("object_id") - 1).alias("a_id"), F.col("slot").alias("sm")), ["scene_id", "a_id"])
    between = slot.select("scene_id", F.col("object_id").alias("b_id"), F.col("slot").alias("sb"))
    return owner.repartition(n, "scene_id", "b_id").join(between, ["scene_id", "b_id"]).where("sb > least(sa, sm) AND sb < greatest(sa, sm)").select("scene_id", F.col("a_id").alias("owner_id"), F.col("b_id").alias("between_id"))


@query(
    cte("boxes")
    + """, p AS (SELECT scene_id, group_id, width / (object_id % 7 + 1) AS lo, width / (object_id % 7 + 1) + height / 3 AS hi FROM boxes WHERE kind = 'image')
SELECT scene_id, group_id, max(lo) AS low, min(hi) AS high, max(lo) <= min(hi) AND max(lo) > 0 AS feasible, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1"""
)
def shared_grid(spark, sf_dir):
    """Pictures of a group share a grid if the intervals of their scales meet."""
    p = fixture(spark, sf_dir, "boxes").where("kind = 'image'").selectExpr("scene_id", "group_id", "width / (object_id % 7 + 1) AS lo", "width / (object_id % 7 + 1) + height / 3 AS hi")
    return p.groupBy("scene_id", "group_id").agg(F.max("lo").alias("low"), F.min("hi").alias("high"), F.count("*").alias("n")).where("n > 1").withColumn("feasible", F.expr("low <= high AND low > 0"))


@query(
    """WITH h AS (SELECT user_id AS job, event_id, floor(value)::BIGINT AS revision, event_type AS digest, ts FROM events),
w AS (SELECT *, max(revision) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
c AS (SELECT job, revision FROM h GROUP BY ALL HAVING count(DISTINCT digest) > 1)
SELECT job, event_id, CASE WHEN before IS NULL OR revision > before THEN 'new' WHEN c.job IS NOT NULL THEN 'conflict' WHEN revision = before THEN 'same' ELSE 'stale' END AS status FROM w LEFT JOIN c USING (job, revision)"""
)
def revision_history(spark, sf_dir):
    """Revisions must grow, and an equal revision must have an equal digest."""
    h = _table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", F.floor("value").alias("revision"), F.col("event_type").alias("digest"), "ts")
    before = F.max("revision").over(Window.partitionBy("job").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    clash = h.groupBy("job", "revision").agg(F.countDistinct("digest").alias("k")).where("k > 1").select("job", "revision", F.lit(True).alias("clash"))
    status = F.when(F.col("before").isNull() | (F.col("revision") > F.col("before")), "new").when(F.col("clash"), "conflict").when(F.col("revision") == F.col("before"), "same").otherwise("stale")
    return h.withColumn("before", before).join(clash, ["job", "revision"], "left").select("job", "event_id", status.alias("status"))


@query(
    cte("log", "boxes")
    + """, d AS (SELECT object_id, sum(dx) AS dx, sum(dy) AS dy, count(*) AS n FROM log WHERE op = 'click' OR op = 'view' GROUP BY object_id)
SELECT b.object_id, b.x + dx AS x, b.y + dy AS y, n, b.object_id % 9 = 0 AS locked, CASE WHEN b.object_id % 9 = 0 THEN 'locked_object_changed' END AS code FROM boxes b JOIN d USING (object_id)"""
)
def patch_translate(spark, sf_dir):
    """Translations of a patch summed per object; changes of locked objects are coded."""
    moves = fixture(spark, sf_dir, "log").where("op = 'click' OR op = 'view'").groupBy("object_id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.count("*").alias("n"))
    locked = F.expr("object_id % 9 = 0")
    return fixture(spark, sf_dir, "boxes").join(moves, "object_id").select("object_id", F.expr("x + dx").alias("x"), F.expr("y + dy").alias("y"), "n", locked.alias("locked"), F.when(locked, "locked_object_changed").alias("code"))


@query(
    cte("log")
    + """, b AS (SELECT object_id, max(CASE WHEN op = 'purchase' THEN seq END) AS last_set FROM log GROUP BY object_id),
s AS (SELECT l.object_id, sum(CASE WHEN seq = last_set THEN dx WHEN (last_set IS NULL OR seq > last_set) AND op <> 'purchase' THEN dy ELSE 0 END) AS x FROM log l JOIN b USING (object_id) GROUP BY l.object_id) SELECT object_id, x FROM s"""
)
def patch_fold(spark, sf_dir):
    """K1: an ordered patch of setbox and translate: what follows the last setbox counts."""
    log = fixture(spark, sf_dir, "log")
    ops = log.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "dx", "dy"))).alias("ops"))
    fold = F.aggregate("ops", F.lit(0.0), lambda x, o: F.when(o["op"] == "purchase", o["dx"]).otherwise(x + o["dy"]))
    return ops.select("object_id", fold.alias("x"))


@query("SELECT user_id AS job, event_id, CASE WHEN event_id % 3 = 0 THEN 'bad_digest' WHEN event_id % 4 = 0 THEN 'stale_revision' ELSE 'accepted' END AS code, CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 THEN event_id % 50 + 1 END AS revision FROM events")
def patch_guard(spark, sf_dir):
    """K1, K3: a patch is accepted if its base revision and digest are the current ones."""
    e = _table(spark, sf_dir, "events").selectExpr("user_id AS job", "event_id", "event_id % 50 AS current")
    e = e.selectExpr("*", "sha2(string(current), 256) AS digest", "CASE WHEN event_id % 4 = 0 THEN current - 1 ELSE current END AS base", "sha2(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE string(current) END, 256) AS base_digest")
    code = F.when(F.col("digest") != F.col("base_digest"), "bad_digest").when(F.col("base") != F.col("current"), "stale_revision").otherwise("accepted")
    return e.select("job", "event_id", code.alias("code"), F.when(code == "accepted", F.col("current") + 1).alias("revision"))


@query("SELECT user_id AS job, coalesce(max(event_id % 1000), 0) + 1 AS run, 'run-' || lpad((coalesce(max(event_id % 1000), 0) + 1)::VARCHAR, 4, '0') AS name FROM events GROUP BY user_id")
def next_run(spark, sf_dir):
    """K5: the next free run of each job."""
    return records.next_runs(_table(spark, sf_dir, "events").withColumnRenamed("user_id", "job"), "job", F.expr("event_id % 1000"))


@query(
    """WITH old AS (SELECT doc_id, lang AS unknown FROM documents WHERE doc_id % 2 = 0), cur AS (SELECT doc_id FROM documents WHERE doc_id % 6 = 0), res AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 0)
SELECT doc_id, unknown FROM old WHERE doc_id NOT IN (SELECT doc_id FROM cur) AND doc_id NOT IN (SELECT doc_id FROM res)"""
)
def unresolved_carried(spark, sf_dir):
    """Old unknowns that are neither listed again nor resolved."""
    docs = _table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("unknown"))
    for rule in ("doc_id % 6 = 0", "doc_id % 10 = 0"):
        old = old.join(docs.where(rule).select("doc_id"), "doc_id", "left_anti")
    return old


@query("WITH r AS (SELECT o_orderkey AS part, o_custkey % 40 AS rid FROM orders), d AS (SELECT DISTINCT o_custkey % 37 AS rid FROM orders) SELECT part, rid FROM r WHERE rid NOT IN (SELECT rid FROM d)")
def relationship_closure(spark, sf_dir):
    """References without a relationship."""
    orders = _table(spark, sf_dir, "orders")
    refs = orders.selectExpr("o_orderkey AS part", "o_custkey % 40 AS rid")
    return refs.join(orders.selectExpr("o_custkey % 37 AS rid").distinct(), "rid", "left_anti").select("part", "rid")


@query("WITH c AS (SELECT p_partkey AS part FROM part WHERE p_partkey % 6 = 0) SELECT part, CASE WHEN part % 4 = 0 THEN 'allowed' ELSE 'unexpected_change' END AS code FROM c")
def allowed_changes(spark, sf_dir):
    """Parts whose digest changed, and whether they may."""
    parts = _table(spark, sf_dir, "part")
    before = parts.select(F.col("p_partkey").alias("part"), F.sha2("p_name", 256).alias("digest"))
    after = parts.select(F.col("p_partkey").alias("part"), F.sha2(F.expr("CASE WHEN p_partkey % 6 = 0 THEN p_name || '~' ELSE p_name END"), 256).alias("digest"))
    allowed = parts.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("part"), F.lit("allowed").alias("ok"))
    return relations.compare(before, after, "part", "digest").select("part").join(allowed, "part", "left").select("part", F.coalesce("ok", F.lit("unexpected_change")).alias("code"))


@query("SELECT o_custkey AS member, count(DISTINCT o_orderkey % 3) AS n_groups FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1")
def disjoint_groups(spark, sf_dir):
    """Members of more than one group."""
    return _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.countDistinct(F.expr("o_orderkey % 3")).alias("n_groups")).where("n_groups > 1")


@query("SELECT DISTINCT o_custkey AS id FROM orders INTERSECT SELECT p_partkey FROM part WHERE p_partkey % 5 = 0")
def id_collisions(spark, sf_dir):
    """Ids used both by objects and by groups."""
    return records.collisions(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), _table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select("p_partkey"))


@query(
    "SELECT d.doc_id, b.item_id, CASE WHEN l.quality IS NULL THEN 'REVIEW' WHEN l.quality = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels l USING (doc_id)"
)
def literal_evidence(spark, sf_dir):
    """Source literals found word for word in texts, with their reading status. Texts and literals of five
    words or more meet by three whole words from inside the literal, so no text is compared with all of them. Shorter
    ones may lie inside words: blocks of LITERAL_BLOCK of them are broadcast, and a map over the texts tries each."""
    docs, bench, labels = (_table(spark, sf_dir, t) for t in ("documents", "benchmark", "labels"))
    words = F.split("text", r"\s+")
    distinct = bench.where("text IS NOT NULL").select("text").distinct()
    literals = distinct.where(F.size(words) > 4).select(F.col("text").alias("literal"), F.xxhash64(F.slice(words, 2, 3)).alias("key"))
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: F.xxhash64(F.slice("w", i, 3)))
    hits = docs.select("doc_id", words.alias("w")).select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).join(literals, "key").select("doc_id", "literal").distinct()
    whole = hits.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "literal")).select("doc_id", "literal")
    short = distinct.where(F.size(words) <= 4).select(F.col("text").alias("literal"))
    blocks = -(-short.count() // LITERAL_BLOCK)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("literal"), F.lit(blocks)) == k)
        whole = whole.union(docs.select("doc_id", "text").join(F.broadcast(block), F.contains("text", "literal")).select("doc_id", "literal"))
    whole = whole.join(bench.select("item_id", F.col("text").alias("literal")), "literal")
    status = F.when(F.col("quality").isNull(), "REVIEW").when(F.col("quality") == 1, "PASS").otherwise("FAIL")
    return whole.join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "item_id", status.alias("status"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_text(spark, sf_dir):
    """The texts of the target objects of a literal, in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.count("*").alias("n"))


@query(
    "WITH f AS (SELECT doc_id % 97 AS scene_id, 'mismatch' AS severity FROM labels WHERE quality = 0 UNION ALL SELECT doc_id % 97, 'unresolved' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id % 97, 'ok' FROM labels) "
    "SELECT scene_id, CASE max(CASE severity WHEN 'mismatch' THEN 3 WHEN 'unresolved' THEN 2 ELSE 1 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'UNRESOLVED' ELSE 'VERIFIED_IN_DECLARED_SCOPE' END AS status, count(*) AS n FROM f GROUP BY scene_id"
)
def status_rollup(spark, sf_dir):
    """A10: the worst status of each scene's findings."""
    labels = _table(spark, sf_dir, "labels").selectExpr("doc_id % 97 AS scene_id", "quality", "toxic")
    found = labels.where("quality = 0").select("scene_id", F.lit(3).alias("rank")).union(labels.where("toxic = 1").select("scene_id", F.lit(2))).union(labels.select("scene_id", F.lit(1)))
    status = F.element_at(F.array(*map(F.lit, ("VERIFIED_IN_DECLARED_SCOPE", "UNRESOLVED", "FAIL"))), F.max("rank"))
    return found.groupBy("scene_id").agg(status.alias("status"), F.count("*").alias("n"))


@query(
    cte("edges", "boxes")
    + _CONNECT
    + """, f AS (
  SELECT scene_id, 'overlap' AS code, count(*) AS n FROM (SELECT a.scene_id FROM boxes a JOIN boxes b ON a.scene_id = b.scene_id AND a.object_id < b.object_id AND a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height) GROUP BY scene_id
  UNION ALL SELECT scene_id, 'dangling', count(*) FROM edges JOIN boxes ON object_id = from_id WHERE to_id NOT IN (SELECT object_id FROM boxes) GROUP BY scene_id
  UNION ALL SELECT scene_id, 'zero_length', count(*) FROM c JOIN boxes ON object_id = from_id WHERE x1 = x2 AND y1 = y2 GROUP BY scene_id)
SELECT scene_id, sum(n)::BIGINT AS n_findings, CASE WHEN bool_or(code <> 'overlap') THEN 'FAIL' ELSE 'REVIEW' END AS status FROM f GROUP BY scene_id"""
)
def resolve_and_audit(spark, sf_dir):
    """Resolve the connectors of every scene and audit it: overlaps, dangling ends, empty connectors."""
    edges, boxes = fixture(spark, sf_dir, "edges"), fixture(spark, sf_dir, "boxes")
    scene = boxes.select(F.col("object_id").alias("from_id"), "scene_id")
    found = relations.overlaps(boxes).select("scene_id", F.lit("overlap").alias("code"))
    loose = relations.dangling(edges, boxes, "object_id", ("to_id",)).join(scene, "from_id").select("scene_id", F.lit("dangling"))
    empty = relations.connect(edges, boxes).where("x1 = x2 AND y1 = y2").join(scene, "from_id").select("scene_id", F.lit("zero_length"))
    every = found.union(loose).union(empty)
    return every.groupBy("scene_id").agg(F.count("*").alias("n_findings"), F.when(F.bool_or(F.col("code") != "overlap"), "FAIL").otherwise("REVIEW").alias("status"))
