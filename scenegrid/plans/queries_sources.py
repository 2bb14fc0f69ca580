"""Queries over packages and markup that are written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenegrid.operators.relations import BOXES
from scenegrid.operators.tables import tasks, written
from scenegrid.plans.fixtures import cte, fixture
from scenegrid.plans.registry import query
from scenegrid.sources import package_sink, packages, svg, svg_images

_NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _binary(c):
    return c.cast("binary")


def _packages(spark, sf_dir):
    """A package for each scene: a member for each object, with its label."""
    b = fixture(spark, sf_dir, "boxes")
    parts = b.select(F.concat(F.lit("scene-"), "scene_id").alias("path"), F.concat(F.lit("objects/"), "ordinal", F.lit(".txt")).alias("part"), _binary(F.concat("label", F.lit(" of "), "object_id")).alias("content"))
    return b, parts


@query(
    cte("boxes")
    + """, m AS (SELECT 'scene-' || scene_id AS path, 'objects/' || ordinal || '.txt' AS part, CASE ordinal % 10 WHEN 0 THEN 'changed ' || object_id WHEN 1 THEN NULL ELSE label || ' of ' || object_id END AS t, ordinal % 10 > 0 AS same FROM boxes
UNION ALL SELECT DISTINCT 'scene-' || scene_id, 'added.txt', 'new in ' || scene_id, NULL FROM boxes) SELECT path, part, sha256(t) AS sha256, length(t)::INT AS n_bytes, same AS same_bytes, NULL::VARCHAR AS code FROM m WHERE t IS NOT NULL"""
)
def package_changes(spark, sf_dir):
    """Packages with a tenth of their members changed and a tenth deleted; the others keep their bytes."""
    b, parts = _packages(spark, sf_dir)
    before = written(package_sink.build_packages(parts), "packages")
    path, kind = F.concat(F.lit("scene-"), "scene_id").alias("path"), F.col("ordinal") % 10
    some = b.where(kind < 2).select(path, F.concat(F.lit("objects/"), "ordinal", F.lit(".txt")).alias("part"), F.when(kind == 0, _binary(F.concat(F.lit("changed "), "object_id"))).alias("content"))
    more = b.select(path, F.lit("added.txt").alias("part"), _binary(F.concat(F.lit("new in "), "scene_id")).alias("content")).distinct()
    after = written(package_sink.update_packages(before, some.union(more)), "packages")
    old = package_sink.raw_members(before).select("path", "part", F.col("raw_sha256").alias("old"))
    raw = package_sink.raw_members(after).join(old, ["path", "part"], "left").select("path", "part", (F.col("raw_sha256") == F.col("old")).alias("same_bytes"))
    read = packages.members(after).select(F.col("package").alias("path"), "part", "sha256", F.octet_length("content").alias("n_bytes"), "code")
    return read.join(raw, ["path", "part"]).select("path", "part", "sha256", "n_bytes", "same_bytes", "code")


def _decks(spark, sf_dir):
    """Decks of five scenes, a slide each; every seventh scene's slide has a small id, every eleventh names a part that isn't there."""
    b = fixture(spark, sf_dir, "boxes")
    shape = F.concat(F.lit('<p:sp><p:nvSpPr><p:cNvPr id="'), F.col("ordinal") + 2, F.lit('" name="'), F.col("object_id"), F.lit('"/></p:nvSpPr></p:sp>'))
    slides = b.groupBy("scene_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", shape.alias("s")))), lambda s: s["s"]), "").alias("s"))
    deck, n = F.concat(F.lit("deck-"), F.expr("scene_id div 5")).alias("path"), F.col("scene_id") % 5
    body = slides.select(deck, F.concat(F.lit("ppt/slides/slide"), n + 1, F.lit(".xml")).alias("part"), _binary(F.concat(F.lit(f"<p:sld {_NS}><p:cSld><p:spTree>"), "s", F.lit("</p:spTree></p:cSld></p:sld>"))).alias("content"))
    native = F.when(F.col("scene_id") % 7 == 0, n + 1).otherwise(n + 256)
    entry = F.concat(F.lit('<p:sldId id="'), native, F.lit('" r:id="rId'), n, F.lit('"/>'))
    target = F.concat(F.lit("slides/slide"), F.when(F.col("scene_id") % 11 == 0, n + 90).otherwise(n + 1), F.lit(".xml"))
    rel = F.concat(F.lit('<Relationship Id="rId'), n, F.lit('" Type="x/slide" Target="'), target, F.lit('"/>'))
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("scene_id", c.alias("v")))), lambda s: s["v"]), "")
    decks = slides.groupBy(deck).agg(listed(entry).alias("ids"), listed(rel).alias("rels"))
    main = decks.select("path", F.lit("ppt/presentation.xml").alias("part"), _binary(F.concat(F.lit(f"<p:presentation {_NS}><p:sldIdLst>"), "ids", F.lit("</p:sldIdLst></p:presentation>"))).alias("content"))
    rels = decks.select("path", F.lit("ppt/_rels/presentation.xml.rels").alias("part"), _binary(F.concat(F.lit(f'<Relationships xmlns="{_RELS}">'), "rels", F.lit("</Relationships>"))).alias("content"))
    return written(package_sink.build_packages(body.union(main).union(rels)), "decks")


@query(
    cte("boxes")
    + """, s AS (SELECT DISTINCT scene_id FROM boxes) SELECT 'deck-' || scene_id // 5 AS package, scene_id % 5 AS ordinal, CASE WHEN scene_id % 7 = 0 THEN scene_id % 5 + 1 ELSE scene_id % 5 + 256 END AS native_id,
'ppt/slides/slide' || CASE WHEN scene_id % 11 = 0 THEN scene_id % 5 + 90 ELSE scene_id % 5 + 1 END || '.xml' AS part, CASE WHEN scene_id % 7 = 0 THEN 'small_id' WHEN scene_id % 11 = 0 THEN 'dangling' END AS code FROM s"""
)
def deck_slides(spark, sf_dir):
    """Slides of decks by their relationships, with small ids and missing parts coded."""
    return packages.slide_catalog(packages.members(_decks(spark, sf_dir)))


@query(cte("boxes") + " SELECT 'deck-' || scene_id // 5 AS package, 'ppt/slides/slide' || (scene_id % 5 + 1) || '.xml' AS part, (ordinal + 2)::VARCHAR AS native_id, object_id::VARCHAR AS name, 'sp' AS kind, NULL::VARCHAR AS parent, NULL::VARCHAR AS code FROM boxes")
def deck_shapes(spark, sf_dir):
    """The shapes of all slides."""
    return packages.shape_inventory(packages.members(_decks(spark, sf_dir))).drop("ordinal")


@query(
    cte("boxes")
    + """ SELECT 'scene-' || scene_id AS file, ordinal, CASE WHEN kind = 'text' THEN 'text' ELSE 'path' END AS kind, 'o' || object_id AS id, CASE WHEN kind = 'text' THEN label END AS text, CASE WHEN kind = 'text' THEN 2 * (x + 10) + 7 END AS x, CASE WHEN kind = 'text' THEN 2 * y + 9 END AS y, CASE WHEN kind = 'text' THEN 24.0::DOUBLE END AS font_size,
CASE WHEN kind = 'text' THEN object_id % 3 = 0 END AS bold, fill, opacity, CASE WHEN ordinal % 10 = 9 THEN 'bad_number' END AS code FROM boxes WHERE kind IN ('text', 'path') AND fill <> 'none' AND NOT (kind = 'text' AND ordinal % 10 = 9)"""
)
def svg_objects(spark, sf_dir):
    """Scenes written as SVG and read again: texts with their place, size and weight under a view box and a transform; lengths that aren't read are coded."""
    b = fixture(spark, sf_dir, "boxes").where("kind IN ('text', 'path') AND fill <> 'none' AND NOT (kind = 'text' AND ordinal % 10 = 9)")
    common = "' id=\"o', object_id, '\" fill=\"', fill, '\" opacity=\"', opacity, '\"'"
    mark = F.expr(
        f"""CASE WHEN kind = 'text' THEN concat('<text x="', x, '" y="', y, '" dx="10" font-size="12px" font-weight="', CASE WHEN object_id % 3 = 0 THEN '700' ELSE 'normal' END, '"', {common}, '>', label, '</text>')
        ELSE concat('<circle cx="', x, '" cy="', y, '" r="', width, CASE WHEN ordinal % 10 = 9 THEN '%' ELSE 'mm' END, '"', {common}, '/>') END"""
    )
    body = b.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", mark.alias("m")))).alias("ms"))
    head = '<svg xmlns="http://www.w3.org/2000/svg" width="2000" height="2000" viewBox="0 0 1000 1000"><g transform="translate(3.5 4.5)">'
    files = body.select(F.concat(F.lit("scene-"), "scene_id").alias("path"), "ms", _binary(F.concat(F.lit(head), F.array_join(F.transform("ms", lambda s: s["m"]), ""), F.lit("</g></svg>"))).alias("content"))
    files = written(files, "svg")
    places = files.select(F.col("path").alias("file"), F.posexplode("ms").alias("at", "m")).select("file", F.col("at").cast("long").alias("at"), "m.ordinal")
    found = svg.objects(files).withColumnRenamed("ordinal", "at").join(places, ["file", "at"])
    return found.select("file", "ordinal", "kind", "id", "text", "x", "y", "font_size", "bold", "fill", "opacity", "code")


@query(
    cte("boxes")
    + """, i AS (SELECT *, CASE WHEN object_id % 7 = 0 THEN 'opacity' WHEN object_id % 11 = 0 THEN 'unresolved' WHEN object_id % 13 = 0 THEN 'transform' END AS code FROM boxes WHERE object_id % 5 > 0)
SELECT 'scene-' || scene_id AS file, row_number() OVER (PARTITION BY scene_id ORDER BY ordinal) - 1 AS ordinal, 'i' || object_id AS id, CASE WHEN code IS NULL THEN 4 * width END AS a, CASE WHEN code IS NULL THEN 2 * height END AS d, CASE WHEN code IS NULL THEN 4 * x + 16 END AS e, CASE WHEN code IS NULL THEN 2 * y + 7 END AS f,
CASE WHEN object_id % 11 = 0 AND object_id % 7 > 0 THEN 'c,none' ELSE 'c' END AS clips, sha256(label) AS sha256, code FROM i"""
)
def image_occurrences(spark, sf_dir):
    """Images of scenes that are written as SVG and read again, with the matrices and clips above them; faint ones, lost clips and unknown transforms are coded, hidden ones are gone."""
    b = fixture(spark, sf_dir, "boxes")
    mark = F.expr(
        """concat('<image id="i', object_id, '" x="', x, '" y="', y, '" width="', width, '" height="', height, '" href="data:image/png;base64,', base64(encode(label, 'UTF-8')), '"',
        CASE WHEN object_id % 5 = 0 THEN ' display="none"' WHEN object_id % 7 = 0 THEN ' opacity="0.5"' WHEN object_id % 11 = 0 THEN ' clip-path="url(#none)"' WHEN object_id % 13 = 0 THEN ' transform="turn(3)"' ELSE '' END, '/>')"""
    )
    body = b.repartition(tasks(b, BOXES), "scene_id").groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", mark.alias("m")))).alias("ms"))
    head = '<svg xmlns="http://www.w3.org/2000/svg"><defs><clipPath id="c"><rect width="9" height="9"/></clipPath></defs><g transform="translate(16 7)"><g transform="scale(4 2)" clip-path="url(#c)">'
    files = body.select(F.concat(F.lit("scene-"), "scene_id").alias("path"), _binary(F.concat(F.lit(head), F.array_join(F.transform("ms", lambda s: s["m"]), ""), F.lit("</g></g></svg>"))).alias("content"))
    found = svg_images.occurrences(written(files, "svg"))
    at = lambda i: F.get("transform", F.lit(i))
    clips = F.array_join(F.transform("clips", lambda c: c["id"]), ",")
    return found.select("file", "ordinal", "id", at(0).alias("a"), at(3).alias("d"), at(4).alias("e"), at(5).alias("f"), clips.alias("clips"), "sha256", "code")
