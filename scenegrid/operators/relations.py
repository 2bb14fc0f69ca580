"""Relationships between records of a scene: endpoints, sites, comparisons, spatial joins.

Every join is an equi-join. Spatial ones meet in cells of grids (``levelled``), so a scene of any size
or a million scenes cost the objects and the pairs that really meet, not the square of a scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.operators.tables import tasks, written

#: Cell of the grid of spatial joins, in pixels.
CELL = 64.0
#: Bytes of a table of boxes that one task takes: a box has several cells, and repeated columns make its file small.
BOXES = 1 << 17
#: Cell of crossings, in pixels: larger than most segments are long, as each is shuffled once for each of its cells.
TILE = 256.0
#: Segments of one direction that meet those of the other in one group: a cell that holds more of either is cut into several.
CROWD = 1 << 15
#: How much coarser the next grid is.
LEVEL = 8


def dangling(links: DataFrame, objects: DataFrame, key: str, ends: tuple[str, ...] = ("from_id", "to_id")) -> DataFrame:
    """Ends of links that name no object: the link's columns and ``end``, ``missing_id``."""
    named = links.withColumn("_end", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("missing_id")) for e in ends]))).select("*", "_end.*").drop("_end")
    return named.join(objects.select(F.col(key).alias("missing_id")).distinct(), "missing_id", "left_anti")


def site_x(box: str, site: str) -> Column:
    x, w = F.col(f"{box}.x"), F.col(f"{box}.width")
    return F.when(F.col(site) == "left", x).when(F.col(site) == "right", x + w).otherwise(x + w / 2)


def site_y(box: str, site: str) -> Column:
    y, h = F.col(f"{box}.y"), F.col(f"{box}.height")
    return F.when(F.col(site) == "top", y).when(F.col(site) == "bottom", y + h).otherwise(y + h / 2)


def connect(connectors: DataFrame, objects: DataFrame) -> DataFrame:
    """Connector geometry from the sites of both ends: x1, y1, x2, y2 and, for elbows, the middle x.
    Connectors with a dangling end don't appear (see ``dangling``)."""
    box = F.struct("x", "y", "width", "height")
    a = objects.select(F.col("object_id").alias("from_id"), box.alias("a"))
    b = objects.select(F.col("object_id").alias("to_id"), box.alias("b"))
    both = connectors.join(a, "from_id").join(b, "to_id")
    out = both.select("edge_id", "from_id", "to_id", "route", site_x("a", "from_site").alias("x1"), site_y("a", "from_site").alias("y1"), site_x("b", "to_site").alias("x2"), site_y("b", "to_site").alias("y2"))
    return out.withColumn("mid_x", F.when(F.col("route") == "elbow", (F.col("x1") + F.col("x2")) / 2))


def _span(low: Column, size: Column, cell: Column) -> Column:
    return F.sequence(F.floor(low / cell), F.floor((low + size) / cell))


def levelled(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """``level`` of each box: grids have cells of ``cell``, LEVEL times that, and so on, and a box belongs to the finest
    that it covers LEVEL + 1 cells of in either direction at most."""
    size = F.greatest("width", "height", F.lit(cell))
    return boxes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(size / (cell * LEVEL)) / F.log(F.lit(LEVEL)) - 1e-9).cast("int")))


def dealt(boxes: DataFrame, levels: DataFrame, cell: float = CELL, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(home, all): a row for each cell of its own level that a box touches, and one for each cell of that level and the coarser ones
    among ``levels`` (scene_id, levels), with the columns grid, size, cx and cy. Cells are dealt to ``n`` tasks, as many as the table of boxes needs unless given."""
    at = levelled(boxes, cell).join(levels, "scene_id")
    every = at.withColumn("grid", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    every = every.withColumn("size", F.pow(F.lit(float(LEVEL)), F.col("grid")) * cell)
    every = every.withColumn("cx", F.explode(_span(F.col("x"), F.col("width"), F.col("size")))).withColumn("cy", F.explode(_span(F.col("y"), F.col("height"), F.col("size"))))
    every = every.repartition(n or tasks(boxes, BOXES), "scene_id", "grid", "cx", "cy")
    return every.where("grid = level"), every


def scene_levels(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """The levels that each scene has a box of."""
    return levelled(boxes, cell).groupBy("scene_id").agg(F.collect_set("level").alias("levels"))


def overlaps(boxes: DataFrame, cell: float = CELL, only: Column | None = None) -> DataFrame:
    """Pairs a < b of one scene whose open rectangles meet, each once: they meet in the grid of the larger one's level, and only
    the cell that holds the upper left corner of the intersection emits the pair. A box of any size has a bounded
    number of cells, and small boxes never meet in the cells of large ones. ``only``: a condition on p.object_id and q.object_id, the ids of a
    pair in either order, that leaves out the others."""
    rows = boxes.select("scene_id", "object_id", "x", "y", "width", "height")
    home, every = dealt(rows, scene_levels(rows, cell), cell)
    p, q = home.alias("p"), every.alias("q")
    left, top = F.greatest("p.x", "q.x"), F.greatest("p.y", "q.y")
    right = F.least(F.col("p.x") + F.col("p.width"), F.col("q.x") + F.col("q.width"))
    low = F.least(F.col("p.y") + F.col("p.height"), F.col("q.y") + F.col("q.height"))
    same = (F.col("p.scene_id") == F.col("q.scene_id")) & (F.col("p.grid") == F.col("q.grid")) & (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy"))
    once = (F.col("q.level") < F.col("p.level")) | ((F.col("q.level") == F.col("p.level")) & (F.col("q.object_id") < F.col("p.object_id")))
    meet = (left < right) & (top < low) & (F.floor(left / F.col("p.size")) == F.col("p.cx")) & (F.floor(top / F.col("p.size")) == F.col("p.cy"))
    met = p.hint("merge").join(q.hint("merge"), same & once & meet if only is None else same & once & meet & only)
    ids = F.col("p.object_id"), F.col("q.object_id")
    return met.select(F.col("p.scene_id").alias("scene_id"), F.least(*ids).alias("a_id"), F.greatest(*ids).alias("b_id"), left.alias("x"), top.alias("y"), (right - left).alias("width"), (low - top).alias("height"))


def crossings(segments: DataFrame, cell: float = TILE) -> DataFrame:
    """Crossings of horizontal with vertical segments of one scene, inside both. segments: scene_id,
    segment_id, x1, y1, x2, y2, which are written once. A vertical segment is dealt to the cells along it, a horizontal one likewise, and cells to as many tasks as the table needs. A crowded cell, which only a scene
    of over CROWD segments can have, is cut into groups of CROWD by CROWD, so neither the memory nor the pairs of a group grow with it. All crossings are listed: their number may grow with the square of a scene."""
    n, place = tasks(segments), ["scene_id", "cx", "cy"]
    s = written(segments.select("scene_id", "segment_id", "x1", "y1", "x2", "y2"), "segments", once=True)
    full = written(s.groupBy("scene_id").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("scene_id"), "full", once=True)
    crowds = not full.isEmpty()
    s = s.withColumns({"lx": F.least("x1", "x2"), "hx": F.greatest("x1", "x2"), "ly": F.least("y1", "y2"), "hy": F.greatest("y1", "y2")})
    across = s.where("y1 = y2 AND x1 <> x2").withColumn("cx", F.explode(F.sequence(F.floor(F.col("lx") / cell), F.floor(F.col("hx") / cell)))).withColumn("cy", F.floor(F.col("y1") / cell))
    down = s.where("x1 = x2 AND y1 <> y2").withColumn("cy", F.explode(F.sequence(F.floor(F.col("ly") / cell), F.floor(F.col("hy") / cell)))).withColumn("cx", F.floor(F.col("x1") / cell))
    h = across.select(*place, F.col("segment_id").alias("h_id"), "lx", "hx", F.col("y1").alias("hy1"))
    v = down.select(*place, F.col("segment_id").alias("v_id"), "ly", "hy", F.col("x1").alias("vx1"))
    if crowds:
        each = h.select(*place, F.lit(1).alias("h"), F.lit(0).alias("v")).union(v.select(*place, F.lit(0), F.lit(1))).join(full, "scene_id", "left_semi")
        groups = lambda c: F.greatest(F.ceil(F.sum(c) / CROWD), F.lit(1))
        crowded = written(each.groupBy(*place).agg(groups("h").alias("of_h"), groups("v").alias("of_v")).where("of_h > 1 OR of_v > 1"), "crowded", once=True)
        h, v = h.join(crowded, place, "left"), v.join(crowded, place, "left")
        one, every = (lambda key, c: F.pmod(F.xxhash64(key), F.coalesce(c, F.lit(1)))), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c, F.lit(1)) - 1))
        h, v = h.withColumns({"hs": one("h_id", "of_h"), "vs": every("of_v")}).drop("of_h", "of_v"), v.withColumns({"vs": one("v_id", "of_v"), "hs": every("of_h")}).drop("of_h", "of_v")
    keys = [*place, "hs", "vs"] if crowds else place
    met = h.repartition(n, *keys).hint("merge").join(v.repartition(n, *keys).hint("merge"), keys)
    return met.where("vx1 > lx AND vx1 < hx AND hy1 > ly AND hy1 < hy").select("scene_id", "h_id", "v_id", F.col("vx1").alias("x"), F.col("hy1").alias("y"))


def segments_through(segments: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Level or upright segments (scene_id, segment_id, x, y, width, height, one of these zero) that run through the open
    inside of other boxes of their scene, each pair once, in the grid of the larger one's level as in ``overlaps``."""
    boxes = boxes.select("scene_id", "object_id", "x", "y", "width", "height")
    segments = segments.select("scene_id", "segment_id", "x", "y", "width", "height")
    both = segments.drop("segment_id").unionByName(boxes.drop("object_id"))
    levels = scene_levels(both, cell)
    n = max(tasks(segments, BOXES), tasks(boxes, BOXES))
    (s_home, s_all), (b_home, b_all) = dealt(segments, levels, cell, n), dealt(boxes, levels, cell, n)

    def through(one: DataFrame, other: DataFrame, once: str) -> DataFrame:
        s, b = one.alias("s"), other.alias("b")
        upright, level = F.col("s.width") == 0, F.col("s.height") == 0
        between = lambda a, size: (F.col(f"s.{a}") > F.col(f"b.{a}")) & (F.col(f"s.{a}") < F.col(f"b.{a}") + F.col(f"b.{size}"))
        along = lambda a, size: (F.col(f"s.{a}") + F.col(f"s.{size}") > F.col(f"b.{a}")) & (F.col(f"s.{a}") < F.col(f"b.{a}") + F.col(f"b.{size}"))
        hit = (upright & between("x", "width") & along("y", "height")) | (level & between("y", "height") & along("x", "width"))
        first = (F.floor(F.greatest("s.x", "b.x") / F.col("s.size")) == F.col("s.cx")) & (F.floor(F.greatest("s.y", "b.y") / F.col("s.size")) == F.col("s.cy"))
        same = (F.col("s.scene_id") == F.col("b.scene_id")) & (F.col("s.grid") == F.col("b.grid")) & (F.col("s.cx") == F.col("b.cx")) & (F.col("s.cy") == F.col("b.cy")) & (F.col("s.segment_id") != F.col("b.object_id"))
        return s.hint("merge").join(b.hint("merge"), same & hit & first & F.expr(once)).select("s.scene_id", "s.segment_id", "b.object_id")

    return through(s_home, b_all, "b.level <= s.level").union(through(s_all, b_home, "s.level < b.level"))


def duplicate_texts(texts: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of equal labels of one scene within ``tolerance`` in x and y: one side is dealt to its cell, the
    other to the nine around it. Both sides are shuffled: a file of labels may be small enough to be broadcast, its ninefold not."""
    cell = F.floor(F.col("x") / tolerance).alias("cx"), F.floor(F.col("y") / tolerance).alias("cy")
    a = texts.select("scene_id", "label", F.col("object_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), *cell)
    near = F.explode(F.expr("transform(sequence(0, 8), i -> struct(i % 3 - 1 AS dx, i div 3 - 1 AS dy))"))
    b = texts.select("scene_id", "label", F.col("object_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), *cell, near.alias("n"))
    b = b.withColumns({"cx": F.col("cx") + F.col("n.dx"), "cy": F.col("cy") + F.col("n.dy")}).drop("n")
    close = (F.abs(F.col("ax") - F.col("bx")) <= tolerance) & (F.abs(F.col("ay") - F.col("by")) <= tolerance)
    return a.hint("merge").join(b.hint("merge"), ["scene_id", "label", "cx", "cy"]).where(close & (F.col("a_id") < F.col("b_id"))).select("scene_id", "label", "a_id", "b_id")


def compare(reference: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """Records of two scenes by id: ``missing``, ``extra`` or ``changed``; equal ones don't appear."""
    r = reference.select(key, F.col(digest).alias("_r"), F.lit(True).alias("_in_r"))
    a = actual.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    code = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_r").isNull(), "extra").when(~F.col("_r").eqNullSafe(F.col("_a")), "changed")
    return r.join(a, key, "full_outer").select(key, code.alias("code")).where("code IS NOT NULL")


def field_diff(reference: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per field that differs between records of equal id."""
    r = reference.select(key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields])
    a = actual.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").alias("expected"), F.col(f"a_{f}").alias("found")) for f in fields]))
    return r.join(a, key).select(key, pairs.alias("d")).select(key, "d.*").where("NOT (expected <=> found)")


def match_by_order(left: DataFrame, right: DataFrame, scene: str, left_order: list[str], right_order: list[str], name: str) -> DataFrame:
    """Records matched by their place in each scene; ``agrees`` says whether the names do."""
    from pyspark.sql import Window

    number = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy(scene).orderBy(*order)).cast("long"))
    a = number(left, left_order).select(scene, "place", F.col(name).alias("left_name"))
    b = number(right, right_order).select(scene, "place", F.col(name).alias("right_name"))
    return a.join(b, [scene, "place"], "full_outer").withColumn("agrees", F.coalesce(F.col("left_name") == F.col("right_name"), F.lit(False)))


def lookup_status(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """How many records carry each wanted key: ``unresolved``, ``verified_match`` or ``ambiguous``."""
    counts = known.groupBy(key).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return wanted.join(counts, key, "left").withColumn("n", n.cast("long")).withColumn("status", F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "verified_match").otherwise("ambiguous"))


def remap_ids(kept: DataFrame, added: DataFrame, scene: str, key: str) -> DataFrame:
    """New ids for added records: a record whose id is taken gets the next free number of its scene."""
    from pyspark.sql import Window

    top = kept.groupBy(scene).agg(F.max(key).alias("_top"))
    taken = kept.select(scene, F.col(key), F.lit(True).alias("_taken"))
    marked = added.join(taken, [scene, key], "left").join(top, scene, "left")
    highest = F.greatest(F.coalesce("_top", F.lit(0)), F.max(key).over(Window.partitionBy(scene)))
    turn = F.sum(F.when(F.col("_taken"), 1).otherwise(0)).over(Window.partitionBy(scene).orderBy(key))
    return marked.select(scene, key, F.when(F.col("_taken"), highest + turn).otherwise(F.col(key)).alias("new_id"))
