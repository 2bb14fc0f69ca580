"""Queries on small tables of their own, against their SQL."""

import math
import os
import random
import struct
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scenegrid.operators import contours, exact, layout, relations, tables
from scenegrid.plans import fixtures, queries_exact


def single(v):
    """The nearest 32-bit float."""
    return struct.unpack("f", struct.pack("f", v))[0]


def compared(spark, tmp_path, name, schemas):
    """The rows of a query and of its SQL over tables {name: (schema, rows)}, each sorted as text."""
    con = duckdb.connect()
    for table, (schema, rows) in schemas.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    plain = lambda r: repr([repr(v + 0.0) if isinstance(v, float) else repr(v) for v in r])
    return sorted(plain(r) for r in df.collect()), sorted(plain(r) for r in con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall())


VECTORS = "vec_id bigint, embedding array<float>, label int"


def edge_of_grey():
    """A 32-bit float whose thousandfold lies below an integer and is rounded to it in 32 bits."""
    for k in range(1, 255):
        for step in range(3):
            v = single(k / 1000)
            for _ in range(step):
                v = struct.unpack("f", struct.pack("I", struct.unpack("I", struct.pack("f", v))[0] - 1))[0]
            if math.floor(v * 1000) != math.floor(single(v * 1000)):
                return v
    raise AssertionError("none")


@pytest.mark.parametrize("name", ["composite_on_white", "colour_error"])
def test_pixels_are_scaled_as_single_floats(spark, tmp_path, name):
    rows = [(i, [single(edge_of_grey())] * 64 if i % 2 else [single(0.2)] * 64, 0) for i in range(6)]
    got, want = compared(spark, tmp_path, name, {"embeddings": (VECTORS, rows)})
    assert got == want and got


def test_edge_agreement_compares_single_floats(spark, tmp_path):
    rows = [(i, [single(0.15), 0.5, -0.5 if i % 3 else 0.1] + [single(-0.15)] * 61, 0) for i in range(6)]
    got, want = compared(spark, tmp_path, "edge_agreement", {"embeddings": (VECTORS, rows)})
    assert got == want and got


LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


def line_items(paths):
    """Rows whose commands are the points (x, y) of each path; x in twentieths."""
    return [(k, 1, 1, i, x / 20, y * 100.0, 0.0, 0.0, None) for k, points in paths.items() for i, (x, y) in enumerate(points)]


def test_chords_of_curves_at_just_the_tolerance(spark, tmp_path):
    # control points at a distance of 4 from the chord, which hypot gives as 4.000000000000023
    curves = {1: [(520, 545), (560, 605), (560, 605), (580, 625)], 2: [(660, 375), (460, 115), (460, 115), (420, 55)], 3: [(0, 0), (0, 900), (900, 900), (900, 0)]}
    got, want = compared(spark, tmp_path, "adaptive_chords", {"lineitem": (LINES, line_items(curves))})
    assert got == want and len(got) > 3


def test_dashes_of_subpaths_that_end_where_they_begin(spark, tmp_path):
    # lengths 4 * 200 and a bit: a dash begins at 800 and the last point is the first
    ring = [(400, 200), (600, 200), (600, 400), (400, 600 - 200), (400, 200)]
    got, want = compared(spark, tmp_path, "dash_paths", {"lineitem": (LINES, line_items({2: ring, 4: [(460, 232), (860, 232), (460, 233), (460, 232)], 6: [(0, 0), (400, 0), (400, 401)], 8: [(460, 232), (861, 232), (460, 232)]}))})
    assert got == want and got


def test_a_route_is_found_without_going_over_the_whole_grid(monkeypatch):
    boxes = [(k * 37 % 1000.0, k * 91 % 1000.0, k * 37 % 1000.0 + 20, k * 91 % 1000.0 + 23) for k in range(100, 200) if k % 12 != 5]
    taken, pop = [], layout.heapq.heappop
    monkeypatch.setattr(layout.heapq, "heappop", lambda h: taken.append(1) or pop(h))
    cost, way = layout.cheapest_route((-30.0, 191.0), (1100.0, 809.0), boxes)
    assert cost == 1130 + 618 + layout.BEND * (len(way) - 2) and len(taken) < 5000


def test_routes_are_dealt_to_more_tasks_than_their_file_has(spark, tmp_path):
    spark.range(400).selectExpr("id AS scene_id", "id AS edge_id", "-30D AS x1", "5D AS y1", "100D AS x2", "9D AS y2").coalesce(1).write.parquet(f"{tmp_path}/e")
    spark.range(400).selectExpr("id AS scene_id", "0D AS x", "0D AS y", "9D AS width", "7D AS height").coalesce(1).write.parquet(f"{tmp_path}/b")
    found = layout.routes(spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/b"))
    parts = {r.p for r in found.selectExpr("spark_partition_id() AS p").distinct().collect()}
    assert len(parts) > 1 and found.count() == 400


@pytest.mark.parametrize("name", ["duplicate_labels", "box_overlaps"])
def test_boxes_dealt_to_cells_are_not_broadcast(spark, tmp_path, capsys, name):
    rows = [(k, f"part {k}", f"Brand#{k % 3}", "T", k % 50 + 1, 1.0) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    assert found.count() > 0
    found.explain()
    shown = capsys.readouterr().out
    assert "SortMergeJoin" in shown and not any("BroadcastHashJoin" in line and "cx#" in line for line in shown.splitlines())


def test_commands_take_as_many_tasks_as_their_table_needs(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    assert tables.tasks(table, 1 << 14) > tables.tasks(table, 1 << 16) > tables.tasks(table)
    monkeypatch.setattr(fixtures, "tasks", lambda df: tables.tasks(df, 1 << 14))
    grouped = fixtures.fixture(spark, "/root/testdata/sf0.01", "commands").groupBy("path_id").count()
    assert grouped.selectExpr("spark_partition_id() AS p").distinct().count() == tables.tasks(table, 1 << 14)


def test_cells_are_dealt_by_the_size_of_the_boxes(spark, tmp_path, monkeypatch):
    """More tasks for a larger table of boxes, so that none sorts a fixed part of it."""
    monkeypatch.setattr(relations, "BOXES", 64, raising=False)
    spark.range(2000).selectExpr("id div 100 AS scene_id", "id AS object_id", "id * 37.0D % 1000 AS x", "id * 91.0D % 1000 AS y", "id % 50 + 1.0D AS width", "id % 50 + 4.0D AS height").write.parquet(f"{tmp_path}/boxes")
    boxes = spark.read.parquet(f"{tmp_path}/boxes")
    home, every = relations.dealt(boxes, relations.scene_levels(boxes))
    assert home.rdd.getNumPartitions() == every.rdd.getNumPartitions() >= tables.tasks(boxes, 64) > 100


@pytest.mark.parametrize("crowd", [40, 1 << 14])
def test_a_crowded_cell_is_cut_into_groups_of_bounded_pairs(spark, tmp_path, monkeypatch, crowd):
    """Every crossing once, whether or not a cell is cut; cut ones are met in more than one task."""
    monkeypatch.setattr(relations, "CROWD", crowd, raising=False)
    spark.range(600).selectExpr("id div 500 AS scene_id", "id AS segment_id", "if(id % 2 = 0, 1L, 2 + id % 50) AS x1", "if(id % 2 = 0, 2 + id % 50, 1L) AS y1", "if(id % 2 = 0, 90L, 2 + id % 50) AS x2", "if(id % 2 = 0, 2 + id % 50, 30L) AS y2").coalesce(1).write.parquet(f"{tmp_path}/s")
    s = spark.read.parquet(f"{tmp_path}/s")
    found = relations.crossings(s).selectExpr("*", "spark_partition_id() AS p").collect()
    rows = s.collect()
    want = [(h.scene_id, h.segment_id, v.segment_id, v.x1, h.y1) for h in rows for v in rows if h.scene_id == v.scene_id and h.y1 == h.y2 and v.x1 == v.x2 and h.x1 < v.x1 < h.x2 and v.y1 < h.y1 < v.y2]
    assert sorted(tuple(r)[:5] for r in found) == sorted(want) and want
    parts = {r.p for r in found if r.scene_id == 0}
    assert len(parts) > 1 if crowd == 40 else len(parts) == 1
    assert max(sum(1 for r in found if r.p == p) for p in parts) < len(want) * (0.7 if crowd == 40 else 1.1)


def on_disk(spark):
    """Shuffled files of the session, with their bytes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    paths = [str(files.apply(i)) for i in range(files.size())]
    return {p: os.path.getsize(p) for p in paths if os.path.exists(p) and "shuffle_" in p and p.endswith(".data")}


def test_a_table_written_once_leaves_no_shuffled_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = on_disk(spark), spark.conf.get(name)
    df = spark.range(20000).selectExpr("id % 100 AS k", "id").groupBy("k").agg(F.sum("id").alias("s"))
    assert tables.written(df).count() == 100 and set(on_disk(spark)) - set(before)
    kept = on_disk(spark)
    assert tables.written(df, once=True).count() == 100
    left = set(on_disk(spark)) - set(kept)
    assert len(left) <= 1 and spark.conf.get(name) == was  # that of the count


def test_route_crossings_shuffle_each_segment_about_once(spark):
    """What stays on disk once the segments are dealt, besides the written ones, is under three times the table."""
    before = on_disk(spark)
    entry.queries()["route_crossings"](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    made = sum(size for path, size in on_disk(spark).items() if path not in before)
    assert 0 < made < 3 * os.path.getsize("/root/testdata/sf0.01/lineitem.parquet")


def test_route_segments_take_as_many_tasks_as_their_table_needs(spark, monkeypatch):
    monkeypatch.setattr(relations, "tasks", lambda df: tables.tasks(df, 1 << 14))
    found = entry.queries()["route_crossings"](spark, "/root/testdata/sf0.01")
    assert found.rdd.getNumPartitions() == tables.tasks(spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet"), 1 << 14) > 8


def test_chains_take_as_many_tasks_as_their_table_needs(spark, monkeypatch):
    monkeypatch.setattr(queries_exact, "tasks", lambda df: tables.tasks(df, 1 << 14), raising=False)
    found = entry.queries()["exact_chains"](spark, "/root/testdata/sf0.01")
    assert found.rdd.getNumPartitions() == tables.tasks(spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet"), 1 << 14) > 8


def test_chains_of_odd_texts(spark):
    """As the expressions of SQL read them: one end of line after a number counts as none, and what stands first in a chain is its code. A chain that comes to nothing is over one."""
    least, big = "matrix(1e-30 0 0 0 0 0)", "matrix(1e20 0 0 1 0 0)"
    rows = [
        (1, [(None, "1\n", "2\r\n")]), (2, [(None, "1\n\n", "2")]), (3, [(None, "\u0663", "2")]), (4, [("matrix(1 0 0 1 1e00001 0)", None, None)]), (5, [(big, None, None), (big, "x", "1")]), (6, [(None, "x", "1"), (big, None, None), (big, None, None)]),
        (7, [(least, None, None)] * 4 + [("matrix(0 0 0 0 0 0)", None, None)]), (8, [None, (None, ".5", "-.25e1")]), (9, [("matrix(1 0 0 1 0 " + "9" * 38 + ")", None, None)]), (10, [("matrix(1 0 0 1 0 " + "9" * 38 + ")", "0", "1")]), (11, [("matrix(1 0 0 1 0 " + "9" * 39 + ")", None, None)]),
    ]
    df = spark.createDataFrame(rows, "id int, steps array<struct<matrix:string,dx:string,dy:string>>").withColumn("c", exact.exact_chain(F.col("steps")))
    got = {r.id: r.c.code or ([int(v) for v in r.c.m], r.c.s) for r in df.collect()}
    assert got == {1: ([1, 0, 0, 1, 1, 2], 0), 2: "unread", 3: "unread", 4: "unread", 5: "overflow", 6: "unread", 7: ([0] * 6, 0), 8: ([10, 0, 0, 10, 5, -25], 1), 9: ([1, 0, 0, 1, 0, 10**38 - 1], 0), 10: "overflow", 11: "overflow"}


def test_runs_of_pixels_and_their_labels_are_not_broadcast(spark, tmp_path, monkeypatch):
    plans, write = [], tables.Rounds.write
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables.Rounds, "write", lambda self, df: plans.append(shown(df)) or write(self, df))
    rows = [(k, [single((k * 31 + i * i * 7) % 255 / 1000 + 0.0004) for i in range(64)], 0) for k in range(30)]
    got, want = compared(spark, tmp_path, "pixel_components", {"embeddings": (VECTORS, rows)})
    assert got == want and got
    plans.append(shown(entry.queries()["pixel_components"](spark, str(tmp_path))))
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)


def halved_probes(points):
    """How often the probes of each edge are halved, in exact fractions: (seq, halvings), None if the middle is on another edge."""
    ring = [(k + 1, p, q) for k, (p, q) in enumerate(zip(points, points[1:] + points[:1])) if p != q]
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    boxes = lambda a, b, p, q: all(max(a[i], b[i]) >= min(p[i], q[i]) and max(p[i], q[i]) >= min(a[i], b[i]) for i in (0, 1))
    meet = lambda a, b, p, q: boxes(a, b, p, q) and side(a, b, p) * side(a, b, q) <= 0 and side(p, q, a) * side(p, q, b) <= 0
    for seq, a, b in ring:
        others = [(p, q) for _, p, q in ring if {p, q} != {a, b}]
        middle = tuple(Fraction(u + v, 2) for u, v in zip(a, b))
        d, k = Fraction(1, max(abs(b[0] - a[0]), abs(b[1] - a[1]))), 0
        if any(side(p, q, middle) == 0 and boxes(middle, middle, p, q) for p, q in others):
            yield seq, None
            continue
        while any(meet(middle, (middle[0] - g * d * (b[1] - a[1]), middle[1] + g * d * (b[0] - a[0])), p, q) for g in (1, -1) for p, q in others):
            d, k = d / 2, k + 1
        yield seq, k


def test_probes_are_halved_as_often_as_it_takes(spark, tmp_path):
    """An edge beside another one has probes however near that is: seven halvings and more, as in the SQL."""
    draw = random.Random(4)
    paths = {2 * k: [(draw.randrange(20, 1000), draw.randrange(9, 1050)) for _ in range(draw.randrange(2, 8))] for k in range(150)}
    # slivers: their long edges come close to one another's middles; an edge along the normal; a middle on another edge
    paths |= {2 * k + 1: [(0, 0), (1000, k), (999, k), (draw.randrange(300, 700), draw.randrange(2))] for k in range(1, 60)}
    paths |= {1001: [(0, 0), (100, 0), (50, 3), (50, 1)], 1003: [(0, 0), (100, 0), (100, 0), (50, 0)], 1005: [(0, 0), (100, 0), (50, -5), (50, 5)]}
    got, want = compared(spark, tmp_path, "side_probes", {"lineitem": (LINES, line_items(paths))})
    assert got == want
    rows = spark.createDataFrame([(i, k + 1, *p) for i, c in paths.items() for k, p in enumerate(c)], "path_id bigint, seq bigint, x bigint, y bigint")
    found = {(r.path_id, r.seq): r.halvings for r in contours.side_probes(rows).collect()}
    assert found == {(i, seq): k for i, c in paths.items() for seq, k in halved_probes(c)}
    assert {0, 7, 8, 9} <= set(found.values()) and None in found.values()


def test_probes_of_large_contours_are_exact(spark):
    far, draw = 1 << 28, random.Random(5)
    slivers = [[(-far, -far), (far, far - k), (far - 1, far - k), (draw.randrange(far), draw.randrange(far))] for k in range(4)] + [[(-far, 0), (far, 1), (1, 1), (far, 2)]]
    rows = spark.createDataFrame([(i, k + 1, *p) for i, c in enumerate(slivers) for k, p in enumerate(c)], "path_id bigint, seq bigint, x bigint, y bigint")
    found = {(r.path_id, r.seq): r.halvings for r in contours.side_probes(rows).collect()}
    assert found == {(i, seq): k for i, c in enumerate(slivers) for seq, k in halved_probes(c)}
    assert max(k for k in found.values() if k is not None) > 20


def test_fill_rules_keep_the_halvings_of_their_sql(spark, tmp_path):
    paths = {2 * k + 1: [(0, 0), (1000, k), (999, k), (500, 1)] for k in range(1, 40)}
    got, want = compared(spark, tmp_path, "fill_rules", {"lineitem": (LINES, line_items(paths))})
    assert got == want and got
