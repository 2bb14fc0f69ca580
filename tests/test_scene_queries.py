"""Every registered scene query against its SQL, and rules against rows that they must take and refuse."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scenegrid.functions import scalar
from scenegrid.operators import contours, graph, layout, paths, relations, rules, text
from scenegrid.plans import catalog, queries_relations

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return repr(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    found = db.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_overlap_doesnt_depend_on_the_cell(spark):
    rows = [(1, i, float(i * 37 % 300), float(i * 91 % 300), float(5 + i % 60), float(4 + i % 80)) for i in range(120)]
    boxes = spark.createDataFrame(rows, "scene_id bigint, object_id bigint, x double, y double, width double, height double")
    pairs = [{(r.a_id, r.b_id) for r in relations.overlaps(boxes, cell).collect()} for cell in (7.0, 64.0, 1000.0)]
    assert pairs[0] == pairs[1] == pairs[2] and pairs[0]


def test_touching_boxes_dont_overlap(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 64.0, 64.0), (1, 2, 64.0, 0.0, 5.0, 5.0), (2, 3, 0.0, 0.0, 9.0, 9.0)], "scene_id bigint, object_id bigint, x double, y double, width double, height double")
    assert relations.overlaps(boxes).count() == 0


def test_diff_is_idempotent_and_ordered(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id bigint, d string")
    b = spark.createDataFrame([(3, "q"), (2, None), (4, "n")], "id bigint, d string")
    assert relations.compare(a, a, "id", "d").count() == 0
    assert {(r.id, r.code) for r in relations.compare(a, b, "id", "d").collect()} == {(1, "missing"), (3, "changed"), (4, "extra")}


def test_cycles_and_depth(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 5)]
    got = {r.child_id: r for r in graph.attachment_order(spark.createDataFrame(rows, "child_id bigint, parent_id bigint"), rounds=4).collect()}
    assert [(got[i].root_id, got[i].depth) for i in (1, 2, 3)] == [(1, 0), (1, 1), (1, 2)]
    assert all(got[i].on_cycle for i in (4, 5, 6))


def test_repeated_ids_and_missing_parents_end_with_a_code(spark):
    rows = [(1, 2, 1.0, 1.0, None), (2, 1, 1.0, 1.0, None), (2, 1, 1.0, 1.0, "x"), (5, 1, 1.0, 1.0, None)]
    rows += [(11, None, 1.0, 1.0, None), (12, 11, 1.0, 2.0, None), (13, 99, 1.0, 1.0, None), (14, 13, 1.0, 1.0, None), (15, 14, 1.0, 1.0, "own"), (21, 22, 0.0, 0.0, None), (22, 21, 0.0, 0.0, None), (None, 11, 0.0, 0.0, None)]
    tree = spark.createDataFrame(rows, "child_id bigint, parent_id bigint, dx double, dy double, v string")
    codes = {1: "repeated_id", 2: "repeated_id", 5: "repeated_id", 11: None, 12: None, 13: "dangling", 14: "dangling", 15: "dangling", 21: "cycle", 22: "cycle"}
    order = graph.attachment_order(tree).collect()
    assert {r.child_id: r.code for r in order} == codes and len(order) == len(codes)
    assert {r.child_id: (r.root_id, r.depth) for r in order if r.code is None} == {11: (11, 0), 12: (11, 1)}
    assert all(r.root_id is r.depth is None for r in order if r.code)
    offsets = {r.child_id: (r.code, r.dx, r.dy) for r in graph.resolve_offsets(tree).collect()}
    assert offsets == {i: (c, None, None) if c else (None, float(i == 12), 2.0 * (i == 12)) for i, c in codes.items()}
    styles = {r.child_id: (r.code, r.v) for r in layout.inherit(tree, "v").collect()}
    assert styles == {i: (c, None) for i, c in codes.items()} | {15: (None, "own")}
    assert graph.attachment_order(tree.limit(0)).collect() == []


def test_rings_with_tails_and_gaps(spark):
    n = 40
    turns = [(i, (i + 1) % n) for i in range(n)] + [(100 + i, 101 + i if i < 59 else 3) for i in range(60)] + [(200, 201), (300, 301), (300, 302), (301, 300)]
    got = {r.node: (r.ring, r.code) for r in layout.rings(spark.createDataFrame(turns, "node bigint, successor bigint")).collect()}
    assert got == {i: (0, None) for i in range(n)} | {100 + i: (None, "not_on_ring") for i in range(60)} | {200: (None, "dangling"), 300: (None, "repeated_id"), 301: (None, "repeated_id")}


def test_reference_cycles_and_depth(spark):
    defs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None), ("d", "c"), ("e", "d")], "def_id string, target_id string")
    uses = spark.createDataFrame([(1, "a"), (2, "e"), (3, "x"), (4, "c")], "use_id bigint, ref_id string")
    got = {r.use_id: (r.final_id, r.code) for r in graph.expand_references(uses, defs, 4).collect()}
    assert got == {1: (None, "cycle"), 2: ("c", None), 3: (None, "dangling"), 4: ("c", None)}
    assert {r.code for r in graph.expand_references(uses.where("use_id = 2"), defs, 2).collect()} == {"too_deep"}


@pytest.mark.parametrize(
    ("value", "want"),
    [("#abc", "#aabbcc"), (" RED", "#ff0000"), ("rgb(1, 2,255)", "#0102ff"), ("rgb(1 2 256)", "#0102ff"), ("rgb(50%,-3,0.5)", "#800000"), ("rgb(1,2)", None), ("rgb(a,2,3)", None), ("none", "none"), ("#abcd", None), ("url(#x)", None)],
)
def test_colours(spark, value, want):
    assert spark.range(1).select(scalar.colour(F.lit(value))).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [(2.5, 3), (-2.5, -2), (0.49999999999999994, 0), (-0.5, 0), (7.0, 7)])
def test_rounding(spark, value, want):
    assert spark.range(1).select(scalar.js_round(F.lit(value))).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [("1in", 96.0), (" 2.54 cm", 96.0), (".5", 0.5), ("-3px", -3.0), ("1 em", None), ("", None), ("1e", None)])
def test_lengths(spark, value, want):
    got = spark.range(1).select(scalar.length_px(F.lit(value))).first()[0]
    assert got == want or abs(got - want) < 1e-9


@pytest.mark.parametrize(("tex", "want"), [(r"\frac{a}{b}", "ok"), (r"\write18{x}", "command"), ("a}b{", "braces"), ("{" * 33 + "}" * 33, "depth"), ("x^^y", "double_caret"), ("", "length"), ("a" * 4097, "length"), (r"\{a\}", "ok"), (r"a\%b", "symbol"), ("a%b", "character"), ("a\\", "symbol")])
def test_math(spark, tex, want):
    assert spark.createDataFrame([(tex,)], "t string").select(rules.math_code("t")).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', "ok"), ('{"a": 1, "a": 2}', "malformed"), ('{"a": 1} x', "malformed"), ("1, 2", "malformed"), ("", "malformed"), ("null", "ok")])
def test_strict_json(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(rules.json_code(F.col("t"))).first()[0]
    assert got == want or (text == "null" and got in ("ok", "malformed"))


def test_winding_of_a_square(spark):
    pts = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])], "path_id bigint, seq bigint, x bigint, y bigint")
    probes = spark.createDataFrame([(1, 1, 2, 2), (1, 2, 9, 2), (1, 3, 2, -1)], "path_id bigint, probe_id bigint, px bigint, py bigint")
    assert {r.probe_id: r.winding for r in paths.winding(pts, probes).collect()} == {1: 1, 2: 0, 3: 0}
    assert paths.area2(pts).first().area2 == 32 and paths.convexity(pts).first().orientation == 1


def test_routes_avoid_boxes_and_cost_bends():
    cost, way = layout.cheapest_route((0.0, 50.0), (200.0, 50.0), [(80.0, 0.0, 120.0, 100.0)])
    assert way[0] == (0.0, 50.0) and way[-1] == (200.0, 50.0)
    for a, b in zip(way, way[1:], strict=False):
        assert a[0] == b[0] or a[1] == b[1]
        assert not (min(a[0], b[0]) < 120 and max(a[0], b[0]) > 80 and min(a[1], b[1]) < 100 and max(a[1], b[1]) > 0)
    assert cost == 200 + 2 * 66 + 2 * layout.BEND  # up at once, across, down at the end
    assert layout.cheapest_route((0.0, 5.0), (9.0, 5.0), [])[0] == 9
    ring = [(-20.0, -20.0, 30.0, -10.0), (-20.0, 10.0, 30.0, 20.0), (-20.0, -20.0, -10.0, 20.0), (10.0, -20.0, 30.0, 20.0)]
    assert layout.cheapest_route((0.0, 0.0), (99.0, 0.0), ring) == (float("inf"), [])


def test_matches_in_order(spark):
    schema = "s bigint, place bigint, value double"
    found = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 1.0, 3.0])] + [(2, 0, 5.0)], schema)
    wanted = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 5.001), (3, 0, 1.0)], schema)
    got = {r.s: (r.n, r.n_matched, r.unique) for r in layout.match_in_order(wanted, found, "s", 0.002).collect()}
    assert got == {1: (2, 2, False), 2: (1, 1, True)}
    strict = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], schema)
    assert layout.match_in_order(strict, found, "s", 0.002).first().unique
    assert layout.match_in_order(spark.createDataFrame([(1, 0, 3.0), (1, 1, 2.0)], schema), found, "s", 0.002).first().n_matched == 1


def test_graphemes_stay_whole(spark):
    rows = [(1, "ééé \U0001f468‍\U0001f469‍\U0001f467 ab"), (2, None), (3, "abcdefgh i")]
    got = {}
    for r in text.wrap_graphemes(spark.createDataFrame(rows, "k bigint, t string"), "k", "t", 3).orderBy("k", "line").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got[1] == ["ééé", "\U0001f468‍\U0001f469‍\U0001f467", "ab"]
    assert got[2] == [""] and got[3] == ["abc", "def", "gh", "i"]


def test_plain_signs_are_not_searched_for():
    """Words of single signs are wrapped as they are; the others by a search for whole characters."""
    import regex

    low = [chr(i) for i in range(0x300)]
    assert [a + b for a in low for b in low if len(regex.findall(r"\X", a + b)) != 2] == ["\r\n"]
    for t in ("", " ", "  ", "abc", "abcd efg", "a\r\nbc d", "e\u0301e\u0301e\u0301e\u0301 \u00e9\u00e9", "ab  c \U0001f1e9\U0001f1ea\U0001f1e9\U0001f1ea", "a b c d e "):
        for width in (1, 2, 3, 60):
            assert text._wrapped(t, width) == _slowly(t, width)


def _slowly(t, width):
    import regex

    lines = [[]]
    for word in t.split(" "):
        signs = regex.findall(r"\X", word)
        room = width - len(lines[-1]) - 1
        if lines[-1] and len(signs) > room:
            lines.append([])
        elif lines[-1]:
            lines[-1].append(" ")
        while len(signs) > width:
            lines[-1] += signs[:width]
            signs = signs[width:]
            lines.append([])
        lines[-1] += signs
    return ["".join(line) for line in lines]


CONTOUR = "path_id bigint, seq bigint, x bigint, y bigint"
STAR = [(0, 100), (59, -81), (-95, 31), (95, 31), (-59, -81)]
SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]


def drawn(spark, *contours_):
    return spark.createDataFrame([(i, k + 1, *p) for i, c in enumerate(contours_) for k, p in enumerate(c)], CONTOUR)


def test_hulls_of_points_on_lines_and_repeats(spark):
    line, one, dented = [(0, 0), (2, 2), (1, 1), (2, 2)], [(5, 5), (5, 5)], [(0, 0), (4, 0), (2, 0), (2, 1), (4, 4), (0, 4), (0, 2)]
    got = contours.convex_hull(drawn(spark, line, one, dented)).orderBy("path_id", "place").collect()
    assert [[(r.x, r.y) for r in got if r.path_id == i] for i in range(3)] == [[(0, 0), (2, 2)], [(5, 5)], [(0, 0), (4, 0), (4, 4), (0, 4)]]


def test_fill_rules_agree_on_simple_contours_only(spark):
    bow = [(0, 0), (10, 10), (10, 0), (0, 10)]
    got = {r.path_id: r.code for r in contours.fill_rules(drawn(spark, STAR, SQUARE, bow)).collect()}
    assert got == {0: "differ", 1: "equal", 2: "undecided"}
    assert {r.path_id: r.domain for r in contours.domains(drawn(spark, STAR, SQUARE, bow)).collect()} == {0: "transverse", 1: "isolated", 2: "transverse"}


def test_probes_stop_short_of_the_next_edge(spark):
    thin = [(0, 0), (100, 0), (100, 1), (0, 1)]
    got = {r.seq: r.halvings for r in contours.side_probes(drawn(spark, thin)).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}
    flat = [(0, 0), (100, 0), (100, 0), (50, 0)]
    assert {r.halvings for r in contours.side_probes(drawn(spark, flat)).collect()} == {None}


def test_boxes_touching_an_edge_stay_undecided(spark):
    rows = [(0, 10, 10, 20, 20), (1, 100, 10, 120, 20), (2, 102, 10, 120, 20), (3, -200, -200, 300, 300)]
    boxes = spark.createDataFrame(rows, "path_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    got = {r.path_id: r.relation for r in contours.box_relation(drawn(spark, *[SQUARE] * 4), boxes).collect()}
    assert got == {0: "inside", 1: "undecided", 2: "outside", 3: "undecided"}


def test_a_contour_that_is_closed_gets_no_second_end(spark):
    got = contours.closed_under(drawn(spark, SQUARE, [*SQUARE, SQUARE[0]]), (1, 0, 0, 1, 0, 0)).groupBy("path_id").count().collect()
    assert {r["count"] for r in got} == {5}


def test_floats_enclose_a_double(spark):
    values = [1.0, 1.0 - 2.0**-30, 1.0 + 2.0**-30, 0.1, 3.0, 2.0**40 + 1]
    low, high = scalar.float_enclosure(F.col("v"))
    import numpy as np

    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", low.alias("low"), high.alias("high")).collect():
        assert r.low <= r.v <= r.high and np.float32(r.low) == r.low and np.float32(r.high) == r.high
        assert r.low == r.high == r.v or np.nextafter(np.float32(r.low), np.float32(np.inf)) == r.high


def test_roots_are_bounded_from_above(spark):
    for r in spark.range(0, 3000).select("id", scalar.sqrt_upper(F.col("id") * 104729, 8).alias("b")).collect():
        k, n = int(r.b * 256), r.id * 104729 << 16
        assert k * k >= n and (k == 0 or (k - 1) ** 2 < n)


def test_short_literals_are_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_relations, "LITERAL_BLOCK", 3)
    texts = ["Figure 1 shows the encoder", "a b c d e f g h", "encoders", None, "", "x\ty  z", "the encoder of Figure 12", "a b c d e f g h"]
    items = ["Figure 1", "encoder", "a b c d", "b c d e f", "b c d e f", "y  z", "x y", "e", "", None, "the encoder of Figure 1", "encoder", " ", "no such text"]
    tables = {
        "documents": spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"),
        "benchmark": spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string"),
        "labels": spark.createDataFrame([(0, 1), (2, 0)], "doc_id bigint, quality int"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["literal_evidence"](spark, str(tmp_path)).collect())
    want = sorted(con.sql(catalog.ORACLE_SQL["literal_evidence"]).fetchall())
    assert got == want and len({i for _, i, _ in want}) > 9


def test_chains_and_rings_of_any_length(spark):
    n = 300
    rows = [(i, i - 1 if i else None, 1.0, 2.0, "top" if i == 0 else None) for i in range(n)]
    ring = [(1000 + i, 1000 + (i + 1) % n, 1.0, 1.0, None) for i in range(n)] + [(2000, 1000, 1.0, 1.0, None), (3000, None, 5.0, 5.0, None)]
    tree = spark.createDataFrame(rows + ring, "child_id bigint, parent_id bigint, dx double, dy double, v string")
    want = {i: (0, i) for i in range(n)} | {3000: (3000, 0)}
    on = {1000 + i for i in range(n)} | {2000}
    order = {r.child_id: r for r in graph.attachment_order(tree).collect()}
    assert {i: (r.root_id, r.depth) for i, r in order.items() if not r.on_cycle} == want
    assert {i for i, r in order.items() if r.on_cycle} == on and all(order[i].root_id is order[i].depth is None for i in on)
    offsets = {r.child_id: (r.root_id, r.dx, r.dy) for r in graph.resolve_offsets(tree).collect()}
    assert offsets == {i: (root, 1.0 * d, 2.0 * d) for i, (root, d) in want.items()} | dict.fromkeys(on, (None, None, None))
    assert {r.child_id: r.v for r in layout.inherit(tree, "v").collect()} == {i: "top" if i < n else None for i in [*want, *on]}
    turns = [(i, (i * 1 + 7) % n) for i in range(n)] + [(5000 + i, 5000 + (i + 1) % 5) for i in range(5)] + [(7000 + i, 7001 + i) for i in range(n)]
    found = layout.rings(spark.createDataFrame(turns, "node bigint, successor bigint")).collect()
    assert {r.node: r.ring for r in found if r.code is None} == dict.fromkeys(range(n), 0) | {5000 + i: 5000 for i in range(5)}
    assert {r.node for r in found if r.code == "dangling"} == {7000 + i for i in range(n)} and len(found) == 2 * n + 5
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "def_id bigint, target_id bigint")
    ends = {r.use_id: (r.final_id, r.code) for r in graph.expand_references(chain.selectExpr("def_id AS use_id", "def_id AS ref_id"), chain).collect()}
    assert ends == {i: (0, None) if i < 32 else (None, "too_deep") for i in range(40)}
