"""Layout of graphs: boxes of nodes, routes of edges, places of labels."""

from __future__ import annotations

import heapq
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.functions.geometry import let
from scenegrid.operators import graph, relations
from scenegrid.operators.tables import Rounds, tasks, written

#: Fixed values, in pixels: width and least height of nodes, the gaps between columns and rows, where the first node stands, the
#: margins of group frames, the cost of a bend, the margin of obstacles, and how far a route leads out of its port.
WIDTH, HEIGHT, COLUMN_GAP, ROW_GAP, LEFT, TOP = 196.0, 96.0, 100.0, 110.0, 64.0, 132.0
FRAME, HEADER = 20.0, 44.0
BEND, MARGIN, LEAD = 28.0, 16.0, 20.0


def node_boxes(nodes: DataFrame, height: float = HEIGHT) -> DataFrame:
    """Boxes by stage and half-lane, left to right. ``height``: that of the scene's highest node."""
    x, y = F.lit(LEFT) + F.col("stage") * (WIDTH + COLUMN_GAP), F.lit(TOP) + F.col("lane2") / 2 * (height + ROW_GAP)
    return nodes.select("scene_id", "node_id", x.alias("x"), y.alias("y"), F.lit(WIDTH).alias("width"), F.lit(height).alias("height"))


def group_frames(members: DataFrame) -> DataFrame:
    """Frames of groups around the boxes of their members (scene_id, group_id, x, y, width, height), with room for a header."""
    g = members.groupBy("scene_id", "group_id").agg((F.min("x") - FRAME).alias("x"), (F.min("y") - HEADER).alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b"))
    return g.select("scene_id", "group_id", "x", "y", (F.col("r") - F.col("x") + FRAME).alias("width"), (F.col("b") - F.col("y") + FRAME).alias("height"))


def edge_sites() -> tuple[Column, Column]:
    """The sites at which an edge of ``kind`` leaves box a and enters box b, in a scene that runs left to right."""
    ax, ay, bx, by = (F.col(c) for c in ("a.x", "a.y", "b.x", "b.y"))
    kind = F.col("kind")
    under, across, down = kind.isin("feedback", "skip"), ax != bx, ay != by
    upright = lambda low, high: F.when(ay < by, low).otherwise(high)
    level = lambda low, high: F.when(ax < bx, low).otherwise(high)
    out = F.when(under, "bottom").when((kind == "training") & down, upright("bottom", "top")).when(across, level("right", "left")).when(down, upright("bottom", "top")).otherwise(level("right", "left"))
    into = F.when(under, "bottom").when((kind == "training") & down, upright("top", "bottom")).when(across, level("left", "right")).when(down, upright("top", "bottom")).otherwise(level("left", "right"))
    return out, into


def _passable(lines: np.ndarray, others: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Per line and gap between neighbouring cross lines: whether no box blocks it. A box lies from low to high across
    the lines and from at to to along them."""
    out = np.ones((len(lines), len(others) - 1), bool)
    spans = np.searchsorted(lines, low, "right"), np.searchsorted(lines, high, "left"), np.maximum(np.searchsorted(others, at, "right") - 1, 0), np.searchsorted(others, to, "left")
    for a, b, c, d in zip(*(v.tolist() for v in spans), strict=True):
        out[a:b, c:d] = False
    return out


def cheapest_route(start: tuple, goal: tuple, boxes: list[tuple]) -> tuple[float, list[tuple]]:
    """Manhattan length plus BEND per turn on the visibility grid of the boxes (x0, y0, x1, y1), which routes don't enter:
    the cost and the corners of the route, of equally cheap ones one with the fewest bends. The search goes by the cost so far and
    what is left at least: the distance, and a turn where the goal isn't straight ahead, which is the cost without boxes."""
    b = np.array(boxes, float).reshape(-1, 4)
    xs = np.unique(np.concatenate([[start[0], goal[0]], b[:, 0] - MARGIN, b[:, 2] + MARGIN]))
    ys = np.unique(np.concatenate([[start[1], goal[1]], b[:, 1] - MARGIN, b[:, 3] + MARGIN]))
    level = _passable(ys, xs, b[:, 1], b[:, 3], b[:, 0], b[:, 2]).tolist()
    upright = _passable(xs, ys, b[:, 0], b[:, 2], b[:, 1], b[:, 3]).tolist()
    place = lambda p: (int(np.searchsorted(xs, p[0])), int(np.searchsorted(ys, p[1])))
    first, last = place(start), place(goal)
    xl, yl = xs.tolist(), ys.tolist()

    def left(n: tuple, axis: int) -> tuple[float, int]:
        dx, dy = abs(xl[n[0]] - goal[0]), abs(yl[n[1]] - goal[1])
        turns = int(dx > 0 and dy > 0 or dx > 0 and axis == 1 or dy > 0 and axis == 0)
        return dx + dy + BEND * turns, turns

    best: dict[tuple, tuple] = {(first, -1): (0.0, 0)}
    came: dict[tuple, tuple] = {}
    done: set[tuple] = set()
    far, turns = left(first, -1)
    # by the least cost and turns of the whole route; of equal ones that with the least left goes on
    todo: list[tuple] = [(far, turns, far, 0.0, 0, first, -1)]
    while todo:
        *_, cost, bends, node, axis = heapq.heappop(todo)
        if (node, axis) in done:
            continue
        done.add((node, axis))
        if node == last:
            way = [(node, axis)]
            while way[-1] in came:
                way.append(came[way[-1]])
            points = [(xl[i], yl[j]) for (i, j), _ in reversed(way)]
            inner = [q for p, q, r in zip(points, points[1:], points[2:], strict=False) if not (p[0] == q[0] == r[0] or p[1] == q[1] == r[1])]
            return cost, [points[0], *inner, points[-1]] if len(points) > 1 else points
        i, j = node
        steps = []
        if i + 1 < len(xl) and level[j][i]:
            steps.append(((i + 1, j), 0, xl[i + 1] - xl[i]))
        if i and level[j][i - 1]:
            steps.append(((i - 1, j), 0, xl[i] - xl[i - 1]))
        if j + 1 < len(yl) and upright[i][j]:
            steps.append(((i, j + 1), 1, yl[j + 1] - yl[j]))
        if j and upright[i][j - 1]:
            steps.append(((i, j - 1), 1, yl[j] - yl[j - 1]))
        for there, turn, length in steps:
            bent = int(axis not in (-1, turn))
            new = cost + length + BEND * bent, bends + bent
            if new < best.get((there, turn), (float("inf"), 0)):
                best[(there, turn)] = new
                came[(there, turn)] = (node, axis)
                far, turns = left(there, turn)
                heapq.heappush(todo, (new[0] + far, new[1] + turns, far, *new, there, turn))
    return float("inf"), []


#: Bytes of scenes whose edges are routed in one task: a search takes far longer than reading its scene.
ROUTED = 64 << 10


def routes(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """edge_id, cost, n_points (ends and bends) and a code for each edge (scene_id, edge_id, x1, y1, x2, y2) around the boxes
    of its scene. A scene has a bounded number of boxes, which travel to its edges; every edge is routed on its own, in as many tasks as the tables need."""
    obstacles = boxes.groupBy("scene_id").agg(F.collect_list(F.array("x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height"))).alias("boxes"))

    def run(batches):
        for pdf in batches:
            found = [cheapest_route((r.x1, r.y1), (r.x2, r.y2), [tuple(b) for b in r.boxes]) for r in pdf.itertuples()]
            yield pd.DataFrame({"edge_id": pdf["edge_id"], "cost": [c for c, _ in found], "n_points": [len(p) for _, p in found], "code": ["ok" if p else "no_route" for _, p in found]})

    # a broadcast would leave the edges in the tasks that their files were read in
    dealt = edges.repartition(tasks(edges, ROUTED), "scene_id").join(obstacles.hint("merge"), "scene_id")
    return dealt.mapInPandas(run, "edge_id bigint, cost double, n_points bigint, code string")


def label_places(labels: DataFrame, boxes: DataFrame, candidates: int = 4) -> DataFrame:
    """Places of labels (scene_id, label_id, x, y, width, height), one after another by label_id: each takes the first of its candidate places that lies over no box of the scene and over no
    label placed before it. label_id, place, x, y; null where none is free.

    Which candidates meet is found once, in cells. Then rounds: a label is settled when none of its first free place's rivals, the free places of labels before it that aren't settled, is left;
    its place takes the places that it covers from the labels after it. The first label of any crowd is settled in each round, so the number of rounds is that of the longest chain of labels
    that wait for one another; the result is that of going through them in order."""
    spots = F.explode(F.expr(f"transform(sequence(0, {candidates - 1}), i -> struct(bigint(i) AS place, x + i * 30 AS cx, y - i * 25 AS cy))"))
    c = labels.select("scene_id", "label_id", "width", "height", spots.alias("s")).select("scene_id", "label_id", "s.place", F.col("s.cx").alias("x"), F.col("s.cy").alias("y"), "width", "height")
    c = written(c.withColumns({v: F.col(v).cast("double") for v in ("x", "y", "width", "height")}), "labels")
    name = lambda kind, own, place: F.struct(F.lit(kind).alias("kind"), own.cast("long").alias("own"), place.cast("long").alias("place")).alias("object_id")
    size = [F.col(v).cast("double").alias(v) for v in ("x", "y", "width", "height")]
    union = c.select("scene_id", name(1, F.col("label_id"), F.col("place")), *size).union(boxes.select("scene_id", name(0, F.monotonically_increasing_id(), F.lit(0)), *size))
    tells = (F.col("p.object_id.kind") + F.col("q.object_id.kind") > 0) & ((F.col("p.object_id.kind") != F.col("q.object_id.kind")) | (F.col("p.object_id.own") != F.col("q.object_id.own")))
    met = written(relations.overlaps(written(union, "label-boxes"), only=tells).select("a_id", "b_id"), "label-pairs")
    over = met.where("a_id.kind = 0").select(F.col("b_id.own").alias("label_id"), F.col("b_id.place").alias("place")).distinct()
    rivals = met.where("a_id.kind = 1").select(F.col("a_id.own").alias("before"), F.col("a_id.place").alias("its"), F.col("b_id.own").alias("label_id"), F.col("b_id.place").alias("place"))
    free, settled = Rounds(labels.sparkSession, "free-places"), Rounds(labels.sparkSession, "settled")
    left, done = free.replace(c.select("label_id", "place").join(over, ["label_id", "place"], "left_anti")), []
    while not left.isEmpty():
        first = left.groupBy("label_id").agg(F.min("place").alias("place"))
        waiting = rivals.join(first, ["label_id", "place"]).join(left.select(F.col("label_id").alias("before"), F.col("place").alias("its")), ["before", "its"], "left_semi").select("label_id").distinct()
        now = settled.write(first.join(waiting, "label_id", "left_anti"))
        taken = rivals.join(now.select(F.col("label_id").alias("before"), F.col("place").alias("its")), ["before", "its"]).select("label_id", "place")
        left = free.replace(left.join(now.select("label_id"), "label_id", "left_anti").join(taken, ["label_id", "place"], "left_anti"))
        done.append(now)
    chosen = reduce(DataFrame.union, done, c.limit(0).select("label_id", "place"))
    return labels.select("label_id").join(chosen.join(c.select("label_id", "place", "x", "y"), ["label_id", "place"]), "label_id", "left").select("label_id", "place", "x", "y")


def inherit(tree: DataFrame, value: str, rounds: int | None = None) -> DataFrame:
    """child_id, the value of the nearest record, itself first, that has one, and a code, by pointer doubling up the tree. Without a value on the way
    up the code tells why: null at a root, else dangling, repeated_id or cycle."""
    has, bare = F.col("parent_id").isNotNull(), F.col(value).isNull()
    step = tree.select("child_id", F.when(bare, F.coalesce("parent_id", "child_id")).otherwise(F.col("child_id")).alias("at"), F.col(value).alias("v"), (has & bare).alias("open"))
    done = graph.doubled(step, "child_id", {"v": F.coalesce("v", "up_v"), "open": F.col("open") & F.col("up_open")}, rounds)
    return done.select("child_id", F.col("v").alias(value), "code")


def rings(successors: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, the smallest node of the ring that its successors run through, and a code: successors that run to a node that isn't there are ``dangling``, those to a node
    with several successors ``repeated_id``, those into a ring that their node isn't on ``not_on_ring``. Where each node is pointed to once, a round without a change
    has gone around every ring; otherwise log2(nodes) + 1 rounds have gone past every node that leads into one."""
    step = successors.select("node", F.col("successor").alias("at"), F.least("node", "successor").alias("ring"), F.lit(True).alias("open"))
    fewer = {"ring": F.least("ring", "up_ring"), "open": F.col("up_ring") < F.col("ring")}
    n, pointed, nodes = successors.agg(F.count("*"), F.count_distinct("successor"), F.count_distinct("node")).first()
    done = written(graph.doubled(step, "node", fewer, rounds, until="unchanged" if n == pointed == nodes else "bound"))
    # only nodes on rings are pointed to after so many steps: what a node off the ring sees isn't its own
    on = done.where("code IS NULL").select(F.col("at").alias("node")).distinct().withColumn("on", F.lit(True))
    code = F.coalesce(F.col("code"), F.when(F.col("on").isNull(), "not_on_ring"))
    return done.join(on, "node", "left").select("node", F.when(code.isNull(), F.col("ring")).alias("ring"), code.alias("code"))


_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_CALL = r"([A-Za-z]+)\s*\(([^()]*)\)\s*,?\s*"


def matrix(text: Column) -> Column:
    """The product of a transform list (matrix, translate, scale, rotate about the origin or a point, skewX, skewY) as an array of six; the identity for an empty list. Null where
    anything of the list isn't read: another name, a wrong number of numbers, text in between."""
    calls = F.regexp_extract_all(text, F.lit(_CALL), 0)

    def times(m: Column, k: Column) -> Column:
        a, b = [m[i] for i in range(6)], [k[i] for i in range(6)]
        return F.array(a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])

    def read(c: Column) -> Column:
        args = F.regexp_extract(c, _CALL, 2)
        n = F.transform(F.regexp_extract_all(args, F.lit(_NUMBER), 0), lambda x: x.try_cast("double"))
        sound = ~F.regexp_replace(args, _NUMBER, "").rlike(r"[^\s,]")
        return let(F.struct(F.regexp_extract(c, _CALL, 1).alias("k"), F.when(sound, n).alias("n")), item)

    def item(s: Column) -> Column:
        zero, unit, n = F.lit(0.0), F.lit(1.0), [F.get(s["n"], F.lit(i)) for i in range(6)]
        is_ = lambda name, *sizes: (s["k"] == name) & F.size(s["n"]).isin(*sizes)
        co, si = F.cos(F.radians(n[0])), F.sin(F.radians(n[0]))
        px, py = F.coalesce(n[1], zero), F.coalesce(n[2], zero)
        return (
            F.when(is_("matrix", 6), F.array(*n))
            .when(is_("translate", 1, 2), F.array(unit, zero, zero, unit, n[0], F.coalesce(n[1], zero)))
            .when(is_("scale", 1, 2), F.array(n[0], zero, zero, F.coalesce(n[1], n[0]), zero, zero))
            .when(is_("rotate", 1, 3), F.array(co, si, -si, co, px - co * px + si * py, py - si * px - co * py))
            .when(is_("skewX", 1), F.array(unit, zero, F.tan(F.radians(n[0])), unit, zero, zero))
            .when(is_("skewY", 1), F.array(unit, F.tan(F.radians(n[0])), zero, unit, zero, zero))
        )

    sound = ~F.regexp_replace(text, _CALL, "").rlike(r"\S")
    identity = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0)])
    product = lambda items: F.when(~F.exists(items, lambda i: i.isNull()), F.aggregate(items, identity, times))
    return F.when(sound, let(F.transform(calls, read), product))


def clip_polygon(points: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A convex polygon (array of struct x, y) inside a rectangle: one pass per side, each point with the next."""

    def side(inside, cut, p: Column) -> Column:
        following = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
        pairs = F.zip_with(p, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.flatten(F.transform(pairs, lambda e: F.concat(F.when(inside(e["a"]), F.array(e["a"])).otherwise(none), F.when(inside(e["a"]) != inside(e["b"]), F.array(cut(e["a"], e["b"]))).otherwise(none))))

    def upright(v: float):
        return lambda a, b: F.struct(F.lit(v).alias("x"), (a["y"] + (b["y"] - a["y"]) * (v - a["x"]) / (b["x"] - a["x"])).alias("y"))

    def level(v: float):
        return lambda a, b: F.struct((a["x"] + (b["x"] - a["x"]) * (v - a["y"]) / (b["y"] - a["y"])).alias("x"), F.lit(v).alias("y"))

    steps = [(lambda q: q["x"] >= x0, upright(x0)), (lambda q: q["x"] <= x1, upright(x1)), (lambda q: q["y"] >= y0, level(y0)), (lambda q: q["y"] <= y1, level(y1))]
    for inside, cut in steps:
        points = F.transform(F.array(points), partial(side, inside, cut))[0]
    return points


def match_in_order(wanted: DataFrame, found: DataFrame, scene: str, tolerance: float) -> DataFrame:
    """Records matched to a subsequence of others in order, by value within a tolerance: n, n_matched of the earliest
    matching, and ``unique``: all are matched, and in one way only. Both: scene, place, value.

    The earliest matching is one walk over the others that goes on to the next record at each hit, so it's linear; the latest is the same from the end. No record's place in
    the latest lies before its place in the earliest, so the two are the same exactly if their sums of places are."""
    listed = lambda df, name: df.groupBy(scene).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias(name))
    both = listed(wanted, "w").join(listed(found, "f"), scene).withColumns({"rw": F.reverse("w"), "rf": F.reverse("f")})
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("sum"))

    def walk(w: str, f: str, place) -> Column:
        def step(a: Column, v: Column) -> Column:
            hit = F.coalesce(F.abs(F.get(F.col(w), a["i"]) - v) <= tolerance, F.lit(False))
            return F.struct((a["i"] + hit.cast("int")).alias("i"), (a["j"] + 1).alias("j"), (a["sum"] + F.when(hit, place(a["j"])).otherwise(0)).alias("sum"))

        return F.aggregate(f, zero, step)

    done = both.select(scene, F.size("w").alias("n"), walk("w", "f", lambda j: j.cast("long")).alias("early"), walk("rw", "rf", lambda j: (F.size("f") - 1 - j).cast("long")).alias("late"))
    whole = F.col("early.i") == F.col("n")
    return done.select(scene, F.col("n").cast("long"), F.col("early.i").cast("long").alias("n_matched"), (whole & (F.col("early.sum") == F.col("late.sum"))).alias("unique"))


def sorted_along(points: DataFrame) -> DataFrame:
    """The rank of each point along its edge by parameter."""
    return points.withColumn("rank", F.row_number().over(Window.partitionBy("edge_id").orderBy("t", "point_id")).cast("long"))
