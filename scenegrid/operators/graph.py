"""Graphs of records: order of attachments, roots, reference chains, components, routing grids.

Depth is found by pointer doubling: each round a record's parent pointer jumps to where the parent's
pointer points, so a chain of length n takes log2(n) joins and there is no limit of recursion. Pointers are joined on ids that are
there once, so no round has more records than the one before, and after log2(records) + 1 rounds a record that is still open stands on a cycle or hangs below one.
Every id has one row in the result, with a code where it has no answer: ``repeated_id`` (its id, or one above it, names several records),
``dangling`` (a parent above it isn't there) or ``cycle``. Each round is a written table, so the plan doesn't double; the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrid.operators.tables import Rounds, written


def doubled(step: DataFrame, key: str, merge: dict[str, Column], rounds: int | None = None, until: str = "closed") -> DataFrame:
    """One round after another over ``step`` (key, at, open and the columns of ``merge``; a record that isn't open points to itself), until no record is
    open, a round closes none, or log2(records) + 1 rounds are done. merge: each column after a round, from its own value and, as up_..., the one
    of the record pointed to. The result has a column ``code`` more: repeated_id, dangling, or cycle for those that stay open. ``until``: in place of the end above,
    ``unchanged`` ends after a round that leaves none open, and ``bound`` after all rounds; neither codes cycles. ``rounds``: do no more than so many."""
    tables = Rounds(step.sparkSession, "graph")
    rest = [c for c in step.columns if c not in (key, "at", "open")]
    once = F.col("copies") == 1
    one = step.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("at", "open", *rest)])
    alone = [F.when(once, F.col("at")).otherwise(F.col(key)).alias("at"), (once & F.col("open")).alias("open"), *[F.when(once, F.col(c)).alias(c) for c in rest]]
    step = tables.replace(one.select(key, *alone, F.when(~once, "repeated_id").alias("code")))
    n = step.count()
    most = max(1, n - 1).bit_length() + 1
    most, before = most if rounds is None else min(rounds, most), None
    names = [c for c in merge if c != "open"]
    for _ in range(most):
        if until != "bound":
            now = step.where("open").count()
            if not now or now == before and until == "closed":
                break
            before = now
        up = step.select(F.col(key).alias("at"), F.col("at").alias("next"), F.col("open").alias("up_open"), F.col("code").alias("up_code"), *[F.col(c).alias(f"up_{c}") for c in rest])
        there = F.col("next").isNotNull()
        code = F.coalesce(F.col("code"), F.when(~there, "dangling"), F.col("up_code"))
        opened = merge["open"] & there & code.isNull()
        going = step.join(up, "at", "left")
        step = tables.replace(going.select(key, F.coalesce("next", "at").alias("at"), F.coalesce(opened, F.lit(False)).alias("open"), *[F.when(there, merge[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rest], code.alias("code")))
    return step if until != "closed" else step.withColumn("code", F.coalesce(F.col("code"), F.when(F.col("open"), "cycle")))


def attachment_order(attachments: DataFrame, rounds: int | None = None) -> DataFrame:
    """child_id, root_id, depth (0: a root), on_cycle and a code of each id."""
    has = F.col("parent_id").isNotNull()
    step = attachments.select("child_id", F.coalesce("parent_id", "child_id").alias("at"), F.when(has, 1).otherwise(0).cast("long").alias("depth"), has.alias("open"))
    done = doubled(step, "child_id", {"depth": F.col("depth") + F.col("up_depth"), "open": F.col("up_open")}, rounds)
    sound = F.col("code").isNull()
    return done.select("child_id", F.when(sound, F.col("at")).alias("root_id"), F.when(sound, F.col("depth")).alias("depth"), F.col("open").alias("on_cycle"), "code")


def resolve_offsets(attachments: DataFrame, rounds: int | None = None) -> DataFrame:
    """child_id, root_id and the sum of the offsets from each record up to its root, by the same doubling; null with a code where there is no root."""
    has = F.col("parent_id").isNotNull()
    step = attachments.select("child_id", F.coalesce("parent_id", "child_id").alias("at"), F.when(has, F.col("dx")).otherwise(0.0).alias("dx"), F.when(has, F.col("dy")).otherwise(0.0).alias("dy"), has.alias("open"))
    done = doubled(step, "child_id", {"dx": F.col("dx") + F.col("up_dx"), "dy": F.col("dy") + F.col("up_dy"), "open": F.col("up_open")}, rounds)
    return done.select("child_id", *[F.when(F.col("code").isNull(), F.col(c)).alias(name) for c, name in (("at", "root_id"), ("dx", "dx"), ("dy", "dy"))], "code")


def expand_references(uses: DataFrame, definitions: DataFrame, depth: int = 32) -> DataFrame:
    """Chains of references (ref_id -> target_id, null at the end): the final target, the number of steps
    and a code (``cycle``, ``too_deep`` or ``dangling``) where there is none."""
    table = definitions.select(F.col("def_id").alias("at"), "target_id", F.lit(True).alias("known"))
    state = uses.select("use_id", F.col("ref_id").alias("at"), F.array("ref_id").alias("path"), F.lit(None).cast("string").alias("code"), F.lit(False).alias("done"))
    tables = Rounds(uses.sparkSession, "references")
    for _ in range(depth):
        state = tables.replace(state)
        if state.where("NOT done").isEmpty():
            break
        found = state.join(table, "at", "left")
        going = ~F.col("done")
        missing, end = F.col("known").isNull(), F.col("target_id").isNull()
        loop = F.array_contains("path", F.col("target_id"))
        code = F.when(going & missing, "dangling").when(going & loop, "cycle").otherwise(F.col("code"))
        move = going & ~missing & ~end & ~F.coalesce(loop, F.lit(False))
        state = found.select(
            "use_id",
            F.when(move, F.col("target_id")).otherwise(F.col("at")).alias("at"),
            F.when(move, F.concat("path", F.array("target_id"))).otherwise(F.col("path")).alias("path"),
            code.alias("code"),
            (~move).alias("done"),
        )
    code = F.when(~F.col("done"), "too_deep").otherwise(F.col("code"))
    return state.select("use_id", F.when(code.isNull(), F.col("at")).alias("final_id"), F.size("path").cast("long").alias("steps"), code.alias("code"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link (columns a, b, of one comparable type); the component is its smallest node. Each round takes the smallest
    label among the neighbours, then the label of that label, so chains shorten by halves; minima are added up before the shuffle, so a node with very many
    links costs a row a task. Nodes and labels stay in tables and are shuffled, not broadcast: small files may hold many labels, and each round would
    send them through the driver."""
    tables = Rounds(links.sparkSession, "components")
    one = links.select(F.col("a").alias("node"), F.col("b").alias("other")).where("a <> b")
    both = tables.write(one.union(one.select("other", "node")).distinct())
    rounds, halves = Rounds(links.sparkSession, "labels"), Rounds(links.sparkSession, "lower")
    labels = rounds.replace(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        near = both.hint("merge").join(labels.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.hint("merge").join(near.hint("merge"), "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        lower = halves.replace(lower)
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = rounds.replace(lower.hint("merge").join(roots.hint("merge"), "component").select("node", F.col("root").alias("component"), (F.col("root") != F.col("old")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "component")


def routing_grid(obstacles: DataFrame, margin: float) -> DataFrame:
    """Points of the orthogonal visibility grid of each scene: lines ``margin`` away from the obstacles' edges,
    without the points strictly inside a grown obstacle. Each obstacle meets the lines of its scene by axis, then the
    points that it covers are taken out by equal keys, so the cost is the points, covered ones included."""
    grown = obstacles.select("scene_id", F.monotonically_increasing_id().alias("box"), (F.col("x") - margin).alias("x0"), (F.col("y") - margin).alias("y0"), (F.col("x") + F.col("width") + margin).alias("x1"), (F.col("y") + F.col("height") + margin).alias("y1"))
    grown = written(grown)
    xs = grown.select("scene_id", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    ys = grown.select("scene_id", F.explode(F.array("y0", "y1")).alias("y")).distinct()
    within = [grown.join(lines, "scene_id").where((F.col(c) > F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1"))).select("scene_id", "box", c) for lines, c in ((xs, "x"), (ys, "y"))]
    covered = within[0].join(within[1], ["scene_id", "box"]).select("scene_id", "x", "y").distinct()
    return xs.join(ys, "scene_id").join(covered, ["scene_id", "x", "y"], "left_anti")
