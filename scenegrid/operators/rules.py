"""Rules on records and on ordered records. A rule gives a code; it never drops a record and never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.operators.tables import Rounds, written

#: The math commands, control symbols and characters that are accepted.
MATH_COMMANDS = """mathbf mathrm mathit mathsf mathtt mathcal text
frac dfrac tfrac sqrt left right vert Vert lvert rvert lVert rVert
Pi pi Gamma gamma Delta delta Sigma sigma Omega omega Lambda lambda
Theta theta Phi phi Psi psi alpha beta eta rho tau epsilon varepsilon
mu nu xi zeta kappa chi upsilon varphi varrho vartheta
sum prod int iint iiint oint lim min max sin cos tan exp log ln
operatorname underset overset substack displaystyle textstyle
circ cdot times pm mp div in notin subset subseteq supset supseteq
le leq ge geq neq approx sim simeq equiv propto to mapsto
infty partial nabla ell ldots cdots vdots ddots forall exists emptyset
top bot perp parallel hat widehat bar overline underline vec dot ddot
quad qquad thinspace medspace thickspace negthinspace
big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr Biggl Biggr
underbrace overbrace langle rangle lbrace rbrace""".split()
MATH_SYMBOLS = ",;:!{}| "
MATH_CHARACTERS = r"a-zA-Z0-9 {}()\[\]|+\-=,.:*/^_!<>\t\n\r\\\\"
#: Caps and joins, and how many stops a gradient has.
CAPS, JOINS = ("butt", "round", "square"), ("miter", "round", "bevel")
STOPS = (2, 64)
KINDS = ("path", "text", "image", "formula")
SLACK = 0.001


def object_rules(width: float, height: float, top_opacity: float = 1.0) -> dict[str, Column]:
    """code -> true where the rule is broken."""
    outside = (F.col("x") < -SLACK) | (F.col("y") < -SLACK) | (F.col("x") + F.col("width") > width + SLACK) | (F.col("y") + F.col("height") > height + SLACK)
    return {
        "outside_canvas": outside,
        "bad_opacity": (F.col("opacity") < 0) | (F.col("opacity") > top_opacity),
        "bad_colour": ~F.col("fill").rlike("^(none|#[0-9A-F]{6})$"),
        "empty_box": F.col("width") <= 1,
        "stroked_image": (F.col("stroke_width") > 0) & (F.col("kind") == "image"),
        "unknown_kind": ~F.col("kind").isin(*KINDS),
    }


def findings(objects: DataFrame, keys: list[str], broken: dict[str, Column]) -> DataFrame:
    """One row per broken rule, in one pass over the objects."""
    codes = F.array(*[F.when(c, F.lit(code)) for code, c in broken.items()])
    return objects.select(*keys, F.explode(F.array_compact(codes)).alias("code"))


def spec_findings(nodes: DataFrame, edges: DataFrame, stages: int = 12, lanes2: int = 15) -> DataFrame:
    """code and id of everything wrong with graph specs."""
    ids = nodes.select("node_id")
    found = nodes.groupBy("scene_id", "stage", "lane2").agg(F.min("node_id").alias("id"), F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_slot").alias("code"), "id")
    for end in ("from", "to"):
        loose = edges.select("edge_id", F.col(f"{end}_id").alias("node_id")).join(ids, "node_id", "left_anti")
        found = found.union(loose.select(F.lit(f"unknown_{end}"), "edge_id"))
    found = found.union(edges.where("from_id = to_id").select(F.lit("self_loop"), "edge_id"))
    found = found.union(nodes.where((F.col("stage") > stages) | (F.col("stage") < 0)).select(F.lit("stage_range"), "node_id"))
    return found.union(nodes.where(F.col("lane2") > lanes2).select(F.lit("lane_range"), "node_id"))


def gradient_code(offsets: Column) -> Column:
    """Offsets that span 0 to 1 and grow, also when they are quantised. With ``order`` wanted as well, the least and the
    greatest are the first and the last."""
    units = F.transform(offsets, lambda o: F.floor(o * 100_000 + 0.5))
    grows = F.forall(F.zip_with(F.slice(units, 1, F.size(units) - 1), F.slice(units, 2, F.size(units) - 1), lambda a, b: a < b), lambda x: x)
    return (
        F.when(~F.size(offsets).between(*STOPS), "count")
        .when(F.exists(offsets, lambda o: F.isnan(o) | (o < 0) | (o > 1)), "range")
        .when((F.array_min(offsets) != 0) | (F.array_max(offsets) != 1), "span")
        .when(~grows, "order")
        .otherwise("ok")
    )


def stroke_code() -> Column:
    """From kind, hairline, stroke_width, join, miterlimit, cap; null where a property isn't given."""
    explicit = F.coalesce("hairline", F.lit(False)) | F.col("join").isNotNull() | F.col("cap").isNotNull() | F.col("miterlimit").isNotNull()
    units = F.floor(F.col("miterlimit") * 100_000 + 0.5)
    return (
        F.when(explicit & (F.col("kind") != "path"), "kind")
        .when(F.col("hairline") & (F.col("stroke_width") != 0), "hairline_width")
        .when(~F.col("cap").isin(*CAPS), "cap")
        .when(~F.col("join").isin(*JOINS), "join")
        .when((F.col("miterlimit") <= 0) | (units < 1) | (units > 2**31 - 1), "miter")
        .when(F.col("miterlimit").isNotNull() & ~F.coalesce(F.col("join") == "miter", F.lit(False)), "miter_join")
        .otherwise("ok")
    )


def spacing_code(text: str, spacing: str) -> Column:
    return F.when(~F.col(text).rlike("^[ -~]*$"), "not_ascii").when(F.size(spacing) != F.length(text) - 1, "length").when(F.exists(spacing, lambda v: F.abs(v) > 1000), "range").otherwise("ok")


def math_code(tex: str, depth: int = 32) -> Column:
    """Only known commands, symbols and characters; balanced braces of bounded depth. An escaped brace doesn't nest."""
    text = F.col(tex)
    escapes = F.regexp_extract_all(text, F.lit(r"(?s)\\([A-Za-z]+|.|$)"), 1)
    commands = F.filter(escapes, lambda c: c.rlike("^[A-Za-z]+$"))
    symbols = F.filter(escapes, lambda c: ~c.rlike("^[A-Za-z]+$"))
    marks = F.regexp_extract_all(F.regexp_replace(text, r"(?s)\\([A-Za-z]+|.)", ""), F.lit(r"[{}]"), 0)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"), F.lit(0).alias("low"))

    def step(a: Column, m: Column) -> Column:
        at = a["at"] + F.when(m == "{", 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(a["top"], at).alias("top"), F.least(a["low"], at).alias("low"))

    nesting = F.aggregate(marks, start, step)
    return (
        F.when((F.trim(text) == "") | (F.length(text) > 4096), "length")
        .when(F.contains(text, F.lit("^^")), "double_caret")
        .when(F.size(F.array_except(commands, F.array(*map(F.lit, MATH_COMMANDS)))) > 0, "command")
        .when(F.size(F.array_except(symbols, F.array(*map(F.lit, MATH_SYMBOLS)))) > 0, "symbol")
        .when(text.rlike(f"[^{MATH_CHARACTERS}]"), "character")
        .when((nesting["at"] != 0) | (nesting["low"] < 0), "braces")
        .when(nesting["top"] > depth, "depth")
        .otherwise("ok")
    )


def region_status(x0: float, y0: float, x1: float, y1: float) -> Column:
    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    inside = (F.col("x") >= x0) & (F.col("y") >= y0) & (right <= x1) & (bottom <= y1)
    meets = (F.col("x") < x1) & (right > x0) & (F.col("y") < y1) & (bottom > y0)
    return F.when(inside, "inside").when(meets, "partial").otherwise("skipped")


def path_code(path: str) -> Column:
    """A relative path without dot segments that never climbs out of its folder."""
    steps = F.split(path, "/")
    climbs = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return F.when(F.startswith(F.col(path), F.lit("/")) | F.contains(F.col(path), F.lit("\\")), "absolute").when(climbs["low"] < 0, "escapes").when(F.exists(steps, lambda s: (s == ".") | (s == "..") | (s == "")), "dot_segment").otherwise("ok")


def json_code(text: Column) -> Column:
    """Strict JSON: one value, nothing after it, no key twice."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_variant_get(wrapped, "$[0]", "variant").isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.when(wrapped.isNull() | ~one, "malformed").otherwise("ok")


def ring(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("path_id").orderBy("seq")
    first = Window.partitionBy("path_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    back = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return points.select("path_id", "seq", "x", "y", back("x").alias("nx"), back("y").alias("ny"))


def drop_collinear(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("path_id").orderBy("seq")
    near = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    return near.where("px IS NULL OR nx IS NULL OR (x - px) * (ny - y) <> (y - py) * (nx - x)").select("path_id", "seq", "x", "y")


def subpaths(commands: DataFrame) -> DataFrame:
    """The number of each command's subpath and its start."""
    w = Window.partitionBy("path_id").orderBy("seq")
    numbered = commands.withColumn("subpath", F.sum(F.when(F.col("op") == "M", 1).otherwise(0)).over(w))
    start = Window.partitionBy("path_id", "subpath").orderBy("seq")
    return numbered.select("path_id", "seq", "subpath", F.first("x").over(start).alias("sx"), F.first("y").over(start).alias("sy"))


def painter_order(objects: DataFrame) -> DataFrame:
    return objects.withColumn("slot", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.coalesce("z_index", "ordinal"), "ordinal")).cast("long"))


#: Scenes of so many rows are folded in one record each; larger ones go through rounds.
FOLDED = 10_000


def _folded_budget(rows: DataFrame, budget: float) -> DataFrame:
    """scene, n, taken and used of scenes (scene, place, cost) of a bounded size."""
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).cast("long").alias("taken"))

    def step(a: Column, r: Column) -> Column:
        fits = F.coalesce((r["cost"] >= 0) & (a["used"] + r["cost"] <= budget), F.lit(False))
        return F.struct((a["used"] + F.when(fits, r["cost"]).otherwise(0.0)).alias("used"), (a["taken"] + fits.cast("long")).alias("taken"))

    costs = rows.groupBy("scene").agg(F.sort_array(F.collect_list(F.struct("place", "cost"))).alias("c"))
    return costs.select("scene", F.size("c").cast("long").alias("n"), F.aggregate("c", start, step).alias("s")).select("scene", "n", "s.taken", "s.used")


def greedy_budget(rows: DataFrame, scene: str, order: str, cost: str, budget: float, folded: int = FOLDED) -> DataFrame:
    """Rows of each scene in order, taken while they fit: scene, n_taken, n_skipped and what is used. Costs are not negative; null and negative ones are skipped; of rows with equal
    order the cheaper comes first. Scenes of up to ``folded`` rows are folded in one record each. Larger ones go through rounds, with the same result: a round takes the longest prefix that fits, then drops every row larger than the room that is left, since room only shrinks; the next one goes on with
    those that remain. Rows are dealt once by ranges of scene and order: running sums are taken within a range and added to those of the ranges before, so a scene
    with most of the rows is as many tasks as it has ranges."""
    named = rows.select(F.col(scene).alias("scene"), F.col(order).alias("place"), F.col(cost).cast("double").alias("cost"))
    n = written(named.groupBy("scene").agg(F.count("*").alias("n")), "budget-sizes")
    large = n.where(F.col("n") > folded)
    if large.isEmpty():
        done = _folded_budget(named, budget)
    else:
        few = named.join(n.where(F.col("n") <= folded).select("scene"), "scene", "left_semi")
        done = _folded_budget(few, budget).unionByName(_budget_by_rounds(named.join(large.select("scene"), "scene", "left_semi"), large, budget))
    return done.select(F.col("scene").alias(scene), F.col("taken").alias("n_taken"), (F.col("n") - F.col("taken")).alias("n_skipped"), "used")


def _budget_by_rounds(rows: DataFrame, n: DataFrame, budget: float) -> DataFrame:
    """scene, n, taken and used of scenes (scene, place, cost) of any size, whose sizes are in ``n``."""
    ranges, states = Rounds(rows.sparkSession, "budget"), Rounds(rows.sparkSession, "budget-state")
    fit = rows.where((F.col("cost") >= 0) & (F.col("cost") <= budget))
    left = ranges.replace(fit.repartitionByRange("scene", "place", "cost").withColumn("range", F.spark_partition_id()))
    state = states.replace(n.select("scene", "n", F.lit(0).cast("long").alias("taken"), F.lit(0.0).alias("used")))
    while not left.isEmpty():
        before = Window.partitionBy("scene").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = left.groupBy("scene", "range").agg(F.sum("cost").alias("sum")).select("scene", "range", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("before"))
        within = Window.partitionBy("scene", "range").orderBy("place", "cost").rowsBetween(Window.unboundedPreceding, 0)
        run = left.join(sums, ["scene", "range"]).withColumn("run", F.col("before") + F.sum("cost").over(within)).join(state.select("scene", "used"), "scene")
        run = run.withColumn("fits", F.col("used") + F.col("run") <= budget)
        more = run.where("fits").groupBy("scene").agg(F.count("*").alias("more"), F.sum("cost").alias("cost"))
        after = states.write(state.join(more, "scene", "left").select("scene", "n", (F.col("taken") + F.coalesce("more", F.lit(0))).alias("taken"), (F.col("used") + F.coalesce("cost", F.lit(0.0))).alias("used")))
        rest = run.where("NOT fits").drop("used").join(after.select("scene", "used"), "scene").where(F.col("cost") <= budget - F.col("used"))
        left, state = ranges.replace(rest.select("scene", "place", "cost", "range")), after
    return state.select("scene", "n", "taken", "used")
