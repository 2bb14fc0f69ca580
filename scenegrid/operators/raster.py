"""Operators over tables of pixels: image_id, x, v (value), a (alpha)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrid.operators import graph
from scenegrid.operators.tables import written


def pixels(vectors: DataFrame) -> DataFrame:
    """Vectors as rows of grey pixels with a made-up alpha. Components are 32-bit floats and are scaled as such: beside an integer Spark would take them as doubles."""
    p = vectors.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return p.select("image_id", F.col("i").cast("long").alias("x"), (F.floor(F.abs("e") * F.lit(1000).cast("float")) % 256).alias("v"), ((F.col("image_id") * 7 + (F.col("i") + 1) * 13) % 256).alias("a"))


def on_white(p: DataFrame) -> DataFrame:
    return p.select("image_id", "x", F.expr("(v * a + 255 * (255 - a) + 127) div 255").alias("v"))


def error(p: DataFrame, q: DataFrame) -> DataFrame:
    """Mean and largest absolute difference of images of equal id."""
    both = p.select("image_id", "x", "v").join(q.select("image_id", "x", F.col("v").alias("w")), ["image_id", "x"])
    gap = F.abs(F.col("v") - F.col("w"))
    return both.groupBy("image_id").agg((F.sum(gap) / F.count("*")).alias("mae"), F.max(gap).alias("worst"))


def runs(p: DataFrame, threshold: int, least: int) -> DataFrame:
    """Runs of neighbouring pixels over the threshold: a component of a row, by the gap of place and rank."""
    front = p.where(F.col("v") > threshold)
    run = F.col("x") - F.row_number().over(Window.partitionBy("image_id").orderBy("x"))
    return front.withColumn("run", run).groupBy("image_id", "run").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("area")).where(F.col("area") >= least).drop("run")


def tiles(images: DataFrame, side: int) -> DataFrame:
    """Images as a grid of tiles, the last ones cut."""
    many = lambda c: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / side) - 1)
    t = images.withColumn("tx", F.explode(many("width"))).withColumn("ty", F.explode(many("height")))
    cut = lambda c, t: F.least(F.lit(side).cast("long"), F.col(c) - F.col(t) * side)
    return t.select("image_id", (F.col("tx") * side).alias("x"), (F.col("ty") * side).alias("y"), cut("width", "tx").alias("w"), cut("height", "ty").alias("h"))


#: Runs of neighbouring rows meet in blocks of this many pixels.
BLOCK = 64


def components(mask: DataFrame, least: int = 1) -> DataFrame:
    """8-connected components of foreground pixels (image_id, x, y; repeated ones count once) with their boxes and areas. Pixels become runs within their row; runs of
    neighbouring rows that touch are links, which are found in blocks of BLOCK pixels, so a run meets those beside it only; runs are joined into components by rounds of
    equivalences. An image is as many tasks as its rows need, whatever its size."""
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("image_id", "y").orderBy("x"))
    begun = mask.select("image_id", "x", "y").withColumn("new", F.when(gap <= 1, 0).otherwise(1))
    run = F.sum("new").over(Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    spans = begun.withColumn("run", run).groupBy("image_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    key = F.struct("image_id", "y", "x0")
    spans = written(spans.select(key.alias("node"), "image_id", "y", "x0", "x1"))
    dealt = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("x0") / BLOCK), F.floor((F.col("x1") + 1) / BLOCK))))
    above, below = dealt.alias("a"), dealt.withColumn("y", F.col("y") - 1).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("image_id", "y", "block")]
    touch = same[0] & same[1] & same[2] & (F.col("a.x0") <= F.col("b.x1") + 1) & (F.col("b.x0") <= F.col("a.x1") + 1)
    parts = graph.components(above.hint("merge").join(below.hint("merge"), touch).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    whole = spans.hint("merge").join(parts.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = whole.groupBy("component").agg(F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    return sums.where(F.col("area") >= least).select("component.image_id", "left", "top", "right", "bottom", "area")


def digests(p: DataFrame) -> DataFrame:
    """image_id and a digest of all its values in order."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda q: q["v"].cast("string"))
    return p.groupBy("image_id").agg(F.sha2(F.array_join(values, ","), 256).alias("digest"))


def match_digests(source: DataFrame, targets: DataFrame) -> DataFrame:
    """image_id, target_id, code: the only target with equal pixels; missing or ambiguous ones are coded."""
    n = targets.groupBy("digest").agg(F.count("*").alias("n"), F.min("image_id").alias("target_id"))
    code = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return source.join(n, "digest", "left").select("image_id", F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"), code.alias("code"))


#: Gates of an estimated shift.
LEAST_EDGES, MOST_SHIFT, LEAST_RESPONSE, MOST_DISAGREEMENT, LEAST_OVERLAP, LEAST_CORRELATION, LEAST_F1 = 24, 32.0, 0.15, 4.0, 0.85, 0.65, 0.4


def shift_reason() -> Column:
    """The first gate that an estimate (edges, phase_dx, phase_dy, response, dx, dy, correlation, f1) on a canvas (width, height) fails."""
    c = F.col
    far = lambda x, y: F.greatest(F.abs(c(x)), F.abs(c(y))) > MOST_SHIFT
    left = lambda d, size: F.greatest(F.lit(0.0), 1 - F.abs(c(d)) / c(size))
    gates = [
        ("insufficient_edges", c("edges") < LEAST_EDGES),
        ("max_shift_exceeded", far("phase_dx", "phase_dy")),
        ("weak_phase_response", c("response") < LEAST_RESPONSE),
        ("max_shift_exceeded", far("dx", "dy")),
        ("phase_ecc_disagreement", F.hypot(c("dx") - c("phase_dx"), c("dy") - c("phase_dy")) > MOST_DISAGREEMENT),
        ("low_canvas_overlap", left("dx", "width") * left("dy", "height") < LEAST_OVERLAP),
        ("insufficient_matching_structure", (c("correlation") < LEAST_CORRELATION) | (c("f1") < LEAST_F1)),
    ]
    return F.coalesce(*(F.when(failed, name) for name, failed in gates), F.lit("phase_and_ecc_agree"))
