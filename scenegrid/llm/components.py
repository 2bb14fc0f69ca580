"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrid.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` has columns a and b, in either direction; repeated links and loops do no harm. Each round
    takes the smallest label among the neighbours and then the label of that label, so chains shorten by
    halves; labels stay in tables, only the number of changes comes to the driver. Minima are added up
    before the shuffle, so a node with very many links costs one row per task.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = scratch.table(both.union(both.select("other", "node")).where("node <> other").distinct(), f"{name}-links")
    labels = scratch.table(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), f"{name}-0")
    round_ = 0
    while True:
        round_ += 1
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = scratch.table(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old")), f"{name}-{round_}a")
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = scratch.table(lower.join(roots, "component").select("node", F.col("root").alias("component"), (F.col("root") != F.col("old")).alias("moved")), f"{name}-{round_}b")
        scratch.drop(f"{name}-{round_ - 1}b", f"{name}-{round_}a")
        labels = jumped.select("node", "component")
        if not jumped.where("moved").limit(1).count():
            return labels
