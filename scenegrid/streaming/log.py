"""Patch logs as streams: an extra beside the batch operators, for logs that never end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def moves_per_window(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Summed translations per object and time window; a window closes when the watermark has passed it."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "object_id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.count("*").alias("n")).select("w.start", "object_id", "dx", "dy", "n")


def guard_revisions(log: DataFrame) -> DataFrame:
    """scene_id, n_accepted, n_stale, revision after each batch: a patch counts if its base is the scene's revision."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, accepted, stale = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for base in rows["base"].tolist():
            if base == revision:
                revision, accepted = revision + 1, accepted + 1
            else:
                stale += 1
        state.update((revision, accepted, stale))
        yield pd.DataFrame({"scene_id": [key[0]], "n_accepted": [accepted], "n_stale": [stale], "revision": [revision]})

    schema = "scene_id bigint, n_accepted bigint, n_stale bigint, revision bigint"
    return log.groupBy("scene_id").applyInPandasWithState(fold, schema, "revision bigint, accepted bigint, stale bigint", "update", GroupStateTimeout.NoTimeout)
