"""Sinks that never overwrite: a result and its receipt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, run: str) -> DataFrame:
    """Write ``df`` to ``path``/``run`` as Parquet, which must not exist, then its receipt: rows and an order-free digest.
    The receipt comes last, so a run without one isn't complete. Returns the receipt."""
    df.write.mode("errorifexists").parquet(f"{path}/{run}/data")
    saved = df.sparkSession.read.parquet(f"{path}/{run}/data")
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in saved.columns])
    receipt = saved.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest")).withColumn("run", F.lit(run))
    receipt.write.mode("errorifexists").json(f"{path}/{run}/receipt")
    return df.sparkSession.read.schema(receipt.schema).json(f"{path}/{run}/receipt")


def publish_batch(df: DataFrame, path: str, run: str, code: str = "code") -> DataFrame:
    """``publish`` of a whole batch or of none of it: n_rows, n_bad, and the codes met. A first pass over the column ``code`` decides; if any row has one, nothing is written, else the rows
    go out without that column. Compute the batch once before (a written table), so both passes see the same rows."""
    bad = F.count_if(F.col(code).isNotNull())
    verdict = df.agg(F.count("*").alias("n_rows"), bad.alias("n_bad"), F.array_sort(F.collect_set(code)).alias("codes"))
    found = verdict.first()
    if not found.n_bad:
        publish(df.drop(code), path, run)
    return df.sparkSession.createDataFrame([found], verdict.schema)
