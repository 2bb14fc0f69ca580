"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``; where that is unset (tests, a laptop) a temporary folder is
made once per session. Written tables cut lineage, so a lost executor costs one stage, never the run,
and a join between two of them has a shuffle on either side, which adaptive execution can split.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a local one where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scenegrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; the folder is scratch space
        pass


def _sweep() -> None:
    for spark, path in _made:
        _delete(spark, path)


atexit.register(_sweep)


#: Text that one Arrow batch holds at most: a task has one batch at each side of its Python worker.
BATCH_BYTES = 2 << 20


class Scratch:
    """Named tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.root = f"{shared_dir(spark)}/scenegrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        _made.append((spark, self.root))

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write and read again."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
