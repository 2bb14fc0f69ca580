"""Tables of intermediate rounds, in the folder that driver and executors share; a round that nothing reads any more is deleted."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one, made once, where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="scenegrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder is scratch space
            return


atexit.register(_sweep)


#: Bytes of files that one task of a shuffle takes.
EACH = 2 << 20


def tasks(df: DataFrame, each: int = EACH) -> int:
    """How many tasks a shuffle of ``df`` takes: one for each ``each`` bytes of the files that it reads, so that a task's memory doesn't grow with the table; as many as the session's at least."""
    spark = df.sparkSession
    jvm, conf, size = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // each))


class Rounds:
    """The written tables of one run of an operator. Writing cuts the lineage: a lost executor costs a stage, not all rounds before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scenegrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _made.append((spark, self.root))

    def write(self, df: DataFrame) -> DataFrame:
        """The table, written and read again."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame) -> DataFrame:
        """The same; the table written before is deleted."""
        out = self.write(df)
        if self.n > 1:
            _delete(self.spark, f"{self.root}/{self.n - 1}")
        return out


#: Whether the shuffled files of a query are deleted as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table", once: bool = False) -> DataFrame:
    """The table, written and read again. ``once``: the shuffled files behind it are deleted then, not when Spark happens to collect them; nothing else may read them."""
    spark = df.sparkSession
    if not once:
        return Rounds(spark, name).write(df)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return Rounds(spark, name).write(df)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
