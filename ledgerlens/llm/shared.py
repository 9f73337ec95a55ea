"""Intermediate tables in the folder that all executors share.

``stage_table`` cuts lineage by writing Parquet under ``spark.checkpoint.dir``; only
where that setting is absent, as in tests, a folder of the driver's own is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ledgerlens-"))
    return _OWN[0]


#: rows of a batch sent to Python where the session has Spark's own number; texts may be long
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; a number set by the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


#: tables between two runs of the driver's collector
RELEASE = 6


class Scratch:
    """Tables of one query; ``drop`` removes those whose readers are through."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        small_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, read from a written table."""
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        df.write.option("compression", "snappy").parquet(path)
        if self.count % RELEASE == 0:
            # what earlier tables were made from is only let go, on all machines, when the driver's collector runs
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path).alias(name)

    def drop(self, *names: str) -> None:
        """Delete the written tables of these names."""
        self._delete(lambda name: name in names)

    def drop_all_but(self, *names: str) -> None:
        """Delete the other written tables."""
        self._delete(lambda name: name not in names)

    def _delete(self, gone) -> None:
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.base)
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return
        for status in fs.listStatus(base):
            path = status.getPath()
            if gone(path.getName().split("-", 1)[1]):
                fs.delete(path, True)
