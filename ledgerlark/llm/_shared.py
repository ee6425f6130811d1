"""Storage that every executor can reach, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and everything runs on this machine, as in tests, a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ledgerlark-"))
    return _OWN[0]


def bound_batches(spark: SparkSession) -> None:
    """Makes Spark hand rows to Python in Arrow batches of about BATCH_BYTES at most, for this session; the default is 64 MB, of which a task holds several."""
    most = spark.conf.get(BATCH_SETTING)
    if not most.rstrip("bB").isdigit() or not 0 < int(most.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files behind: Spark deletes them as each ends, and not when the driver happens to collect its garbage. A session's setting, put back at the end."""
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)


class Tables:
    """Intermediate tables: each is written once and read back, which cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{scratch(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
