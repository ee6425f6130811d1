"""Usage records as a stream: deduplicated, and added up by tool and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str, schema, per_batch: int = 100) -> DataFrame:
    """Record files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def deduplicated(records: DataFrame, late: str = "1 day") -> DataFrame:
    """The first record to arrive of each key. Keys are remembered for as long as records may be late."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tool", "dedup_key"])


def hourly(records: DataFrame) -> DataFrame:
    w = F.window("ts", "1 hour")
    return records.groupBy("tool", w.alias("w")).agg(F.count("*").alias("n"), F.sum("total").alias("total")).select("tool", F.col("w.start").alias("hour"), "n", "total")


def write(hours: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Appends each hour when it can't change any more."""
    w = hours.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)
