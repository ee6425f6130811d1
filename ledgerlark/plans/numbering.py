"""Places in an order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.plans.kept import kept


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place from 1. Ranges are sorted each by a task and written; then what is in the ranges before is added up. The order should have no ties."""
    ranged = rows.orderBy(*order).withColumns({"task_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()})
    done = kept(ranged, "placed")
    counts = done.groupBy("task_").agg(F.count("*").alias("n_"), F.min("at_").alias("begins_"))
    # a row for each task
    before = F.coalesce(F.sum("n_").over(Window.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.withColumn("before_", before).select("task_", (F.col("before_") - F.col("begins_") + 1).alias("shift_"))
    return done.join(spans, "task_").select(*rows.columns, (F.col("at_") + F.col("shift_")).cast("long").alias(name))
