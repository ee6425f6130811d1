"""Operators on ordered records: running counters, conversation folds, hourly buckets. Windows only, no Python state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def counter_deltas(log: DataFrame) -> DataFrame:
    """What each line of a log of running totals adds: the step from the line before, or the line's own last usage where the total went down.

    log: file, line, day, total, last, context_model (lines with one only set the model).
    Usage before the first model of a file is added up by day and given to that model.
    """
    w = Window.partitionBy("file").orderBy("line")
    carried = F.last("context_model", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("context_model", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lines = log.withColumns({"carried": carried, "first_model": first}).filter("total is not null")
    before = F.lag("total").over(w)
    delta = F.when(before.isNull(), F.col("total")).when(F.col("total") >= before, F.col("total") - before).otherwise(F.col("last"))
    reset = F.coalesce(F.col("total") < before, F.lit(False))
    return lines.select("file", "line", "day", F.coalesce("carried", "first_model", F.lit("(unknown)")).alias("model"), F.col("carried").isNull().alias("parked"), delta.alias("delta"), reset.alias("reset"))


def counter_records(deltas: DataFrame) -> DataFrame:
    """Usage records of a log; parked usage is one record for each file and day, without an hour."""
    some = deltas.filter("delta > 0")
    live = some.filter("not parked").select("file", "model", "day", F.col("line"), F.col("delta").alias("tokens"))
    parked = some.filter("parked").groupBy("file", "model", "day").agg(F.lit(None).cast("long").alias("line"), F.sum("delta").alias("tokens"))
    return live.unionByName(parked)


def fold_turns(messages: DataFrame) -> DataFrame:
    """Turns of conversations: each user message opens one, what comes before the first is turn 0.

    messages: stem, ord, role, tokens.
    """
    w = Window.partitionBy("stem").orderBy("ord")
    numbered = messages.withColumn("turn_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    used = F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0)
    return numbered.groupBy("stem", "turn_no").agg(
        F.count("*").alias("messages"),
        F.sum(used).cast("long").alias("output"),
        F.sum(F.when(F.col("role") != "assistant", F.col("tokens")).otherwise(0)).cast("long").alias("input"),
        F.max(F.when(F.col("role") == "assistant", F.col("ord"))).alias("last_ord"),
        F.bool_or(F.col("role") == "assistant").alias("has_usage"),
    )


def hourly(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Tumbling hours of records with a time stamp (the batch form of streaming.usage)."""
    return rows.groupBy("tool", F.date_format(F.window("ts", "1 hour").start, "yyyy-MM-dd HH").alias("h")).agg(F.count("*").alias("n"))
