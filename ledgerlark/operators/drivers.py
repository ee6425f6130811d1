"""Drivers: manifests whose records depend on the lines before them, as functions from decoded records to usage records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.functions.models import UNKNOWN_MODEL

Driver = Callable[[DataFrame, "object"], DataFrame]
DRIVERS: dict[str, Driver] = {}

TOKENS = ("input", "cacheRead", "cacheWrite", "output", "reasoning")
# The counters that must not go down, else the log has begun again.
MONOTONE = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens", "total_tokens")


def driver(name: str):
    """Registers a driver under the name that manifests use."""

    def add(f: Driver) -> Driver:
        DRIVERS[name] = f
        return f

    return add


def events(records: DataFrame, counters: tuple[str, ...]) -> DataFrame:
    """The lines of a rollout log that count: file, dir, line, ts, meta_id, context_id, model, and the structs total and last (null elsewhere)."""
    from ledgerlark.operators.ingest import dig, to_int

    obj, kind = F.col("obj"), dig(F.col("obj"), "type")
    text = lambda p: F.nullif(dig(obj, p), F.lit(""))
    usage = lambda p: F.when(
        F.schema_of_variant(F.try_variant_get(obj, f"$.{p}", "variant")).startswith("OBJECT<"), F.struct(*(to_int(dig(obj, f"{p}.{c}")).alias(c) for c in counters), (F.to_json(F.try_variant_get(obj, f"$.{p}", "variant")) == "{}").alias("empty"))
    )
    counted = (kind == "event_msg") & (dig(obj, "payload.type") == "token_count")
    return records.select(
        "file", "dir", "line", dig(obj, "timestamp").alias("ts"),
        F.when(kind == "session_meta", F.coalesce(text("payload.session_id"), text("payload.id"))).alias("meta_id"),
        F.when(kind == "turn_context", text("payload.session_id")).alias("context_id"),
        F.when(kind == "turn_context", F.coalesce(text("payload.model"), text("payload.model_id"))).alias("model"),
        F.when(counted, usage("payload.info.total_token_usage")).alias("total"), F.when(counted, usage("payload.info.last_token_usage")).alias("last"),
    )


def rollout_day(ts: Column, file: Column) -> Column:
    """The day of a line: its time stamp's, else the one in the log's name."""
    named = F.regexp_extract(file, "rollout-(.{4}-.{2}-.{2})", 1)
    return F.coalesce(F.when(F.length(ts) >= 10, F.substring(ts, 1, 10)), F.nullif(named, F.lit("")))


@driver("codex")
def rollout(records: DataFrame, manifest) -> DataFrame:
    """Usage of logs of running totals, each file for itself.

    A line adds what its totals have grown by. Where one of MONOTONE has gone down the log was resumed or forked, and the line's own last
    usage counts. Input contains what came from and went to the cache, which is taken off. The model is named on other lines and
    carried forward; usage before the first is added up by day and goes to that model, so it keeps its day.
    """
    field = {t: (manifest.fields.get(t) or ("",))[0] for t in TOKENS}
    counters = tuple(dict.fromkeys([*MONOTONE, *(f for f in field.values() if f)]))
    w = Window.partitionBy("file").orderBy("line")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = events(records, counters).withColumns(
        {
            "session": F.coalesce(F.last("meta_id", ignorenulls=True).over(so_far), F.first("context_id", ignorenulls=True).over(so_far), F.nullif("dir", F.lit("")), F.col("file")),
            "carried": F.last("model", ignorenulls=True).over(so_far),
            "first_model": F.first("model", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    counted = lines.filter("total is not null").withColumn("before", F.lag("total").over(w))
    fell = F.lit(False)
    for c in MONOTONE:
        fell |= F.col(f"total.{c}") < F.col(f"before.{c}")
    grown = F.struct(*((F.col(f"total.{c}") - F.coalesce(F.col(f"before.{c}"), F.lit(0))).alias(c) for c in counters), F.lit(False).alias("empty"))
    counted = counted.withColumn("reset", F.coalesce(fell, F.lit(False))).withColumn("delta", F.when(F.col("reset"), F.col("last")).otherwise(grown)).filter("delta is not null")
    n = {t: F.col(f"delta.{field[t]}") if field[t] else F.lit(0).cast("long") for t in TOKENS}
    used = counted.select(
        "file", "line", "session", "ts", "carried", "first_model", "reset",
        F.greatest(n["input"] - n["cacheRead"] - n["cacheWrite"], F.lit(0)).alias("input"), n["cacheRead"].alias("cache_read"), n["cacheWrite"].alias("cache_write"),
        n["output"].alias("output"), F.least(n["reasoning"], n["output"]).alias("reasoning"),
    ).filter("input + cache_read + cache_write + output + reasoning <> 0")
    sums = ("input", "cache_read", "cache_write", "output", "reasoning")
    known = used.filter("carried is not null").select("file", "line", F.col("carried").alias("model"), "session", "ts", *sums, F.col("reset").cast("int").alias("resets"))
    parked = used.filter("carried is null").withColumn("day", rollout_day(F.col("ts"), F.col("file"))).groupBy("file", "day").agg(
        F.min("line").alias("line"), F.first("first_model").alias("model"), F.min_by("session", "line").alias("session"), *(F.sum(c).alias(c) for c in sums), F.sum(F.col("reset").cast("int")).cast("int").alias("resets")
    )
    parked = parked.select("file", "line", F.coalesce("model", F.lit(UNKNOWN_MODEL)).alias("model"), "session", F.col("day").alias("ts"), *sums, "resets")
    return known.unionByName(parked).withColumns({"tool": F.lit(manifest.id), "dedup_key": F.concat(F.lit(f"{manifest.id}:"), "file", F.lit("#"), "line"), "has_usage": F.lit(True)})
