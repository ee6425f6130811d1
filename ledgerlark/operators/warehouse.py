"""Aggregates of the usage warehouse over turns and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.functions.models import NO_PROJECT, canonical_model, local_day, local_hour, one_decimal

SUMS = ("cache_read", "cache_write", "input", "output", "reasoning", "total")
SLOT, HOUR, DAY = 900_000, 3_600_000, 86_400_000  #: milliseconds


def _sums(names: tuple[str, ...] = SUMS) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names]


def totals(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count("*").alias("turns"), F.count_if("has_usage").alias("turns_with_usage"), *_sums())


def models(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.col("model_canon").alias("key")).agg(
        F.count("*").alias("turns"),
        F.count_if(~F.col("has_usage")).alias("missing_usage"),
        *_sums(),
        F.concat_ws("|", F.array_sort(F.collect_set("model_raw"))).alias("raw_ids"),
        F.min(F.when(F.col("started_at") > 0, F.col("started_at"))).alias("first_ts"),
        F.max("started_at").alias("last_ts"),
    )


def model_raw(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.col("model_canon").alias("key"), F.col("model_raw").alias("rid")).agg(F.count("*").alias("turns"), *_sums())


def model_status(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.col("model_canon").alias("key"), F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))


def _slots(turns: DataFrame, unit: int, zone: str, keys: list[Column], sums: list[Column]) -> DataFrame:
    """Sums by a number, the slot of time that a turn began in, with `at` a moment of that slot (null where the time is unknown). Days and hours are made from these few rows, not for each turn; outside UTC slots are quarters of an hour, of which every zone's days and hours consist."""
    unit = unit if zone == "UTC" else SLOT
    slot = F.expr(f"CASE WHEN started_at > 0 THEN started_at div {unit} END").alias("slot_")
    return turns.groupBy(slot, *keys).agg(*sums).withColumn("at", F.col("slot_") * unit + 1).drop("slot_")


def days(turns: DataFrame, zone: str = "UTC") -> DataFrame:
    """By local day; turns without a known time are the day ''."""
    return _slots(turns, DAY, zone, [], [F.count("*").alias("turns"), *_sums()]).groupBy(F.coalesce(local_day(F.col("at"), zone), F.lit("")).alias("d")).agg(F.sum("turns").alias("turns"), *_sums())


def day_model(turns: DataFrame, zone: str = "UTC") -> DataFrame:
    slots = _slots(turns, DAY, zone, [F.col("model_canon").alias("key")], [F.count("*").alias("turns"), *_sums(("total", "output"))])
    return slots.groupBy(F.coalesce(local_day(F.col("at"), zone), F.lit("")).alias("d"), "key").agg(F.sum("turns").alias("turns"), *_sums(("total", "output")))


def _facts() -> list[Column]:
    """What models are made from: turns, those without usage, sums, and the first and last known time."""
    known = F.when(F.col("started_at") > 0, F.col("started_at"))
    return [F.count("*").alias("turns"), F.count_if(~F.col("has_usage")).alias("missing_usage"), *_sums(), F.min(known).alias("first_ts"), F.max("started_at").alias("last_ts")]


def _facts_of() -> list[Column]:
    return [F.sum("turns").alias("turns"), F.sum("missing_usage").alias("missing_usage"), *_sums(), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")]


def day_models(turns: DataFrame, zone: str = "UTC") -> DataFrame:
    """One pass over turns to day, model and raw id; everything by day or model follows from its few rows. Models are named once for each raw id and day, not for each turn."""
    slots = _slots(turns, DAY, zone, [F.col("model_raw")], _facts())
    sums = slots.groupBy(F.coalesce(local_day(F.col("at"), zone), F.lit("")).alias("d"), "model_raw").agg(*_facts_of())
    return sums.withColumn("key", canonical_model(F.col("model_raw")))


def model_statuses(turns: DataFrame) -> DataFrame:
    """One pass over turns to raw id and status; models, their raw ids and their statuses follow from it."""
    return turns.groupBy("model_raw", F.coalesce("status", F.lit("")).alias("status")).agg(*_facts()).withColumn("key", canonical_model(F.col("model_raw")))


def model_raw_of(base: DataFrame) -> DataFrame:
    """model_raw() from model_statuses()."""
    return base.groupBy("key", F.col("model_raw").alias("rid")).agg(F.sum("turns").alias("turns"), *_sums())


def model_status_of(base: DataFrame) -> DataFrame:
    """model_status() from model_statuses()."""
    return base.groupBy("key", "status").agg(F.sum("turns").alias("n"))


def models_of(base: DataFrame) -> DataFrame:
    """models() from day_models() or model_statuses()."""
    return base.groupBy("key").agg(*_facts_of(), F.concat_ws("|", F.array_sort(F.collect_set("model_raw"))).alias("raw_ids"))


def days_of(base: DataFrame) -> DataFrame:
    """days() from day_models()."""
    return base.groupBy("d").agg(F.sum("turns").alias("turns"), *_sums())


def day_model_of(base: DataFrame) -> DataFrame:
    """day_model() from day_models()."""
    return base.groupBy("d", "key").agg(F.sum("turns").alias("turns"), *_sums(("total", "output")))


def hours(turns: DataFrame, zone: str = "UTC") -> DataFrame:
    sums = _sums(("cache_read", "cache_write", "input", "output", "total"))
    slots = _slots(turns.filter("started_at > 0"), HOUR, zone, [], [F.count("*").alias("turns"), *sums])
    return slots.groupBy(local_hour(F.col("at"), zone).alias("h")).agg(F.sum("turns").alias("turns"), *sums)


def projects(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    used = turns.filter("has_usage").join(sessions.select(F.col("id").alias("session_id"), "project"), "session_id", "left")
    return used.groupBy(F.coalesce("project", F.lit(NO_PROJECT)).alias("name")).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"), *_sums())


def session_sums(turns: DataFrame, names: tuple[str, ...] = SUMS) -> DataFrame:
    """One pass over turns to session_id, turns, turns_with_usage and the sums of those."""
    used = F.col("has_usage")
    return turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.count_if(used).alias("turns_with_usage"), *(F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0)).cast("long").alias(c) for c in names))


def session_usage(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions that have usage, with its sums. The sums are made before the join, so only one row of each session meets it."""
    sums = turns.filter("has_usage").groupBy("session_id").agg(*_sums(("cache_read", "cache_write", "input", "output", "total")))
    return sessions.join(sums, sessions.id == sums.session_id).drop("session_id")


def top_sessions(usage: DataFrame, n: int = 40) -> DataFrame:
    return usage.orderBy(F.desc("total"), "id").limit(n)


def session_counts(turns: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Turns and messages of each session, 0 where it has none."""
    n_turns = turns.groupBy("session_id").agg(F.count("*").alias("turns"))
    n_messages = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    joined = sessions.select("id").join(n_turns, F.col("id") == n_turns.session_id, "left").drop("session_id").join(n_messages, F.col("id") == n_messages.session_id, "left")
    return joined.select("id", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("messages", F.lit(0)).alias("messages"))


def counted(rows: DataFrame, key: str, error: Column) -> DataFrame:
    """How often each key occurs, and how often with an error."""
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several sources, added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))


def time_range(turns: DataFrame) -> DataFrame:
    return turns.agg(F.min(F.when(F.col("started_at") > 0, F.col("started_at"))).alias("first_ts"), F.max("started_at").alias("last_ts"))


def cache_hit(sums: DataFrame) -> DataFrame:
    """Share of input that came from the cache, in per cent to one decimal."""
    base = F.greatest(F.lit(1), F.col("cache_read") + F.col("cache_write") + F.col("input"))
    return sums.select(one_decimal(100.0 * F.col("cache_read") / base).alias("cache_hit_pct"))


def quality_checks(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assertions on the warehouse: one row each, with the number of rows that break it."""
    off = F.col("total") != F.col("cache_read") + F.col("cache_write") + F.col("input") + F.col("output")
    one = turns.agg(F.count_if(off).alias("total_is_sum"), F.count_if(F.expr("started_at is null or started_at <= 0")).alias("time_known"), (F.sum(F.col("cache_read") + F.col("cache_write") + F.col("input") + F.col("output")) - F.sum("total")).alias("sums_agree"))
    orphans = turns.join(sessions, turns.session_id == sessions.id, "left_anti").agg(F.count("*").alias("no_orphans"))
    return one.crossJoin(orphans).unpivot([], ["total_is_sum", "time_known", "sums_agree", "no_orphans"], "check_name", "violations")


def known_sessions_removed(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Turns of sessions that the other source doesn't have."""
    return incoming.join(known.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one written last."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in others))
