"""Usage of external tools: cubes, costs of ranges, and rollups with the own side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.functions.models import canonical_model, half_up, source_day, source_hour
from ledgerlark.functions.prices import cost, normalized
from ledgerlark.operators.cost import PARTS, in_range

COUNTERS = (*PARTS, "total")


def first_wins(records: DataFrame, keys: list[str], order: list[str], copies: str = "") -> DataFrame:
    """The first record of each identity, and how many it had in a column `copies`; a task sends on one for each. A record claims its identity even if it has no usage, so that goes later."""
    rest = [c for c in records.columns if c not in keys]
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first_"), F.count("*").alias("copies_"))
    return first.select(*(F.col(c) if c in keys else F.col(f"first_.{c}").alias(c) for c in records.columns), *([F.col("copies_").alias(copies)] if copies else []))


def usage(records: DataFrame) -> DataFrame:
    """Deduplicated records with usage, their total, day and hour."""
    one = first_wins(records, ["tool", "dedup_key"], ["ord"])
    total = F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output")
    return one.withColumn("total", total).filter("total > 0").withColumns({"d": source_day(F.col("ts")), "h": source_hour(F.col("ts"))})


def dropped(records: DataFrame) -> DataFrame:
    return records.groupBy("tool").agg(F.count("*").alias("records"), F.count_distinct("dedup_key").alias("kept")).withColumn("dropped", F.col("records") - F.col("kept"))


def _sums(more: tuple[str, ...] = ()) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in (*COUNTERS, *more)]


def tool_totals(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy("tool").agg(F.count("*").alias("calls"), F.count_distinct("session").alias("sessions"), *_sums(more), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def cube(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Sums (of `more` columns too) by tool, and by tool with model, day, day and model, or hour: one pass over the rows."""
    sets = [["tool"], ["tool", "model"], ["tool", "d"], ["tool", "d", "model"], ["tool", "h"]]
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], "tool", "model", "d", "h")
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("calls"), *_sums(more))


def by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*_sums())


def day_model_cost(rows: DataFrame, prices: DataFrame, policy: str = "ratio10") -> DataFrame:
    j = by(rows, "tool", "d", "model").join(prices, "model", "left").withColumns(normalized(policy))
    return j.select("tool", "d", "model", *COUNTERS, F.when(F.col("price_ok"), cost()).otherwise(0.0).alias("cost"), F.coalesce("price_ok", F.lit(False)).alias("priced"))


def model_rows(costs: DataFrame) -> DataFrame:
    """Tool and model: tokens, cost and unit price."""
    sums = costs.groupBy("tool", "model").agg(*_sums(), F.sum("cost").alias("cost"), F.bool_and("priced").alias("priced"))
    return sums.withColumn("unit", F.when(F.col("priced") & (F.col("total") > 0), F.col("cost") / F.col("total") * 1e6).otherwise(0.0))


def summary(models: DataFrame) -> DataFrame:
    sums = models.groupBy("tool").agg(F.sum("total").alias("total"), F.sum("cost").alias("cost"), F.count("*").alias("models"))
    return sums.withColumn("unit", F.when(F.col("total") > 0, F.col("cost") / F.col("total") * 1e6).otherwise(0.0))


def unit_by_model(models: DataFrame) -> DataFrame:
    """For each canonical model the unit price in the largest tool that has it."""
    tools = models.groupBy("tool").agg(F.sum("total").alias("tool_total"))
    named = models.join(tools, "tool").withColumn("key", canonical_model(F.col("model"))).filter("key <> '(unknown)'")
    first = F.struct(-F.col("tool_total"), "tool", -F.col("cost"), -F.col("total"))
    return named.groupBy("key").agg(F.min_by("unit", first).alias("unit"))


def model_totals(models: DataFrame) -> DataFrame:
    """Over all tools: canonical model, tokens, cost and cost-weighted unit price."""
    sums = models.groupBy(canonical_model(F.col("model")).alias("key")).agg(F.sum("total").alias("total"), F.sum("cost").alias("cost"), F.concat_ws("|", F.array_sort(F.collect_set("tool"))).alias("tools"))
    return sums.withColumn("unit", F.when(F.col("total") > 0, F.col("cost") / F.col("total") * 1e6).otherwise(0.0))


def range_by_model(costs: DataFrame, days: DataFrame, models: DataFrame, key: str, anchored: DataFrame) -> dict[str, DataFrame]:
    """Cost of a range by model, tool and day.

    Exact for tools whose day x model rows cover every day with usage; the others' total cost
    is spread by tokens over days and by cost over models.
    """
    open_days = days.join(costs.select("tool", "d").distinct(), ["tool", "d"], "left_anti")
    tools = days.select("tool").distinct()
    inexact = open_days.select("tool").distinct().unionByName(tools.join(costs.select("tool").distinct(), "tool", "left_anti")).distinct()
    exact = in_range(costs.join(inexact, "tool", "left_anti"), key, anchored).filter("total > 0")
    exact = exact.select("tool", "d", canonical_model(F.col("model")).alias("key"), F.col("total").alias("tokens"), "cost", F.lit(True).alias("exact"))
    spread_days = in_range(days.join(inexact, "tool", "left_semi"), key, anchored).filter("total > 0").select("tool", "d", F.col("total").alias("tokens"))
    whole = models.join(inexact, "tool", "left_semi")
    per_tool = whole.groupBy("tool").agg(F.sum("total").alias("all_tokens"), F.sum("cost").alias("all_cost"))
    ranged = spread_days.groupBy("tool").agg(F.sum("tokens").alias("range_tokens"))
    unit = F.when(F.col("all_tokens") > 0, F.col("all_cost") / F.col("all_tokens")).otherwise(0.0)
    spread_by_day = spread_days.join(per_tool, "tool", "left").select("tool", "d", "tokens", (F.coalesce(unit, F.lit(0.0)) * F.col("tokens")).alias("cost"), F.lit(False).alias("exact"))
    share = F.when(F.col("all_cost") > 0, F.col("cost") / F.col("all_cost")).when(F.col("all_tokens") > 0, F.col("total") / F.col("all_tokens")).otherwise(0.0)
    spread_by_key = whole.join(per_tool, "tool").join(ranged, "tool").select("tool", canonical_model(F.col("model")).alias("key"), half_up(F.col("range_tokens") * F.col("total") / F.col("all_tokens")).cast("long").alias("tokens"), (unit * F.col("range_tokens") * share).alias("cost"), F.lit(False).alias("exact"))
    agg = [F.sum("tokens").cast("long").alias("tokens"), F.sum("cost").alias("cost"), F.bool_and("exact").alias("exact")]
    keys = exact.select("tool", "key", "tokens", "cost", "exact").unionByName(spread_by_key).filter("tokens > 0 and key <> '(unknown)'")
    dated = exact.select("tool", "d", "tokens", "cost", "exact").unionByName(spread_by_day)
    return {"key": keys.groupBy("key").agg(*agg), "tool": dated.groupBy("tool").agg(*agg), "day": dated.groupBy("d").agg(*agg)}


def range_tools(days: DataFrame, costs_by_tool: DataFrame, key: str, anchored: DataFrame) -> DataFrame:
    """Each tool's counters in the range with its cost, most tokens first."""
    sums = in_range(days, key, anchored).groupBy("tool").agg(*_sums())
    return sums.join(costs_by_tool.select("tool", "cost", "exact"), "tool", "left").select("tool", *COUNTERS, F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("exact", F.lit(False)).alias("exact"))


def window_usage(days: DataFrame, anchored: DataFrame) -> DataFrame:
    """Tokens of the last 7 and 30 days of each tool that had any in 30."""
    from_day = lambda n: F.date_format(F.date_sub(F.col("anchor").cast("date"), n - 1), "yyyy-MM-dd")
    j = days.join(F.broadcast(anchored)).filter(F.col("d") <= F.col("anchor"))
    part = lambda n: F.sum(F.when(F.col("d") >= from_day(n), F.col("total")).otherwise(0)).cast("long")
    return j.groupBy("tool").agg(part(7).alias("tokens_7d"), part(30).alias("tokens_30d")).filter("tokens_30d > 0")


def range_model_agg(own: DataFrame, own_all: DataFrame, other: DataFrame) -> DataFrame:
    """Tokens of a range by model and side; the own side's parts are scaled from the model's mix of all time."""
    scaled = own.join(own_all.select("key", F.col("total").alias("all_total"), *PARTS), "key", "left")
    scale = F.when(F.col("all_total") > 0, F.col("total") / F.col("all_total")).otherwise(0.0)
    own_part = scaled.select("key", F.col("total").alias("own_tokens"), *(F.coalesce(half_up(F.col(c) * scale), F.lit(0)).cast("long").alias(c) for c in PARTS))
    j = own_part.join(other.select("key", F.col("tokens").alias("ext_tokens"), F.col("cost").alias("ext_cost")), "key", "full_outer")
    return j.select("key", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("own_tokens", *PARTS, "ext_tokens")), F.coalesce("ext_cost", F.lit(0.0)).alias("ext_cost"))


def cross_tool_bars(own_total: DataFrame, tools: DataFrame, label: str = "pi") -> DataFrame:
    own = own_total.select(F.lit(label).alias("tool"), F.col("tokens").cast("long").alias("tokens"), "cost")
    return own.unionByName(tools.select("tool", F.col("total").alias("tokens"), "cost")).filter("tokens > 0")
