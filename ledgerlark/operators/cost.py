"""Costs of usage, and analytics over ranges of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.functions.models import half_up, iso_millis
from ledgerlark.functions.prices import cost, normalized

RANGES = {"1d": 1, "7d": 7, "30d": 30, "all": None}
PARTS = ("cache_read", "cache_write", "input", "output")


def model_cost(models: DataFrame, prices: DataFrame, policy: str = "ratio10") -> DataFrame:
    """models (key, counters, total) with cost, priced, estimated and unit ($ for a million tokens)."""
    priced = models.join(prices, models.key == prices.model_canon, "left").withColumns(normalized(policy))
    priced = priced.withColumn("cost", F.when(F.col("price_ok"), cost()).otherwise(0.0)).withColumn("priced", F.coalesce("price_ok", F.lit(False)))
    unit = F.when(F.col("priced") & (F.col("total") > 0), F.col("cost") / F.col("total") * 1e6).otherwise(0.0)
    return priced.select(*models.columns, "cost", "priced", F.coalesce("estimated", F.array().cast("array<string>")).alias("estimated"), unit.alias("unit"))


def shares(costs: DataFrame) -> DataFrame:
    """Each model's share of tokens and cost, in per cent. The totals are one row."""
    total = costs.agg(F.sum("total").alias("all_tokens"), F.sum("cost").alias("all_cost"))
    j = costs.join(F.broadcast(total))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)
    return j.select("key", "total", "cost", "priced", "unit", share("total", "all_tokens").alias("share"), share("cost", "all_cost").alias("cost_share"))


def coverage(costs: DataFrame) -> DataFrame:
    unpriced = F.sum(F.when(~F.col("priced"), F.col("total")).otherwise(0))
    return costs.agg(F.sum("total").alias("tokens"), F.sum("cost").alias("cost"), unpriced.alias("unpriced_tokens"), ((F.sum("total") - unpriced) / F.sum("total") * 100).alias("coverage"), F.count_if(~F.col("priced") & (F.col("total") > 0)).alias("unpriced_models"))


def daily_cost(day_model: DataFrame, units: DataFrame) -> DataFrame:
    j = day_model.filter("d <> ''").join(units.select("key", "unit"), "key", "left")
    return j.groupBy("d").agg(F.sum(F.coalesce("unit", F.lit(0.0)) * F.col("total") / 1e6).alias("cost"))


def anchor(*days: DataFrame) -> DataFrame:
    """The last day of all sides: one row."""
    out = days[0].select("d")
    for x in days[1:]:
        out = out.unionByName(x.select("d"))
    return out.agg(F.max(F.nullif("d", F.lit(""))).alias("anchor"))


def span(*days: DataFrame) -> DataFrame:
    out = days[0].select("d")
    for x in days[1:]:
        out = out.unionByName(x.select("d"))
    return out.filter("d <> ''").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"))


def in_range(rows: DataFrame, key: str, anchored: DataFrame, day: Column | None = None) -> DataFrame:
    """Rows of the last days up to the anchor."""
    day = F.col("d") if day is None else day
    n = RANGES[key]
    j = rows.join(F.broadcast(anchored))  # one row
    ok = day <= F.col("anchor")
    if n is not None:
        ok &= day >= F.date_format(F.date_sub(F.col("anchor").cast("date"), n - 1), "yyyy-MM-dd")
    return j.filter((day != "") & ok).drop("anchor")


def merged_daily(own: DataFrame, other: DataFrame) -> DataFrame:
    """Both sides' days added up; a total of 0 is taken from its parts."""
    cols = ["d", *PARTS, "total"]
    both = own.select(*cols).unionByName(other.select(*cols)).filter("d <> ''").groupBy("d").agg(*(F.sum(c).cast("long").alias(c) for c in cols[1:]))
    return both.withColumn("total", F.when(F.col("total") > 0, F.col("total")).otherwise(sum(F.col(c) for c in PARTS)))


def range_stats(days: DataFrame, costs: DataFrame, key: str, anchored: DataFrame) -> DataFrame:
    """Tokens, cost and its extremes of the days in range; the first day of equal ones counts."""
    rows = in_range(days, key, anchored).join(costs, "d", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    order = F.datediff(F.col("d").cast("date"), F.lit("1970-01-01").cast("date"))
    base = F.sum(F.col("cache_read") + F.col("cache_write") + F.col("input"))
    return rows.agg(
        F.count("*").alias("day_count"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.avg("cost"), F.lit(0.0)).alias("avg_cost"),
        F.min("cost").alias("min_cost"),
        F.max("cost").alias("max_cost"),
        F.min_by("d", F.struct("cost", order)).alias("min_day"),
        F.max_by("d", F.struct("cost", -order)).alias("max_day"),
        F.coalesce(half_up(1000.0 * F.sum("cache_read") / F.nullif(base, F.lit(0))) / 10, F.lit(0.0)).alias("cache_hit_pct"),
    )


def range_insights(stats: DataFrame, day_model: DataFrame, units: DataFrame) -> DataFrame:
    """The dearest day, its dearest model, mean burn and a forecast of thirty days."""
    top = stats.select(F.when(F.col("max_cost") > 0, F.col("max_day")).alias("peak_day"), "max_cost", "avg_cost", "cache_hit_pct", "day_count")
    of_day = day_model.join(F.broadcast(top.select(F.col("peak_day").alias("d"))), "d").join(units.select("key", "unit"), "key")
    cost_of = F.col("unit") * F.col("total") / 1e6
    best = of_day.withColumn("c", cost_of).filter("c > 0").agg(F.max_by("key", F.struct("c", "key")).alias("peak_model"), F.max("c").alias("peak_model_cost"))
    return top.crossJoin(best).select("peak_day", F.coalesce("max_cost", F.lit(0.0)).alias("peak_day_cost"), "peak_model", F.coalesce("peak_model_cost", F.lit(0.0)).alias("peak_model_cost"), F.col("avg_cost").alias("avg_burn"), (F.col("avg_cost") * 30).alias("forecast30"), "cache_hit_pct", "day_count")


def month_to_date(costs: DataFrame, now: str) -> DataFrame:
    """Cost of the calendar month of `now`, up to that day."""
    return costs.filter((F.col("d") >= now[:8] + "01") & (F.col("d") <= now)).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("month_cost"), F.count("*").alias("days"))


def budget_tier(spent: DataFrame, budget: float) -> DataFrame:
    p = F.col("month_cost") / budget * 100
    return spent.select("month_cost", p.alias("used_pct"), F.when(p >= 95, "critical").when(p >= 80, "warning").when(p >= 50, "notice").otherwise("ok").alias("tier"))


def waste_hints(stats: DataFrame, unpriced: DataFrame) -> DataFrame:
    hint = lambda cond, name: F.when(cond, F.lit(name))
    j = stats.crossJoin(unpriced.select("unpriced_models"))
    return j.select(F.concat_ws("|", hint(F.col("cache_hit_pct") < 20, "low_cache_hit"), hint(F.col("max_cost") > 3 * F.col("avg_cost"), "peak_day"), hint(F.col("unpriced_models") > 0, "unpriced_models")).alias("hints"))


def streak(days: DataFrame, anchored: DataFrame) -> DataFrame:
    """Consecutive active days up to the anchor, or to the day before it."""
    active = days.filter("total > 0 and d <> ''").select(F.col("d").cast("date").alias("day")).distinct()
    # days are one row each, at most a few thousand
    island = F.date_sub("day", F.row_number().over(Window.orderBy("day")))
    runs = active.withColumn("island", island).groupBy("island").agg(F.count("*").alias("streak"), F.max("day").alias("end"))
    live = runs.join(F.broadcast(anchored.select(F.col("anchor").cast("date").alias("a")))).filter("end = a or end = date_sub(a, 1)")
    return live.agg(F.coalesce(F.max_by("streak", "end"), F.lit(0)).alias("streak"), F.date_format(F.max("end"), "yyyy-MM-dd").alias("end_date"))


def hour_matrix(hours: DataFrame) -> DataFrame:
    """Tokens by weekday (0 is Sunday) and hour: all 168 cells. Hours read 'yyyy-MM-dd HH' or with a T."""
    day = F.substring("h", 1, 10).cast("date")
    sums = hours.groupBy((F.dayofweek(day) - 1).alias("dow"), F.substring("h", 12, 2).cast("int").alias("hour")).agg(F.sum("total").alias("total"))
    grid = hours.sparkSession.range(168).select((F.expr("id div 24")).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(sums, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def heat_tone(matrix: DataFrame) -> DataFrame:
    """Five tones by the root of each cell's share of the largest."""
    top = matrix.agg(F.max("total").alias("top"))
    v = F.sqrt(F.col("total") / F.col("top"))
    tone = F.when((F.col("top") <= 0) | (F.col("total") <= 0), 0).when(v <= 0.25, 1).when(v <= 0.5, 2).when(v <= 0.75, 3).otherwise(4)
    return matrix.join(F.broadcast(top)).select("dow", "hour", "total", tone.alias("tone"))


def stable_color(rows: DataFrame) -> DataFrame:
    """Rank of each key in their order, which doesn't change with the range."""
    keys = rows.select("key").distinct()  # models: few
    return keys.select("key", (F.dense_rank().over(Window.orderBy("key")) - 1).alias("color"))


def week_top_models(own: DataFrame, own_units: DataFrame, other: DataFrame, other_units: DataFrame, anchored: DataFrame, n: int = 5) -> DataFrame:
    """Models of the anchor's week (from Monday) by cost; each side's tokens at its own unit price."""
    side = lambda rows, units: rows.join(units.select("key", "unit"), "key", "left").select("d", "key", F.col("total").alias("tokens"), (F.coalesce("unit", F.lit(0.0)) * F.col("total") / 1e6).alias("cost"))
    both = side(own, own_units).unionByName(side(other, other_units)).join(F.broadcast(anchored))
    week = both.filter((F.col("d") <= F.col("anchor")) & (F.col("d") >= F.date_format(F.date_trunc("week", F.col("anchor").cast("date")), "yyyy-MM-dd")) & ~F.col("key").isin("", "(unknown)"))
    sums = week.groupBy("key").agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("cost").alias("cost")).filter("tokens > 0 or cost > 0")
    total = sums.agg(F.sum("cost").alias("all"))
    share = F.when(F.col("all") > 0, F.col("cost") / F.col("all") * 100).otherwise(0.0)
    return sums.join(F.broadcast(total)).select("key", "tokens", "cost", share.alias("share")).orderBy(F.desc("cost"), F.desc("tokens"), "key").limit(n)


def session_burn(usage: DataFrame, unit: float) -> DataFrame:
    """Tokens and dollars a day of each session, over its life of at least a day."""
    days = F.greatest(F.lit(1), F.ceil((F.col("updated_at") - F.col("created_at")) / 86_400_000)).cast("long")
    return usage.select("id", "total", days.alias("days")).select("id", "total", "days", (F.col("total") / F.col("days")).alias("tokens_per_day"), (F.col("total") / F.col("days") * unit / 1e6).alias("cost_per_day"))


def session_search(usage: DataFrame, text: str) -> DataFrame:
    """Sessions with the text in their title, project, model or id, whatever its case."""
    found = F.lit(False)
    for c in ("title", "project", "model_raw", "id"):
        if c in usage.columns:
            found |= F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    return usage.filter(found)


def freshness(days: DataFrame, now: str, stale_after: int = 7) -> DataFrame:
    """Whole days since each tool's last day; stale beyond stale_after."""
    age = F.datediff(F.lit(now).cast("date"), F.col("last_day").cast("date"))
    last = days.groupBy("tool").agg(F.max("d").alias("last_day"))
    return last.select("tool", "last_day", age.cast("long").alias("age_days"), (age > stale_after).alias("stale"))


def _stamp(text: Column) -> Column:
    """A time stamp as it is kept, with a blank or a T before the hour, with or without seconds, in milliseconds; null where there is none."""
    timed = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(?![:\d])", "$1:00")
    return F.nullif(iso_millis(timed), F.lit(0))


def freshness_chip(tools: DataFrame, collected_at: str | None, now: str, stale_days: int = 7) -> DataFrame:
    """One row: whole minutes since the collection (null where that is unknown), how they are said (minutes, hours or days), a tone, and the labels of tools whose last time stamp is older than stale_days. tools: label, last_ts."""
    at, known = _stamp(F.lit(now)), _stamp(F.lit(collected_at).cast("string"))
    old = (F.coalesce("label", F.lit("")) != "") & (_stamp(F.col("last_ts")) < at - stale_days * 86_400_000)
    stale = tools.agg(F.array_sort(F.collect_list(F.when(old, F.col("label")))).alias("stale"))
    minutes = F.when(known.isNotNull(), F.greatest(F.lit(0), F.floor((at - known) / 60_000 + 0.5))).cast("long")
    m = F.col("minutes")
    unit = F.when(m.isNull(), "unknown").when(m < 1, "now").when(m < 60, "minutes").when(m < 1440, "hours").otherwise("days")
    count = F.when(m < 60, m).when(m < 1440, F.floor(m / 60)).otherwise(F.floor(m / 1440)).cast("long")
    tone = F.when(m.isNull() | (m >= 1440), "error").when((m >= 180) | (F.size("stale") > 0), "warn").otherwise("ok")
    return stale.withColumn("minutes", minutes).select("minutes", unit.alias("unit"), count.alias("count"), tone.alias("tone"), "stale")


def settings_counters(costs: DataFrame, overrides: DataFrame, fetched_at: str, now: str) -> DataFrame:
    """One row: models with a price, models, overrides of prices, and the catalogue's age in days."""
    priced = costs.agg(F.count_if("priced").alias("priced_models"), F.count("*").alias("models"))
    age = F.datediff(F.lit(now).cast("date"), F.lit(fetched_at).cast("date")).cast("long")
    return priced.crossJoin(overrides.agg(F.count("*").alias("overrides"))).withColumn("price_age_days", age)  # one row each
