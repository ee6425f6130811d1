"""Blocks of the dashboard that put several aggregates together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.functions.models import one_decimal, redact_home
from ledgerlark.functions.prices import COUNTERS


def models(model_sums: DataFrame, raw: DataFrame, status: DataFrame) -> DataFrame:
    """Models with raw_usage (array of rid, turns and counters, most tokens first) and statuses (array of status and n). One row a model on each side, so the joins don't multiply."""
    stats = [c for c in raw.columns if c not in ("key", "rid")]
    by_total = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("o"), "rid", *stats)))
    usage = raw.groupBy("key").agg(F.transform(by_total, lambda s: F.struct(s["rid"].alias("rid"), *(s[c].alias(c) for c in stats))).alias("raw_usage"))
    states = status.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("status", "n"))).alias("statuses"))
    return model_sums.join(usage, "key", "left").join(states, "key", "left")


def pricing_rows(assembled: DataFrame, prices: DataFrame) -> DataFrame:
    """The price page's models, each with its raw rows: a model is priced if its price has an input price. Sort by total, then key."""
    known = prices.filter("price_input is not null").select(F.col("model_canon").alias("key"), F.lit(True).alias("known"))
    return assembled.join(known, "key", "left").withColumn("priced", F.coalesce("known", F.lit(False))).drop("known")


def cost_parts(models: DataFrame) -> DataFrame:
    """The cost of each token class of priced models (with unit_ columns); 0 for the others."""
    part = lambda c, u: F.when(F.col("price_ok"), F.col(c) / 1e6 * F.coalesce(F.col(f"unit_{u}"), F.lit(0.0))).otherwise(0.0)
    return models.select("key", *(part(c, u).alias(f"cost_{c}") for c, u in COUNTERS), F.coalesce("price_ok", F.lit(False)).alias("priced"))


def merged_daily_cost(own: DataFrame, external: DataFrame) -> DataFrame:
    """Own cost of each day and that of external tools (d, cost), whichever has the day."""
    return own.select("d", "cost").unionByName(external.select("d", "cost")).groupBy("d").agg(F.sum("cost").alias("cost"))


def amortised_daily_cost(days: DataFrame, summary: DataFrame) -> DataFrame:
    """What external tools' days (tool, d, total) cost at each tool's mean unit price."""
    j = days.filter("d <> ''").join(summary.select("tool", "unit"), "tool", "left")
    return j.groupBy("d").agg(F.sum(F.coalesce("unit", F.lit(0.0)) * F.col("total") / 1e6).alias("cost"))


def merged_roots(own: DataFrame, discovered: DataFrame) -> DataFrame:
    """name and path of projects: the own mapping where it has a path, else what was discovered."""
    mine = own.filter("coalesce(path, '') <> ''").select("name", F.col("path").alias("own"))
    return discovered.select("name", F.col("path").alias("found")).join(mine, "name", "full_outer").select("name", F.coalesce("own", "found").alias("path"))


def megabytes(size: Column) -> Column:
    return F.when(size > 0, one_decimal(size / 1_048_576)).otherwise(0.0)


def meta(times: DataFrame, source: dict, home: str) -> DataFrame:
    """One row: sizes in MB to a decimal, the time range to the minute, paths without the home folder. times: first_ts, last_ts; source: generated_at, db_path, dir, db_version, db_size, wal_size."""
    minute = lambda c: F.when(F.col(c) > 0, F.date_format(F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_interval(secs=(F.col(c) / 1000).cast("decimal(18,3)")), "yyyy-MM-dd HH:mm"))
    return times.select(
        F.lit(source["generated_at"]).alias("generated_at"), redact_home(F.lit(source["db_path"]), home).alias("db_path"), redact_home(F.lit(source["dir"]), home).alias("dir"), F.lit(source["db_version"]).cast("long").alias("db_version"),
        megabytes(F.lit(source["db_size"])).alias("db_size_mb"), megabytes(F.lit(source["wal_size"])).alias("wal_size_mb"), minute("first_ts").alias("range_start"), minute("last_ts").alias("range_end"),
    )


def project_kpis(projects: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: projects, their tokens and cost; repositories and commits, and how many repositories with commits belong to a project. projects: total, cost; commits: commits, project."""
    a = projects.agg(F.count("*").alias("projects"), F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    some = F.col("commits") > 0
    b = commits.agg(F.count("*").alias("repos"), F.coalesce(F.sum("commits"), F.lit(0)).alias("commits"), F.count_if(some & F.col("project").isNotNull()).alias("attributed"), F.count_if(some & F.col("project").isNull()).alias("unattributed"))
    return a.crossJoin(b)  # one row each
