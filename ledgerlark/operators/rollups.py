"""Rollups by project, commit, title and side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.functions.models import NO_PROJECT, local_day
from ledgerlark.operators.cost import anchor, in_range

SUBJECT = 60  #: bytes of a commit's subject that are kept


def sorted_by(rows: DataFrame, column: str, descending: bool, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(column) if descending else F.asc(column), tie)


def merged_hours(own: DataFrame, other: DataFrame) -> DataFrame:
    """Hours of both sides, without empty ones. The sides write hours differently and stay apart."""
    both = own.select("h", "total").unionByName(other.select("h", "total"))
    return both.filter("coalesce(h, '') <> ''").groupBy("h").agg(F.sum("total").alias("total")).filter("total > 0")


def model_range_cost(sides: DataFrame, units: DataFrame) -> DataFrame:
    """The own side's tokens at the own unit price, and the other side's cost."""
    j = sides.join(units.select("key", "unit"), "key", "left")
    return j.select("key", (F.coalesce("unit", F.lit(0.0)) * F.col("own_tokens") / 1e6 + F.col("ext_cost")).alias("cost"))


def own_first(own: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both sides; a key that both have is the own side's."""
    return own.withColumn("side", F.lit("pi")).unionByName(other.join(own.select("key"), "key", "left_anti").withColumn("side", F.lit("ext")))


def project_rollup(usage: DataFrame, sessions: DataFrame, key: str, zone: str = "UTC") -> DataFrame:
    """Sessions updated in the range, by project."""
    dated = lambda df: df.withColumn("d", local_day(F.col("updated_at"), zone))
    rows = in_range(dated(usage), key, anchor(dated(sessions)))
    return rows.groupBy(F.coalesce("project", F.lit(NO_PROJECT)).alias("name")).agg(F.count_distinct("id").alias("sessions"), F.sum("total").cast("long").alias("total"))


def project_models(turns: DataFrame, sessions: DataFrame, project: str) -> DataFrame:
    own = sessions.filter(F.col("project") == project).select(F.col("id").alias("session_id"))
    return turns.filter("has_usage").join(own, "session_id", "left_semi").groupBy(F.col("model_canon").alias("key")).agg(F.count("*").alias("turns"), F.sum("total").alias("total"))


def project_days(usage: DataFrame, project: str, zone: str = "UTC") -> DataFrame:
    own = usage.filter(F.col("project") == project)
    return own.groupBy(local_day(F.col("updated_at"), zone).alias("d")).agg(F.count_distinct("id").alias("sessions"), F.sum("total").alias("total"))


def commits_by_day(commits: DataFrame, shown: int = 3, order: str = "subject") -> DataFrame:
    """Commits of each repository and day, and the first few subjects in the order of a column (the log's, where it is known). Only as many subjects are kept as are shown."""
    cut = F.when(F.octet_length("subject") > SUBJECT, F.concat(F.decode(F.substring(F.encode("subject", "UTF-8"), 1, SUBJECT), "UTF-8"), F.lit("…"))).otherwise(F.col("subject"))
    w = Window.partitionBy("root", "d").orderBy(order)
    first = F.array_sort(F.collect_list(F.struct("rn", cut.alias("s"))))
    some = commits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= shown).groupBy("root", "d").agg(F.array_join(F.transform(first, lambda x: x["s"]), "|").alias("subjects"))
    return commits.groupBy("root", "d").agg(F.count("*").alias("commits")).join(some, ["root", "d"])


def cost_per_commit(commits: DataFrame, repos: DataFrame, projects: DataFrame, unit: float) -> DataFrame:
    """Each repository's project (its name, or the first alias that is one) and what a commit cost. Without a project or commits it is null."""
    names = repos.select("root", F.posexplode(F.concat(F.array("name"), F.coalesce("also", F.array().cast("array<string>")))).alias("pos", "project"))
    found = names.join(projects.select(F.col("name").alias("project"), "total"), "project").groupBy("root").agg(F.min_by(F.struct("project", "total"), "pos").alias("p"))
    n = commits.groupBy("root").agg(F.count("*").alias("commits"))
    j = repos.select("root").join(n, "root", "left").join(found, "root", "left").select("root", F.coalesce("commits", F.lit(0)).alias("commits"), "p.project", "p.total")
    return j.withColumn("cost_per_commit", F.try_divide(F.col("total") * unit / 1e6, F.col("commits")))


def title_categories(usage: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """Sessions and tokens by category. The classifier is the caller's; an external one is never called here."""
    return usage.groupBy(classify(F.col("title")).alias("category")).agg(F.count("*").alias("n"), F.sum("total").alias("total"))
