"""Rows of the tool's own database (projects, sessions, turns, messages) as warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlark.functions.models import NO_PROJECT, canonical_model
from ledgerlark.operators.warehouse import counted

TOOL = "pi"
# Keys of a turn's usage.
USAGE = {"cache_read": "cacheReadTokens", "cache_write": "cacheWriteTokens", "input": "inputTokens", "output": "outputTokens", "reasoning": "reasoningTokens", "total": "totalTokens"}


def projects(rows: DataFrame) -> DataFrame:
    """id, name and path of every project; nulls are empty."""
    return rows.select(F.col("id").cast("long").alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("path", F.lit("")).alias("path"))


def turns(rows: DataFrame) -> DataFrame:
    """Turns with the counters of usage_json. The table's own columns hold only what a step added, so they aren't used. A turn without a total has no usage; nulls count 0."""
    usage = F.from_json("usage_json", ", ".join(f"{k} long" for k in USAGE.values()))
    raw = F.coalesce(F.nullif("model_id", F.lit("")), F.lit("(none)"))
    out = rows.withColumn("u", usage).select(
        F.coalesce("session_id", F.lit("")).alias("session_id"), F.lit(TOOL).alias("tool"), raw.alias("model_raw"), F.coalesce(F.col("started_at").cast("long"), F.lit(0)).alias("started_at"), F.coalesce(F.col("ended_at").cast("long"), F.lit(0)).alias("ended_at"),
        F.coalesce("status", F.lit("")).alias("status"), *(F.coalesce(F.col(f"u.{k}"), F.lit(0)).alias(c) for c, k in USAGE.items()), F.col(f"u.{USAGE['total']}").isNotNull().alias("has_usage"),
    )
    return out.withColumn("model_canon", canonical_model(F.col("model_raw")))


def sessions(rows: DataFrame, project_rows: DataFrame, turn_rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their project's name and how many turns and messages they have. Both are counted before the join."""
    count = lambda df, name: df.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias(name))
    names = project_rows.select(F.col("id").cast("long").alias("project_id"), F.coalesce("name", F.lit("")).alias("project"))
    base = rows.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("project_id").cast("long"), F.lit(0)).alias("project_id"), F.coalesce("model_id", F.lit("")).alias("model_raw"), F.coalesce("mode", F.lit("")).alias("mode"), F.col("thinking_level").alias("thinking"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("created_at", "updated_at")))
    joined = base.join(names, "project_id", "left").join(count(turn_rows, "turns"), "id", "left").join(count(messages, "messages"), "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("turns", "messages")}
    return joined.withColumns(zero | {"project": F.coalesce("project", F.lit(NO_PROJECT))}).drop("project_id")


def message_counts(messages: DataFrame) -> dict[str, DataFrame]:
    """Messages and errors by role and by tool."""
    failed = F.coalesce(F.col("is_error").cast("long"), F.lit(0)) != 0
    return {"roles": messages.groupBy(F.coalesce("role", F.lit("")).alias("name")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors")), "tools": counted(messages, "tool_name", failed)}
