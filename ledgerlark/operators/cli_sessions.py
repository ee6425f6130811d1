"""Folds the record stream of CLI sessions to sessions, turns and counters. Windows and aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.functions.models import ABORT_STOPS, ERROR_STOPS, canonical_model, iso_millis, local_day, local_hour, project_name, status_for
from ledgerlark.operators.ingest import dig, to_int

REVISIONS = ".revisions.jsonl"
TOOL = "pi-cli"
COUNTERS = {"input": "input", "output": "output", "cache_read": "cacheRead", "cache_write": "cacheWrite", "reasoning": "reasoning"}


def _text(path: str) -> Column:
    return F.nullif(dig(F.col("obj"), path), F.lit(""))


def records(lines: DataFrame) -> DataFrame:
    """Typed records of decoded lines (file, line, obj). Files of one name are one session, in the order of their roots (column root, if there is one) and then of their paths; revisions of messages are left out."""
    order = [*(["root"] if "root" in lines.columns else []), "file", "line"]
    stem = F.regexp_extract("file", r"([^/\\]+)\.jsonl$", 1)
    usage_at = F.when(dig(F.col("obj"), "type") == "compaction", "usage").otherwise("message.usage")
    count = lambda k: to_int(F.when(usage_at == "usage", dig(F.col("obj"), f"usage.{k}")).otherwise(dig(F.col("obj"), f"message.usage.{k}")))
    usage = F.when(usage_at == "usage", F.try_variant_get("obj", "$.usage", "variant")).otherwise(F.try_variant_get("obj", "$.message.usage", "variant"))
    ms = lambda p: iso_millis(F.coalesce(dig(F.col("obj"), p), F.lit("")))
    rows = lines.filter(~F.col("file").endswith(REVISIONS)).select(
        stem.alias("stem"), F.struct(*order).alias("ord"), _text("type").alias("type"), F.coalesce(_text("id"), F.lit("")).alias("id"), ms("timestamp").alias("rts"), _text("cwd").alias("cwd"),
        _text("modelId").alias("model_id"), _text("thinkingLevel").alias("thinking_level"), dig(F.col("obj"), "version", "bigint").alias("version"),
        _text("message.role").alias("role"), _text("message.model").alias("model"), F.coalesce(_text("message.stopReason"), _text("message.rawStopReason")).alias("stop"),
        _text("message.toolCallId").alias("call_id"), _text("message.toolName").alias("tool_name"), F.coalesce(dig(F.col("obj"), "message.isError", "boolean"), F.lit(False)).alias("is_error"),
        ms("message.timestamp").alias("mts"), (usage.isNotNull() & ~F.is_variant_null(usage)).alias("has_usage"), *(count(k).alias(c) for c, k in COUNTERS.items()),
        F.try_variant_get("obj", "$.message.content", "array<variant>").alias("content"),
    )
    rows = rows.withColumn("mts", F.when(F.col("mts") != 0, F.col("mts")).otherwise(F.col("rts")))
    first = F.row_number().over(Window.partitionBy("stem", "id").orderBy("ord"))
    return rows.withColumn("rn", first).filter("rn = 1 or id = ''").drop("rn")


def _walk(recs: DataFrame) -> DataFrame:
    """Records in their order in time, with the model in force and the number of the turn."""
    w = Window.partitionBy("stem").orderBy("rts", "id", "ord")
    carried = F.last(F.when(F.col("type") == "model_change", F.col("model_id")), ignorenulls=True).over(w)
    n = F.sum(F.when((F.col("type") == "message") & (F.col("role") == "user"), 1).otherwise(0)).over(w)
    return recs.withColumns({"carried": carried, "turn_no": n, "place": F.struct("rts", "id", "ord")})


def turns(recs: DataFrame) -> DataFrame:
    """stem, model, status, started_at, ended_at, counters, total and has_usage of each turn."""
    walked = _walk(recs)
    talk = walked.filter("type = 'message' and role in ('user', 'assistant')")
    said = F.col("role") == "assistant"
    ends = said & F.col("stop").isNotNull() & ~F.col("stop").isin("toolUse", "tool_use")
    model = F.coalesce("model", "carried")
    sums = [F.sum(F.when(said, F.col(c)).otherwise(0)).alias(c) for c in COUNTERS]
    folded = talk.groupBy("stem", "turn_no").agg(
        F.max_by(F.when(said, model), F.when(said & model.isNotNull(), F.col("place"))).alias("model"),
        F.coalesce(status_for(F.max_by("stop", F.when(ends, F.col("place")))), F.lit("completed")).alias("status"),
        F.min_by("mts", "place").alias("started_at"),
        F.coalesce(F.max_by("mts", F.when(said & (F.col("mts") != 0), F.col("place"))), F.min_by("mts", "place")).alias("ended_at"),
        *sums,
        F.bool_or(said & F.col("has_usage")).alias("has_usage"),
    )
    compact = walked.filter("type = 'compaction'").select("stem", F.lit(-1).cast("long").alias("turn_no"), F.coalesce("model_id", "carried").alias("model"), F.lit("completed").alias("status"), F.col("rts").alias("started_at"), F.col("rts").alias("ended_at"), *COUNTERS, "has_usage")
    both = folded.unionByName(compact)
    return both.withColumn("total", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"))


def sessions(recs: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """One row for each session stem."""
    is_session, is_message = F.col("type") == "session", F.col("type") == "message"
    place = F.struct("rts", "id", "ord")
    first = lambda c, cond: F.min_by(c, F.when(cond & F.col(c).isNotNull(), F.col("ord")))
    s = recs.withColumns({"sid": F.nullif("id", F.lit("")), "touch": F.when(is_message, F.col("mts")).when(F.col("type") == "compaction", F.col("rts"))}).groupBy("stem").agg(
        first("sid", is_session).alias("id"),
        first("cwd", is_session).alias("cwd"),
        F.coalesce(first("version", is_session), F.lit(0)).alias("version"),
        F.max_by("model_id", F.when((F.col("type") == "model_change") & F.col("model_id").isNotNull(), place)).alias("model_raw"),
        F.max_by("thinking_level", F.when((F.col("type") == "thinking_level_change") & F.col("thinking_level").isNotNull(), place)).alias("thinking"),
        F.coalesce(F.min_by(F.when(is_session, F.col("rts")).otherwise(F.col("mts")), F.when((is_session & (F.col("rts") != 0)) | (is_message & (F.col("mts") != 0)), place)), F.lit(0)).alias("created_at"),
        F.coalesce(F.max("touch"), F.lit(0)).alias("touched"),
        F.count_if(is_message).alias("messages"),
    )
    n = turn_rows.groupBy("stem").agg(F.count("*").alias("turns"), F.bool_or("has_usage").alias("used"))
    out = s.join(n, "stem", "left")
    return out.select("stem", "id", project_name(F.coalesce("cwd", F.lit(""))).alias("project"), F.coalesce("model_raw", F.lit("(none)")).alias("model_raw"), F.lit("agent").alias("mode"), "thinking", "created_at", F.greatest("touched", F.when(F.col("touched") == 0, F.col("created_at"))).alias("updated_at"), F.coalesce("turns", F.lit(0)).alias("turns"), "messages", "version", F.coalesce("used", F.lit(False)).alias("used"), F.col("model_raw").alias("last_model"))


def collect(lines: DataFrame, known: DataFrame | None = None, zone: str = "UTC") -> dict[str, DataFrame]:
    """sessions, turns, roles, tools and stats of CLI logs; sessions that `known` (id) has are left out, and so are those without an id, turns or usage."""
    recs = records(lines)
    turn_rows = turns(recs)
    every = sessions(recs, turn_rows)
    named = every.filter("id is not null")
    dup = named.join(known.select("id").distinct(), "id", "left_semi") if known is not None else named.limit(0)
    fresh = named.join(known.select("id").distinct(), "id", "left_anti") if known is not None else named
    kept = fresh.filter("turns > 0 and used")
    stems = kept.select("stem", F.col("id").alias("session"), "last_model")
    rows = turn_rows.join(stems, "stem")
    raw = F.coalesce("model", "last_model")
    at = F.when(F.col("started_at") != 0, F.col("started_at")).otherwise(F.col("ended_at"))
    out_turns = rows.select("session", F.lit(TOOL).alias("tool"), F.coalesce(raw, F.lit("(none)")).alias("model_raw"), canonical_model(F.coalesce(raw, F.lit(""))).alias("model_canon"), "status", local_day(at, zone).alias("day"), local_hour(at, zone).alias("hour"), "started_at", "ended_at", *COUNTERS, "total", "has_usage")
    mine = recs.join(stems.select("stem"), "stem", "left_semi").filter("type = 'message'")
    bad = ((F.col("role") == "toolResult") & F.col("is_error")) | ((F.col("role") == "assistant") & F.col("stop").isin(*ERROR_STOPS, *ABORT_STOPS))
    roles = mine.groupBy(F.col("role").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("errors"))
    blocks = mine.filter("role = 'assistant'").select("stem", F.struct("rts", "id", "ord").alias("place"), F.posexplode("content").alias("i", "b")).select("stem", "place", "i", F.try_variant_get("b", "$.type", "string").alias("kind"), F.try_variant_get("b", "$.name", "string").alias("name"), F.coalesce(F.try_variant_get("b", "$.id", "string"), F.lit("")).alias("call_id"))
    calls = blocks.filter("kind = 'toolCall' and coalesce(name, '') <> ''")
    last = calls.groupBy("stem", "call_id").agg(F.max_by("name", F.struct("place", "i")).alias("name"))
    failed = mine.filter("role = 'toolResult' and is_error and call_id is not null").select("stem", "call_id").distinct()
    errors = last.join(failed, ["stem", "call_id"]).groupBy("name").agg(F.count("*").alias("errors"))
    tools = calls.groupBy("name").agg(F.count("*").alias("n")).join(errors, "name", "left").select("name", "n", F.coalesce("errors", F.lit(0)).alias("errors"))
    files = lines.filter(~F.col("file").endswith(REVISIONS)).agg(F.count_distinct("file").alias("files"), (F.count_distinct("root") if "root" in lines.columns else F.lit(None)).cast("long").alias("dirs"))
    stats = every.agg(F.count("*").alias("stems")).crossJoin(files).crossJoin(dup.agg(F.count("*").alias("skipped_dup"))).crossJoin(kept.agg(F.count("*").alias("sessions"))).withColumn("skipped_empty", F.col("stems") - F.col("skipped_dup") - F.col("sessions"))
    return {"sessions": kept.drop("stem", "used", "last_model"), "turns": out_turns, "roles": roles, "tools": tools, "stats": stats}


def stat_rows(collected: dict[str, DataFrame]) -> DataFrame:
    """k and v of what collect() took in: dirs, files, sessions, turns, skippedDup, skippedEmpty and tokenTotal."""
    tokens = collected["turns"].agg(F.count("*").alias("turns"), F.coalesce(F.sum("total"), F.lit(0)).alias("tokenTotal"))
    one = collected["stats"].crossJoin(tokens)  # one row each
    named = one.select(F.coalesce("dirs", F.lit(0)).alias("dirs"), "files", "sessions", "turns", F.col("skipped_dup").alias("skippedDup"), F.col("skipped_empty").alias("skippedEmpty"), "tokenTotal")
    return named.unpivot([], named.columns, "k", "v")


def file_checks(collected: dict[str, DataFrame]) -> DataFrame:
    """Assertions on a collection: sessions can't outnumber files, and every session is kept or counted as skipped."""
    s = collected["stats"]
    checks = s.select(F.greatest(F.lit(0), F.col("sessions") - F.col("files")).alias("files_at_least_sessions"), F.abs(F.col("stems") - F.col("sessions") - F.col("skipped_dup") - F.col("skipped_empty")).alias("all_accounted_for"))
    return checks.unpivot([], checks.columns, "check_name", "violations")
