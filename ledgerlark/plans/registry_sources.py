"""Registered queries on the sources: counter logs, the own database, price tables, and the blocks assembled from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlark.functions.models import local_day
from ledgerlark.functions.prices import normalized
from ledgerlark.operators import assembly as A, catalogue as K, cli_sessions as S, cost as C, exports, external as X, ingest as I, own_store as O, resolve as R, rollups as Y, warehouse as W
from ledgerlark.operators.drivers import DRIVERS
from ledgerlark.plans import views as V
from ledgerlark.plans.duck import canon
from ledgerlark.plans.kept import folder, kept
from ledgerlark.plans.registry import NOW, _OVERRIDE_SQL, _ext, _ext_days, _override_tables, _own_costs, _own_day_cost, _round, query
from ledgerlark.plans.registry_ranges import _BURN, _COMMITS, _MODEL_AGG, _commits, _ext_models, _model_agg, _repos
from ledgerlark.streaming import rollouts

# --- logs of running totals

_ROLLOUT = I.Manifest.of(
    {
        "id": "rollouts", "driver": "codex", "paths": ["-"], "prefilter": ['"token', '"turn_context"', '"session_meta"'],
        "fields": {"model": ["model"], "input": ["input_tokens"], "cacheRead": ["cached_input_tokens"], "cacheWrite": ["cache_write_input_tokens"], "output": ["output_tokens"], "reasoning": ["reasoning_output_tokens"]},
    }
)


def _rollout_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log for each user: contexts at sign-ups, meta lines at some views, else running totals of five counters that start again at an error."""
    e = V.table(spark, d, "events").select("user_id", F.col("event_id").alias("line"), "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    order = Window.partitionBy("user_id").orderBy("line")
    e = e.withColumn("run", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(order))
    k = F.col("k")
    own = {"input_tokens": 3 * k + 50, "cached_input_tokens": k, "cache_write_input_tokens": k % 5, "output_tokens": k % 40 + 1, "reasoning_output_tokens": k % 60, "total_tokens": 3 * k + 51 + k % 40}
    w = Window.partitionBy("user_id", "run").orderBy("line")
    total = F.struct(*(F.sum(v).over(w).alias(c) for c, v in own.items()))
    last = F.when(k % 13 != 0, F.struct(*(v.alias(c) for c, v in own.items())))
    meta = (F.col("event_type") == "view") & (k % 25 == 0)
    stamp = F.when(F.col("line") % 11 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    text = (
        F.when(meta, F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("meta-"), k).alias("id")).alias("payload"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("ctx-"), "user_id")).alias("session_id"), F.concat(F.lit("model-"), k % 4).alias("model")).alias("payload"))))
        .otherwise(F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage"), last.alias("last_token_usage")).alias("info")).alias("payload"))))
    )
    file = F.concat(F.lit("rollout-2024-01-"), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00-"), F.col("user_id"), F.lit(".jsonl"))
    return e.select(file.alias("file"), F.lit("dir").alias("dir"), "line", text.alias("value"))


_KEYS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
_OWN = {"input_tokens": "3 * k + 50", "cached_input_tokens": "k", "cache_write_input_tokens": "k % 5", "output_tokens": "k % 40 + 1", "reasoning_output_tokens": "k % 60", "total_tokens": "3 * k + 51 + k % 40"}
_FELL = " OR ".join(f"t_{c} < p_{c}" for c in _KEYS if c != "reasoning_output_tokens")
_ROLLOUT_SQL = f"""WITH e AS (SELECT user_id, event_id AS line, event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
 l AS (SELECT *, {', '.join(f'CAST(sum({v}) OVER (PARTITION BY user_id, run ORDER BY line) AS BIGINT) AS t_{c}' for c, v in _OWN.items())}, event_type = 'view' AND k % 25 = 0 AS is_meta, event_type = 'signup' AND NOT (event_type = 'view' AND k % 25 = 0) AS is_context FROM e),
 s AS (SELECT *, coalesce(last_value(CASE WHEN is_meta THEN 'meta-' || k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING), CASE WHEN user_id % 2 = 0 AND max(CASE WHEN is_context THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) = 1 THEN 'ctx-' || user_id END, 'dir') AS session,
  last_value(CASE WHEN is_context THEN 'model-' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS carried, first_value(CASE WHEN is_context THEN 'model-' || (k % 4) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_model FROM l),
 c AS (SELECT *, {', '.join(f'lag(t_{c}) OVER (PARTITION BY user_id ORDER BY line) AS p_{c}' for c in _KEYS)} FROM s WHERE NOT is_meta AND NOT is_context),
 g AS (SELECT *, coalesce({_FELL}, false) AS reset, {', '.join(f'CASE WHEN coalesce({_FELL}, false) THEN {_OWN[c]} ELSE t_{c} - coalesce(p_{c}, 0) END AS d_{c}' for c in _KEYS)} FROM c),
 u AS (SELECT user_id, line, session, carried, first_model, reset, CASE WHEN line % 11 <> 0 THEN day END AS d, greatest(d_input_tokens - d_cached_input_tokens - d_cache_write_input_tokens, 0) AS input, d_cached_input_tokens AS cache_read, d_cache_write_input_tokens AS cache_write, d_output_tokens AS output, least(d_reasoning_output_tokens, d_output_tokens) AS reasoning FROM g WHERE NOT (reset AND k % 13 = 0)),
 p AS (SELECT coalesce(carried, first_model, '(unknown)') AS model, carried IS NULL AS parked, CASE WHEN carried IS NULL THEN coalesce(d, '2024-01-' || lpad(CAST(user_id % 28 + 1 AS VARCHAR), 2, '0')) ELSE d END AS d, CASE WHEN carried IS NULL THEN first_value(session) OVER (PARTITION BY user_id, carried IS NULL, coalesce(d, '2024-01-' || lpad(CAST(user_id % 28 + 1 AS VARCHAR), 2, '0')) ORDER BY line) ELSE session END AS session, input, cache_read, cache_write, output, reasoning, reset FROM u WHERE input + cache_read + cache_write + output + reasoning <> 0)
 SELECT model, session, d, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning) AS BIGINT) AS reasoning, count(*) FILTER (WHERE reset) AS resets FROM p GROUP BY 1, 2, 3"""


def _rollout_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model", "session", F.substring("ts", 1, 10).alias("d")).agg(*(F.sum(c).alias(c) for c in ("input", "cache_read", "cache_write", "output", "reasoning")), F.sum("resets").alias("resets"))


query("codex_records", _ROLLOUT_SQL)(lambda s, d: _rollout_sums(DRIVERS["codex"](I.decoded(I.prefiltered(_rollout_lines(s, d), _ROLLOUT.prefilter)), _ROLLOUT)))


def _rollout_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same logs as they grow: their lines come in three parts, and a batch reads some files of one."""
    root = f"{folder(spark)}/rollouts-{uuid.uuid4().hex}"
    lines = kept(_rollout_lines(spark, d), "lines")
    third = F.ntile(3).over(Window.partitionBy("file").orderBy("line"))
    parts = kept(lines.withColumn("part", third), "parts")
    for k in (1, 2, 3):
        parts.filter(F.col("part") == k).drop("part").repartition(4, "file").write.mode("append").parquet(f"{root}/lines")
    found = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 3).parquet(f"{root}/lines")
    rows = rollouts.records(I.decoded(I.prefiltered(found, _ROLLOUT.prefilter)), _ROLLOUT)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return _rollout_sums(rollouts.latest(spark.read.schema(rows.schema).parquet(f"{root}/rows")))


query("codex_stream", _ROLLOUT_SQL)(_rollout_stream)

# --- sessions of the command line


def _cli_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log for each conversation: a session line, then its messages a second apart; assistants have usage and a reason to stop."""
    c = V.table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.length("text").cast("long").alias("n"))
    stamp = lambda k: F.concat(F.lit("2024-01-01T00:00:"), F.lpad(k.cast("string"), 2, "0"), F.lit("Z"))
    said = F.col("role") == "assistant"
    usage = F.when(said, F.struct(F.col("n").alias("input"), F.col("turn").alias("output")))
    message = F.struct("role", F.when(said, F.lit("openai/m-1")).alias("model"), F.when(said, F.when(F.col("n") % 7 == 0, "error").otherwise("stop")).alias("stopReason"), stamp(F.col("turn") + 1).alias("timestamp"), usage.alias("usage"))
    file = F.concat(F.lit("/logs/c"), "conv_id", F.lit(".jsonl"))
    lines = c.select(file.alias("file"), (F.col("turn") + 1).alias("line"), F.to_json(F.struct(F.lit("message").alias("type"), stamp(F.col("turn") + 1).alias("timestamp"), message.alias("message"))).alias("value"))
    first = F.to_json(F.struct(F.lit("session").alias("type"), F.lit(1).alias("version"), F.concat(F.lit("s"), "conv_id").alias("id"), stamp(F.lit(0)).alias("timestamp"), F.concat(F.lit("/w/p"), F.col("conv_id") % 3).alias("cwd")))
    return c.select("conv_id").distinct().select(file.alias("file"), F.lit(0).cast("long").alias("line"), first.alias("value")).unionByName(lines)


query("cli_fold", """WITH m AS (SELECT conv_id, turn, role, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')),
 t AS (SELECT conv_id, k, coalesce(max_by(n % 7 = 0, turn) FILTER (WHERE role = 'assistant'), false) AS failed, bool_or(role = 'assistant') AS used, coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) AS input, coalesce(sum(turn) FILTER (WHERE role = 'assistant'), 0) AS output, min(turn) AS a, coalesce(max(turn) FILTER (WHERE role = 'assistant'), min(turn)) AS b FROM m GROUP BY 1, 2)
 SELECT 's' || conv_id AS session, CASE WHEN failed THEN 'error' ELSE 'completed' END AS status, CASE WHEN used THEN 'm-1' ELSE '(unknown)' END AS model_canon, used AS has_usage, count(*) AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(input + output) AS BIGINT) AS total, CAST(sum((b - a) * 1000) AS BIGINT) AS ms
 FROM t WHERE conv_id IN (SELECT conv_id FROM t WHERE used) GROUP BY 1, 2, 3, 4""")(
    lambda s, d: S.collect(I.decoded(_cli_lines(s, d)))["turns"].groupBy("session", "status", "model_canon", "has_usage").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("input", "output", "total")), F.sum(F.col("ended_at") - F.col("started_at")).alias("ms"))
)



def _collected(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The logs of conversations below two roots; every fourth session is known from elsewhere."""
    conv = F.regexp_extract("file", "c([0-9]+)", 1).cast("long")
    lines = I.decoded(_cli_lines(spark, d)).withColumn("root", (conv % 2).cast("int"))
    known = V.table(spark, d, "conversations").filter("conv_id % 4 = 0").select(F.concat(F.lit("s"), "conv_id").alias("id"))
    return S.collect(lines, known)


_COLLECTED = """m AS (SELECT conv_id, turn, role, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')),
 c AS (SELECT conv_id, conv_id % 4 = 0 AS dup, conv_id IN (SELECT conv_id FROM m WHERE role = 'assistant') AS used FROM (SELECT DISTINCT conv_id FROM conversations)), ok AS (SELECT conv_id FROM c WHERE used AND NOT dup),
 st AS (SELECT count(*) AS files, count(*) FILTER (WHERE dup) AS dups, count(*) FILTER (WHERE NOT dup AND NOT used) AS empty, count(*) FILTER (WHERE used AND NOT dup) AS sessions, count(DISTINCT conv_id % 2) AS dirs FROM c)"""
query("cli_statistics", f"""WITH {_COLLECTED}, tt AS (SELECT count(DISTINCT (conv_id, k)) AS turns, CAST(coalesce(sum(n + turn) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS tokens FROM m WHERE conv_id IN (SELECT conv_id FROM ok))
 SELECT 'dirs' AS k, dirs AS v FROM st UNION ALL SELECT 'files', files FROM st UNION ALL SELECT 'sessions', sessions FROM st UNION ALL SELECT 'turns', turns FROM tt UNION ALL SELECT 'skippedDup', dups FROM st UNION ALL SELECT 'skippedEmpty', empty FROM st UNION ALL SELECT 'tokenTotal', tokens FROM tt""")(lambda s, d: S.stat_rows(_collected(s, d)))
query("cli_checks", "SELECT 'files_at_least_sessions' AS check_name, CAST(greatest(0, count(DISTINCT conv_id) FILTER (WHERE role = 'assistant' AND conv_id % 4 <> 0) - count(DISTINCT conv_id)) AS BIGINT) AS violations FROM conversations UNION ALL SELECT 'all_accounted_for', CAST(0 AS BIGINT)")(lambda s, d: S.file_checks(_collected(s, d)))
query("cli_tool_errors", f"""WITH {_COLLECTED} SELECT 'role' AS kind, role AS name, count(*) AS n, count(*) FILTER (WHERE role = 'assistant' AND length(text) % 7 = 0) AS errors FROM conversations WHERE conv_id IN (SELECT conv_id FROM ok) GROUP BY 1, 2""")(lambda s, d: _collected(s, d)["roles"].select(F.lit("role").alias("kind"), "name", "n", "errors"))



def _tool_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log for each user with all kinds of records: models change at sign-ups, views are questions, clicks answer them and call tools, purchases are results of the last call, and errors compact the session."""
    e = V.table(spark, d, "events").select("user_id", F.col("event_id").alias("line"), F.col("event_type").alias("t"), F.floor("value").cast("long").alias("v"))
    call = F.last(F.when(F.col("t") == "click", F.concat(F.lit("c"), "line")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("call", call)
    stamp = F.concat(F.date_format(F.expr("timestamp_ntz '2024-03-01 00:00:00'") + F.make_interval(secs=F.col("line").cast("decimal(18,3)")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp")
    ident = F.concat(F.lit("r"), "line").alias("id")
    usage = F.struct(F.col("v").alias("input"), F.lit(1).alias("output")).alias("usage")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("toolCall").alias("type"), F.concat(F.lit("c"), "line").alias("id"), F.concat(F.lit("tool-"), F.col("v") % 5).alias("name"))).alias("content")
    said = lambda *more: F.to_json(F.struct(F.lit("message").alias("type"), ident, stamp, F.struct(stamp, *more).alias("message")))
    text = (
        F.when(F.col("t") == "signup", F.to_json(F.struct(F.lit("model_change").alias("type"), ident, stamp, F.concat(F.lit("openai/m-"), F.col("v") % 3).alias("modelId"))))
        .when(F.col("t") == "view", said(F.lit("user").alias("role")))
        .when(F.col("t") == "click", said(F.lit("assistant").alias("role"), usage, F.when(F.col("v") % 4 == 0, "toolUse").when(F.col("v") % 9 == 1, "error").otherwise("stop").alias("stopReason"), blocks))
        .when(F.col("t") == "purchase", said(F.lit("toolResult").alias("role"), F.col("call").alias("toolCallId"), (F.col("v") > 60).alias("isError")))
        .otherwise(F.to_json(F.struct(F.lit("compaction").alias("type"), ident, stamp, usage)))
    )
    file = F.concat(F.lit("/logs/u"), "user_id", F.lit(".jsonl"))
    first = F.to_json(F.struct(F.lit("session").alias("type"), F.lit(1).alias("version"), F.concat(F.lit("s"), "user_id").alias("id"), F.lit("2024-03-01T00:00:00Z").alias("timestamp"), F.concat(F.lit("/w/p"), F.col("user_id") % 3).alias("cwd")))
    heads = e.select("user_id").distinct().select(file.alias("file"), F.lit(-1).cast("long").alias("line"), first.alias("value"))
    return heads.unionByName(e.select(file.alias("file"), "line", text.alias("value")))


def _tool_fold(spark: SparkSession, d: str) -> DataFrame:
    out = S.collect(I.decoded(_tool_lines(spark, d)))
    counts = out["tools"].select(F.lit("tool").alias("kind"), "name", "n", "errors").unionByName(out["roles"].select(F.lit("role").alias("kind"), "name", "n", "errors"))
    t = out["turns"]
    turns = t.groupBy(F.lit("status").alias("kind"), F.col("status").alias("name")).agg(F.count("*").alias("n"), F.sum("input").alias("errors"))
    models = t.groupBy(F.lit("model").alias("kind"), F.col("model_canon").alias("name")).agg(F.count("*").alias("n"), F.sum("input").alias("errors"))
    sessions = out["sessions"].groupBy(F.lit("project").alias("kind"), F.col("project").alias("name")).agg(F.sum("turns").alias("n"), F.sum("messages").alias("errors"))
    return counts.unionByName(turns).unionByName(models).unionByName(sessions).withColumnRenamed("errors", "m")


query("cli_fold_tools", """WITH e AS (SELECT user_id AS u, event_id AS line, event_type AS t, CAST(floor(value) AS BIGINT) AS v, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS call FROM events),
 ok AS (SELECT DISTINCT u FROM e WHERE t IN ('click', 'error')), w AS (SELECT *, last_value(CASE WHEN t = 'signup' THEN 'm-' || (v % 3) END IGNORE NULLS) OVER (PARTITION BY u ORDER BY line ROWS UNBOUNDED PRECEDING) AS carried, max(CASE WHEN t = 'signup' THEN line END) OVER (PARTITION BY u) AS lastmodel,
  sum(CASE WHEN t = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY line) AS k FROM e WHERE u IN (SELECT u FROM ok)),
 calls AS (SELECT line, 'tool-' || (v % 5) AS name FROM w WHERE t = 'click'), bad AS (SELECT DISTINCT call FROM w WHERE t = 'purchase' AND v > 60 AND call IS NOT NULL),
 mm AS (SELECT u, 'm-' || (v % 3) AS last_model FROM e WHERE t = 'signup' QUALIFY row_number() OVER (PARTITION BY u ORDER BY line DESC) = 1),
 tt AS (SELECT u, coalesce(max_by(carried, line) FILTER (WHERE t = 'click' AND carried IS NOT NULL), NULL) AS model, CASE WHEN coalesce(max_by(v % 9 = 1, line) FILTER (WHERE t = 'click' AND v % 4 <> 0), false) THEN 'error' ELSE 'completed' END AS status, coalesce(sum(v) FILTER (WHERE t = 'click'), 0) AS input FROM w WHERE t IN ('view', 'click') GROUP BY u, k
  UNION ALL SELECT u, carried, 'completed', v FROM w WHERE t = 'error'),
 named AS (SELECT t.*, coalesce(model, last_model, '(unknown)') AS name FROM tt t LEFT JOIN mm USING (u)),
 msg AS (SELECT u, count(*) AS messages FROM w WHERE t IN ('view', 'click', 'purchase') GROUP BY 1), tn AS (SELECT u, count(*) AS n_turns FROM tt GROUP BY 1)
 SELECT 'tool' AS kind, name, count(*) AS n, count(bad.call) AS m FROM calls LEFT JOIN bad ON bad.call = calls.line GROUP BY 2
 UNION ALL SELECT 'role', CASE t WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'toolResult' END, count(*), count(*) FILTER (WHERE (t = 'purchase' AND v > 60) OR (t = 'click' AND v % 4 <> 0 AND v % 9 = 1)) FROM w WHERE t IN ('view', 'click', 'purchase') GROUP BY 2
 UNION ALL SELECT 'status', status, count(*), CAST(sum(input) AS BIGINT) FROM tt GROUP BY 2 UNION ALL SELECT 'model', name, count(*), CAST(sum(input) AS BIGINT) FROM named GROUP BY 2
 UNION ALL SELECT 'project', 'p' || (u % 3), CAST(sum(n_turns) AS BIGINT), CAST(sum(coalesce(messages, 0)) AS BIGINT) FROM tn LEFT JOIN msg USING (u) GROUP BY 2""")(_tool_fold)

# --- the own database


def _own_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns as the database has them, with their usage as JSON text."""
    li = V.table(spark, d, "lineitem")
    q = F.floor("l_quantity").cast("long")
    usage = F.struct((10 * q).alias("inputTokens"), (3 * q).alias("outputTokens"), F.floor("l_extendedprice").cast("long").alias("cacheReadTokens"), F.when(F.col("l_linenumber") % 2 == 0, q).alias("reasoningTokens"), F.when(F.col("l_tax") > 0.01, 13 * q + F.floor("l_extendedprice").cast("long")).alias("totalTokens"))
    model = F.when(F.col("l_partkey") % 5 == 0, F.lit("")).when(F.col("l_partkey") % 5 != 1, F.concat(F.lit("openai/brand-"), F.col("l_partkey") % 25))
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return li.select(F.concat(F.lit("s"), "l_orderkey").alias("session_id"), model.alias("model_id"), F.when(F.col("l_linenumber") != 7, day).alias("started_at"), (day + q).alias("ended_at"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("status"), F.when(F.col("l_discount") > 0.005, F.to_json(usage)).alias("usage_json"))


def _own_projects(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return V.table(spark, d, "nation").select(n.alias("id"), F.when(n % 5 != 0, F.concat(F.lit("/work/"), "n_name")).alias("path"), F.when(n % 4 != 3, F.col("n_name")).alias("name"))


def _own_sessions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    created = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return V.table(spark, d, "orders").select(F.concat(F.lit("s"), k).alias("id"), F.when(k % 13 != 0, F.col("o_orderpriority")).alias("title"), F.when(k % 7 != 0, k % 30).alias("project_id"), F.when(k % 3 != 0, F.lit("brand-1")).alias("model_id"), F.when(k % 2 == 0, F.lit("agent")).alias("mode"), F.when(k % 5 == 0, F.lit("high")).alias("thinking_level"), created.alias("created_at"), F.when(k % 11 != 0, created + k).alias("updated_at"))


def _own_messages(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.when(F.col("user_id") % 9 != 0, F.col("event_type")).alias("role"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tool-"), F.col("user_id") % 4)).when(F.col("event_id") % 3 == 1, F.lit("")).alias("tool_name"), F.when(F.col("event_id") % 4 != 0, (F.col("value") > 60).cast("long")).alias("is_error"))


_OWN_TURNS = f"""(SELECT 's' || l_orderkey AS session_id, CASE WHEN l_partkey % 5 IN (0, 1) THEN '(none)' ELSE 'openai/brand-' || (l_partkey % 25) END AS model_raw, coalesce(nullif(l_returnflag, 'N'), '') AS status, CASE WHEN l_linenumber = 7 THEN 0 ELSE date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 86400000 END AS started_at,
 l_discount > 0.005 AND l_tax > 0.01 AS has_usage, CASE WHEN l_discount > 0.005 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END AS cache_read, CASE WHEN l_discount > 0.005 THEN 10 * CAST(floor(l_quantity) AS BIGINT) ELSE 0 END AS input, CASE WHEN l_discount > 0.005 THEN 3 * CAST(floor(l_quantity) AS BIGINT) ELSE 0 END AS output,
 CASE WHEN l_discount > 0.005 AND l_linenumber % 2 = 0 THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END AS reasoning, CASE WHEN l_discount > 0.005 AND l_tax > 0.01 THEN 13 * CAST(floor(l_quantity) AS BIGINT) + CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END AS total FROM lineitem)"""
_SUMS = ("cache_read", "input", "output", "reasoning", "total")
query("pi_turns_scan", f"""SELECT model_raw, {canon('model_raw')} AS model_canon, 'pi' AS tool, status, has_usage, count(*) AS n, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}, CAST(0 AS BIGINT) AS cache_write, CAST(sum(started_at // 86400000) AS BIGINT) AS days FROM {_OWN_TURNS} GROUP BY ALL""")(
    lambda s, d: O.turns(_own_turns(s, d)).groupBy("model_raw", "model_canon", "tool", "status", "has_usage").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in (*_SUMS, "cache_write")), F.sum(F.expr("started_at div 86400000")).alias("days"))
)
query("pi_projects_scan", "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 4 <> 3 THEN n_name ELSE '' END AS name, CASE WHEN n_nationkey % 5 <> 0 THEN '/work/' || n_name ELSE '' END AS path FROM nation")(lambda s, d: O.projects(_own_projects(s, d)))
query("pi_sessions_scan", """SELECT 's' || o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority ELSE '' END AS title, CASE WHEN o_orderkey % 3 <> 0 THEN 'brand-1' ELSE '' END AS model_raw, CASE WHEN o_orderkey % 2 = 0 THEN 'agent' ELSE '' END AS mode, CASE WHEN o_orderkey % 5 = 0 THEN 'high' END AS thinking,
 date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000 AS created_at, CASE WHEN o_orderkey % 11 <> 0 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000 + o_orderkey ELSE 0 END AS updated_at,
 CASE WHEN n_nationkey IS NULL THEN '(无项目)' WHEN n_nationkey % 4 <> 3 THEN n_name ELSE '' END AS project, coalesce(t.n, 0) AS turns, coalesce(m.n, 0) AS messages FROM orders LEFT JOIN nation ON n_nationkey = CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 30 ELSE 0 END
 LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) m ON user_id = o_orderkey""")(
    lambda s, d: O.sessions(_own_sessions(s, d), _own_projects(s, d), _own_turns(s, d), _own_messages(s, d))
)
query("pi_message_counts", """SELECT 'role' AS kind, CASE WHEN user_id % 9 <> 0 THEN event_type ELSE '' END AS name, count(*) AS n, count(*) FILTER (WHERE event_id % 4 <> 0 AND value > 60) AS errors FROM events GROUP BY 1, 2
 UNION ALL SELECT 'tool', 'tool-' || (user_id % 4), count(*), count(*) FILTER (WHERE event_id % 4 <> 0 AND value > 60) FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2""")(
    lambda s, d: (lambda c: c["roles"].withColumn("kind", F.lit("role")).unionByName(c["tools"].withColumn("kind", F.lit("tool"))))(O.message_counts(_own_messages(s, d)))
)

# --- price tables


def _catalogue_document(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue as it is served: providers with their models, some without prices or origin."""
    p = V.table(spark, d, "part").select((F.col("p_partkey") % 6).alias("v"), (F.col("p_partkey") % 40).alias("m"), F.col("p_size").cast("long").alias("size")).groupBy("v", "m").agg(F.max("size").alias("size"))
    cost = F.when(F.col("size") % 3 != 0, F.struct((F.col("size") / 4).alias("input"), F.when(F.col("size") % 2 == 0, F.col("size") * 1.5).alias("output")))
    model = F.struct(F.when(F.col("m") % 2 == 0, F.concat(F.lit("Model "), "m")).alias("name"), F.when(F.col("v") > 2, F.concat(F.lit("p0/m-"), "m")).alias("canonical_model_id"), cost.alias("cost"))
    name = F.concat(F.when(F.col("v") == 5, "lab/").otherwise(""), F.lit("m-"), "m")
    models = p.groupBy("v").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), model.alias("m"))))).alias("models"))
    return models.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), "v").alias("k"), F.struct("models").alias("p"))))).alias("value"))


_MODELS = "(SELECT p_partkey % 6 AS v, p_partkey % 40 AS m, max(p_size) AS size FROM part GROUP BY 1, 2)"
query("catalogue_parse", f"""SELECT 'p' || v || '/' || CASE WHEN v = 5 THEN 'lab/' ELSE '' END || 'm-' || m AS full_id, 'p' || v AS provider, CASE WHEN v = 5 THEN 'lab/' ELSE '' END || 'm-' || m AS model, 'm-' || m AS leaf, CASE WHEN m % 2 = 0 THEN 'Model ' || m ELSE '' END AS name, CASE WHEN v > 2 THEN 'p0/m-' || m END AS canonical_id,
 CASE WHEN size % 3 <> 0 THEN size / 4.0::DOUBLE END AS price_input, CASE WHEN size % 3 <> 0 AND size % 2 = 0 THEN size * 1.5::DOUBLE END AS price_output, CAST(NULL AS DOUBLE) AS price_cache_read, CAST(NULL AS DOUBLE) AS price_cache_write FROM {_MODELS}""")(lambda s, d: K.parsed(_catalogue_document(s, d)))


def _curated_document(spark: SparkSession, d: str) -> DataFrame:
    """A curated table in which targets come twice and some are missing; entries in the order of the nations."""
    n = F.col("n_nationkey").cast("long")
    entry = F.struct(F.when(n % 8 != 7, F.concat(F.lit("t-"), n % 10)).alias("target"), F.struct((n * 1.0).alias("input"), F.when(n % 2 == 0, n * 3.0).alias("output")).alias("cost"))
    return V.table(spark, d, "nation").agg(F.to_json(F.struct(F.lit("2001-11-01").alias("fetchedAt"), F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), entry.alias("e")))), lambda x: x["e"]).alias("models"))).alias("value"))


query("curated_prices", "SELECT 't-' || (n_nationkey % 10) AS target, max(n_nationkey) * 1.0::DOUBLE AS price_input, CASE WHEN max(n_nationkey) % 2 = 0 THEN max(n_nationkey) * 3.0::DOUBLE END AS price_output, '2001-11-01' AS fetched_at FROM nation WHERE n_nationkey % 8 <> 7 GROUP BY 1")(lambda s, d: K.curated(_curated_document(s, d)).select("target", "price_input", "price_output", "fetched_at"))
query("price_freshness", f"""SELECT n_name AS path, CASE WHEN n_nationkey % 5 NOT IN (0, 1) THEN CAST(date_diff('day', DATE '2001-10-20' + CAST(n_nationkey AS INTEGER), DATE '{NOW}') AS BIGINT) END AS age_days, CASE WHEN n_nationkey % 5 IN (0, 1) THEN true ELSE date_diff('day', DATE '2001-10-20' + CAST(n_nationkey AS INTEGER), DATE '{NOW}') > 7 END AS stale,
 CASE n_nationkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' ELSE CASE WHEN date_diff('day', DATE '2001-10-20' + CAST(n_nationkey AS INTEGER), DATE '{NOW}') > 7 THEN 'old' ELSE '' END END AS reason FROM nation""")(
    lambda s, d: K.freshness(
        V.table(s, d, "nation").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 5 == 1, F.lit("yesterday")).otherwise(F.concat(F.date_format(F.date_add(F.lit("2001-10-20").cast("date"), F.col("n_nationkey").cast("int")), "yyyy-MM-dd"), F.lit("T08:00:00Z"))).alias("fetched_at"), (F.col("n_nationkey") % 5 != 0).alias("there")), NOW
    )
)

# --- assembled blocks


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    base = kept(W.model_statuses(V.turns(spark, d)), "models")
    return A.models(W.models_of(base), W.model_raw_of(base), W.model_status_of(base))


_RAW = "(SELECT key, string_agg(rid || ':' || n || ':' || t, '|' ORDER BY t DESC, rid) AS raw_usage FROM (SELECT model_canon AS key, model_raw AS rid, count(*) AS n, CAST(sum(total) AS BIGINT) AS t FROM turns GROUP BY 1, 2) GROUP BY 1)"
_shown_raw = lambda: F.array_join(F.transform("raw_usage", lambda r: F.concat_ws(":", r["rid"], r["turns"], r["total"])), "|").alias("raw_usage")
query("model_assembly", f"SELECT key, total, turns, raw_usage, statuses FROM (SELECT model_canon AS key, CAST(sum(total) AS BIGINT) AS total, count(*) AS turns FROM turns GROUP BY 1) JOIN {_RAW} USING (key) JOIN (SELECT key, string_agg(status || '=' || n, '|' ORDER BY status) AS statuses FROM (SELECT model_canon AS key, status, count(*) AS n FROM turns GROUP BY 1, 2) GROUP BY 1) USING (key)")(
    lambda s, d: _assembled(s, d).select("key", "total", "turns", _shown_raw(), F.array_join(F.transform("statuses", lambda x: F.concat_ws("=", x["status"], x["n"])), "|").alias("statuses"))
)
query("pricing_rows", f"SELECT key, total, price_input IS NOT NULL AS priced, raw_usage, row_number() OVER (ORDER BY total DESC, key) AS place FROM model_sums JOIN {_RAW} USING (key) JOIN prices ON model_canon = key")(
    # models are few
    lambda s, d: A.pricing_rows(_assembled(s, d), V.prices(s, d)).select("key", "total", "priced", _shown_raw(), F.row_number().over(Window.orderBy(F.desc("total"), "key")).cast("long").alias("place"))
)
_PART = lambda c: f"round(CASE WHEN price_input IS NULL THEN 0.0::DOUBLE ELSE {c} / 1e6::DOUBLE * unit_{c} END, 6) AS cost_{c}"
query("model_cost_parts", f"SELECT key, price_input IS NOT NULL AS priced, {', '.join(map(_PART, ('cache_read', 'cache_write', 'input', 'output')))} FROM model_sums JOIN units u ON u.model_canon = key")(
    lambda s, d: (lambda df: df.select("key", "priced", *(F.round(c, 6).alias(c) for c in df.columns if c.startswith("cost_"))))(A.cost_parts(W.models(V.turns(s, d)).join(V.prices(s, d), F.col("key") == F.col("model_canon"), "left").withColumns(normalized())))
)
query("merged_daily_cost", "SELECT d, round(sum(cost), 4) AS cost FROM (SELECT d, cost FROM day_cost UNION ALL SELECT d, cost FROM ext_day_model_cost) GROUP BY 1")(lambda s, d: _round(A.merged_daily_cost(_own_day_cost(s, d), X.day_model_cost(_ext(s, d), V.external_prices(s, d))), "cost"))
query("merged_daily_cost_amortised", "SELECT d, round(sum(cost), 4) AS cost FROM (SELECT d, cost FROM day_cost UNION ALL SELECT e.d, u.unit * sum(e.total) / 1e6::DOUBLE FROM external e JOIN (SELECT tool, sum(cost) / sum(total) * 1e6::DOUBLE AS unit FROM ext_models GROUP BY 1) u ON u.tool = e.tool GROUP BY e.tool, e.d, u.unit) GROUP BY 1")(
    lambda s, d: _round(A.merged_daily_cost(_own_day_cost(s, d), A.amortised_daily_cost(_ext_days(s, d), X.summary(_ext_models(s, d)))), "cost")
)
query("project_roots", "SELECT name, path FROM (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '/own/' || n_name WHEN n_nationkey % 2 = 0 THEN '/found/' || n_name END AS path FROM nation) WHERE path IS NOT NULL")(
    lambda s, d: (lambda n: A.merged_roots(n.filter("n_nationkey % 3 < 2").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/own/"), "n_name")).otherwise("").alias("path")), n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.concat(F.lit("/found/"), "n_name").alias("path"))))(V.table(s, d, "nation"))
)
_SOURCE = {"generated_at": "2001-11-10 08:00", "db_path": "/home/me/.pi/pi.sqlite", "dir": "/home/me/.pi", "db_version": 12, "db_size": 136_524_800, "wal_size": 0}
query("meta_block", """SELECT '2001-11-10 08:00' AS generated_at, '~/.pi/pi.sqlite' AS db_path, '~/.pi' AS dir, CAST(12 AS BIGINT) AS db_version, 130.2::DOUBLE AS db_size_mb, 0.0::DOUBLE AS wal_size_mb, strftime(make_timestamp(min(CASE WHEN started_at > 0 THEN started_at END) * 1000), '%Y-%m-%d %H:%M') AS range_start, strftime(make_timestamp(max(started_at) * 1000), '%Y-%m-%d %H:%M') AS range_end FROM turns""")(
    lambda s, d: A.meta(W.time_range(V.turns(s, d)), _SOURCE, "/home/me")
)
query("project_kpis", f"""WITH p AS (SELECT coalesce(project, '(无项目)') AS name, CAST(sum(t.total) AS BIGINT) AS total FROM turns t LEFT JOIN sessions ON id = session_id WHERE has_usage GROUP BY 1), c AS (SELECT root, count(*) AS n FROM {_COMMITS} GROUP BY 1)
 SELECT (SELECT count(*) FROM p) AS projects, CAST((SELECT sum(total) FROM p) AS BIGINT) AS tokens, round((SELECT sum(total * 2.5::DOUBLE / 1e6::DOUBLE) FROM p), 4) AS cost, count(*) AS repos, CAST(sum(n) AS BIGINT) AS commits, count(*) FILTER (WHERE root <> 'lost') AS attributed, count(*) FILTER (WHERE root = 'lost') AS unattributed FROM c""")(
    lambda s, d: (lambda p: _round(A.project_kpis(p.withColumn("cost", F.col("total") * 2.5 / 1e6), Y.cost_per_commit(_commits(s, d), _repos(s), p, 2.5)), "cost"))(W.projects(V.turns(s, d), V.sessions(s, d)))
)

# --- sorts, drills and details

_COLUMNS = ("title", "turns", "total", "output", "burn", "updated_at")


def _session_table(spark: SparkSession, d: str) -> DataFrame:
    sums = W.session_sums(V.turns(spark, d), ("output", "total")).filter("turns_with_usage > 0")
    usage = V.sessions(spark, d).join(sums, F.col("id") == F.col("session_id"))
    days = F.greatest(F.lit(1), F.ceil((F.col("updated_at") - F.col("created_at")) / 86_400_000))
    return usage.select("id", "title", "turns", "total", "output", F.round(F.col("total") / days, 4).alias("burn"), "updated_at")


_SESSION_TABLE = "(SELECT b.id, title, n AS turns, b.total, b.output, round(b.total / greatest(1, CAST(ceil((updated_at - created_at) / 86400000.0::DOUBLE) AS BIGINT)), 4) AS burn, updated_at FROM (SELECT id, title, created_at, updated_at, CAST(sum(turns.total) AS BIGINT) AS total, CAST(sum(turns.output) AS BIGINT) AS output FROM sessions JOIN turns ON id = session_id AND has_usage GROUP BY 1, 2, 3, 4) b JOIN (SELECT session_id, count(*) AS n FROM turns GROUP BY 1) t ON t.session_id = b.id)"
for _column in _COLUMNS:
    for _down in (True, False):
        query(f"session_sort_{_column}_{'desc' if _down else 'asc'}", f"SELECT * FROM {_SESSION_TABLE} ORDER BY {_column} {'DESC' if _down else 'ASC'}, id")(lambda s, d, c=_column, down=_down: Y.sorted_by(_session_table(s, d), c, down, "id"))
def _model_places(spark: SparkSession, d: str) -> DataFrame:
    """Models are few."""
    totals = _model_agg(spark, d).select("key", (F.col("own_tokens") + F.col("ext_tokens")).alias("range_total"))
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("range_total"), "key")).cast("long"))


query("model_sort_range_total", f"SELECT key, own_tokens + ext_tokens AS range_total, row_number() OVER (ORDER BY own_tokens + ext_tokens DESC, key) AS place FROM {_MODEL_AGG}")(lambda s, d: _model_places(s, d))
query("project_drill_sessions", f"SELECT id, title, total, updated_at FROM {_BURN} WHERE project = 'BUILDING' ORDER BY updated_at DESC, id LIMIT 40")(
    # a list of forty
    lambda s, d: W.session_usage(V.turns(s, d), V.sessions(s, d)).filter("project = 'BUILDING'").orderBy(F.desc("updated_at"), "id").limit(40).select("id", "title", "total", "updated_at")
)
query("hours_of_a_day", "SELECT h, count(*) AS turns, CAST(sum(total) AS BIGINT) AS total FROM turns WHERE d = '1998-03-05' GROUP BY 1")(lambda s, d: W.hours(V.turns(s, d).filter(local_day(F.col("started_at")) == "1998-03-05")).select("h", "turns", "total"))
query("epoch_times", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || 'Z' WHEN user_id % 3 = 1 THEN 'at ' || event_id END AS ts FROM events")(
    lambda s, d: V.table(s, d, "events").select("event_id", I.time_text(F.when(F.col("user_id") % 3 == 0, (F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp"))) + F.col("event_id") % 1000).cast("string")).when(F.col("user_id") % 3 == 1, F.concat(F.lit("at "), "event_id")).otherwise(F.col("event_id").cast("string"))).alias("ts"))
)
_ADDED = I.Manifest.of({"id": "added", "paths": ["-"], "fields": {"model": ["message.model"], "input": ["message.usage.input_tokens"], "output": ["message.usage.output_tokens"], "reasoning": ["message.usage.thinking"]}, "outputAdd": ["message.usage.thinking"], "reasoningIsSubsetOfOutput": False, "where": {"type": "purchase"}, "require": ["message.usage.thinking"]})
query("output_add", "SELECT coalesce(model, '(unknown)') AS model, count(*) AS n, CAST(sum(output_tokens + thinking) AS BIGINT) AS output, CAST(sum(thinking) AS BIGINT) AS reasoning FROM raw_records WHERE type = 'purchase' AND has AND input_tokens + output_tokens + thinking <> 0 GROUP BY 1")(
    lambda s, d: I.normalized(I.decoded(V.raw_records(s, d)), _ADDED).filter("has_usage").groupBy("model").agg(F.count("*").alias("n"), F.sum("output").alias("output"), F.sum("reasoning").alias("reasoning"))
)


def _price_tables(spark: SparkSession, d: str) -> DataFrame:
    """Where each model's price comes from, and whether parts of that price are estimated: custom and manual prices have an input and an output price at most."""
    prices = V.prices(spark, d)
    catalogue, custom, manual = _override_tables(spark, d)
    chosen = R.overrides(catalogue, custom, manual)
    cache = prices.select(F.col("model_canon").alias("key"), "price_cache_read", "price_cache_write")
    own = F.col("via") == "catalogue"
    full = chosen.join(cache, "key").withColumns({c: F.when(own, F.col(c)) for c in ("price_cache_read", "price_cache_write")})
    return full.withColumns(normalized()).select("key", "via", "price_input", F.array_join("estimated", "|").alias("estimated"))


query("price_settings_roundtrip", f"SELECT key, price_input, CAST(NULL AS DOUBLE) AS price_output, CAST(NULL AS DOUBLE) AS price_cache_read, CAST(NULL AS DOUBLE) AS price_cache_write, 'inputprice' AS policy FROM ({_OVERRIDE_SQL}) WHERE via = 'manual'")(
    # written as one text and read back
    lambda s, d: (lambda text: exports.imported_settings(text)[0].crossJoin(exports.imported_settings(text)[1]))(exports.price_settings(_override_tables(s, d)[2], "inputprice"))
)
query("settings_counters", f"SELECT count(*) FILTER (WHERE priced) AS priced_models, count(*) AS models, (SELECT count(*) FROM ({_OVERRIDE_SQL}) WHERE via = 'manual') AS overrides, CAST(date_diff('day', DATE '2001-11-01', DATE '{NOW}') AS BIGINT) AS price_age_days FROM model_costs")(
    lambda s, d: C.settings_counters(_own_costs(s, d), _override_tables(s, d)[2], "2001-11-01", NOW)
)
query("freshness_chip", """SELECT CAST(125 AS BIGINT) AS minutes, 'hours' AS unit, CAST(2 AS BIGINT) AS count, CASE WHEN count(*) FILTER (WHERE last < TIMESTAMP '2024-01-31 00:05:00') > 0 THEN 'warn' ELSE 'ok' END AS tone, coalesce(string_agg(tool, '|' ORDER BY tool) FILTER (WHERE last < TIMESTAMP '2024-01-31 00:05:00'), '') AS stale
 FROM (SELECT tool, max(CAST(substr(ts, 1, 19) AS TIMESTAMP)) AS last FROM (SELECT * FROM external WHERE tool <> 'view' OR d < '2024-01-20') GROUP BY 1)""")(
    lambda s, d: C.freshness_chip(X.tool_totals(_ext(s, d).filter("tool <> 'view' or d < '2024-01-20'")).select(F.col("tool").alias("label"), "last_ts"), "2024-02-06 22:00", "2024-02-07 00:05").withColumn("stale", F.array_join("stale", "|"))
)
_OWN_PRICE = "via = 'catalogue' AND {} IS NOT NULL"
query("price_tables", f"""SELECT key, via, price_input, CASE WHEN price_input IS NULL THEN '' ELSE concat_ws('|', CASE WHEN NOT ({_OWN_PRICE.format('price_cache_read')}) THEN 'cache_read' END, CASE WHEN NOT ({_OWN_PRICE.format('price_cache_write')}) THEN 'cache_write' END, CASE WHEN price_output IS NULL THEN 'output' END) END AS estimated
 FROM ({_OVERRIDE_SQL}) JOIN (SELECT model_canon, price_cache_read, price_cache_write FROM prices) ON model_canon = key""")(_price_tables)
query("page_kpis_cost", f"SELECT round(sum(coalesce(unit, 0.0::DOUBLE) * own_tokens / 1e6::DOUBLE + ext_cost), 4) AS range_cost, count(*) FILTER (WHERE own_tokens > 0 AND priced) AS own_priced, count(*) FILTER (WHERE ext_tokens > 0 AND ext_cost > 0) AS ext_priced FROM {_MODEL_AGG} a LEFT JOIN model_units u USING (key)")(
    lambda s, d: _model_agg(s, d).join(_own_costs(s, d).select("key", "unit", "priced"), "key", "left").agg(F.round(F.sum(F.coalesce("unit", F.lit(0.0)) * F.col("own_tokens") / 1e6 + F.col("ext_cost")), 4).alias("range_cost"), F.count_if((F.col("own_tokens") > 0) & F.col("priced")).alias("own_priced"), F.count_if((F.col("ext_tokens") > 0) & (F.col("ext_cost") > 0)).alias("ext_priced"))
)
