"""Registered queries of the engine and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.functions import models as fm
from ledgerlark.functions.prices import normalized
from ledgerlark.operators import cost as C, external as X, ingest as I, resolve as R, sequences as S, warehouse as W
from ledgerlark.plans import views as V
from ledgerlark.plans.duck import canon, oracle
from ledgerlark.plans.kept import kept

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

NOW = "2001-11-10"
BUDGET = 5000.0


def query(name: str, sql: str | None = None):
    """Registers a query; sql may use the views of plans.duck."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = oracle(sql)
        return f

    return add


def _sql_sums(*names: str) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in names)


ALL = ("cache_read", "cache_write", "input", "output", "reasoning", "total")
FIVE = ("cache_read", "cache_write", "input", "output", "total")


def _ext(spark: SparkSession, d: str) -> DataFrame:
    return X.usage(V.external(spark, d))


def _base(spark: SparkSession, d: str) -> DataFrame:
    """Own usage by day and model."""
    return W.day_models(V.turns(spark, d))


def _own_costs(spark: SparkSession, d: str, policy: str = "ratio10", base: DataFrame | None = None) -> DataFrame:
    return C.model_cost(W.models_of(_base(spark, d) if base is None else base), V.prices(spark, d), policy)


def _own_day_cost(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    base = kept(_base(spark, d), "own") if base is None else base
    return C.daily_cost(W.day_model_of(base), _own_costs(spark, d, base=base))


def _own_days(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    return W.days_of(_base(spark, d) if base is None else base).filter("d <> ''")


def _ext_days(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    return X.by(_ext(spark, d) if base is None else base, "tool", "d")


def _ext_base(spark: SparkSession, d: str) -> DataFrame:
    """External usage by tool, day and model, after deduplication: one pass for all that a query asks of it."""
    return kept(X.by(_ext(spark, d), "tool", "d", "model"), "external")


def _ext_costs(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    return X.day_model_cost(_ext(spark, d) if base is None else base, V.external_prices(spark, d))


def _round(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


# --- warehouse aggregates

query("wh_totals", f"SELECT count(*) AS turns, count(*) FILTER (WHERE has_usage) AS turns_with_usage, {_sql_sums(*ALL)} FROM turns")(lambda s, d: W.totals(V.turns(s, d)))
query("wh_models", f"""SELECT model_canon AS key, count(*) AS turns, count(*) FILTER (WHERE NOT has_usage) AS missing_usage, {_sql_sums(*ALL)},
  string_agg(DISTINCT model_raw, '|' ORDER BY model_raw) AS raw_ids, min(CASE WHEN started_at > 0 THEN started_at END) AS first_ts, max(started_at) AS last_ts FROM turns GROUP BY 1""")(lambda s, d: W.models_of(_base(s, d)))
query("wh_model_raw", f"SELECT model_canon AS key, model_raw AS rid, count(*) AS turns, {_sql_sums(*ALL)} FROM turns GROUP BY 1, 2")(lambda s, d: W.model_raw(V.turns(s, d)))
query("wh_model_status", "SELECT model_canon AS key, coalesce(status, '') AS status, count(*) AS n FROM turns GROUP BY 1, 2")(lambda s, d: W.model_status(V.turns(s, d)))
query("wh_days", f"SELECT coalesce(d, '') AS d, count(*) AS turns, {_sql_sums(*ALL)} FROM turns GROUP BY 1")(lambda s, d: W.days(V.turns(s, d)))
query("wh_day_model", f"SELECT coalesce(d, '') AS d, model_canon AS key, count(*) AS turns, {_sql_sums('total', 'output')} FROM turns GROUP BY 1, 2")(lambda s, d: W.day_model_of(_base(s, d)))
query("wh_hours", f"SELECT h, count(*) AS turns, {_sql_sums(*FIVE)} FROM turns WHERE h IS NOT NULL GROUP BY 1")(lambda s, d: W.hours(V.turns(s, d)))
query("wh_projects", f"""SELECT coalesce(project, '(无项目)') AS name, count(DISTINCT session_id) AS sessions, count(*) AS turns, {_sql_sums(*ALL)}
  FROM turns LEFT JOIN sessions ON id = session_id WHERE has_usage GROUP BY 1""")(lambda s, d: W.projects(V.turns(s, d), V.sessions(s, d)))
query("wh_sessions", f"SELECT id, title, project, created_at, updated_at, {_sql_sums(*FIVE)} FROM sessions JOIN turns ON id = session_id AND has_usage GROUP BY 1, 2, 3, 4, 5")(lambda s, d: W.session_usage(V.turns(s, d), V.sessions(s, d)))
query("wh_top_sessions", f"SELECT id, title, project, created_at, updated_at, {_sql_sums(*FIVE)} FROM sessions JOIN turns ON id = session_id AND has_usage GROUP BY 1, 2, 3, 4, 5 ORDER BY sum(turns.total) DESC, id LIMIT 40")(
    lambda s, d: W.top_sessions(W.session_usage(V.turns(s, d), V.sessions(s, d)))
)
query("wh_session_counts", """SELECT s.id, (SELECT count(*) FROM turns t WHERE t.session_id = s.id) AS turns, (SELECT count(*) FROM orders o WHERE 's' || (o.o_orderkey // 3) = s.id) AS messages FROM sessions s""")(
    lambda s, d: W.session_counts(V.turns(s, d), V.sessions(s, d), V.table(s, d, "orders").select(F.concat(F.lit("s"), F.expr("o_orderkey div 3")).alias("session_id")))
)
query("wh_roles", "SELECT role AS name, count(*) AS n, count(*) FILTER (WHERE length(text) > 500) AS errors FROM conversations GROUP BY 1")(lambda s, d: W.counted(V.table(s, d, "conversations"), "role", F.length("text") > 500))
query("wh_tools", "SELECT event_type AS name, count(*) AS n, count(*) FILTER (WHERE value > 60) AS errors FROM events WHERE coalesce(event_type, '') <> '' GROUP BY 1")(lambda s, d: W.counted(V.table(s, d, "events"), "event_type", F.col("value") > 60))
query("counts_merge", """SELECT name, CAST(sum(n) AS BIGINT) AS n, CAST(sum(errors) AS BIGINT) AS errors FROM (SELECT role AS name, count(*) AS n, count(*) FILTER (WHERE length(text) > 500) AS errors FROM conversations GROUP BY 1
  UNION ALL SELECT CASE event_type WHEN 'click' THEN 'user' ELSE event_type END, count(*), count(*) FILTER (WHERE value > 60) FROM events GROUP BY 1) GROUP BY 1""")(
    lambda s, d: W.merge_counts(W.counted(V.table(s, d, "conversations"), "role", F.length("text") > 500), W.counted(V.table(s, d, "events").withColumn("n_", F.when(F.col("event_type") == "click", "user").otherwise(F.col("event_type"))), "n_", F.col("value") > 60))
)
query("wh_range", "SELECT min(CASE WHEN started_at > 0 THEN started_at END) AS first_ts, max(started_at) AS last_ts FROM turns")(lambda s, d: W.time_range(V.turns(s, d)))
query("wh_counts", "SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(DISTINCT project) FROM sessions) AS projects")(lambda s, d: V.sessions(s, d).agg(F.count("*").alias("sessions"), F.count_distinct("project").alias("projects")))
query("wh_cache_hit", "SELECT floor(100.0::DOUBLE * sum(cache_read) / greatest(1, sum(cache_read) + sum(cache_write) + sum(input)) * 10 + 0.5::DOUBLE) / 10 AS cache_hit_pct FROM turns")(lambda s, d: W.cache_hit(W.totals(V.turns(s, d))))
query("quality_checks", """SELECT 'total_is_sum' AS check_name, count(*) FILTER (WHERE total <> cache_read + cache_write + input + output) AS violations FROM turns UNION ALL SELECT 'time_known', count(*) FILTER (WHERE started_at IS NULL OR started_at <= 0) FROM turns
  UNION ALL SELECT 'sums_agree', CAST(sum(cache_read + cache_write + input + output) - sum(total) AS BIGINT) FROM turns UNION ALL SELECT 'no_orphans', count(*) FROM turns WHERE session_id NOT IN (SELECT id FROM sessions)""")(lambda s, d: W.quality_checks(V.turns(s, d), V.sessions(s, d)))
query("anti_known_sessions", "SELECT tool, count(*) AS turns FROM turns WHERE tool = 'pi-cli' AND session_id NOT IN (SELECT session_id FROM turns WHERE tool = 'pi') GROUP BY 1")(
    lambda s, d: W.known_sessions_removed(V.turns(s, d).filter("tool = 'pi-cli'"), V.turns(s, d).filter("tool = 'pi'").select(F.col("session_id").alias("id"))).groupBy("tool").agg(F.count("*").alias("turns"))
)
query("upsert_last_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")(
    lambda s, d: W.last_wins(V.table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
)
query("cli_stats", """SELECT 'sessions' AS k, count(DISTINCT session_id) AS v FROM turns WHERE tool = 'pi-cli' UNION ALL SELECT 'turns', count(*) FROM turns WHERE tool = 'pi-cli'
  UNION ALL SELECT 'skipped_empty', count(*) FROM turns WHERE tool = 'pi-cli' AND NOT has_usage UNION ALL SELECT 'token_total', CAST(sum(total) AS BIGINT) FROM turns WHERE tool = 'pi-cli'""")(
    lambda s, d: V.turns(s, d).filter("tool = 'pi-cli'").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"), F.count_if(~F.col("has_usage")).alias("skipped_empty"), F.sum("total").alias("token_total")).unpivot([], ["sessions", "turns", "skipped_empty", "token_total"], "k", "v")
)
query("meta_pivot", "SELECT max(ts) FILTER (WHERE event_type = 'click') AS click, max(ts) FILTER (WHERE event_type = 'error') AS error FROM (SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM events)")(
    lambda s, d: V.table(s, d, "events").groupBy().pivot("event_type", ["click", "error"]).agg(F.max(F.date_format("ts", "yyyy-MM-dd HH:mm")))
)
query("project_paths", "SELECT c_mktsegment AS name, max(c_name) AS path FROM customer WHERE coalesce(c_mktsegment, '') <> '' GROUP BY 1")(lambda s, d: W.last_wins(V.table(s, d, "customer").filter("coalesce(c_mktsegment, '') <> ''").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("path"), F.col("c_name").alias("o")), "name", "o").drop("o"))
query("repo_groups", "SELECT n_regionkey AS root, min(n_name) AS name, coalesce(string_agg(n_name, '|' ORDER BY n_name) FILTER (WHERE n_name <> m), '') AS also FROM (SELECT *, min(n_name) OVER (PARTITION BY n_regionkey) AS m FROM nation) GROUP BY 1")(
    lambda s, d: V.table(s, d, "nation").groupBy(F.col("n_regionkey").alias("root")).agg(F.min("n_name").alias("name"), F.array_sort(F.collect_set("n_name")).alias("all")).select("root", "name", F.array_join(F.array_remove("all", F.col("name")), "|").alias("also"))
)

# --- scalar functions

query("canon_models", f"SELECT DISTINCT raw, {canon('raw')} AS canon FROM (SELECT model_raw AS raw FROM turns UNION ALL SELECT 'OpenAI/' || upper(model_raw) || '-preview' FROM turns UNION ALL SELECT '')")(
    lambda s, d: V.turns(s, d).select(F.explode(F.array("model_raw", F.concat(F.lit("OpenAI/"), F.upper("model_raw"), F.lit("-preview")), F.lit(""))).alias("raw")).distinct().select("raw", fm.canonical_model(F.col("raw")).alias("canon"))
)
query("project_names", "SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(replace(url, chr(92), '/'), '/+$', ''), '([^/]*)$', 1), ''), '(无项目)') AS project FROM pages")(lambda s, d: V.table(s, d, "pages").select("page_id", fm.project_name(F.col("url")).alias("project")))
query("status_map", "SELECT event_type, CASE WHEN event_type IN ('error', 'failed', 'refusal') THEN 'error' WHEN event_type IN ('aborted', 'abort') THEN 'aborted' ELSE 'completed' END AS status, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda s, d: V.table(s, d, "events").groupBy("event_type", fm.status_for(F.col("event_type")).alias("status")).agg(F.count("*").alias("n"))
)
query("iso_millis", "SELECT tool, CAST(sum(epoch_ms(CAST(replace(ts, 'Z', '') AS TIMESTAMP))) AS BIGINT) AS ms FROM external_raw GROUP BY 1")(lambda s, d: V.external(s, d).groupBy("tool").agg(F.sum(fm.iso_millis(F.col("ts"))).alias("ms")))
query("redact_paths", "SELECT page_id, CASE WHEN lower(url) = 'https://www' OR starts_with(lower(url), 'http:/') THEN '~' || substr(url, 6) ELSE url END AS shown FROM pages")(lambda s, d: V.table(s, d, "pages").select("page_id", fm.redact_home(F.col("url"), "HTTP:").alias("shown")))

# --- ingest

_MANIFEST = I.Manifest.of(
    {
        "id": "events", "prefilter": ['"usage"', '"click"'], "require": ["message.usage"], "dedup": ["message.id"], "paths": ["-"],
        "fields": {"model": ["message.model", "type"], "session": ["sessionId", "$dir"], "time": ["timestamp"], "input": ["message.usage.input_tokens"], "cacheRead": ["message.usage.cached"], "output": ["message.usage.output_tokens"], "reasoning": ["message.usage.thinking"]},
        "inputSubtract": ["message.usage.cached"],
    }
)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return I.decoded(I.prefiltered(V.raw_records(spark, d), _MANIFEST.prefilter))


_NORMAL = """(SELECT file, line, 'events:' || id AS dedup_key, coalesce(model, type) AS model, 'dir' AS session, timestamp AS ts, greatest(input_tokens - cached, 0) AS input, cached AS cache_read, output_tokens AS output, least(thinking, output_tokens) AS reasoning,
  greatest(input_tokens - cached, 0) + cached + output_tokens > 0 AS has_usage FROM raw_records WHERE has)"""
query("prefilter_scan", "SELECT type, count(*) AS n FROM raw_records WHERE has OR type = 'click' GROUP BY 1")(lambda s, d: _records(s, d).groupBy(I.dig(F.col("obj"), "type").alias("type")).agg(F.count("*").alias("n")))
query("require_where", "SELECT file, count(*) AS n FROM raw_records WHERE has AND type = 'view' GROUP BY 1")(lambda s, d: I.decoded(V.raw_records(s, d)).filter(I.required(I.Manifest("x", require=("message.usage",), where={"type": "view"}), F.col("obj"))).groupBy("file").agg(F.count("*").alias("n")))
query("first_of_paths", "SELECT coalesce(model, type) AS model, count(*) AS n, CAST(sum(coalesce(thinking, 0)) AS BIGINT) AS thinking FROM raw_records GROUP BY 1")(
    lambda s, d: I.decoded(V.raw_records(s, d)).groupBy(I.first_of(F.col("obj"), ("message.model", "type")).alias("model")).agg(F.count("*").alias("n"), F.sum(I.to_int(I.first_of(F.col("obj"), ("message.usage.thinking",)))).alias("thinking"))
)
query("normalize_records", f"SELECT 'events' AS tool, file, line, dedup_key, model, session, ts, input, cache_read, CAST(0 AS BIGINT) AS cache_write, output, reasoning FROM {_NORMAL} WHERE has_usage")(lambda s, d: I.normalized(_records(s, d), _MANIFEST).filter("has_usage").drop("has_usage"))
query("dedup_manifest", f"""SELECT model, count(*) AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(output) AS BIGINT) AS output FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY file, line) AS rn FROM
  (SELECT r.file, r.line, 'events:' || r.id AS k, n.model, n.input, n.cache_read, n.output, coalesce(n.has_usage, false) AS has_usage FROM raw_records r LEFT JOIN {_NORMAL} n ON n.line = r.line WHERE r.has OR r.type = 'click')) WHERE rn = 1 AND has_usage GROUP BY 1""")(
    lambda s, d: I.deduplicated(I.normalized(_records(s, d), _MANIFEST)).groupBy("model").agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.sum("cache_read").alias("cache_read"), F.sum("output").alias("output"))
)
query("dedup_first", "SELECT tool, count(*) AS records, count(DISTINCT dedup_key) AS kept, count(*) - count(DISTINCT dedup_key) AS dropped FROM external_raw GROUP BY 1")(lambda s, d: X.dropped(V.external(s, d)))
query("file_claim", "SELECT path, min_by(tool, rank * 1000 + ascii(tool)) AS owner, coalesce(string_agg(DISTINCT tool, '|' ORDER BY tool) FILTER (WHERE tool <> own), '') AS losers FROM (SELECT *, min_by(tool, rank * 1000 + ascii(tool)) OVER (PARTITION BY path) AS own FROM (SELECT 'p' || (user_id % 40) AS path, event_type AS tool, length(event_type) AS rank FROM events)) GROUP BY 1")(
    lambda s, d: I.claimed(V.table(s, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 40).alias("path"), F.col("event_type").alias("tool"), F.length("event_type").alias("rank")))
)


def _nested(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "conversations")
    items = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("type"), F.length("text").alias("tokens"))))
    doc = c.groupBy("conv_id").agg(items.alias("messages")).select(F.concat(F.lit("c"), "conv_id").alias("file"), F.lit("").alias("dir"), F.col("conv_id").alias("line"), F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.lit("m").alias("model"), "messages")).alias("value"))
    return I.flattened(I.decoded(doc), "messages")


query("json_rows_flatten", "SELECT conv_id * 1000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS line, 's' || conv_id AS session, 'm' AS model, role AS type, CAST(length(text) AS BIGINT) AS tokens FROM conversations")(
    lambda s, d: _nested(s, d).select("line", I.dig(F.col("obj"), "sessionId").alias("session"), I.dig(F.col("obj"), "model").alias("model"), I.dig(F.col("obj"), "type").alias("type"), I.dig(F.col("obj"), "tokens", "bigint").alias("tokens"))
)
query("tool_cube", f"SELECT tool, count(*) AS calls, count(DISTINCT session) AS sessions, {_sql_sums(*FIVE)}, min(ts) AS first_ts, max(ts) AS last_ts FROM external GROUP BY 1")(lambda s, d: X.tool_totals(_ext(s, d)))
query("tool_cube_grouping_sets", f"SELECT tool, model, d, h, CAST(grouping_id(tool, model, d, h) AS BIGINT) AS level, count(*) AS calls, {_sql_sums(*FIVE)} FROM external GROUP BY GROUPING SETS ((tool), (tool, model), (tool, d), (tool, d, model), (tool, h))")(lambda s, d: X.cube(_ext(s, d)))

# --- sequences

query("cumulative_delta", """SELECT model, day, count(*) AS n, CAST(sum(delta) AS BIGINT) AS delta, count(*) FILTER (WHERE reset) AS resets, count(*) FILTER (WHERE parked) AS parked FROM (SELECT day, coalesce(carried, first_model, '(unknown)') AS model, carried IS NULL AS parked,
  CASE WHEN prev IS NULL THEN total WHEN total >= prev THEN total - prev ELSE last END AS delta, coalesce(total < prev, false) AS reset FROM (SELECT *, lag(total) OVER (PARTITION BY file ORDER BY line) AS prev,
  last_value(context_model IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS carried, first_value(context_model IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_model FROM counters)) GROUP BY 1, 2""")(
    lambda s, d: S.counter_deltas(V.counters(s, d)).groupBy("model", "day").agg(F.count("*").alias("n"), F.sum("delta").alias("delta"), F.count_if("reset").alias("resets"), F.count_if("parked").alias("parked"))
)
query("session_fold", """SELECT stem, turn_no, count(*) AS messages, CAST(sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS output, CAST(sum(CASE WHEN role <> 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS input, max(CASE WHEN role = 'assistant' THEN turn END) AS last_ord, bool_or(role = 'assistant') AS has_usage
  FROM (SELECT 'c' || conv_id AS stem, turn, role, length(text) AS tokens, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM conversations) GROUP BY 1, 2""")(lambda s, d: S.fold_turns(V.conversation_records(s, d)))
# --- prices and costs

query("price_policy", "SELECT model_canon, unit_input, unit_cache_read, unit_cache_write, unit_output, price_input IS NOT NULL AS price_ok, CASE WHEN price_input IS NULL THEN '' ELSE concat_ws('|', CASE WHEN price_cache_read IS NULL THEN 'cache_read' END, CASE WHEN price_cache_write IS NULL THEN 'cache_write' END, CASE WHEN price_output IS NULL THEN 'output' END) END AS estimated FROM units")(
    lambda s, d: V.prices(s, d).withColumns(normalized()).select("model_canon", "unit_input", "unit_cache_read", "unit_cache_write", "unit_output", "price_ok", F.array_join("estimated", "|").alias("estimated"))
)
query("model_cost", "SELECT key, total, round(cost, 4) AS cost, priced, round(unit, 4) AS unit FROM model_units")(lambda s, d: _round(_own_costs(s, d).select("key", "total", "cost", "priced", "unit"), "cost", "unit"))
query("compute_all", "SELECT key, total, round(cost, 4) AS cost, priced, round(unit, 4) AS unit, round(total / sum(total) OVER () * 100, 4) AS share, round(cost / sum(cost) OVER () * 100, 4) AS cost_share FROM model_units")(lambda s, d: _round(C.shares(_own_costs(s, d)), "cost", "unit", "share", "cost_share"))
query("cost_coverage", "SELECT CAST(sum(total) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, CAST(sum(CASE WHEN NOT priced THEN total ELSE 0 END) AS BIGINT) AS unpriced_tokens, round((sum(total) - sum(CASE WHEN NOT priced THEN total ELSE 0 END)) / sum(total) * 100, 4) AS coverage, count(*) FILTER (WHERE NOT priced AND total > 0) AS unpriced_models FROM model_units")(
    lambda s, d: _round(C.coverage(_own_costs(s, d)), "cost", "coverage")
)
query("daily_cost", "SELECT d, round(cost, 4) AS cost FROM day_cost")(lambda s, d: _round(_own_day_cost(s, d), "cost"))
query("policy_sensitivity", "SELECT bool_or(cache_write > 0 AND price_input IS NOT NULL AND price_cache_write IS NULL) AS write_matters, bool_or(cache_read > 0 AND price_input IS NOT NULL AND price_cache_read IS NULL) AS read_matters FROM model_sums JOIN prices ON model_canon = key")(
    lambda s, d: _own_costs(s, d).agg(F.bool_or((F.col("cache_write") > 0) & F.array_contains("estimated", "cache_write")).alias("write_matters"), F.bool_or((F.col("cache_read") > 0) & F.array_contains("estimated", "cache_read")).alias("read_matters"))
)


def _override_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = V.prices(spark, d).select(F.col("model_canon").alias("key"), "price_input", "price_output")
    n = F.regexp_extract("key", "([0-9]+)$", 1).cast("long")
    return p, p.filter(n % 4 == 0).select("key", F.lit(1.5).alias("price_input"), F.lit(3.0).alias("price_output")), p.filter(n % 6 == 0).select("key", F.lit(9.0).alias("price_input"), F.lit(None).cast("double").alias("price_output"))


_OVERRIDE_SQL = """SELECT model_canon AS key, CASE WHEN n % 6 = 0 THEN 9.0::DOUBLE WHEN n % 4 = 0 THEN 1.5::DOUBLE ELSE price_input END AS price_input, CASE WHEN n % 4 = 0 THEN 3.0::DOUBLE ELSE price_output END AS price_output,
  CASE WHEN n % 6 = 0 THEN 'manual' WHEN n % 4 = 0 THEN 'custom' WHEN price_input IS NOT NULL THEN 'catalogue' ELSE 'missing' END AS via FROM (SELECT *, CAST(regexp_extract(model_canon, '([0-9]+)$', 1) AS BIGINT) AS n FROM prices)"""
query("override_precedence", _OVERRIDE_SQL)(lambda s, d: R.overrides(*_override_tables(s, d)))
query("price_provenance", f"SELECT via, count(*) AS models FROM ({_OVERRIDE_SQL}) GROUP BY 1")(lambda s, d: R.overrides(*_override_tables(s, d)).groupBy("via").agg(F.count("*").alias("models")))

# --- price resolution


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return V.turns(spark, d).select(F.col("model_raw").alias("model"))


def _price_targets(spark: SparkSession, d: str) -> DataFrame:
    return V.prices(spark, d).select(F.col("model_canon").alias("target"), F.array(F.concat(F.lit("Kimi/"), "model_canon")).alias("aliases"), "price_input")


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Each brand at a relay, at kimi, and at a maker that the others name as origin; an aggregator lists all."""
    n = F.regexp_extract("model_canon", "([0-9]+)$", 1).cast("long")
    p = V.prices(spark, d).withColumn("n", n)
    maker = F.concat(F.lit("maker/"), "model_canon")
    row = lambda provider, name, origin, price: F.struct(F.lit(provider).alias("provider"), F.concat(F.lit(f"{provider}/"), name).alias("full_id"), name.alias("model"), origin.alias("canonical_id"), price.alias("price_input"))
    m, none, text = F.col("model_canon"), F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = F.array(
        row("maker", m, text, F.when(n % 2 == 0, F.col("price_input"))),
        row("kimi", m, F.when(n % 3 == 0, maker), n * F.lit(1.0)),
        row("alpha", m, text, none),
        row("openrouter", F.concat(F.lit("maker/"), m), text, n * F.lit(2.0)),
    )
    return p.select(F.explode(F.filter(rows, lambda r: ~((r["provider"] == "kimi") & (n % 5 == 0)))).alias("r")).select("r.*")


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """The ids of turns, and some with paths, brackets, dates and levels of effort."""
    n = F.col("p_partkey")
    ends = F.array(*map(F.lit, ("(beta)", "--int-260731", "-ga_2607", "--X-High", "-thinking-high(2)", "-int")))
    odd = F.concat(F.when(n % 3 == 0, "vertex-").when(n % 3 == 1, "a/B/").otherwise(""), F.lower("p_brand"), F.element_at(ends, (n % 6 + 1).cast("int")))
    return _ids(spark, d).unionByName(V.table(spark, d, "part").select(odd.alias("model")))


_PEEL = lambda p: f"list_concat(f, list_filter(list_transform(f, lambda k: regexp_replace(k, '{p}', '')), lambda k: k <> ''))"
_LADDER = "".join(f", p{k + 1} AS (SELECT model, {_PEEL(p)} AS f FROM p{k})" for k, p in enumerate(("--?int$", "--?ga[-_]?[0-9]{4,6}$", "-[0-9]{6}$", "\\([^)]*\\)$", "(?i)-+(?:x-?high|x-?low|efficiency|think(?:ing)?-high)$")))
# steps keep duplicates; the first place of a key is what counts


def _ladder_sql(ids: str) -> str:
    """e: model, candidate and i, its first place; ids has the models."""
    prefixed = " ".join(f"WHEN starts_with(model, '{p}') THEN '{p[:-1]}/' || substr(model, {len(p) + 1})" for p in R.DASH_PREFIXES)
    return f"""WITH ids AS ({ids}),
 p0 AS (SELECT model, list_filter([model, CASE {prefixed} END], lambda k: k IS NOT NULL) AS f FROM ids){_LADDER},
 t AS (SELECT model, list_concat(f, list_filter(flatten(list_transform(list_filter(f, lambda k: contains(k, '/')), lambda k: [substr(k, instr(k, '/') + 1), string_split(k, '/')[-1]])), lambda k: k <> '')) AS f FROM p5),
 g AS (SELECT model, list_concat(f, list_filter(flatten(list_transform(f, lambda k: list_transform({list(R.PROVIDER_PATHS)}, lambda p: p || string_split(k, '/')[-1]))), lambda k: k <> '')) AS f FROM t),
 e AS (SELECT model, candidate, min(i) AS i FROM (SELECT model, unnest(f) AS candidate, unnest(range(len(f))) AS i FROM g) GROUP BY 1, 2)"""


_ODD_IDS = "SELECT DISTINCT model FROM (SELECT model_raw AS model FROM turns UNION ALL SELECT (CASE p_partkey % 3 WHEN 0 THEN 'vertex-' WHEN 1 THEN 'a/B/' ELSE '' END) || lower(p_brand) || ['(beta)', '--int-260731', '-ga_2607', '--X-High', '-thinking-high(2)', '-int'][p_partkey % 6 + 1] FROM part)"
query("key_variants", f"{_ladder_sql(_ODD_IDS)} SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY i) - 1 AS INTEGER) AS pos, candidate FROM e")(lambda s, d: R.candidates(_variants(s, d)))
query("price_alias_match", f"""{_ladder_sql("SELECT DISTINCT model_raw AS model FROM turns")}, a AS (SELECT lower(alias) AS alias, min(target) AS target FROM (SELECT model_canon AS target, unnest([model_canon, string_split(model_canon, '/')[-1], 'Kimi/' || model_canon]) AS alias FROM prices) GROUP BY 1)
 SELECT model, arg_min(target, i) AS target FROM e JOIN a ON alias = lower(candidate) GROUP BY 1""")(lambda s, d: R.match_prices(_ids(s, d), _price_targets(s, d)).select("model", "target"))
query("price_models", "SELECT DISTINCT model_raw AS model, CASE WHEN price_input IS NOT NULL THEN t.model_canon END AS target, CASE WHEN price_input IS NOT NULL THEN 'catalogue' ELSE 'unpriced' END AS via, price_input FROM turns t JOIN prices p ON p.model_canon = t.model_canon")(lambda s, d: R.price_models(_ids(s, d), _price_targets(s, d)))
_CATALOGUE_SQL = """cat AS (SELECT 'maker/' || model_canon AS full_id, 'maker' AS provider, model_canon, CASE WHEN n % 2 = 0 THEN price_input END AS price, n % 3 = 0 AND n % 5 <> 0 AS lab, n FROM (SELECT *, CAST(regexp_extract(model_canon, '([0-9]+)$', 1) AS BIGINT) AS n FROM prices)
  UNION ALL SELECT 'kimi/' || model_canon, 'kimi', model_canon, n * 1.0::DOUBLE, false, n FROM (SELECT *, CAST(regexp_extract(model_canon, '([0-9]+)$', 1) AS BIGINT) AS n FROM prices) WHERE n % 5 <> 0
  UNION ALL SELECT 'openrouter/maker/' || model_canon, 'openrouter', model_canon, n * 2.0::DOUBLE, false, n FROM (SELECT *, CAST(regexp_extract(model_canon, '([0-9]+)$', 1) AS BIGINT) AS n FROM prices)),
ids AS (SELECT DISTINCT model_raw AS model, model_canon FROM turns)"""
query("catalogue_resolve", f"""WITH {_CATALOGUE_SQL} SELECT model, full_id, true AS priced FROM (SELECT model, full_id, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN contains(lower(model), provider || '/') OR starts_with(lower(model), provider || '-') THEN 400 WHEN lab THEN 300 WHEN provider = 'openrouter' THEN 50 ELSE 100 END DESC, full_id) AS rn
  FROM ids JOIN cat USING (model_canon) WHERE price IS NOT NULL) WHERE rn = 1""")(lambda s, d: R.resolve(_ids(s, d), _catalogue(s, d)))
query("proven_publishers", "SELECT 'maker/' || model_canon AS full_id FROM (SELECT *, CAST(regexp_extract(model_canon, '([0-9]+)$', 1) AS BIGINT) AS n FROM prices) WHERE n % 3 = 0 AND n % 5 <> 0")(lambda s, d: R.publishers(_catalogue(s, d)))
query("price_table_build", f"""WITH {_CATALOGUE_SQL}, best AS (SELECT model, full_id, provider FROM (SELECT model, full_id, provider, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN contains(lower(model), provider || '/') OR starts_with(lower(model), provider || '-') THEN 400 WHEN lab THEN 300 WHEN provider = 'openrouter' THEN 50 ELSE 100 END DESC, full_id) AS rn FROM ids JOIN cat USING (model_canon) WHERE price IS NOT NULL) WHERE rn = 1),
 g AS (SELECT full_id, provider, regexp_extract(full_id, '([^/]*)$', 1) AS leaf, string_agg(model, '|' ORDER BY model) AS ids, count(*) AS n, bool_or(model = full_id) AS exact FROM best GROUP BY 1, 2, 3)
 SELECT CASE WHEN count(*) OVER (PARTITION BY leaf) > 1 AND provider <> min(provider) OVER (PARTITION BY leaf) THEN leaf || '@' || provider ELSE leaf END AS target, full_id, ids, n, CASE WHEN exact THEN 'exact' ELSE 'normalised' END AS match FROM g""")(
    lambda s, d: R.price_table(R.resolve(_ids(s, d), _catalogue(s, d)), _catalogue(s, d))
)
query("observed_ids", "SELECT model, min_by(origin, p) AS origin FROM (SELECT 'brand-1' AS model, 'list' AS origin, 0 AS p UNION ALL SELECT DISTINCT model, 'external', 1 FROM external UNION ALL SELECT DISTINCT model_raw, 'pi', 2 FROM turns) GROUP BY 1")(
    lambda s, d: s.range(1).select(F.lit("brand-1").alias("model"), F.lit("list").alias("origin"), F.lit(0).alias("p")).unionByName(_ext(s, d).select("model", F.lit("external").alias("origin"), F.lit(1).alias("p")).distinct()).unionByName(_ids(s, d).select("model", F.lit("pi").alias("origin"), F.lit(2).alias("p")).distinct()).groupBy("model").agg(F.min_by("origin", "p").alias("origin"))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per day."""
    return _own_day_cost(spark, sf_dir)


def queries() -> dict[str, Query]:
    from ledgerlark.plans import registry_collect, registry_payload, registry_ranges, registry_sources  # noqa: F401  register the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from ledgerlark.plans import registry_collect, registry_payload, registry_ranges, registry_sources  # noqa: F401

    return dict(_ORACLES)
