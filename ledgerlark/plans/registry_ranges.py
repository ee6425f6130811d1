"""Registered queries on ranges of days, external costs and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.functions import format as fmt, models as fm
from ledgerlark.operators import compare, cost as C, exports, external as X, resolve as R, rollups as Y, warehouse as W
from ledgerlark.plans import views as V
from ledgerlark.plans.kept import kept
from ledgerlark.plans.numbering import placed
from ledgerlark.plans.registry import ALL, BUDGET, FIVE, NOW, _base, _catalogue, _ext_base, _ext, _ext_costs, _ext_days, _ids, _own_costs, _own_day_cost, _own_days, _round, _sql_sums, query


def _anchor(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    return C.anchor(_own_days(spark, d, base))


def _ext_anchor(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    return C.anchor(_ext_days(spark, d, base))


def _stats(spark: SparkSession, d: str, key: str, base: DataFrame | None = None) -> DataFrame:
    base = kept(_base(spark, d), "own") if base is None else base
    return C.range_stats(_own_days(spark, d, base), _own_day_cost(spark, d, base), key, _anchor(spark, d, base))


def _insights(spark: SparkSession, d: str) -> DataFrame:
    base = kept(_base(spark, d), "own")
    return C.range_insights(_stats(spark, d, "30d", base), W.day_model_of(base), _own_costs(spark, d, base=base))


_FROM = {"7d": "strftime(CAST((SELECT max(d) FROM {t}) AS DATE) - INTERVAL 6 DAY, '%Y-%m-%d')", "30d": "strftime(CAST((SELECT max(d) FROM {t}) AS DATE) - INTERVAL 29 DAY, '%Y-%m-%d')", "all": "''"}


def _stats_sql(key: str) -> str:
    return f"""rng AS (SELECT s.*, coalesce(c.cost, 0.0::DOUBLE) AS cost FROM day_sums s LEFT JOIN day_cost c USING (d) WHERE s.d >= {_FROM[key].format(t='day_sums')}),
stats AS (SELECT count(*) AS day_count, CAST(sum(total) AS BIGINT) AS tokens, sum(cost) AS cost, avg(cost) AS avg_cost, min(cost) AS min_cost, max(cost) AS max_cost,
  (SELECT d FROM rng ORDER BY cost, d LIMIT 1) AS min_day, (SELECT d FROM rng ORDER BY cost DESC, d LIMIT 1) AS max_day, floor(1000.0::DOUBLE * sum(cache_read) / sum(cache_read + cache_write + input) + 0.5::DOUBLE) / 10 AS cache_hit_pct FROM rng)"""


for _key in ("7d", "30d", "all"):
    query(
        "range_stats" if _key == "30d" else f"range_stats_{_key}",
        f"WITH {_stats_sql(_key)} SELECT day_count, tokens, round(cost, 4) AS cost, round(avg_cost, 4) AS avg_cost, round(min_cost, 4) AS min_cost, round(max_cost, 4) AS max_cost, min_day, max_day, cache_hit_pct FROM stats",
    )(lambda s, d, k=_key: _round(_stats(s, d, k), "cost", "avg_cost", "min_cost", "max_cost"))

query("range_insights", f"""WITH {_stats_sql('30d')}, best AS (SELECT key, unit * m.total / 1e6::DOUBLE AS c FROM day_model m JOIN model_units u USING (key) WHERE d = (SELECT max_day FROM stats) AND unit * m.total > 0)
 SELECT max_day AS peak_day, round(max_cost, 4) AS peak_day_cost, (SELECT key FROM best ORDER BY c DESC, key DESC LIMIT 1) AS peak_model, round((SELECT max(c) FROM best), 4) AS peak_model_cost, round(avg_cost, 4) AS avg_burn, round(avg_cost * 30, 4) AS forecast30, cache_hit_pct, day_count FROM stats""")(
    lambda s, d: _round(_insights(s, d), "peak_day_cost", "peak_model_cost", "avg_burn", "forecast30")
)
_MONTH = f"(SELECT coalesce(sum(cost), 0.0::DOUBLE) AS month_cost, count(*) AS days FROM day_cost WHERE d BETWEEN '{NOW[:8]}01' AND '{NOW}')"
query("month_to_date", f"SELECT round(month_cost, 4) AS month_cost, days FROM {_MONTH}")(lambda s, d: _round(C.month_to_date(_own_day_cost(s, d), NOW), "month_cost"))
query("budget_tier", f"SELECT round(month_cost, 4) AS month_cost, round(month_cost / {BUDGET}::DOUBLE * 100, 4) AS used_pct, CASE WHEN month_cost / {BUDGET}::DOUBLE * 100 >= 95 THEN 'critical' WHEN month_cost / {BUDGET}::DOUBLE * 100 >= 80 THEN 'warning' WHEN month_cost / {BUDGET}::DOUBLE * 100 >= 50 THEN 'notice' ELSE 'ok' END AS tier FROM {_MONTH}")(
    lambda s, d: _round(C.budget_tier(C.month_to_date(_own_day_cost(s, d), NOW), BUDGET), "month_cost", "used_pct")
)
query("waste_hints", f"WITH {_stats_sql('all')} SELECT concat_ws('|', CASE WHEN cache_hit_pct < 20 THEN 'low_cache_hit' END, CASE WHEN max_cost > 3 * avg_cost THEN 'peak_day' END, CASE WHEN (SELECT count(*) FROM model_costs WHERE NOT priced AND total > 0) > 0 THEN 'unpriced_models' END) AS hints FROM stats")(
    lambda s, d: C.waste_hints(_stats(s, d, "all"), C.coverage(_own_costs(s, d)))
)
_BURN = "(SELECT *, greatest(1, CAST(ceil((updated_at - created_at) / 86400000.0::DOUBLE) AS BIGINT)) AS days FROM (SELECT id, title, project, created_at, updated_at, CAST(sum(turns.total) AS BIGINT) AS total FROM sessions JOIN turns ON id = session_id AND has_usage GROUP BY 1, 2, 3, 4, 5))"
query("session_burn", f"SELECT id, total, days, round(total / days, 4) AS tokens_per_day, round(total / days * 2.5::DOUBLE / 1e6::DOUBLE, 8) AS cost_per_day FROM {_BURN}")(
    lambda s, d: C.session_burn(W.session_usage(V.turns(s, d), V.sessions(s, d)), 2.5).withColumns({"tokens_per_day": F.round("tokens_per_day", 4), "cost_per_day": F.round("cost_per_day", 8)})
)
query("session_search", f"SELECT id, title, project, total FROM {_BURN} WHERE contains(lower(title), 'urg') OR contains(lower(coalesce(project, '')), 'urg') OR contains(lower(id), 'urg')")(lambda s, d: C.session_search(W.session_usage(V.turns(s, d), V.sessions(s, d)), "URG").select("id", "title", "project", "total"))
query("session_kpis", f"SELECT count(*) AS sessions, CAST(sum(total) AS BIGINT) AS tokens, round(sum(total / days * 2.5::DOUBLE / 1e6::DOUBLE), 4) AS cost_per_day FROM {_BURN}")(
    lambda s, d: C.session_burn(W.session_usage(V.turns(s, d), V.sessions(s, d)), 2.5).agg(F.count("*").alias("sessions"), F.sum("total").alias("tokens"), F.round(F.sum("cost_per_day"), 4).alias("cost_per_day"))
)
query("session_sort", f"SELECT id, title, total, row_number() OVER (ORDER BY title DESC, id) AS place FROM {_BURN}")(
    lambda s, d: placed(W.session_usage(V.turns(s, d), V.sessions(s, d)).select("id", "title", "total"), [F.desc("title"), F.col("id")])
)
query("streak", """WITH a AS (SELECT DISTINCT CAST(d AS DATE) AS day FROM day_sums WHERE total > 0), r AS (SELECT count(*) AS streak, max(day) AS e FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM a) GROUP BY island),
 x AS (SELECT * FROM r WHERE e >= (SELECT max(CAST(d AS DATE)) FROM day_sums) - 1 ORDER BY e DESC LIMIT 1) SELECT coalesce((SELECT streak FROM x), 0) AS streak, (SELECT strftime(e, '%Y-%m-%d') FROM x) AS end_date""")(lambda s, d: (lambda base: C.streak(_own_days(s, d, base), _anchor(s, d, base)))(kept(_base(s, d), "own")))
_MATRIX = "(SELECT g.dow, g.hour, CAST(coalesce(sum(m.total), 0) AS BIGINT) AS total FROM (SELECT CAST(a AS INTEGER) AS dow, CAST(b AS INTEGER) AS hour FROM range(7) x(a), range(24) y(b)) g LEFT JOIN (SELECT CAST(dayofweek(CAST(substr(h, 1, 10) AS DATE)) AS INTEGER) AS dow, CAST(substr(h, 12, 2) AS INTEGER) AS hour, total FROM (SELECT h, total FROM turns WHERE h IS NOT NULL AND total > 0 UNION ALL SELECT h, total FROM external)) m USING (dow, hour) GROUP BY 1, 2)"


def _all_hours(spark: SparkSession, d: str) -> DataFrame:
    return Y.merged_hours(W.hours(V.turns(spark, d)), X.by(_ext(spark, d), "h"))


query("hour_matrix", f"SELECT * FROM {_MATRIX}")(lambda s, d: C.hour_matrix(_all_hours(s, d)))
query("merge_all_hours", "SELECT h, CAST(sum(total) AS BIGINT) AS total FROM (SELECT h, total FROM turns WHERE h IS NOT NULL UNION ALL SELECT h, total FROM external) GROUP BY h HAVING sum(total) > 0")(lambda s, d: _all_hours(s, d))
query("heat_tone", f"SELECT dow, hour, total, CASE WHEN total <= 0 THEN 0 WHEN sqrt(total / top) <= 0.25 THEN 1 WHEN sqrt(total / top) <= 0.5 THEN 2 WHEN sqrt(total / top) <= 0.75 THEN 3 ELSE 4 END AS tone FROM (SELECT *, max(total) OVER () AS top FROM {_MATRIX})")(lambda s, d: C.heat_tone(C.hour_matrix(_all_hours(s, d))))
query("stable_color", "SELECT key, CAST(dense_rank() OVER (ORDER BY key) - 1 AS INTEGER) AS color FROM model_sums")(lambda s, d: C.stable_color(W.models(V.turns(s, d))))
query("span", "SELECT min(d) AS first_day, max(d) AS last_day FROM (SELECT d FROM day_sums UNION ALL SELECT d FROM external)")(lambda s, d: C.span(_own_days(s, d), _ext_days(s, d)))
query("merged_daily", "SELECT d, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(total) AS BIGINT) AS total FROM (SELECT d, cache_read, cache_write, input, output, total FROM day_sums UNION ALL SELECT d, cache_read, cache_write, input, output, total FROM external) GROUP BY 1")(
    lambda s, d: C.merged_daily(_own_days(s, d), X.by(_ext(s, d), "d"))
)
query("freshness", "SELECT tool, max(d) AS last_day, CAST(date_diff('day', CAST(max(d) AS DATE), DATE '2024-02-04') AS BIGINT) AS age_days, date_diff('day', CAST(max(d) AS DATE), DATE '2024-02-04') > 4 AS stale FROM external GROUP BY 1")(lambda s, d: C.freshness(_ext_days(s, d), "2024-02-04", 4))
query("empty_state_facts", "SELECT count(*) AS days, max(d) AS last_day, count(*) FILTER (WHERE d >= strftime(CAST((SELECT max(d) FROM day_sums) AS DATE) - INTERVAL 6 DAY, '%Y-%m-%d')) AS in_range FROM day_sums")(
    lambda s, d: (lambda base: _own_days(s, d, base).agg(F.count("*").alias("days"), F.max("d").alias("last_day")).crossJoin(C.in_range(_own_days(s, d, base), "7d", _anchor(s, d, base)).agg(F.count("*").alias("in_range"))))(kept(_base(s, d), "own"))
)
query("tools_with_hours", "SELECT count(DISTINCT tool) AS tools FROM external")(lambda s, d: _ext(s, d).filter("h is not null").agg(F.count_distinct("tool").alias("tools")))

# --- external tools


def _ext_models(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    return X.model_rows(_ext_costs(spark, d, base))


query("ext_summary", "SELECT tool, CAST(sum(total) AS BIGINT) AS total, round(sum(cost), 4) AS cost, count(*) AS models, round(sum(cost) / sum(total) * 1e6::DOUBLE, 4) AS unit FROM ext_models GROUP BY 1")(lambda s, d: _round(X.summary(_ext_models(s, d)), "cost", "unit"))
query("ext_totals", f"SELECT {_sql_sums(*FIVE)} FROM external")(lambda s, d: _ext(s, d).agg(*(F.sum(c).alias(c) for c in FIVE)))
_EXT_UNIT = "(SELECT key, unit FROM (SELECT model AS key, CASE WHEN priced AND total > 0 THEN cost / total * 1e6::DOUBLE ELSE 0.0::DOUBLE END AS unit, row_number() OVER (PARTITION BY model ORDER BY tool_total DESC, tool, cost DESC, total DESC) AS rn FROM (SELECT *, sum(total) OVER (PARTITION BY tool) AS tool_total FROM ext_models)) WHERE rn = 1)"
query("ext_unit_by_model", f"SELECT key, round(unit, 4) AS unit FROM {_EXT_UNIT}")(lambda s, d: _round(X.unit_by_model(_ext_models(s, d)), "unit"))
query("ext_model_rows", "SELECT model AS key, CAST(sum(total) AS BIGINT) AS total, round(sum(cost), 4) AS cost, string_agg(DISTINCT tool, '|' ORDER BY tool) AS tools, round(sum(cost) / sum(total) * 1e6::DOUBLE, 4) AS unit FROM ext_models GROUP BY 1")(lambda s, d: _round(X.model_totals(_ext_models(s, d)), "cost", "unit"))
query("ext_zero_rows_dropped", "SELECT model AS key, CAST(sum(total) AS BIGINT) AS total FROM external GROUP BY 1 HAVING sum(total) > 0")(lambda s, d: X.by(_ext(s, d), "model").filter("total > 0").select(F.col("model").alias("key"), "total"))

# the day x model rows of `purchase` and `view` lack a day each, so their cost of a range is spread
_HOLES = "(tool = 'purchase' AND d = (SELECT min(d) FROM external WHERE tool = 'purchase')) OR (tool = 'view' AND d = (SELECT max(d) FROM external WHERE tool = 'view'))"
_RANGE = f"""holes AS (SELECT *, {_HOLES} AS hole FROM ext_day_model_cost), inexact AS (SELECT DISTINCT tool FROM holes WHERE hole), w AS (SELECT strftime(CAST((SELECT max(d) FROM external) AS DATE) - INTERVAL 6 DAY, '%Y-%m-%d') AS a),
exact_rows AS (SELECT tool, d, model AS key, total AS tokens, cost, true AS exact FROM holes WHERE tool NOT IN (SELECT tool FROM inexact) AND d >= (SELECT a FROM w)),
per_tool AS (SELECT tool, sum(total) AS all_tokens, sum(cost) AS all_cost FROM ext_models WHERE tool IN (SELECT tool FROM inexact) GROUP BY 1),
spread AS (SELECT e.tool, d, CAST(sum(total) AS BIGINT) AS tokens, sum(total) * (all_cost / all_tokens) AS cost, false AS exact FROM external e JOIN per_tool p ON e.tool = p.tool WHERE d >= (SELECT a FROM w) GROUP BY e.tool, d, all_cost, all_tokens),
ranged AS (SELECT tool, sum(tokens) AS range_tokens FROM spread GROUP BY 1),
spread_keys AS (SELECT m.tool, model AS key, CAST(floor(range_tokens * m.total / all_tokens + 0.5::DOUBLE) AS BIGINT) AS tokens, all_cost / all_tokens * range_tokens * (m.cost / all_cost) AS cost, false AS exact FROM ext_models m JOIN per_tool USING (tool) JOIN ranged USING (tool))"""


def _range_parts(spark: SparkSession, d: str, base: DataFrame | None = None) -> dict[str, DataFrame]:
    base = _ext_base(spark, d) if base is None else base
    costs, days = _ext_costs(spark, d, base), _ext_days(spark, d, base)
    ends = days.groupBy("tool").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    holes = ends.filter("tool in ('purchase', 'view')").select("tool", F.when(F.col("tool") == "purchase", F.col("lo")).otherwise(F.col("hi")).alias("d"))
    return X.range_by_model(costs.join(holes, ["tool", "d"], "left_anti"), days, X.model_rows(costs), "7d", _ext_anchor(spark, d, base))


def _range_tools(spark: SparkSession, d: str) -> DataFrame:
    base = _ext_base(spark, d)
    return X.range_tools(_ext_days(spark, d, base), _range_parts(spark, d, base)["tool"], "7d", _ext_anchor(spark, d, base))


query("ext_range_exact_or_amortised", f"WITH {_RANGE} SELECT key, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, bool_and(exact) AS exact FROM (SELECT key, tokens, cost, exact FROM exact_rows UNION ALL SELECT key, tokens, cost, exact FROM spread_keys) WHERE tokens > 0 GROUP BY 1")(lambda s, d: _round(_range_parts(s, d)["key"], "cost"))
query("ext_range_by_tool", f"WITH {_RANGE} SELECT tool, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, bool_and(exact) AS exact FROM (SELECT tool, tokens, cost, exact FROM exact_rows UNION ALL SELECT tool, tokens, cost, exact FROM spread) GROUP BY 1")(lambda s, d: _round(_range_parts(s, d)["tool"], "cost"))
query("ext_range_by_day", f"WITH {_RANGE} SELECT d, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, bool_and(exact) AS exact FROM (SELECT d, tokens, cost, exact FROM exact_rows UNION ALL SELECT d, tokens, cost, exact FROM spread) GROUP BY 1")(lambda s, d: _round(_range_parts(s, d)["day"], "cost"))
_RANGE_EXT = f"(SELECT e.tool, {', '.join(f'CAST(sum(e.{c}) AS BIGINT) AS {c}' for c in FIVE)}, any_value(c.cost) AS cost, any_value(c.exact) AS exact FROM external e JOIN (SELECT tool, sum(cost) AS cost, bool_and(exact) AS exact FROM (SELECT tool, cost, exact FROM exact_rows UNION ALL SELECT tool, cost, exact FROM spread) GROUP BY 1) c ON c.tool = e.tool WHERE d >= (SELECT a FROM w) GROUP BY 1)"
query("range_ext", f"WITH {_RANGE} SELECT tool, {', '.join(FIVE)}, round(cost, 4) AS cost, exact FROM {_RANGE_EXT}")(lambda s, d: _round(_range_tools(s, d), "cost"))
query("cross_tool_bars", f"WITH {_RANGE} SELECT tool, total AS tokens, round(cost, 4) AS cost FROM {_RANGE_EXT} UNION ALL SELECT 'pi', CAST(sum(total) AS BIGINT), round((SELECT sum(cost) FROM day_cost), 4) FROM day_sums")(
    lambda s, d: _round(X.cross_tool_bars(_stats(s, d, "all"), _range_tools(s, d)), "cost")
)
query("window_usage", "WITH a AS (SELECT CAST(max(d) AS DATE) AS a FROM external) SELECT tool, CAST(sum(CASE WHEN CAST(d AS DATE) >= a - 6 THEN total ELSE 0 END) AS BIGINT) AS tokens_7d, CAST(sum(CASE WHEN CAST(d AS DATE) >= a - 29 THEN total ELSE 0 END) AS BIGINT) AS tokens_30d FROM external, a GROUP BY 1 HAVING sum(CASE WHEN CAST(d AS DATE) >= a - 29 THEN total ELSE 0 END) > 0")(
    lambda s, d: X.window_usage(_ext_days(s, d), _ext_anchor(s, d))
)
def _week(spark: SparkSession, d: str) -> DataFrame:
    own, ext = kept(_base(spark, d), "own"), _ext_base(spark, d)
    # the own side's days are moved by 1181 days to meet those of the events
    days = W.day_model_of(own).filter("d <> ''").withColumn("d", F.date_format(F.date_add(F.col("d").cast("date"), 1181), "yyyy-MM-dd"))
    return C.week_top_models(days, _own_costs(spark, d, base=own), X.by(ext, "d", "model").withColumn("key", fm.canonical_model(F.col("model"))), X.unit_by_model(_ext_models(spark, d, ext)), _ext_anchor(spark, d, ext))


query("week_top_models", f"""WITH a AS (SELECT CAST(max(d) AS DATE) AS a FROM external), own AS (SELECT m.key, m.total AS tokens, unit * m.total / 1e6::DOUBLE AS cost FROM day_model m JOIN model_units USING (key), a WHERE CAST(m.d AS DATE) + 1181 BETWEEN date_trunc('week', a) AND a),
 ext AS (SELECT e.model AS key, e.total AS tokens, u.unit * e.total / 1e6::DOUBLE AS cost FROM external e JOIN {_EXT_UNIT} u ON u.key = e.model, a WHERE CAST(e.d AS DATE) BETWEEN date_trunc('week', a) AND a),
 s AS (SELECT key, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost FROM (SELECT * FROM own UNION ALL SELECT * FROM ext) GROUP BY 1) SELECT key, tokens, round(cost, 4) AS cost, round(cost / (SELECT sum(cost) FROM s) * 100, 4) AS share FROM s ORDER BY s.cost DESC, tokens DESC, key LIMIT 5""")(
    lambda s, d: _round(_week(s, d), "cost", "share")
)
_OWN_RANGE = "(SELECT m.key, CAST(sum(m.total) AS BIGINT) AS total FROM day_model m WHERE d >= strftime(CAST((SELECT max(d) FROM day_sums) AS DATE) - INTERVAL 29 DAY, '%Y-%m-%d') GROUP BY 1)"
_MODEL_AGG = f"""(SELECT coalesce(o.key, e.key) AS key, coalesce(o.total, 0) AS own_tokens, {', '.join(f"coalesce(CAST(floor(s.{c} * (o.total / s.total) + 0.5::DOUBLE) AS BIGINT), 0) AS {c}" for c in FIVE[:4])}, coalesce(e.total, 0) AS ext_tokens, coalesce(e.cost, 0.0::DOUBLE) AS ext_cost
 FROM {_OWN_RANGE} o JOIN model_sums s USING (key) FULL JOIN (SELECT model AS key, CAST(sum(total) AS BIGINT) AS total, sum(cost) AS cost FROM ext_models GROUP BY 1) e ON e.key = o.key)"""


def _model_agg(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    base = kept(_base(spark, d), "own") if base is None else base
    own = C.in_range(W.day_model_of(base), "30d", _anchor(spark, d, base)).groupBy("key").agg(F.sum("total").alias("total"))
    return X.range_model_agg(own, W.models_of(base), X.model_totals(_ext_models(spark, d)).withColumnRenamed("total", "tokens"))


query("range_model_agg", f"SELECT key, own_tokens, {', '.join(FIVE[:4])}, ext_tokens, round(ext_cost, 4) AS ext_cost FROM {_MODEL_AGG}")(lambda s, d: _round(_model_agg(s, d), "ext_cost"))
query("model_range_cost", f"SELECT key, round(coalesce(unit, 0.0::DOUBLE) * own_tokens / 1e6::DOUBLE + ext_cost, 4) AS cost FROM {_MODEL_AGG} a LEFT JOIN model_units u USING (key)")(lambda s, d: _round(Y.model_range_cost(_model_agg(s, d), _own_costs(s, d)), "cost"))
query("models_pi_wins", "SELECT key, total, 'pi' AS side FROM model_sums UNION ALL SELECT model, CAST(sum(total) AS BIGINT), 'ext' FROM ext_models WHERE model NOT IN (SELECT key FROM model_sums) GROUP BY 1")(lambda s, d: Y.own_first(W.models(V.turns(s, d)).select("key", "total"), X.model_totals(_ext_models(s, d)).select("key", "total")))
query("page_kpis", "SELECT count(*) FILTER (WHERE own_tokens > 0) AS own_models, count(*) FILTER (WHERE ext_tokens > 0) AS ext_models, CAST(sum(own_tokens) AS BIGINT) AS own_tokens, CAST(sum(ext_tokens) AS BIGINT) AS ext_tokens FROM " + _MODEL_AGG)(
    lambda s, d: _model_agg(s, d).agg(F.count_if(F.col("own_tokens") > 0).alias("own_models"), F.count_if(F.col("ext_tokens") > 0).alias("ext_models"), F.sum("own_tokens").alias("own_tokens"), F.sum("ext_tokens").alias("ext_tokens"))
)

# --- projects, commits and titles

_CUT = "(SELECT strftime(make_timestamp(max(updated_at) * 1000), '%Y-%m-%d') FROM sessions)"
query("project_rollup", f"SELECT coalesce(project, '(无项目)') AS name, count(DISTINCT id) AS sessions, CAST(sum(t.total) AS BIGINT) AS total FROM sessions JOIN turns t ON id = session_id AND has_usage WHERE strftime(make_timestamp(updated_at * 1000), '%Y-%m-%d') >= strftime(CAST({_CUT} AS DATE) - INTERVAL 29 DAY, '%Y-%m-%d') GROUP BY 1")(
    lambda s, d: Y.project_rollup(W.session_usage(V.turns(s, d), V.sessions(s, d)), V.sessions(s, d), "30d")
)
query("project_drill", "SELECT model_canon AS key, count(*) AS turns, CAST(sum(total) AS BIGINT) AS total FROM turns JOIN sessions ON id = session_id WHERE project = 'BUILDING' AND has_usage GROUP BY 1")(lambda s, d: Y.project_models(V.turns(s, d), V.sessions(s, d), "BUILDING"))
query("project_drill_days", "SELECT strftime(make_timestamp(updated_at * 1000), '%Y-%m-%d') AS d, count(DISTINCT id) AS sessions, CAST(sum(total) AS BIGINT) AS total FROM turns JOIN sessions ON id = session_id WHERE project = 'BUILDING' AND has_usage GROUP BY 1")(lambda s, d: Y.project_days(W.session_usage(V.turns(s, d), V.sessions(s, d)), "BUILDING"))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders")
    n = F.array(*map(F.lit, ("AUTOMOBILE", "bldg", "HOUSEHOLD", "lost")))
    return o.select(F.element_at(n, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("root"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.concat(F.lit("fix "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey")).alias("subject"), (-F.col("o_orderkey")).alias("n"))


def _repos(spark: SparkSession) -> DataFrame:
    also = F.when(F.col("root") == "bldg", F.array(F.lit("BUILDING"), F.lit("HOUSEHOLD"))).otherwise(F.array().cast("array<string>"))
    return spark.createDataFrame([("AUTOMOBILE",), ("bldg",), ("HOUSEHOLD",), ("lost",)], "root string").select("root", F.col("root").alias("name"), also.alias("also"))


_COMMITS = "(SELECT ['AUTOMOBILE', 'bldg', 'HOUSEHOLD', 'lost'][o_orderkey % 4 + 1] AS root, strftime(o_orderdate, '%Y-%m-%d') AS d, 'fix ' || o_orderpriority || ' ' || o_orderkey AS subject, -o_orderkey AS n FROM orders)"
query("commits_by_day", f"SELECT root, d, count(*) AS commits, array_to_string(list_slice(list(subject ORDER BY n), 1, 3), '|') AS subjects FROM {_COMMITS} GROUP BY 1, 2")(lambda s, d: Y.commits_by_day(_commits(s, d), order="n"))
query("cost_per_commit", f"""WITH c AS (SELECT root, count(*) AS commits FROM {_COMMITS} GROUP BY 1), p AS (SELECT coalesce(project, '(无项目)') AS project, CAST(sum(t.total) AS BIGINT) AS total FROM turns t LEFT JOIN sessions ON id = session_id WHERE has_usage GROUP BY 1)
 SELECT root, commits, project, total, round(total * 2.5::DOUBLE / 1e6::DOUBLE / commits, 8) AS cost_per_commit FROM c LEFT JOIN p ON p.project = CASE root WHEN 'bldg' THEN 'BUILDING' ELSE root END""")(
    lambda s, d: Y.cost_per_commit(_commits(s, d), _repos(s), W.projects(V.turns(s, d), V.sessions(s, d)), 2.5).withColumn("cost_per_commit", F.round("cost_per_commit", 8))
)
query("title_categories", f"SELECT CASE WHEN contains(title, 'URGENT') THEN 'fix' WHEN contains(title, 'HIGH') THEN 'feature' ELSE 'other' END AS category, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM {_BURN} GROUP BY 1")(
    lambda s, d: Y.title_categories(W.session_usage(V.turns(s, d), V.sessions(s, d)), lambda t: F.when(F.contains(t, F.lit("URGENT")), "fix").when(F.contains(t, F.lit("HIGH")), "feature").otherwise("other"))
)
query("payload_diff", "SELECT a.key, 'total' AS field, CAST(a.total AS DOUBLE) AS left_value, CAST(a.total + 1 AS DOUBLE) AS right_value FROM model_sums a WHERE CAST(regexp_extract(a.key, '([0-9]+)$', 1) AS BIGINT) % 5 = 0 UNION ALL SELECT key, 'row', 1.0::DOUBLE, 0.0::DOUBLE FROM model_sums WHERE key = 'brand-7'")(
    lambda s, d: compare.differences(
        W.models(V.turns(s, d)).select("key", "total", "turns"),
        W.models(V.turns(s, d)).filter("key <> 'brand-7'").select("key", F.when(F.regexp_extract("key", "([0-9]+)$", 1).cast("long") % 5 == 0, F.col("total") + 1).otherwise(F.col("total")).alias("total"), "turns"),
        "key",
    )
)
query("override_counters", "SELECT count(*) FILTER (WHERE priced) AS priced_models, count(*) AS models FROM model_costs")(lambda s, d: _own_costs(s, d).agg(F.count_if("priced").alias("priced_models"), F.count("*").alias("models")))

# --- exports and formats

query("number_formats", """SELECT key, CASE WHEN total >= 1000000000 THEN printf('%.2fB', total / 1e9::DOUBLE) WHEN total >= 1000000 THEN printf('%.2fM', total / 1e6::DOUBLE) WHEN total >= 1000 THEN printf('%.1fK', total / 1e3::DOUBLE) ELSE CAST(total AS VARCHAR) END AS tokens,
  CASE WHEN x = 0 THEN '$0' WHEN x < 0.01 THEN printf('$%.4f', x) WHEN x < 1 THEN printf('$%.3f', x) ELSE '$' || format('{:,.2f}', x) END AS cost, printf('%.1f%%', y) AS hit FROM (SELECT key, total, round(output / 1e6::DOUBLE, 3) AS x, round(100.0::DOUBLE * cache_read / total, 3) AS y FROM model_sums)""")(
    lambda s, d: W.models(V.turns(s, d)).select("key", fmt.compact(F.col("total")).alias("tokens"), fmt.money(F.round(F.col("output") / 1e6, 3)).alias("cost"), fmt.percent(F.round(100.0 * F.col("cache_read") / F.col("total"), 3)).alias("hit"))
)
query("catalogue_stats", "SELECT CAST(4 AS BIGINT) AS providers, CAST(sum(3 + CASE WHEN n % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS models, CAST(sum(CASE WHEN n % 2 = 0 AND price_input IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN n % 5 = 0 THEN 0 ELSE 1 END + 1) AS BIGINT) AS with_input FROM (SELECT *, CAST(regexp_extract(model_canon, '([0-9]+)$', 1) AS BIGINT) AS n FROM prices)")(
    lambda s, d: exports.catalogue_stats(_catalogue(s, d))
)
query("resolution_confidence", "SELECT DISTINCT model_raw AS model, CASE WHEN starts_with(model_raw, 'kimi/') AND NOT contains(model_raw, '--int') AND NOT contains(model_raw, '-ga-') AND CAST(regexp_extract(model_canon, '([0-9]+)$', 1) AS BIGINT) % 5 <> 0 THEN 'high' ELSE 'medium' END AS confidence FROM turns")(
    lambda s, d: exports.confidence(R.resolve(_ids(s, d), _catalogue(s, d))).select("model", "confidence")
)
query("compare_sources", "SELECT round(sum(cost), 4) AS ratio10, round(sum(CASE WHEN u.price_input IS NULL THEN 0.0::DOUBLE ELSE cache_read / 1e6::DOUBLE * coalesce(price_cache_read, 0.0::DOUBLE) + cache_write / 1e6::DOUBLE * coalesce(price_cache_write, 0.0::DOUBLE) + input / 1e6::DOUBLE * price_input + output / 1e6::DOUBLE * price_output END), 4) AS zero FROM model_costs LEFT JOIN prices u ON model_canon = key")(
    lambda s, d: _own_costs(s, d).select("key", F.col("cost").alias("a")).join(_own_costs(s, d, "zero").select("key", F.col("cost").alias("b")), "key").agg(F.round(F.sum("a"), 4).alias("ratio10"), F.round(F.sum("b"), 4).alias("zero"))
)
query("custom_prices", "SELECT lower(p_brand) AS key, CAST(max(p_size) AS DOUBLE) AS price_input, 2.5::DOUBLE AS price_output FROM part GROUP BY 1")(
    lambda s, d: exports.custom_prices(
        V.table(s, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("n")).select(F.to_json(F.create_map(F.concat(F.lit(" "), "p_brand"), F.struct(F.struct(F.col("n").alias("input"), F.lit("2.5").alias("output")).alias("cost")))).alias("value"))
    ).select("key", "price_input", "price_output")
)
query("dashboard_export", f"""SELECT CAST(to_json(struct_pack(models := (SELECT list(struct_pack(key := key, total := total, turns := turns) ORDER BY total DESC, key) FROM (SELECT model_canon AS key, CAST(sum(total) AS BIGINT) AS total, count(*) AS turns FROM turns GROUP BY 1)),
 days := (SELECT list(struct_pack(d := d, total := total) ORDER BY d) FROM day_sums), turns := turns, turns_with_usage := turns_with_usage, {', '.join(f'{c} := {c}' for c in ALL)})) AS VARCHAR) AS payload FROM (SELECT count(*) AS turns, count(*) FILTER (WHERE has_usage) AS turns_with_usage, {_sql_sums(*ALL)} FROM turns)""")(
    lambda s, d: exports.document([exports.nested("models", W.models(V.turns(s, d)).select("key", "total", "turns"), [-F.col("total"), F.col("key")]), exports.nested("days", _own_days(s, d).select("d", "total"), [F.col("d")]), W.totals(V.turns(s, d))])
)
query("external_export", f"""SELECT CAST(to_json(struct_pack(tools := list(struct_pack(tool := tool, calls := calls, sessions := sessions, {', '.join(f'{c} := {c}' for c in FIVE)}, first_ts := first_ts, last_ts := last_ts) ORDER BY total DESC, tool))) AS VARCHAR) AS payload
 FROM (SELECT tool, count(*) AS calls, count(DISTINCT session) AS sessions, {_sql_sums(*FIVE)}, min(ts) AS first_ts, max(ts) AS last_ts FROM external GROUP BY 1)""")(lambda s, d: exports.document([exports.nested("tools", X.tool_totals(_ext(s, d)), [-F.col("total"), F.col("tool")])]))
