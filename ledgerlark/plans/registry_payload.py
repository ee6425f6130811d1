"""Registered queries on the whole payload: all its blocks as leaves, the comparison of two payloads, and places in an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators import compare, payload as P
from ledgerlark.plans import views as V
from ledgerlark.plans.kept import kept
from ledgerlark.plans.numbering import placed
from ledgerlark.plans.registry import FIVE, _ext, query
from ledgerlark.plans.registry_ranges import _COMMITS, _commits
from ledgerlark.plans.registry_sources import _COLUMNS, _SESSION_TABLE, _SOURCE, _session_table

SUMS = ("cache_read", "cache_write", "input", "output", "reasoning", "total")


def _payload(spark: SparkSession, d: str) -> P.Payload:
    e = V.table(spark, d, "events")
    messages = e.select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tool-"), F.col("user_id") % 4)).alias("tool"), (F.col("value") > 60).alias("is_error"))
    commits = _commits(spark, d).groupBy("root").agg(F.count("*").alias("commits")).withColumn("project", F.when(F.col("root") != "lost", F.upper("root")))
    return P.Payload(V.turns(spark, d), V.sessions(spark, d), messages, V.prices(spark, d), _ext(spark, d), V.external_prices(spark, d), commits, _SOURCE | {"prices_fetched_at": "2001-11-01", "prices_file": "prices.json"}, "/home/me")


def _leaves(rows: DataFrame) -> DataFrame:
    """Leaves with numbers as numbers, to four digits."""
    number = F.round(F.col("value").try_cast("double"), 4)
    return compare.leaves(rows).select("path", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


def _payload_leaves(spark: SparkSession, d: str) -> DataFrame:
    rows = kept(_payload(spark, d).rows(), "payload")
    return _leaves(rows.select(F.concat("block", F.lit("["), "place", F.lit("]")).alias("path"), "value"))


def _sum(names, t: str = "") -> str:
    return ", ".join(f"CAST(coalesce(sum({t}{c}), 0) AS BIGINT) AS {c}" for c in names)


def _flat(block: str, sql: str, fields: str, order: str = "1") -> str:
    """A block's rows as leaves."""
    names = fields.split()
    return f"SELECT '{block}[' || place || '].' || field AS path, value FROM (SELECT row_number() OVER (ORDER BY {order}) AS place, {', '.join(f'CAST({f} AS VARCHAR) AS {f}' for f in names)} FROM ({sql})) UNPIVOT (value FOR field IN ({', '.join(names)}))"


_S = " ".join(SUMS)
_F = " ".join(FIVE)
_MESSAGES = "(SELECT 's' || user_id AS session_id, event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'tool-' || (user_id % 4) END AS tool, value > 60 AS is_error FROM events)"
_USED_SESSIONS = f"(SELECT s.id, any_value(title) AS title, any_value(project) AS project, any_value(created_at) AS created_at, any_value(updated_at) AS updated_at, count(*) AS turns, {_sum(FIVE, 't.')}, coalesce(any_value(m.n), 0) AS messages FROM sessions s JOIN turns t ON t.session_id = s.id LEFT JOIN (SELECT session_id, count(*) AS n FROM {_MESSAGES} GROUP BY 1) m ON m.session_id = s.id GROUP BY s.id HAVING count(*) FILTER (WHERE has_usage) > 0)"
_MODEL_PLACES = "(SELECT key, row_number() OVER (ORDER BY total DESC, key) AS place FROM model_sums)"
_RAWS = f"(SELECT place, model_raw AS rid, count(*) AS turns, {_sum(SUMS)} FROM turns JOIN {_MODEL_PLACES} p ON p.key = model_canon GROUP BY 1, 2)"
_BLOCKS = [
    _flat("meta", "SELECT '2001-11-10 08:00' AS generated_at, '~/.pi/pi.sqlite' AS db_path, '~/.pi' AS dir, 12 AS db_version, 130.2 AS db_size_mb, 0.0 AS wal_size_mb, (SELECT min(d) FROM (SELECT d FROM day_sums UNION ALL SELECT d FROM external)) AS range_start, (SELECT max(d) FROM (SELECT d FROM day_sums UNION ALL SELECT d FROM external)) AS range_end, (SELECT count(DISTINCT tool) FROM external) AS tools", "generated_at db_path dir db_version db_size_mb wal_size_mb range_start range_end tools"),
    _flat("totals", f"SELECT count(*) AS turns, count(*) FILTER (WHERE has_usage) AS turns_with_usage, {_sum(SUMS)}, (SELECT count(*) FROM sessions) AS sessions, (SELECT count(DISTINCT project) FROM sessions) AS projects, (SELECT count(*) FROM events) AS messages, floor(1000.0::DOUBLE * sum(cache_read) / greatest(1, sum(cache_read) + sum(cache_write) + sum(input)) + 0.5::DOUBLE) / 10 AS cache_hit_pct FROM turns", f"turns turns_with_usage {_S} sessions projects messages cache_hit_pct"),
    _flat("models", f"SELECT model_canon AS key, count(*) AS turns, count(*) FILTER (WHERE NOT has_usage) AS missing_usage, {_sum(SUMS)}, min(CASE WHEN started_at > 0 THEN started_at END) AS first_ts, max(started_at) AS last_ts, any_value(price_input) IS NOT NULL AS priced FROM turns LEFT JOIN prices USING (model_canon) GROUP BY 1", f"key turns missing_usage {_S} first_ts last_ts priced", "total DESC, key"),
    "SELECT 'models[' || place || '].raw_ids[' || (row_number() OVER (PARTITION BY place ORDER BY rid) - 1) || ']' AS path, rid AS value FROM " + _RAWS,
    f"SELECT 'models[' || place || '].raw_usage[' || id || '].' || field AS path, value FROM (SELECT place, rid AS id, {', '.join(f'CAST({f} AS VARCHAR) AS {f}' for f in ('rid', 'turns', *SUMS))} FROM {_RAWS}) UNPIVOT (value FOR field IN (rid, turns, {', '.join(SUMS)}))",
    f"SELECT 'models[' || place || '].statuses[' || id || '].' || field AS path, value FROM (SELECT place, coalesce(status, '') AS id, coalesce(status, '') AS status, CAST(count(*) AS VARCHAR) AS n FROM turns JOIN {_MODEL_PLACES} p ON p.key = model_canon GROUP BY 1, 2, 3) UNPIVOT (value FOR field IN (status, n))",
    _flat("days", f"SELECT coalesce(d, '') AS d, count(*) AS turns, {_sum(SUMS)} FROM turns GROUP BY 1", f"d turns {_S}", "d"),
    _flat("dayModel", f"SELECT coalesce(d, '') AS d, model_canon AS key, count(*) AS turns, {_sum(('total', 'output'))} FROM turns GROUP BY 1, 2", "d key turns total output", "d, key"),
    _flat("hours", f"SELECT h, count(*) AS turns, {_sum(FIVE)} FROM turns WHERE h IS NOT NULL GROUP BY 1", f"h turns {_F}", "h"),
    _flat("projects", f"SELECT coalesce(project, '(无项目)') AS name, count(DISTINCT session_id) AS sessions, count(*) AS turns, {_sum(SUMS, 'turns.')} FROM turns LEFT JOIN sessions ON id = session_id WHERE has_usage GROUP BY 1", f"name sessions turns {_S}", "total DESC, name"),
    _flat("sessions", f"SELECT * FROM {_USED_SESSIONS} ORDER BY total DESC, id LIMIT 40", f"id title project created_at updated_at turns {_F} messages", "total DESC, id"),
    _flat("sessionsAll", f"SELECT * FROM {_USED_SESSIONS}", f"id title project created_at updated_at turns {_F} messages", "total DESC, id"),
    _flat("sessionCount", f"SELECT count(*) AS sessions FROM {_USED_SESSIONS}", "sessions"),
    _flat("roles", f"SELECT name, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM {_MESSAGES} GROUP BY 1", "name n errors", "name"),
    _flat("tools", f"SELECT tool AS name, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM {_MESSAGES} WHERE tool IS NOT NULL GROUP BY 1", "name n errors", "n DESC, name"),
    _flat("pricing", "SELECT model_canon AS key, price_input, price_output, price_cache_read, price_cache_write FROM prices WHERE price_input IS NOT NULL AND model_canon IN (SELECT model_canon FROM turns)", "key price_input price_output price_cache_read price_cache_write", "key"),
    _flat("pricingMeta", "SELECT count(*) AS models, count(price_input) AS priced, CAST(coalesce(sum(CASE WHEN price_input IS NULL THEN total END), 0) AS BIGINT) AS unpriced_tokens, '2001-11-01' AS fetched_at, 'prices.json' AS file FROM model_sums LEFT JOIN prices ON model_canon = key", "models priced unpriced_tokens fetched_at file"),
    _flat("external", f"SELECT e.*, models, cost FROM (SELECT tool, count(*) AS calls, count(DISTINCT session) AS sessions, {_sum(FIVE)}, min(ts) AS first_ts, max(ts) AS last_ts FROM external GROUP BY 1) e JOIN (SELECT tool, count(*) AS models, sum(cost) AS cost FROM ext_models GROUP BY 1) USING (tool)", f"tool calls sessions {_F} first_ts last_ts models cost", "total DESC, tool"),
    _flat("externalDays", f"SELECT tool, d, {_sum(FIVE)} FROM external GROUP BY 1, 2", f"tool d {_F}", "tool, d"),
    _flat("yield", f"SELECT root, count(*) AS commits, CASE WHEN root <> 'lost' THEN upper(root) END AS project FROM {_COMMITS} GROUP BY 1", "root commits project", "commits DESC, root"),
]
query("dashboard_payload", "SELECT path, round(TRY_CAST(value AS DOUBLE), 4) AS number, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END AS text FROM (" + " UNION ALL ".join(f"({b})" for b in _BLOCKS) + ")")(_payload_leaves)

# --- two payloads, of which the second differs here and there


def _nested(spark: SparkSession, d: str, other: bool) -> DataFrame:
    """A nested entry for each order, with its items by number: of the other side some items lack, some have another price or flag, and some titles are null."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    off = F.lit(other)
    tokens = F.floor("l_extendedprice").cast("long") + F.when(off & (k % 7 == 0) & (n == 1), 1).otherwise(0)
    item = F.struct(n.cast("long").alias("rid"), tokens.alias("total"), F.struct(F.when(off & (k % 11 == 3), F.lit("?")).otherwise(F.col("l_returnflag")).alias("flag")).alias("inner"))
    items = V.table(spark, d, "lineitem").filter(~(off & (k % 13 == 5) & (n == 2))).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item), asc=not other).alias("raw_usage"))
    o = V.table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.filter(~(off & (F.col("o_orderkey") % 17 == 1)))
    title = F.when(~(off & (F.col("o_orderkey") % 19 == 2)), F.col("o_orderpriority"))
    value = F.to_variant_object(F.struct(F.concat(F.lit("s"), "o_orderkey").alias("id"), title.alias("title"), "raw_usage"))
    return o.select(F.lit("sessionsAll").alias("block"), F.col("o_orderkey").alias("place"), value.alias("value"))


_SIDES = """l AS (SELECT l_orderkey AS k, l_linenumber AS n, 'sessionsAll[s' || l_orderkey || '].raw_usage[' || l_linenumber || '].' AS spot, CAST(floor(l_extendedprice) AS BIGINT) AS total, l_returnflag AS flag, l_orderkey % 17 = 1 OR (l_orderkey % 13 = 5 AND l_linenumber = 2) AS lost FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 items AS (SELECT spot || 'rid' AS path, CAST(n AS VARCHAR) AS a, CASE WHEN NOT lost THEN CAST(n AS VARCHAR) END AS b FROM l UNION ALL SELECT spot || 'total', CAST(total AS VARCHAR), CASE WHEN NOT lost THEN CAST(total + CASE WHEN k % 7 = 0 AND n = 1 THEN 1 ELSE 0 END AS VARCHAR) END FROM l
  UNION ALL SELECT spot || 'inner.flag', flag, CASE WHEN NOT lost THEN CASE WHEN k % 11 = 3 THEN '?' ELSE flag END END FROM l),
 heads AS (SELECT DISTINCT 'sessionsAll[s' || o_orderkey || '].id' AS path, 's' || o_orderkey AS a, CASE WHEN o_orderkey % 17 <> 1 THEN 's' || o_orderkey END AS b FROM orders
  UNION SELECT DISTINCT 'sessionsAll[s' || o_orderkey || '].title', o_orderpriority, CASE WHEN o_orderkey % 17 <> 1 AND o_orderkey % 19 <> 2 THEN o_orderpriority END FROM orders)"""
# items of one order that share a number have one path, and are compared as a whole
query("payload_compare", f"WITH {_SIDES} SELECT * FROM (SELECT path, string_agg(a, '|' ORDER BY a) AS left_value, string_agg(b, '|' ORDER BY b) AS right_value FROM (SELECT * FROM items UNION ALL SELECT * FROM heads) GROUP BY path) WHERE left_value IS DISTINCT FROM right_value")(
    lambda s, d: compare.nested_differences(*(compare.payload_entries(_nested(s, d, other)) for other in (False, True)))
)

# --- places


def _session_places(spark: SparkSession, d: str) -> DataFrame:
    table = kept(_session_table(spark, d), "session-table")
    parts = [placed(table.select("id", c), [(F.desc if down else F.asc)(c), F.col("id")]).select(F.lit(f"{c} {'desc' if down else 'asc'}").alias("sorted_by"), "id", "place") for c in _COLUMNS for down in (True, False)]
    return reduce(DataFrame.unionByName, parts)


query("session_sort_places", " UNION ALL ".join(f"SELECT '{c} {way}' AS sorted_by, id, row_number() OVER (ORDER BY {c} {way}, id) AS place FROM {_SESSION_TABLE}" for c in _COLUMNS for way in ("desc", "asc")))(_session_places)
