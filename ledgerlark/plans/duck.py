"""The views of plans.views in DuckDB's SQL, for the oracles."""

from __future__ import annotations

PREFIXES = "azure-|openai/|kimi/|moonshotai/|moonshot-|x-ai/|z-ai/|google/|anthropic/|deepseek/|qwen/|zai-org/|minimax/|xiaomi/|stepfun/|subconscious/|bothub/|modelis/|greenpt/"


def canon(column: str) -> str:
    s = f"regexp_replace(lower(trim({column})), '^({PREFIXES})+', '')"
    for p in ("--?int$", "--?(ga|preview|exp|latest|beta)[-_]?[0-9]*$", "-[0-9]{6}$", "-(preview|exp)$"):
        s = f"regexp_replace({s}, '{p}', '')"
    return f"CASE WHEN coalesce({column}, '') = '' THEN '(unknown)' WHEN {s} = '' THEN lower(trim({column})) ELSE {s} END"


VIEWS = {
    "turns_raw": """SELECT 's' || l_orderkey AS session_id, CASE WHEN l_linenumber <= 5 THEN 'pi' ELSE 'pi-cli' END AS tool,
  (CASE l_partkey % 4 WHEN 0 THEN 'azure-' WHEN 1 THEN 'openai/' WHEN 2 THEN '' ELSE 'kimi/' END) || lower(replace(p_brand, '#', '-')) || (CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '--int' ELSE '-ga-260731' END) AS model_raw,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL ELSE (date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 24 + (3 * l_linenumber + CAST(floor(l_quantity) AS BIGINT)) % 24) * 3600000 END AS started_at,
  CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'aborted' ELSE 'completed' END AS status,
  l_discount > 0.005 AS has_usage,
  CASE WHEN l_discount > 0.005 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END AS cache_read,
  CASE WHEN l_discount > 0.005 THEN l_partkey % 500 ELSE 0 END AS cache_write,
  CASE WHEN l_discount > 0.005 THEN 10 * CAST(floor(l_quantity) AS BIGINT) ELSE 0 END AS input,
  CASE WHEN l_discount > 0.005 THEN 3 * CAST(floor(l_quantity) AS BIGINT) + 1 ELSE 0 END AS output,
  CASE WHEN l_discount > 0.005 THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END AS reasoning
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "turns": f"""SELECT *, cache_read + cache_write + input + output AS total, {canon("model_raw")} AS model_canon,
  CASE WHEN started_at > 0 THEN strftime(make_timestamp(started_at * 1000), '%Y-%m-%d') END AS d,
  CASE WHEN started_at > 0 THEN strftime(make_timestamp(started_at * 1000), '%Y-%m-%d %H') END AS h FROM turns_raw""",
    "sessions": """SELECT 's' || o_orderkey AS id, 'order ' || o_orderpriority AS title, CASE WHEN o_orderkey % 17 <> 0 THEN c_mktsegment END AS project,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000 AS created_at,
  date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400000 + (o_orderkey % 40) * 28800000 AS updated_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "external_raw": """SELECT event_type AS tool, 'ext-' || (user_id % 6) AS model, CAST(user_id AS VARCHAR) AS session, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS ts,
  CAST(json_extract(props, '$.k') AS BIGINT) AS input, CAST(floor(value * 100) AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write, CAST(floor(value) AS BIGINT) AS output,
  user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS dedup_key, event_id AS ord FROM events""",
    "external": """SELECT tool, model, session, ts, input, cache_read, cache_write, output, input + cache_read + cache_write + output AS total, substr(ts, 1, 10) AS d, substr(ts, 1, 13) AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY tool, dedup_key ORDER BY ord) AS rn FROM external_raw) WHERE rn = 1 AND input + cache_read + cache_write + output > 0""",
    "counters": """SELECT 'log' || user_id AS file, event_id AS line, strftime(ts, '%Y-%m-%d') AS day,
  CAST(sum(k) OVER (PARTITION BY user_id, run ORDER BY event_id) AS BIGINT) AS total, k AS last, CASE WHEN event_type = 'signup' THEN 'model-' || (k % 4) END AS context_model
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)""",
    "prices": """SELECT model_canon, CASE WHEN n % 7 <> 0 THEN n / 10.0::DOUBLE END AS price_input, n / 2.0::DOUBLE AS price_output, CASE WHEN n % 5 <> 0 THEN n / 100.0::DOUBLE END AS price_cache_read, CASE WHEN n % 3 <> 0 THEN n / 8.0::DOUBLE END AS price_cache_write
  FROM (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS model_canon, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS n FROM part)""",
    "external_prices": """SELECT 'ext-' || k AS model, k + 1.0::DOUBLE AS price_input, CASE WHEN k <> 3 THEN (k + 1.0::DOUBLE) * 4 END AS price_output, CASE WHEN k % 2 = 0 THEN (k + 1.0::DOUBLE) / 10 END AS price_cache_read, CAST(NULL AS DOUBLE) AS price_cache_write FROM range(5) r(k)""",
    "raw_records": """SELECT 'f' || (user_id % 10) AS file, 'dir' AS dir, event_id AS line, event_type AS type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  'm' || (event_id % 4000) AS id, CASE WHEN user_id % 7 <> 0 THEN 'ext-' || (user_id % 6) END AS model, event_type <> 'error' AS has,
  CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS input_tokens, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 3) AS BIGINT) END AS cached,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS output_tokens, CASE WHEN event_type <> 'error' THEN user_id % 50 END AS thinking FROM events""",
    # unit prices under the ratio10 policy
    "units": """SELECT *, price_input AS unit_input, CASE WHEN price_input IS NOT NULL THEN coalesce(price_cache_read, price_input * 0.1::DOUBLE) END AS unit_cache_read,
  CASE WHEN price_input IS NOT NULL THEN coalesce(price_cache_write, price_input * 1.25::DOUBLE) END AS unit_cache_write, CASE WHEN price_input IS NOT NULL THEN coalesce(price_output, price_input) END AS unit_output FROM prices""",
    "external_units": """SELECT *, price_input AS unit_input, CASE WHEN price_input IS NOT NULL THEN coalesce(price_cache_read, price_input * 0.1::DOUBLE) END AS unit_cache_read,
  CASE WHEN price_input IS NOT NULL THEN coalesce(price_cache_write, price_input * 1.25::DOUBLE) END AS unit_cache_write, CASE WHEN price_input IS NOT NULL THEN coalesce(price_output, price_input) END AS unit_output FROM external_prices""",
    "model_sums": """SELECT model_canon AS key, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(total) AS BIGINT) AS total FROM turns GROUP BY 1""",
    "model_costs": """SELECT m.*, price_input IS NOT NULL AS priced, CASE WHEN price_input IS NULL THEN 0.0::DOUBLE ELSE cache_read / 1e6::DOUBLE * unit_cache_read + cache_write / 1e6::DOUBLE * unit_cache_write + input / 1e6::DOUBLE * unit_input + output / 1e6::DOUBLE * unit_output END AS cost FROM model_sums m LEFT JOIN units u ON u.model_canon = m.key""",
    "model_units": """SELECT *, CASE WHEN priced AND total > 0 THEN cost / total * 1e6::DOUBLE ELSE 0.0::DOUBLE END AS unit FROM model_costs""",
    "day_model": """SELECT d, model_canon AS key, count(*) AS turns, CAST(sum(total) AS BIGINT) AS total, CAST(sum(output) AS BIGINT) AS output FROM turns GROUP BY 1, 2""",
    "day_cost": """SELECT d, sum(coalesce(unit, 0.0::DOUBLE) * m.total / 1e6::DOUBLE) AS cost FROM day_model m LEFT JOIN model_units u USING (key) WHERE d IS NOT NULL GROUP BY d""",
    "day_sums": """SELECT d, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(total) AS BIGINT) AS total FROM turns WHERE d IS NOT NULL GROUP BY d""",
    "ext_day_model": """SELECT tool, d, model, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(total) AS BIGINT) AS total FROM external GROUP BY 1, 2, 3""",
    "ext_day_model_cost": """SELECT m.*, CASE WHEN price_input IS NULL THEN 0.0::DOUBLE ELSE cache_read / 1e6::DOUBLE * unit_cache_read + cache_write / 1e6::DOUBLE * unit_cache_write + input / 1e6::DOUBLE * unit_input + output / 1e6::DOUBLE * unit_output END AS cost, price_input IS NOT NULL AS priced FROM ext_day_model m LEFT JOIN external_units u USING (model)""",
    "ext_models": """SELECT tool, model, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(total) AS BIGINT) AS total, sum(cost) AS cost, bool_and(priced) AS priced FROM ext_day_model_cost GROUP BY 1, 2""",
}


def oracle(sql: str) -> str:
    """The query with the views it needs in front of it."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    body = sql.strip()
    if not need:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need)
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
