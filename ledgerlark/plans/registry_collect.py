"""Registered queries on files: each writes logs from the tables to a folder of its own, collects them, and equals SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators import ingest as I, warehouse as W
from ledgerlark.plans import collect, incremental, views as V, warehouse_store
from ledgerlark.plans.kept import folder, kept
from ledgerlark.plans.registry import query
from ledgerlark.sources import paths as P, readers
from ledgerlark.streaming import usage

#: of every log's folder: a blank, an umlaut, a plus and per cent signs, which the writer escapes once and a reader's URI twice
ODD = " ü+x 100%"
ON_DISK = " ü+x 100%25"
FIELDS = {"model": ["message.model"], "time": ["timestamp"], "input": ["message.usage.input_tokens"], "cacheRead": ["message.usage.cached"], "output": ["message.usage.output_tokens"]}


def _manifest(name: str) -> I.Manifest:
    return I.Manifest.of({"id": name, "paths": ["-"], "prefilter": ['"usage"', '"error"'], "require": ["message.usage"], "dedup": ["message.id"], "fields": FIELDS})


def _root(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name} ä {uuid.uuid4().hex}"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with the event they come from: event (its number), k (its file) and type."""
    return V.raw_records(spark, d).select(F.col("line").alias("event"), F.substring("file", 2, 9).cast("int").alias("k"), F.get_json_object("value", "$.type").alias("type"), "value")


def _write(lines: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each log, with its lines in the order of events; overwriting replaces the logs that lines has."""
    dealt = lines.repartition("log").sortWithinPartitions("log", "event").select("log", "value")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("log").text(path)


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("input", "cache_read", "output")))


_SQL_SUMS = "count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cache_read, CAST(sum(output_tokens) AS BIGINT) AS output"
_USED = "has AND input_tokens + cached + output_tokens > 0"

# --- lines of files in many splits


def _jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    root = _root(spark, "lines")
    lines = _lines(spark, d)
    # some lines are noise, some have white space around them
    text = F.when(F.col("event") % 7 == 3, F.concat(F.lit("\t"), "value", F.lit("\r"))).when(F.col("event") % 11 == 5, F.concat(F.lit("# "), "value")).otherwise(F.col("value"))
    _write(lines.withColumns({"log": F.concat("k", F.lit(ODD)), "value": text}), f"{root}/logs")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "65536")
    try:
        found = readers.jsonl(spark, [s.path for s in P.listed(spark, f"{root}/logs") if s.path.endswith(".txt")], ('"purchase"', '"click"'))
        ids = I.decoded(found).select("dir", "line", I.dig(F.col("obj"), "message.id").alias("id"), I.dig(F.col("obj"), "type").alias("type"))
        return kept(ids, "scanned")
    finally:
        spark.conf.set(setting, before)


query("jsonl_scan", f"""SELECT 'log=' || k || '{ON_DISK}' AS dir, line, id, type FROM (SELECT substr(file, 2) AS k, row_number() OVER (PARTITION BY file ORDER BY line) AS line, id, type, line AS event FROM raw_records)
 WHERE type IN ('purchase', 'click') AND (event % 7 = 3 OR event % 11 <> 5)""")(_jsonl_scan)

# --- a cache of what files gave, after some of them changed


def _replay(spark: SparkSession, d: str) -> DataFrame:
    """Logs 0 and 1 grow, 2 is cut, 3 is new, 4 goes; then everything is collected again, the others from the cache."""
    root, k, event = _root(spark, "replay"), F.col("k"), F.col("event")
    lines = kept(_lines(spark, d).withColumn("log", F.concat("k", F.lit(ODD))), "lines")
    logs = f"{root}/logs"
    _write(lines.filter(F.when(k < 2, event % 2 == 0).otherwise(k != 3)), logs)
    stamps = lambda: [s for s in P.listed(spark, logs) if s.path.endswith(".txt")]
    cache = collect.Cache(spark, _manifest("events"), f"{root}/cache")
    cache.collect(stamps())
    _write(lines.filter((k < 2) | ((k == 2) & (event % 3 == 0)) | (k == 3)), logs, "overwrite")
    now = [s for s in stamps() if "/log=4" not in s.path]
    merged, read = cache.collect(now)
    return _sums(I.deduplicated(merged).withColumn("read_again", F.col("file").isin(read)), "session", "model", "read_again")


query("replay_merge", f"""WITH f AS (SELECT *, CAST(substr(file, 2) AS INTEGER) AS k FROM raw_records WHERE file <> 'f4' AND (file <> 'f2' OR line % 3 = 0) AND (has OR type = 'error')),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, line) AS rn FROM f)
 SELECT 'log=' || k || '{ON_DISK}' AS session, coalesce(model, '(unknown)') AS model, k <= 3 AS read_again, {_SQL_SUMS} FROM o WHERE rn = 1 AND {_USED} GROUP BY 1, 2, 3""")(_replay)

# --- a refresh in which two of five tools changed


def _refresh(spark: SparkSession, d: str) -> DataFrame:
    root, event = _root(spark, "refresh"), F.col("event")
    lines = kept(_lines(spark, d).withColumn("late", F.col("type").isin("click", "view") & (event % 5 == 0)), "lines")
    names = ["click", "error", "purchase", "signup", "view"]
    log = F.concat(F.when(F.col("late"), "b").otherwise("a"), "k", F.lit(ODD))

    def write(late: bool) -> None:
        for name in names:
            mine = lines.filter((F.col("late") == late) & (F.col("type") == name)).withColumn("log", log)
            if not late or name in ("click", "view"):
                _write(mine, f"{root}/{name} logs")

    found = lambda: {n: [s for s in P.listed(spark, f"{root}/{n} logs") if s.path.endswith(".txt")] for n in names}
    use, manifests = incremental.Usage(spark, f"{root}/use"), [_manifest(n) for n in names]
    write(False)
    use.refresh(manifests, found())
    write(True)
    second = use.refresh(manifests, found())
    read = F.create_map(*(F.lit(x) for n in names for x in (n, second.files_read.get(n, 0))))
    day = use.cube().filter("level = 5").select("tool", "d", "calls", "input", "cache_read", "output")
    per_tool = use.totals().select("tool", F.col("files").alias("n_files"), "dropped", F.col("tool").isin(second.parsed).alias("parsed"), read[F.col("tool")].cast("long").alias("files_read"))
    return day.join(per_tool, "tool")


query("incremental_refresh", f"""WITH l AS (SELECT *, CASE WHEN type IN ('click', 'view') AND line % 5 = 0 THEN 'b' ELSE 'a' END || substr(file, 2) AS log FROM raw_records),
 c AS (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY log, line) AS rn FROM l WHERE has OR type = 'error'),
 t AS (SELECT type AS tool, count(DISTINCT log) AS n_files, count(DISTINCT CASE WHEN log LIKE 'b%' THEN log END) AS files_read FROM l GROUP BY 1), dr AS (SELECT type AS tool, count(*) FILTER (WHERE rn > 1) AS dropped FROM c GROUP BY 1)
 SELECT tool, d, calls, input, cache_read, output, n_files, CAST(dropped AS BIGINT) AS dropped, files_read > 0 AS parsed, CAST(files_read AS BIGINT) AS files_read FROM (SELECT type AS tool, substr(timestamp, 1, 10) AS d, count(*) AS calls,
  CAST(sum(input_tokens) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cache_read, CAST(sum(output_tokens) AS BIGINT) AS output FROM c WHERE rn = 1 AND {_USED} GROUP BY 1, 2) JOIN t USING (tool) JOIN dr USING (tool)""")(_refresh)

# --- a warehouse that is built again while it is read


def _publish(spark: SparkSession, d: str) -> DataFrame:
    root = _root(spark, "warehouse")
    t = V.turns(spark, d)

    def build(turns: DataFrame) -> dict[str, DataFrame]:
        return {"models": W.models(turns), "days": W.days(turns), "hours": W.hours(turns)}

    warehouse_store.publish(spark, build(t.filter("tool = 'pi'")), root)
    old = warehouse_store.Warehouse.open(spark, root)
    warehouse_store.publish(spark, build(t), root)
    new = warehouse_store.Warehouse.open(spark, root)
    shown = [w.table(name).select(F.lit(w.number).cast("long").alias("version"), F.lit(name).alias("block"), F.col(key).alias("name"), F.col("total").cast("long").alias("total")) for w in (old, new) for name, key in (("models", "key"), ("days", "d"), ("hours", "h"))]
    out = shown[0]
    for df in shown[1:]:
        out = out.unionByName(df)
    return out


_BLOCKS = " UNION ALL ".join(f"SELECT {v} AS version, '{block}' AS block, {key} AS name, CAST(sum(total) AS BIGINT) AS total FROM turns WHERE {where} GROUP BY 3" for v, rows in ((1, "tool = 'pi'"), (2, "true")) for block, key, where in (("models", "model_canon", rows), ("days", "coalesce(d, '')", rows), ("hours", "h", f"h IS NOT NULL AND {rows}")))
query("warehouse_versions", f"SELECT CAST(version AS BIGINT) AS version, block, name, total FROM ({_BLOCKS})")(_publish)

# --- documents: arrays, single objects, and files that turn out to be lines


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Conversations in 30 files: of each three, one holds an array, one an object with an array, and one lines."""
    root, g = _root(spark, "documents"), F.col("g")
    entry = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.col("n").alias("turns")))
    c = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select((F.col("conv_id") % 30).cast("int").alias("g"), "conv_id", entry.alias("entry"))
    kept_ = kept(c, "documents")
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "entry"))), lambda x: x["entry"]), ",\n ")
    whole = kept_.filter(g % 3 != 2).groupBy("g").agg(all_.alias("all")).select("g", F.lit(0).cast("long").alias("event"), F.when(g % 3 == 0, F.concat(F.lit(" [\n"), "all", F.lit("]\n"))).otherwise(F.concat(F.lit('{"group": '), g, F.lit(', "items": ['), "all", F.lit("]}"))).alias("value"))
    lines = kept_.filter(g % 3 == 2).select("g", F.col("conv_id").alias("event"), F.col("entry").alias("value"))
    _write(whole.unionByName(lines).withColumn("log", F.concat("g", F.lit(ODD))), f"{root}/docs")
    found = readers.documents(spark, [s.path for s in P.listed(spark, f"{root}/docs") if s.path.endswith(".txt")])
    obj = F.col("obj")
    return found.select("dir", "line", I.dig(obj, "sessionId").alias("session"), I.dig(obj, "group", "bigint").alias("grp"), F.coalesce(I.dig(obj, "turns", "bigint"), F.size(F.try_variant_get(obj, "$.items", "array<variant>")).cast("long")).alias("n"))


# a file of one line is one document
query("documents_scan", f"""WITH c AS (SELECT conv_id, conv_id % 30 AS g, count(*) AS n FROM conversations GROUP BY 1, 2), p AS (SELECT *, CASE WHEN g % 3 = 2 AND count(*) OVER (PARTITION BY g) = 1 THEN 0 ELSE row_number() OVER (PARTITION BY g ORDER BY conv_id) END AS line FROM c)
 SELECT 'log=' || g || '{ON_DISK}' AS dir, line, 's' || conv_id AS session, CAST(NULL AS BIGINT) AS grp, n FROM p WHERE g % 3 <> 1 UNION ALL SELECT 'log=' || g || '{ON_DISK}', 0, NULL, g, count(*) FROM c WHERE g % 3 = 1 GROUP BY g""")(_documents)

# --- a collection of several tools: which file belongs to whom, and what a subset of tools gives


def _usage(spark: SparkSession, d: str, chosen: tuple[str, ...]) -> DataFrame:
    """Files of five tools, of which two name some of the same files; only the chosen tools are collected."""
    root = _root(spark, "tools")
    lines = _lines(spark, d).withColumn("log", F.concat("type", F.lit(" "), "k", F.lit(ODD)))
    _write(lines, f"{root}/logs")
    stamps = [s for s in P.listed(spark, f"{root}/logs") if s.path.endswith(".txt")]
    # the first names all files of clicks and views, the second views and errors, the third errors and the rest
    names = {"a": ("click", "view"), "b": ("view", "error", "signup"), "c": ("error", "purchase")}
    manifests = [_manifest(n) for n in names]
    owned, _ = P.claim((m, [s.path for s in stamps if s.path.rpartition("/log=")[2].split(" ")[0] in names[m.id]]) for m in manifests)
    parts = [I.deduplicated(collect.contributions(spark, m, owned[m.id])) for m in manifests if m.id in chosen]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _sums(out, "tool", "model")


_OWNER = "CASE type WHEN 'click' THEN 'a' WHEN 'view' THEN 'a' WHEN 'error' THEN 'b' WHEN 'signup' THEN 'b' ELSE 'c' END"
query("claimed_collection", f"""WITH f AS (SELECT *, {_OWNER} AS tool, row_number() OVER (PARTITION BY {_OWNER}, id ORDER BY type, file, line) AS rn FROM raw_records WHERE has OR type = 'error')
 SELECT tool, coalesce(model, '(unknown)') AS model, {_SQL_SUMS} FROM f WHERE rn = 1 AND {_USED} AND tool IN ('a', 'c') GROUP BY 1, 2""")(lambda s, d: _usage(s, d, ("a", "c")))

# --- usage records as a stream


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Records arrive in files, repeated ones in any batch. Hours are appended when they can't change any more; two late records, which don't count, close the last ones."""
    root = _root(spark, "stream")
    used = F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output")
    records = V.external(spark, d).select("tool", "dedup_key", F.to_timestamp_ntz(F.substring("ts", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp").alias("ts"), used.alias("total"))
    records.repartition(6).write.parquet(f"{root}/in")
    for k in (1, 2):
        records.agg(F.lit("(end)").alias("tool"), F.lit(f"end {k}").alias("dedup_key"), (F.max("ts") + F.make_interval(days=F.lit(200 * k))).alias("ts"), F.lit(1).cast("long").alias("total")).write.mode("append").parquet(f"{root}/in")
    hours = usage.hourly(usage.deduplicated(usage.read(spark, f"{root}/in", records.schema, 2), "100 days").filter("total > 0"))
    usage.write(hours, f"{root}/out", f"{root}/state").awaitTermination()
    out = spark.read.schema(hours.schema).parquet(f"{root}/out").filter("tool <> '(end)'")
    return out.select("tool", F.date_format("hour", "yyyy-MM-dd HH").alias("h"), "n")


# which of several copies comes first is up to the batches, so their tokens aren't compared
query("stream_dedup_hourly", "SELECT tool, replace(h, 'T', ' ') AS h, count(*) AS n FROM external GROUP BY 1, 2")(_stream)
