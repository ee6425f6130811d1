"""Log-shaped inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlark.functions.models import canonical_model

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: a turn of an agent session."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey)
    q, used = F.floor("l_quantity").cast("long"), F.col("l_discount") > 0.005
    pick = lambda key, *values: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    raw = F.concat(pick("l_partkey", "azure-", "openai/", "", "kimi/"), F.lower(F.translate("p_brand", "#", "-")), pick("l_suppkey", "", "--int", "-ga-260731"))
    hour = _days(F.col("l_shipdate")) * 24 + (3 * F.col("l_linenumber") + q) % 24
    count = lambda c: F.when(used, c.cast("long")).otherwise(F.lit(0).cast("long"))
    out = j.select(
        F.concat(F.lit("s"), F.col("l_orderkey")).alias("session_id"),
        F.when(F.col("l_linenumber") <= 5, "pi").otherwise("pi-cli").alias("tool"),
        raw.alias("model_raw"),
        F.when(~((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")), hour * HOUR_MS).alias("started_at"),
        F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "aborted").otherwise("completed").alias("status"),
        used.alias("has_usage"),
        count(F.floor("l_extendedprice")).alias("cache_read"),
        count(F.col("l_partkey") % 500).alias("cache_write"),
        count(10 * q).alias("input"),
        count(3 * q + 1).alias("output"),
        count(q).alias("reasoning"),
    )
    total = F.col("cache_read") + F.col("cache_write") + F.col("input") + F.col("output")
    return out.withColumns({"total": total, "model_canon": canonical_model(F.col("model_raw"))})


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    created = _days(F.col("o_orderdate")) * 24 * HOUR_MS
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.concat(F.lit("s"), F.col("o_orderkey")).alias("id"),
        F.concat(F.lit("order "), F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("c_mktsegment")).alias("project"),
        created.alias("created_at"),
        (created + (F.col("o_orderkey") % 40) * 28_800_000).alias("updated_at"),
    )


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records of five tools, before deduplication."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("tool"),
        F.concat(F.lit("ext-"), F.col("user_id") % 6).alias("model"),
        F.col("user_id").cast("string").alias("session"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z")).alias("ts"),
        F.get_json_object("props", "$.k").cast("long").alias("input"),
        F.floor(F.col("value") * 100).cast("long").alias("cache_read"),
        F.lit(0).cast("long").alias("cache_write"),
        F.floor("value").cast("long").alias("output"),
        F.concat_ws("|", F.col("user_id"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH")).alias("dedup_key"),
        F.col("event_id").alias("ord"),
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user: running totals that start again at an error, and context lines (signup) that name a model."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    runs = e.withColumn("run", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w))
    total = F.sum("k").over(Window.partitionBy("user_id", "run").orderBy("event_id"))
    return runs.withColumn("total", total).select(
        F.concat(F.lit("log"), F.col("user_id")).alias("file"),
        F.col("event_id").alias("line"),
        F.col("day"),
        F.col("total"),
        F.col("k").alias("last"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("model-"), F.col("k") % 4)).alias("context_model"),
    )


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id")).alias("stem"), F.col("turn").alias("ord"), "role", F.length("text").cast("long").alias("tokens"), "text")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each canonical model of `turns`: brand-N costs by N; some prices are missing."""
    n = F.regexp_extract("model_canon", "([0-9]+)$", 1).cast("long")
    brands = table(spark, sf_dir, "part").select(F.lower(F.translate("p_brand", "#", "-")).alias("model_canon")).distinct().withColumn("n", n)
    return brands.select(
        "model_canon",
        F.when(F.col("n") % 7 != 0, F.col("n") / F.lit(10.0)).alias("price_input"),
        (F.col("n") / F.lit(2.0)).alias("price_output"),
        F.when(F.col("n") % 5 != 0, F.col("n") / F.lit(100.0)).alias("price_cache_read"),
        F.when(F.col("n") % 3 != 0, F.col("n") / F.lit(8.0)).alias("price_cache_write"),
    )


def external_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of ext-0 to ext-4; ext-5 has none."""
    k = F.col("k")
    return spark.range(5).withColumnRenamed("id", "k").select(
        F.concat(F.lit("ext-"), k).alias("model"),
        (k + F.lit(1.0)).alias("price_input"),
        F.when(k != 3, (k + F.lit(1.0)) * 4).alias("price_output"),
        F.when(k % 2 == 0, (k + F.lit(1.0)) / 10).alias("price_cache_read"),
        F.lit(None).cast("double").alias("price_cache_write"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines as a tool would write them, from events: file, line, value."""
    e = table(spark, sf_dir, "events")
    usage = F.struct(F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.floor(F.col("value") * 3).cast("long").alias("cached"), F.floor("value").cast("long").alias("output_tokens"), (F.col("user_id") % 50).alias("thinking"))
    message = F.struct(F.concat(F.lit("m"), F.col("event_id") % 4000).alias("id"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("ext-"), F.col("user_id") % 6)).alias("model"), F.when(F.col("event_type") != "error", usage).alias("usage"))
    row = F.struct(F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), message.alias("message"))
    return e.select(F.concat(F.lit("f"), F.col("user_id") % 10).alias("file"), F.lit("dir").alias("dir"), F.col("event_id").alias("line"), F.to_json(row).alias("value"))
