"""Whole results as nested rows, and price tables as they are loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def nested(key: str, rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows as one array of structs, in order. For exports of aggregates, which are small."""
    columns = [F.col(c) for c in rows.columns]
    packed = rows.select(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), F.struct(*columns).alias("v")).alias("s"))
    return packed.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias(key))


def document(parts: list[DataFrame]) -> DataFrame:
    """One JSON text of one-row parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("payload"))


def custom_prices(raw: DataFrame) -> DataFrame:
    """Prices of a user's JSON map (column value), from name to prices or to an object with `cost`; names in lower case, input and output required."""
    entry = F.from_json("value", "map<string,string>")
    each = raw.select(F.explode(entry).alias("name", "price"))
    cost = F.coalesce(F.get_json_object("price", "$.cost"), F.col("price"))
    number = lambda k: F.get_json_object(cost, f"$.{k}").try_cast("double")
    out = each.select(F.lower(F.trim("name")).alias("key"), number("input").alias("price_input"), number("output").alias("price_output"), number("cache_read").alias("price_cache_read"), number("cache_write").alias("price_cache_write"))
    return out.filter("price_input is not null and price_output is not null and key <> ''")


def catalogue_stats(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count_distinct("provider").alias("providers"), F.count("*").alias("models"), F.count_if(F.col("price_input").isNotNull()).alias("with_input"))


def confidence(resolved: DataFrame, column: str = "model") -> DataFrame:
    """How sure a resolution is: high where the id is a full key."""
    return resolved.withColumn("confidence", F.when(F.col(column) == F.col("full_id"), "high").otherwise("medium"))


def price_settings(overrides: DataFrame, policy: str) -> DataFrame:
    """One JSON text of a user's own prices (key and price_ columns, null ones left out) and the policy for missing ones. Overrides are typed by hand, so they are few."""
    names = [c for c in overrides.columns if c.startswith("price_")]
    prices = F.struct(*(F.col(c).alias(c.removeprefix("price_")) for c in names))
    packed = overrides.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", prices.alias("v"))))).alias("overrides"))
    return packed.select(F.to_json(F.struct("overrides", F.lit(policy).alias("policy"))).alias("value"))


def imported_settings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The overrides (key and the four prices) and the policy (a row, or none where the text has none) of such a text (column value). What isn't an object has neither."""
    each = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.overrides"), "map<string,struct<input:double,output:double,cache_read:double,cache_write:double>>")).alias("key", "p"))
    policy = raw.select(F.get_json_object("value", "$.policy").alias("policy")).filter("policy is not null")
    return each.select("key", *(F.col(f"p.{c}").alias(f"price_{c}") for c in ("input", "output", "cache_read", "cache_write"))), policy
