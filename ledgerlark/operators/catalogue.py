"""Price tables as they are loaded: the public catalogue, the curated table and its age."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PRICES = ("input", "output", "cache_read", "cache_write")
MOST_AGE = 7  #: days after which a price table is stale

_MODEL = "struct<name: string, canonical_model_id: string, cost: struct<" + ", ".join(f"{p}: double" for p in PRICES) + ">>"


def parsed(documents: DataFrame, column: str = "value") -> DataFrame:
    """A row for each model of each provider of catalogue documents: full_id, provider, model, leaf, name, canonical_id and prices. A leaf keeps all its candidates, as providers differ in price."""
    doc = F.from_json(F.col(column), f"map<string, struct<models: map<string, {_MODEL}>>>")
    each = documents.select(F.explode(doc).alias("provider", "p")).select("provider", F.explode("p.models").alias("model", "m"))
    return each.select(
        F.concat("provider", F.lit("/"), "model").alias("full_id"), "provider", "model", F.substring_index("model", "/", -1).alias("leaf"), F.coalesce("m.name", F.lit("")).alias("name"),
        F.nullif("m.canonical_model_id", F.lit("")).alias("canonical_id"), *(F.col(f"m.cost.{p}").alias(f"price_{p}") for p in PRICES),
    )


def curated(documents: DataFrame, column: str = "value") -> DataFrame:
    """target, its whole entry as JSON and its prices, of a table {fetchedAt, models: [...]}. Of entries with one target the last counts; those without are left out."""
    doc = F.from_json(F.col(column), "struct<fetchedAt: string, models: array<string>>")
    each = documents.select(doc.alias("doc")).select(F.col("doc.fetchedAt").alias("fetched_at"), F.posexplode("doc.models").alias("i", "entry"))
    named = each.withColumn("target", F.nullif(F.get_json_object("entry", "$.target"), F.lit(""))).filter("target is not null")
    last = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("i")))
    one = named.withColumn("rn", last).filter("rn = 1")
    return one.select("target", "entry", "fetched_at", *(F.get_json_object("entry", f"$.cost.{p}").cast("double").alias(f"price_{p}") for p in PRICES))


def freshness(tables: DataFrame, now: str, most: int = MOST_AGE) -> DataFrame:
    """tables (path, fetched_at; there: is there a table at all) with age_days, stale and why. A table that is missing or has no readable date is stale."""
    day = F.when(F.substring("fetched_at", 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring("fetched_at", 1, 10).try_cast("date"))
    age = F.when(F.col("there"), F.datediff(F.lit(now).cast("date"), day).cast("long"))
    why = F.when(~F.col("there"), "missing").when(age.isNull(), "unreadable").when(age > most, "old").otherwise("")
    return tables.select("path", age.alias("age_days"), (why != "").alias("stale"), why.alias("reason"))
