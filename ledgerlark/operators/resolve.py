"""From observed model ids to prices: candidate keys, alias match and catalogue resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Gateway prefixes that stand for a path, and provider paths to try last, in order.
DASH_PREFIXES = ("azure-", "vertex-", "bedrock-", "openai-", "anthropic-", "google-")
PROVIDER_PATHS = ("", "openai/", "azure/", "anthropic/", "gemini/", "vertex_ai/", "moonshot/", "moonshotai/", "deepseek/", "openrouter/openai/", "openrouter/anthropic/", "openrouter/google/")
# Suffixes that are peeled off, one after the other.
PEELS = (r"--?int\z", r"--?ga[-_]?[0-9]{4,6}\z", r"-[0-9]{6}\z", r"\([^)]*\)\z", r"(?i)-+(?:x-?high|x-?low|efficiency|think(?:ing)?-high)\z")
# Providers that list others' models under their own name, and the scores of candidates.
AGGREGATORS = ("openrouter", "302ai", "siliconflow", "novita", "together", "fireworks-ai", "nebius", "hyperbolic")
NAMED, PUBLISHER, RESELLER, AGGREGATOR = 400, 300, 100, 50


def _tail(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def key_ladder(model: Column) -> Column:
    """Keys under which a model may be listed, the most literal first; none for a model without a name.

    Each step adds what it makes of every key so far: a gateway's prefix as a path, suffixes peeled off one after the other,
    what follows the first and the last slash, and at last every key's end behind each provider's path.
    """
    some = lambda keys: F.filter(keys, lambda k: k != "")
    gateway = F.coalesce(*(F.when(model.startswith(p), F.concat(F.lit(f"{p[:-1]}/"), F.substr(model, F.lit(len(p) + 1)))) for p in DASH_PREFIXES))
    forms = F.array_compact(F.array(F.nullif(model, F.lit("")), gateway))
    peeled = F.reduce(F.array(*map(F.lit, PEELS)), forms, lambda keys, p: F.array_distinct(F.concat(keys, some(F.transform(keys, lambda k: F.regexp_replace(k, p, F.lit("")))))))
    # a lambda's argument is computed once, however often it is used
    ends = lambda keys: F.array_distinct(F.concat(keys, some(F.flatten(F.transform(F.filter(keys, lambda k: F.contains(k, F.lit("/"))), lambda k: F.array(F.substr(k, F.instr(k, "/") + 1), _tail(k)))))))
    paths = F.array(*map(F.lit, PROVIDER_PATHS))
    guessed = lambda keys: F.array_distinct(F.concat(keys, some(F.flatten(F.transform(keys, lambda k: F.transform(paths, lambda p: F.concat(p, _tail(k))))))))
    step = lambda keys, f: F.transform(F.array(keys), f)[0]
    return step(step(peeled, ends), guessed)


def candidates(ids: DataFrame, column: str = "model") -> DataFrame:
    """column, pos, candidate for each distinct id."""
    distinct = ids.select(column).distinct()
    return distinct.select(column, F.posexplode(key_ladder(F.col(column))).alias("pos", "candidate"))


def alias_index(prices: DataFrame) -> DataFrame:
    """alias -> target for a price table (target, aliases): targets, their last parts and their aliases, in lower case. The smallest target wins."""
    all_names = F.concat(F.array("target", F.substring_index("target", "/", -1)), F.coalesce("aliases", F.array().cast("array<string>")))
    return prices.select("target", F.explode(all_names).alias("alias")).groupBy(F.lower("alias").alias("alias")).agg(F.min("target").alias("target"))


def match_prices(ids: DataFrame, prices: DataFrame, column: str = "model") -> DataFrame:
    """column, target, pos: the price whose alias comes first on the id's ladder."""
    found = candidates(ids, column).withColumn("alias", F.lower("candidate")).join(alias_index(prices), "alias")
    return found.groupBy(column).agg(F.min_by("target", "pos").alias("target"), F.min("pos").alias("pos"))


def price_models(ids: DataFrame, prices: DataFrame, column: str = "model") -> DataFrame:
    """column, target, via: a free tail costs nothing; a match without an input price is unpriced."""
    hit = match_prices(ids, prices, column).join(prices.select("target", "price_input"), "target", "left")
    j = ids.select(column).distinct().join(hit, column, "left")
    free = F.col(column).rlike("(?i)[-:]free$")
    via = F.when(free, "free").when(F.col("price_input").isNotNull(), "catalogue").otherwise("unpriced")
    return j.select(column, F.when(via != "unpriced", F.when(~free, F.col("target"))).alias("target"), via.alias("via"), F.when(free, 0.0).otherwise(F.col("price_input")).alias("price_input"))


def publishers(catalogue: DataFrame) -> DataFrame:
    """Entries that another entry names as its origin."""
    return catalogue.filter("coalesce(canonical_id, '') <> '' and canonical_id <> full_id").select(F.col("canonical_id").alias("full_id")).distinct()


def resolve(ids: DataFrame, catalogue: DataFrame, column: str = "model") -> DataFrame:
    """column, full_id, priced: each id's catalogue entry (full_id, provider, model, canonical_id, price_input).

    An id that is itself a full key is that entry. Else every entry on the ladder, by full key and
    (unless a publisher's or a named entry with a price was found) by last part, is scored, and the best with a price wins; the first without
    one is the last resort.
    """
    distinct = ids.select(column).distinct()
    listed = catalogue.join(publishers(catalogue).withColumn("lab", F.lit(True)), "full_id", "left").withColumn("leaf", F.substring_index("model", "/", -1)).drop("model")
    exact = distinct.join(listed, distinct[column] == listed.full_id).select(column, "full_id", F.col("price_input").isNotNull().alias("priced"))
    steps = candidates(distinct.join(exact.select(column), column, "left_anti"), column)
    full = steps.join(listed, steps.candidate == listed.full_id).withColumn("stage", F.lit(1))
    leaf = steps.join(listed, steps.candidate == listed.leaf).withColumn("stage", F.lit(2))
    cols = [column, "pos", "full_id", "provider", "lab", "price_input", "stage"]
    obs, p = F.lower(column), F.lower("provider")
    score = F.when(F.contains(obs, F.concat(p, F.lit("/"))) | obs.startswith(F.concat(p, F.lit("-"))), NAMED).when(F.col("lab"), PUBLISHER).when(p.isin(*AGGREGATORS), AGGREGATOR).otherwise(RESELLER)
    both = full.select(*cols).unionByName(leaf.select(*cols)).withColumn("score", score)
    best_full = F.max(F.when((F.col("stage") == 1) & F.col("price_input").isNotNull(), F.col("score")))
    settled = both.groupBy(column).agg(F.coalesce(best_full, F.lit(-1)).alias("best_full"))
    open_ = both.join(settled, column).filter((F.col("stage") == 1) | (F.col("best_full") < PUBLISHER))
    has = F.col("price_input").isNotNull()
    rank = F.struct(F.when(has, 0).otherwise(1), F.when(has, -F.col("score")).otherwise(0), "stage", "pos", "full_id")
    chosen = open_.groupBy(column).agg(F.min_by(F.struct("full_id", has.alias("priced")), rank).alias("v"))
    return exact.unionByName(chosen.select(column, "v.full_id", "v.priced"))


def price_table(resolved: DataFrame, catalogue: DataFrame, column: str = "model") -> DataFrame:
    """target, full_id, ids, match: one row for each priced entry in use; targets that two entries share carry the provider."""
    j = resolved.filter("priced").join(catalogue.select("full_id", "provider", F.substring_index("full_id", "/", -1).alias("leaf")), "full_id")
    g = j.groupBy("full_id", "provider", "leaf").agg(F.concat_ws("|", F.array_sort(F.collect_set(column))).alias("ids"), F.count("*").alias("n"), F.bool_or(F.col(column) == F.col("full_id")).alias("exact"))
    same = g.groupBy("leaf").agg(F.count("*").alias("entries"), F.min("provider").alias("first_provider"))
    target = F.when((F.col("entries") > 1) & (F.col("provider") != F.col("first_provider")), F.concat("leaf", F.lit("@"), "provider")).otherwise(F.col("leaf"))
    return g.join(same, "leaf").select(target.alias("target"), "full_id", "ids", "n", F.when(F.col("exact"), "exact").otherwise("normalised").alias("match"))


def overrides(catalogue: DataFrame, custom: DataFrame, manual: DataFrame) -> DataFrame:
    """Prices by precedence: manual, then custom, then catalogue; each is (key, price_input, price_output)."""
    side = lambda df, p: df.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("price_input", "price_output")), F.lit(True).alias(f"{p}_has"))
    j = side(catalogue, "l").join(side(custom, "c"), "key", "full_outer").join(side(manual, "m"), "key", "full_outer")
    pick = lambda c: F.when(F.col("m_has"), F.coalesce(f"m_{c}", f"c_{c}", f"l_{c}")).when(F.col("c_has"), F.col(f"c_{c}")).otherwise(F.col(f"l_{c}"))
    via = F.when(F.col("m_has"), "manual").when(F.col("c_has"), "custom").when(F.col("l_price_input").isNotNull(), "catalogue").otherwise("missing")
    return j.select("key", pick("price_input").alias("price_input"), pick("price_output").alias("price_output"), via.alias("via"))
