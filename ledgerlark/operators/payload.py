"""The dashboard's payload: every block from one pass over turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.functions.models import NO_PROJECT, canonical_model, local_day, local_hour, one_decimal
from ledgerlark.operators import assembly, cost as C, exports, external as X, warehouse as W
from ledgerlark.plans.kept import kept
from ledgerlark.plans.numbering import placed

TOP = 40  #: sessions shown first
#: how the rows of each block with more than one are ordered, downwards after a minus
ORDER = {
    "models": ("-total", "key"), "days": ("d",), "dayModel": ("d", "key"), "hours": ("h",), "projects": ("-total", "name"), "sessions": ("-total", "id"), "sessionsAll": ("-total", "id"),
    "roles": ("name",), "tools": ("-n", "name"), "pricing": ("key",), "external": ("-total", "tool"), "externalDays": ("tool", "d"), "yield": ("-commits", "root"),
}


def _order(block: str) -> list[Column]:
    return [-F.col(c[1:]) if c.startswith("-") else F.col(c) for c in ORDER[block]]


def grains(turns: DataFrame) -> DataFrame:
    """Turns summed in one scan to two grains: quarter of an hour, raw model, status and usage (grain 0), and session and usage (grain 1)."""
    time = F.when(F.col("started_at") > 0, F.col("started_at"))
    rows = turns.select(F.expr(f"CASE WHEN started_at > 0 THEN started_at div {W.SLOT} END").alias("slot"), "model_raw", F.coalesce("status", F.lit("")).alias("status"), "has_usage", "session_id", time.alias("known"), "started_at", *W.SUMS)
    small, session = ["slot", "model_raw", "status"], ["session_id"]
    g = rows.groupingSets([[F.col(c) for c in (*small, "has_usage")], [F.col(c) for c in (*session, "has_usage")]], *small, *session, "has_usage")
    grain = F.grouping("slot").cast("int").alias("grain")
    return g.agg(grain, F.count("*").alias("turns"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in W.SUMS), F.min("known").alias("first_ts"), F.max("started_at").alias("last_ts"))


def _sums(names: tuple[str, ...] = W.SUMS) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names]


class Payload:
    """Blocks of one payload.

    turns and sessions are the warehouse's tables, messages has session_id, name (role), tool and is_error; prices a row for
    each model; external the deduplicated usage of tools with model and day; external_prices their prices; commits
    root, project and commits of each repository; source what meta says of where all comes from.
    """

    def __init__(self, turns: DataFrame, sessions: DataFrame, messages: DataFrame, prices: DataFrame, external: DataFrame, external_prices: DataFrame, commits: DataFrame, source: dict, home: str = "", zone: str = "UTC"):
        both = kept(grains(turns), "grains")
        self.prices, self.external, self.external_prices, self.commits, self.source, self.home = prices, external, external_prices, commits, source, home
        at = F.col("slot") * W.SLOT + 1  # the first slot begins at 0, which would be no known time
        small = both.filter("grain = 0").withColumns({"d": F.coalesce(local_day(at, zone), F.lit("")), "h": local_hour(at, zone)})
        # models are named once for each row of this grain, not for each turn
        self.usage = kept(small.withColumn("key", canonical_model(F.col("model_raw"))), "usage")
        self.by_session = both.filter("grain = 1")
        said = messages.filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("messages"))
        used = F.col("has_usage")
        per_session = self.by_session.groupBy("session_id").agg(F.sum("turns").alias("turns"), F.sum(F.when(used, F.col("turns")).otherwise(0)).alias("turns_with_usage"), *(F.sum(F.when(used, F.col(c)).otherwise(0)).alias(c) for c in W.SUMS))
        self.per_session = kept(per_session, "sessions")
        self.messages = messages
        joined = sessions.join(self.per_session, sessions.id == F.col("session_id")).drop("session_id").join(said.withColumnRenamed("session_id", "said_in"), F.col("id") == F.col("said_in"), "left").drop("said_in")
        self.sessions = sessions
        self.all_sessions = kept(joined.withColumn("messages", F.coalesce("messages", F.lit(0))), "all-sessions")

    # --- blocks; those of one row have no order

    def totals(self) -> DataFrame:
        """One row: sums, sessions, messages, projects and cache hits."""
        sums = self.usage.agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum(F.when(F.col("has_usage"), F.col("turns")).otherwise(0)), F.lit(0)).alias("turns_with_usage"), *_sums())
        one = sums.crossJoin(self.sessions.agg(F.count("*").alias("sessions"), F.count_distinct("project").alias("projects"))).crossJoin(self.messages.agg(F.count("*").alias("messages")))  # one row each
        base = F.greatest(F.lit(1), F.col("cache_read") + F.col("cache_write") + F.col("input"))
        return one.withColumn("cache_hit_pct", one_decimal(100.0 * F.col("cache_read") / base))

    def models(self) -> DataFrame:
        """Models with raw_usage and statuses, and whether they are priced."""
        sums = self.usage.groupBy("key").agg(F.sum("turns").alias("turns"), F.sum(F.when(~F.col("has_usage"), F.col("turns")).otherwise(0)).alias("missing_usage"), *_sums(), F.array_sort(F.collect_set("model_raw")).alias("raw_ids"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
        raw = self.usage.groupBy("key", F.col("model_raw").alias("rid")).agg(F.sum("turns").alias("turns"), *_sums())
        status = self.usage.groupBy("key", "status").agg(F.sum("turns").alias("n"))
        return assembly.pricing_rows(assembly.models(sums, raw, status), self.prices)

    def days(self) -> DataFrame:
        return self.usage.groupBy("d").agg(F.sum("turns").alias("turns"), *_sums())

    def day_model(self) -> DataFrame:
        return self.usage.groupBy("d", "key").agg(F.sum("turns").alias("turns"), *_sums(("total", "output")))

    def hours(self) -> DataFrame:
        return self.usage.filter("h is not null").groupBy("h").agg(F.sum("turns").alias("turns"), *_sums(("cache_read", "cache_write", "input", "output", "total")))

    def projects(self) -> DataFrame:
        used = self.per_session.filter("turns_with_usage > 0").join(self.sessions.select("id", "project"), F.col("session_id") == F.col("id"), "left")
        return used.groupBy(F.coalesce("project", F.lit(NO_PROJECT)).alias("name")).agg(F.count("*").alias("sessions"), F.sum("turns_with_usage").alias("turns"), *_sums())

    def sessions_all(self) -> DataFrame:
        """Every session with usage. This block grows with the data, so it is a table and never one value."""
        return self.all_sessions.filter("turns_with_usage > 0").drop("turns_with_usage", "reasoning")

    def sessions_top(self) -> DataFrame:
        return self.sessions_all().orderBy(*_order("sessions")).limit(TOP)

    def session_count(self) -> DataFrame:
        return self.sessions_all().agg(F.count("*").alias("sessions"))

    def roles(self) -> DataFrame:
        return W.counted(self.messages, "name", F.col("is_error"))

    def tools(self) -> DataFrame:
        return W.counted(self.messages, "tool", F.col("is_error"))

    def pricing(self) -> DataFrame:
        """Unit prices of the models that are used and have an input price."""
        used = self.usage.select("key").distinct()
        return used.join(self.prices, F.col("key") == F.col("model_canon")).filter("price_input is not null").select("key", *(c for c in self.prices.columns if c != "model_canon"))

    def pricing_meta(self) -> DataFrame:
        """One row: when prices were fetched, and how many of the models have one."""
        m = self.models().agg(F.count("*").alias("models"), F.count_if("priced").alias("priced"), F.coalesce(F.sum(F.when(~F.col("priced"), F.col("total"))), F.lit(0)).alias("unpriced_tokens"))
        return m.select("*", F.lit(self.source.get("prices_fetched_at")).cast("string").alias("fetched_at"), F.lit(self.source.get("prices_file", "")).alias("file"))

    def external_tools(self) -> DataFrame:
        """Each tool's sums, span and cost."""
        costs = X.summary(X.model_rows(X.day_model_cost(self.external, self.external_prices))).select("tool", "models", F.col("cost"))
        return X.tool_totals(self.external).join(costs, "tool", "left")

    def external_days(self) -> DataFrame:
        return X.by(self.external, "tool", "d")

    def yields(self) -> DataFrame:
        """Commits of each repository and the project that it belongs to."""
        return self.commits

    def meta(self) -> DataFrame:
        """One row; the range of days is that of all sides."""
        times = self.usage.agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
        days = C.span(self.days(), self.external_days())
        tools = self.external_days().agg(F.count_distinct("tool").alias("tools"))
        block = assembly.meta(times, self.source, self.home).crossJoin(days).crossJoin(tools)  # one row each
        return block.withColumns({"range_start": F.coalesce("first_day", "range_start"), "range_end": F.coalesce("last_day", "range_end")}).drop("first_day", "last_day")

    def blocks(self) -> dict[str, DataFrame]:
        return {
            "meta": self.meta(), "totals": self.totals(), "models": self.models(), "days": self.days(), "dayModel": self.day_model(), "hours": self.hours(), "projects": self.projects(), "sessions": self.sessions_top(), "sessionsAll": self.sessions_all(),
            "sessionCount": self.session_count(), "roles": self.roles(), "tools": self.tools(), "pricing": self.pricing(), "pricingMeta": self.pricing_meta(), "external": self.external_tools(), "externalDays": self.external_days(), "yield": self.yields(),
        }

    def document(self) -> DataFrame:
        """One JSON text of all blocks but sessionsAll, which grows with the data: write that as a table beside it."""
        parts = []
        for name, block in self.blocks().items():
            if name in ORDER and name != "sessionsAll":
                parts.append(exports.nested(name, block, _order(name)))
            elif name != "sessionsAll":
                parts.append(block.select(F.struct(*block.columns).alias(name)))
        return exports.document(parts)

    def rows(self) -> DataFrame:
        """block, place (from 1, in the block's order) and value (a variant) of every entry of every block."""
        out = []
        for name, block in self.blocks().items():
            value = F.to_variant_object(F.struct(*block.columns)).alias("value")
            if name == "sessionsAll":
                numbered = placed(block, _order(name))
                out.append(numbered.select(F.lit(name).alias("block"), "place", value))
            else:
                place = F.row_number().over(Window.orderBy(*_order(name))).cast("long") if name in ORDER else F.lit(1).cast("long")  # blocks of models, days, projects or tools
                out.append(block.select(F.lit(name).alias("block"), place.alias("place"), value))
        return reduce(DataFrame.unionByName, out)
