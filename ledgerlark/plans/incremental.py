"""Usage of all tools, kept by tool, of which a refresh only collects what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators import external as X, ingest
from ledgerlark.operators.ingest import Manifest
from ledgerlark.plans import collect, warehouse_store
from ledgerlark.plans.kept import kept
from ledgerlark.plans.versions import Versions
from ledgerlark.sources.paths import Stamp

STATE = "tool string, path string, size bigint, changed bigint"
SUMS = "input bigint, cache_read bigint, cache_write bigint, output bigint, reasoning bigint, total bigint"
TOTALS = f"calls bigint, sessions bigint, {SUMS}, first_ts string, last_ts string, files bigint, dropped bigint, tool string"
CUBE = f"model string, d string, h string, level bigint, calls bigint, {SUMS}, tool string"


def fingerprints(files: DataFrame) -> DataFrame:
    """tool, number of files, second of the latest change, and bytes."""
    return files.groupBy("tool").agg(F.count("*").alias("files"), F.max(F.expr("changed div 1000")).alias("newest"), F.sum("size").alias("bytes"))


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """Tools of which the files aren't as they were before: those with files that have no equal fingerprint."""
    now, then = fingerprints(files), fingerprints(before)
    return now.join(then, [now[c].eqNullSafe(then[c]) for c in now.columns], "left_anti").select("tool")


@dataclass
class Refreshed:
    number: int  #: of the version that now counts
    parsed: list[str] = field(default_factory=list)
    reused: list[str] = field(default_factory=list)
    files_read: dict[str, int] = field(default_factory=dict)


class Usage:
    """Totals and cubes of tools in a folder. A version names for each tool the folder that its rows are in, so a refresh writes those of changed tools only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/usage")

    def refresh(self, manifests: Iterable[Manifest], found: dict[str, list[Stamp]], full: bool = False) -> Refreshed:
        """Collects the tools whose files changed (all, without the cache of files, if full) and publishes what then holds. found: each tool's files; a tool without files goes."""
        spark, manifests = self.spark, {m.id: m for m in manifests if m.enabled}
        if wrong := {i: p for i, m in manifests.items() if (p := m.problems())}:
            raise ValueError(f"manifests with problems: {wrong}")
        number, content = self.versions.current()
        folders = content.get("folders", {})
        files = spark.createDataFrame([(i, *s) for i in manifests for s in found.get(i, [])], STATE)
        before = spark.read.schema(STATE).parquet(self.versions.data(folders["state"])) if number and not full else spark.createDataFrame([], STATE)
        # one row for each tool
        parsed = {r["tool"] for r in changed(files, before).collect()}
        out = Refreshed(number, sorted(parsed), sorted(i for i in manifests if found.get(i) and i not in parsed))
        live = {k: f for k, f in folders.items() if k.partition(":")[2] in out.reused}
        if not parsed and live.keys() | {"state"} == folders.keys():
            return out
        if parsed:
            records = []
            for i in out.parsed:
                m, stamps = manifests[i], found[i]
                if collect.cacheable(m) and not full:
                    rows, read = collect.cached_contributions(spark, m, stamps, f"{self.root}/files")
                else:
                    rows, read = collect.contributions(spark, m, [s.path for s in stamps]), stamps
                records.append(rows)
                out.files_read[i] = len(read)
            first = X.first_wins(reduce(DataFrame.unionByName, records), ["tool", "dedup_key"], ["file", "line"], copies="copies")
            claims = kept(ingest.hours_of(first).withColumn("total", F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output")), "claims")
            used = claims.filter("has_usage")
            dropped = claims.groupBy("tool").agg(F.sum(F.col("copies") - 1).alias("dropped"))
            totals = X.tool_totals(used, ("reasoning",)).join(files.groupBy("tool").agg(F.count("*").alias("files")), "tool").join(dropped, "tool")
            for name, df, schema in (("totals", totals, TOTALS), ("cube", X.cube(used, ("reasoning",)), CUBE)):
                folder = self.versions.fresh()
                df.select(*(c.split()[0] for c in schema.split(", "))).write.partitionBy("tool").parquet(self.versions.data(folder))
                live |= {f"{name}:{i}": folder for i in out.parsed}
        live["state"] = self.versions.fresh()
        files.write.parquet(self.versions.data(live["state"]))
        out.number = self.versions.commit(number, {"folders": live})
        self.versions.vacuum()
        return out

    def _table(self, name: str, schema: str) -> DataFrame:
        _, content = self.versions.current()
        by_folder: dict[str, list[str]] = {}
        for key, folder in content.get("folders", {}).items():
            kind, _, tool = key.partition(":")
            if kind == name:
                by_folder.setdefault(folder, []).append(tool)
        parts = [self.spark.read.schema(schema).parquet(self.versions.data(f)).filter(F.col("tool").isin(tools)) for f, tools in sorted(by_folder.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        """A row for each tool with usage."""
        return self._table("totals", TOTALS)

    def cube(self) -> DataFrame:
        """The sums of external.cube, of all tools."""
        return self._table("cube", CUBE)


def rebuilt(spark: SparkSession, root: str, stamps: list[Stamp], build: Callable[[], dict[str, DataFrame]]) -> bool:
    """Publishes the tables of a warehouse anew if the files that they come from changed since it was built."""
    print_ = [len(stamps), max((s.changed // 1000 for s in stamps), default=0), sum(s.size for s in stamps)]
    _, content = Versions(spark, root).current()
    if content.get("made_from") == print_:
        return False
    warehouse_store.publish(spark, build(), root, note={"made_from": print_})
    return True
