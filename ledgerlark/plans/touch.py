"""One refresh of all that is shown: usage of external tools, and the warehouse of the own database and the command line's sessions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators import cli_sessions, warehouse as W
from ledgerlark.operators.ingest import Manifest
from ledgerlark.plans.incremental import Refreshed, Usage, rebuilt
from ledgerlark.sources import cli, own_store, paths as P

TURNS = ("session_id", "tool", "model_raw", "model_canon", "status", "started_at", "ended_at", *W.SUMS, "has_usage")
SESSIONS = ("id", "title", "project", "model_raw", "mode", "thinking", "created_at", "updated_at", "turns", "messages")


@dataclass
class Touched:
    usage: Refreshed
    rebuilt: bool  #: whether the warehouse was built anew
    source: str = ""  #: the database that it comes from; empty if there is none


def merged(own: dict[str, DataFrame], logs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of a warehouse from the own database's and from collected session logs, whose sessions the database doesn't have. Counters of roles and tools are added up."""
    log_turns = logs["turns"].withColumnRenamed("session", "session_id")
    log_sessions = logs["sessions"].withColumn("title", F.lit(""))
    names = log_sessions.select(F.col("project").alias("name")).distinct().join(own["projects"].select("name"), "name", "left_anti")
    projects = own["projects"].unionByName(names.select(F.lit(None).cast("long").alias("id"), "name", F.lit("").alias("path")))
    return {
        "turns": own["turns"].select(*TURNS).unionByName(log_turns.select(*TURNS)), "sessions": own["sessions"].select(*SESSIONS).unionByName(log_sessions.select(*SESSIONS)), "projects": projects,
        "roles": W.merge_counts(own["roles"], logs["roles"]), "tools": W.merge_counts(own["tools"], logs["tools"]), "cli_info": cli_sessions.stat_rows(logs),
    }


def touch(spark: SparkSession, root: str, manifests: list[Manifest], home: str, env: Mapping[str, str] | None = None, full: bool = False) -> Touched:
    """Collects the external tools whose files changed, and builds the warehouse again if its database or the session logs did. Both are published below root, as usage (see incremental.Usage) and warehouse (see warehouse_store.Warehouse)."""
    found = {m.id: [s for p in P.files(m, home, env) if (s := P.stamp(p))] for m in manifests if m.enabled}
    refreshed = Usage(spark, root).refresh(manifests, found, full)
    sources = own_store.detect(home, env)
    if not sources:
        return Touched(refreshed, False)
    database, roots = sources[0].database, cli.roots(home)
    stamps = [s for p in (*(database + x for x in ("", "-wal", "-shm")), *(p for _, p in cli.session_files(roots))) if (s := P.stamp(p))]

    def build() -> dict[str, DataFrame]:
        own = own_store.load(spark, database)
        return merged(own, cli_sessions.collect(cli.scan(spark, roots), known=own["sessions"].select("id")))

    return Touched(refreshed, rebuilt(spark, f"{root.rstrip('/')}/warehouse", stamps, build), database)
