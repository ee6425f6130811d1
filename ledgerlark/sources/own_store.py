"""Where the tool's own database is, and its tables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators import own_store as O
from ledgerlark.sources import sqlite

DATABASE = "pi.sqlite"
# Folders of the home directory that may hold the database.
FOLDERS = (".pi-desktop", ".pi", ".config/pi", "AppData/Roaming/pi")
# Optional databases of other tools that know their sessions' folders.
WORKSPACES = (".zcode/cli/db/db.sqlite", ".local/share/mimocode/mimocode.db")
QUERIES = {
    "projects": ("select id, path, name from projects", "id long, path string, name string"),
    "sessions": ("select id, title, project_id, model_id, mode, thinking_level, created_at, updated_at from sessions", "id string, title string, project_id long, model_id string, mode string, thinking_level string, created_at long, updated_at long"),
    "turns": ("select session_id, model_id, started_at, ended_at, status, usage_json from turns", "session_id string, model_id string, started_at long, ended_at long, status string, usage_json string"),
    "messages": ("select session_id, role, tool_name, is_error from messages", "session_id string, role string, tool_name string, is_error long"),
}


@dataclass(frozen=True)
class Source:
    folder: str
    database: str
    size: int
    wal_size: int
    modified: int  #: milliseconds of the journal's last write, 0 without one


def detect(home: str, env: Mapping[str, str] | None = None) -> list[Source]:
    """Folders with a database, the one written last first. They overlap, so only the first is to be read."""
    env = os.environ if env is None else env
    own = env.get("PI_HOME")
    candidates = ([own] if own else []) + [os.path.join(home, f) for f in FOLDERS]
    out = []
    for folder in dict.fromkeys(candidates):
        path = os.path.join(folder, DATABASE)
        if os.path.isfile(path):
            wal = path + "-wal"
            there = os.path.exists(wal)
            out.append(Source(folder, path, os.path.getsize(path), os.path.getsize(wal) if there else 0, int(os.path.getmtime(wal) * 1000) if there else 0))
    return sorted(out, key=lambda s: -s.modified)


def tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The database's tables as they are."""

    def read(query: str, schema: str) -> DataFrame:
        return sqlite.scan(spark, [database], query, errors="raise").select(F.from_json("value", schema).alias("r")).select("r.*")

    return {name: read(*q) for name, q in QUERIES.items()}


def load(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """projects, sessions, turns, roles and tools of the database as warehouse tables."""
    t = tables(spark, database)
    return {"projects": O.projects(t["projects"]), "sessions": O.sessions(t["sessions"], t["projects"], t["turns"], t["messages"]), "turns": O.turns(t["turns"]), **O.message_counts(t["messages"])}


def version(database: str) -> int:
    return next(r["user_version"] for r in sqlite.rows(database, "pragma user_version"))


def workspaces(spark: SparkSession, home: str) -> DataFrame:
    """name and path of folders that other tools' databases know and that are git repositories. Databases that are missing or can't be read are no failure."""
    paths = [p for w in WORKSPACES if os.path.isfile(p := os.path.join(home, w))]
    found = sqlite.scan(spark, paths, "select directory from session group by directory", errors="report").filter("error is null").collect()
    roots = {}
    for r in found:
        folder = (json.loads(r.value)["directory"] or "").strip()
        if folder and os.path.exists(os.path.join(folder, ".git")):
            roots[os.path.basename(folder.rstrip("/\\"))] = folder
    return spark.createDataFrame(sorted(roots.items()), "name string, path string")
