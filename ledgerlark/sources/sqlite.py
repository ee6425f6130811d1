"""A Spark data source over SQLite files: one partition for each database, rows as JSON text."""

from __future__ import annotations

import contextlib
import json
import logging
import os
import shutil
import sqlite3
import tempfile
import time
import urllib.parse
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, dir string, line bigint, value string, error string"


class Database(InputPartition):
    def __init__(self, path: str):
        self.path = path


PREFIX = "ledgerlark-snapshot-"
STALE_SECONDS = 3600


def snapshot(path: str, folder: str) -> str:
    """A consistent copy of a database in a private folder, made page by page while others may write to it."""
    copy = os.path.join(folder, "db")
    source, target = sqlite3.connect(f"file:{urllib.parse.quote(os.path.abspath(path))}?mode=ro", uri=True), sqlite3.connect(copy)
    try:
        source.backup(target)
    finally:
        source.close()
        target.close()
    return copy


@contextlib.contextmanager
def copied(path: str):
    """The path of a snapshot, which goes afterwards. What killed processes left behind more than an hour ago goes first."""
    root = tempfile.gettempdir()
    for entry in os.scandir(root):
        with contextlib.suppress(OSError):
            if entry.name.startswith(PREFIX) and entry.is_dir() and time.time() - entry.stat().st_mtime > STALE_SECONDS:
                shutil.rmtree(entry.path)
    folder = tempfile.mkdtemp(prefix=PREFIX, dir=root)
    try:
        yield snapshot(path, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _text(v):
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else v


def rows(path: str, query: str, json_column: str = "") -> Iterator[dict]:
    """Rows of a query; an object in json_column is merged over the row. A database or query that fails raises sqlite3.Error with the path."""
    try:
        with copied(path) as copy:
            db = sqlite3.connect(f"file:{urllib.parse.quote(copy)}?mode=ro", uri=True)
            try:
                found = db.execute(query)
                names = [c[0] for c in found.description]
                for values in found:
                    row = {n: _text(v) for n, v in zip(names, values)}
                    if isinstance(row.get(json_column), str):
                        try:
                            extra = json.loads(row[json_column])
                        except ValueError:
                            extra = None
                        if isinstance(extra, dict):
                            row |= extra
                    yield row | {"$file": path, "$dir": os.path.basename(os.path.dirname(path))}
            finally:
                db.close()
    except sqlite3.Error as e:
        raise sqlite3.OperationalError(f"{path}: {e}") from e


class Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.query, self.json_column = options["query"], options.get("jsoncolumn", "")
        self.errors = options.get("errors", "raise")

    def partitions(self):
        return [Database(p) for p in self.paths]

    def read(self, partition):
        try:
            for k, row in enumerate(rows(partition.path, self.query, self.json_column)):
                yield partition.path, row["$dir"], k, json.dumps(row, ensure_ascii=False), None
        except sqlite3.Error as e:
            if self.errors == "raise":
                raise
            logging.getLogger(__name__).warning("left out: %s", e)
            if self.errors == "report":
                yield partition.path, None, None, None, str(e)


class SqliteSource(DataSource):
    """Options: paths (a JSON list), query, jsoncolumn, errors (for a database that fails: raise, report it in a row with the error, or skip it with a warning)."""

    @classmethod
    def name(cls):
        return "ledgerlark_sqlite"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def scan(spark: SparkSession, paths: Iterable[str], query: str, json_column: str = "", errors: str = "raise") -> DataFrame:
    """Rows of the query in each database. One that fails raises, as a result without its rows would look whole; else it is reported in a row of its own, or skipped with a warning."""
    paths = list(paths)
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("ledgerlark_sqlite").options(paths=json.dumps(paths), query=query, jsoncolumn=json_column, errors=errors).load()
