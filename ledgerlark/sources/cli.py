"""Session logs of the command line: where they are, and in which order files of one name belong together."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators import ingest
from ledgerlark.operators.cli_sessions import REVISIONS
from ledgerlark.sources import readers

# The folders of sessions below a home, in their order.
ROOTS = (".pi/agent/sessions", ".config/pi/agent/sessions")


def roots(home: str) -> list[str]:
    """Those of ROOTS that there are."""
    return [r for x in ROOTS if os.path.isdir(r := os.path.join(home, x))]


def session_files(folders: Iterable[str]) -> list[tuple[int, str]]:
    """(number of its root, path) of every log below the roots, by root and then by path, without revisions. A file below two roots belongs to the first; a root that can't be read has none."""
    seen: dict[str, int] = {}
    for n, root in enumerate(folders):
        for path in sorted(os.path.join(d, name) for d, _, names in os.walk(root) for name in names if name.endswith(".jsonl") and not name.endswith(REVISIONS)):
            seen.setdefault(path, n)
    return [(n, path) for path, n in seen.items()]


def scan(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    """Decoded lines of all logs below the roots: root, file, dir, line, obj, as cli_sessions.collect takes them."""
    found = session_files(folders)
    lines = ingest.decoded(readers.jsonl(spark, [p for _, p in found]))
    order = spark.createDataFrame(found, "root int, path string")
    return lines.join(order, F.col("file") == F.col("path")).drop("path")
