"""A Spark data source over logs of local repositories: one partition for each, streamed in the log's order."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, n bigint, d string, subject string"
DAYS = 60


def root_of(folder: str) -> str | None:
    """The repository that a folder belongs to."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    return done.stdout.strip() or None


def repositories(projects: Mapping[str, str]) -> list[tuple[str, str, list[str]]]:
    """root, project and further projects of each repository: the first by name has it, the others share it. Projects without a repository are left out."""
    found: dict[str, list[str]] = {}
    for name in sorted(projects):
        if projects[name] and (root := root_of(projects[name])):
            found.setdefault(root, []).append(name)
    return [(root, names[0], names[1:]) for root, names in found.items()]


def log(root: str, since: str) -> Iterator[tuple[int, str, str]]:
    """Number (from 0, newest first), day and subject of each commit, as git lists them. A repository without commits has none."""
    args = ["git", "-C", root, "log", f"--since={since}", "--date=short", "--pretty=format:%ad%x09%s"]
    with subprocess.Popen(args, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        n = 0
        for line in run.stdout:
            day, _, subject = line.decode("utf-8", "replace").rstrip("\r\n").partition("\t")
            if day := day.strip():
                yield n, day, subject.strip()
                n += 1


class Repository(InputPartition):
    def __init__(self, root: str):
        self.root = root


class Reader(DataSourceReader):
    def __init__(self, options):
        self.roots, self.since = json.loads(options["roots"]), options["since"]

    def partitions(self):
        return [Repository(r) for r in self.roots]

    def read(self, partition):
        for row in log(partition.root, self.since):
            yield partition.root, *row


class GitSource(DataSource):
    """Options: roots (a JSON list) and since (as git takes it)."""

    @classmethod
    def name(cls):
        return "ledgerlark_git"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def commits(spark: SparkSession, folders: Iterable[str], since: str = f"{DAYS} days ago") -> DataFrame:
    """Commits of each repository once, whichever of its folders is named, with their number in its log. Runs where the repositories are."""
    roots = sorted({r for f in folders if (r := root_of(f))})
    if not roots:
        return spark.createDataFrame([], SCHEMA)
    spark.dataSource.register(GitSource)
    return spark.read.format("ledgerlark_git").options(roots=json.dumps(roots), since=since).load()
