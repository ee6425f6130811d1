"""Collection: manifests to usage records, with a cache of what each file gave."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import shutil
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlark.operators import ingest
from ledgerlark.operators.drivers import DRIVERS
from ledgerlark.operators.ingest import Manifest
from ledgerlark.plans.versions import Conflict, Versions
from ledgerlark.sources import paths as P, readers

CACHE_VERSION = 2
MOST_BATCHES = 16  #: folders of a cache; with more, what counts is written anew into one
CONTRIBUTION = "tool string, file string, line bigint, dedup_key string, model string, session string, ts string, input bigint, cache_read bigint, cache_write bigint, output bigint, reasoning bigint, has_usage boolean"
COLUMNS = [c.split()[0] for c in CONTRIBUTION.split(", ")]


def contributions(spark: SparkSession, m: Manifest, files: list[str]) -> DataFrame:
    """Every record of the files with its dedup key, before deduplication. A manifest's driver takes the place of the normalisation."""
    records = readers.records(spark, m, files)
    found = DRIVERS[m.driver](records, m) if m.driver else ingest.normalized(records, m)
    return found.select(*COLUMNS)


def cacheable(m: Manifest) -> bool:
    """Records of one file must depend on that file alone."""
    return not m.driver and m.kind != "sqlite"


def _key(m: Manifest, stamp: P.Stamp) -> str:
    """Of what a file gives: its path, size and time, and how it is read."""
    how = repr(dataclasses.replace(m, label="", paths=(), file_name="", enabled=True))
    return hashlib.sha256(json.dumps([CACHE_VERSION, how, stamp.path, stamp.size, stamp.changed]).encode()).hexdigest()[:32]


class Cache:
    """What each file of a tool gave, in a folder that is published in versions: a version lists the live keys, each with the folder that its records are in.

    Rows carry their key and are read by it, never by a file name. A file is read again when its size or time changes; its old
    rows, and those of files that are gone, count no more from the next version on.
    """

    def __init__(self, spark: SparkSession, m: Manifest, root: str):
        self.spark, self.m = spark, m
        self.versions = Versions(spark, f"{root.rstrip('/')}/{m.id}")

    def _rows(self, live: dict[str, str]) -> DataFrame:
        """Rows of the live keys."""
        if not live:
            return self.spark.createDataFrame([], f"{CONTRIBUTION}, key string")
        keys = self.spark.createDataFrame([(k,) for k in live], "key string")
        rows = self.spark.read.schema(f"{CONTRIBUTION}, key string").parquet(*(self.versions.data(f) for f in sorted(set(live.values()))))
        return rows.join(keys, "key", "left_semi")

    def _write(self, rows: DataFrame) -> str:
        folder = self.versions.fresh()
        rows.write.parquet(self.versions.data(folder))
        return folder

    def collect(self, stamps: list[P.Stamp]) -> tuple[DataFrame, list[str]]:
        """Contributions of the files, and which of them were read now."""
        while True:
            number, content = self.versions.current()
            known = content.get("files", {})
            keys = {s.path: _key(self.m, s) for s in stamps}
            live = {k: known[k] for k in keys.values() if k in known}
            missing = [s.path for s in stamps if keys[s.path] not in live]
            if missing:
                # many files are one job; a path that wasn't asked for would be a reader's mistake, never a row without a key
                asked = self.spark.createDataFrame([(p, keys[p]) for p in missing], "file string, key string")
                fresh = contributions(self.spark, self.m, missing).join(asked, "file", "left")
                key = F.coalesce("key", F.raise_error(F.concat(F.lit("not asked for: "), F.col("file"))))
                live |= dict.fromkeys((keys[p] for p in missing), self._write(fresh.select(*COLUMNS, key.alias("key"))))
            if len(set(live.values())) > MOST_BATCHES:
                live = dict.fromkeys(live, self._write(self._rows(live)))
            if live != known:
                try:
                    self.versions.commit(number, {"files": live, "folders": sorted(set(live.values()))})
                except Conflict:
                    continue  # by then another collection may have read them
                self.versions.vacuum()
            return self._rows(live).drop("key"), missing


def cached_contributions(spark: SparkSession, m: Manifest, files: list[str] | list[P.Stamp], cache: str) -> tuple[DataFrame, list[str]]:
    """Contributions of the files, and which of them were read now."""
    return Cache(spark, m, cache).collect([s for f in files if (s := f if isinstance(f, P.Stamp) else P.stamp(f))])


def usage_records(spark: SparkSession, manifests: list[Manifest], home: str, env=None, cache: str | None = None) -> DataFrame:
    """Deduplicated records of all enabled manifests. Each file belongs to the first manifest that names it. A manifest with problems raises."""
    chosen = [m for m in manifests if m.enabled]
    if wrong := {m.id or m.file_name: p for m in chosen if (p := m.problems())}:
        raise ValueError(f"manifests with problems: {wrong}")
    owned, _ = P.claim((m, P.files(m, home, env)) for m in chosen)
    parts = [ingest.deduplicated(cached_contributions(spark, m, owned[m.id], cache)[0] if cache and cacheable(m) else contributions(spark, m, owned[m.id])) for m in chosen if owned[m.id]]
    if not parts:
        return spark.createDataFrame([], CONTRIBUTION).drop("has_usage")
    return reduce(DataFrame.unionByName, parts)


def changed(state_file: str, manifests: list[Manifest], home: str, env=None) -> list[str]:
    """Ids of the tools whose files differ from the state kept last time; the state is then renewed."""
    try:
        with open(state_file, encoding="utf-8") as f:
            state = json.load(f)
    except (OSError, ValueError):
        state = {}
    now = {m.id: list(P.fingerprint(P.files(m, home, env))) for m in manifests}
    write_json(state_file, state | now)
    return [i for i, v in now.items() if state.get(i) != v]


def write_json(path: str, value, backup: bool = False) -> None:
    """Writes a file so that readers see the old or the new one, never half; on request the old one is kept as .bak."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
    if backup and os.path.exists(path):
        shutil.copyfile(path, path + ".bak")
    os.replace(path + ".tmp", path)
