"""Scans of log files: file, dir, line and value (the raw text) or obj (the decoded object)."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlark.operators import ingest
from ledgerlark.operators.ingest import Manifest
from ledgerlark.plans.kept import kept
from ledgerlark.sources import local

LINES = "file string, dir string, line bigint, value string"
MOST_LINE = 16 << 20  #: bytes of a line; longer ones are damaged


def plain_path(uri: Column) -> Column:
    """The path that a reader was asked for, from the URI that it reports. A + is itself there, not a blank."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def _folder(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -2)


def _literal(path: str) -> str:
    """A path as a pattern that only matches itself."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _hidden(path: str) -> bool:
    """Whether Spark's own readers would pass over it."""
    return os.path.basename(path).startswith(("_", "."))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LINES)


def _numbered(found: DataFrame, counted: DataFrame, first: int) -> DataFrame:
    """Line numbers in files, without a window over lines: the lines of the splits (or frames) before are summed and joined back.

    found: uri, start (of the split), at (number of the line, from where its split begins), value.
    counted, a row for each split: uri, start, begins, n and file.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = counted.select("uri", "start", "begins", before.alias("before"), "file", _folder(F.col("file")).alias("dir"))
    line = F.col("before") + F.col("at") - F.col("begins") + first
    return found.filter("value is not null").join(splits, ["uri", "start"]).select("file", "dir", line.cast("long").alias("line"), "value")


def _text_lines(spark: SparkSession, paths: list[str], keep: Callable[[Column], Column], wanted: tuple[str, ...]) -> DataFrame:
    """Lines of text files that keep gives a value, numbered from 1.

    Files are read once, as they may grow meanwhile: one job writes the kept lines, and of each other line only
    that it is there. Numbers come from what was written; lines that aren't kept are never shuffled.
    """
    seen = [p for p in paths if not _hidden(p)]
    hidden = [p for p in paths if _hidden(p)]
    parts = []
    if seen:
        raw = spark.read.option("lineSep", "\n").text([_literal(p) for p in seen])
        raw = raw.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), keep(F.col("value")).alias("value"))
        found = kept(raw, "lines")
        counted = found.groupBy("uri", "start").agg(F.count("*").alias("n"), F.min("at").alias("begins")).withColumn("file", plain_path(F.col("uri")))
        parts.append(_numbered(found, counted, 1))
    if hidden:
        parts.append(_numbered(*_local_lines(spark, hidden, "lines", keep, wanted), 1))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _local_lines(spark: SparkSession, paths: list[str], kind: str, keep: Callable[[Column], Column], wanted: tuple[str, ...], bytes: int = local.BYTES) -> tuple[DataFrame, DataFrame]:
    """Kept lines of local files, and how many lines each range or frame has."""
    all_ = kept(local.scan(spark, paths, kind, wanted, bytes).withColumn("value", keep(F.col("value"))), "lines")
    counted = all_.filter("total is not null").select(F.col("file").alias("uri"), "start", F.lit(0).alias("begins"), F.col("total").alias("n"), "file")
    return all_.filter("total is null").withColumnRenamed("file", "uri"), counted


def _texts(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    paths = list(paths)
    seen, hidden = [_literal(p) for p in paths if not _hidden(p)], [p for p in paths if _hidden(p)]
    parts = [spark.read.text(seen, wholetext=True).select("value", plain_path(F.col("_metadata.file_path")).alias("file"))] if seen else []
    parts += [local.scan(spark, hidden, "whole").filter("total is null").select("value", "file")] if hidden else []
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).withColumn("dir", _folder(F.col("file"))) if parts else None


def _json_line(prefilter: tuple[str, ...], most: int | None = None) -> Callable[[Column], Column]:
    """A line without the white space around it, or null if it doesn't begin like JSON, has none of the prefilter's texts, or has more than `most` bytes."""

    def keep(value: Column) -> Column:
        text = ingest.trimmed(value)
        ok = text.startswith("{") | text.startswith("[")
        if prefilter:
            ok &= ingest.contains_any(value, prefilter)
        return F.when(ok if most is None else (F.octet_length(value) <= most) & ok, text)

    return keep


def jsonl(spark: SparkSession, paths: Iterable[str], prefilter: tuple[str, ...] = ()) -> DataFrame:
    """Lines from 1 without the white space around them, only those that begin like JSON and have at most MOST_LINE bytes."""
    paths = list(paths)
    return _text_lines(spark, paths, _json_line(prefilter, MOST_LINE), prefilter) if paths else _none(spark)


def documents(spark: SparkSession, paths: Iterable[str], prefilter: tuple[str, ...] = ()) -> DataFrame:
    """Objects of whole files, or of the arrays that they hold (numbered from 1). A file that isn't one document is read line by line."""
    texts = _texts(spark, paths)
    if texts is None:
        return _none(spark).select("file", "dir", "line", F.lit(None).cast("variant").alias("obj"))
    ingest.allow_duplicate_keys(spark)
    # the parser stops after one value: a first line that is one, with more behind it, makes a file of lines
    body = ingest.trimmed(F.col("value"))
    by_line = F.contains(body, F.lit("\n")) & F.try_parse_json(F.substring_index(body, "\n", 1)).isNotNull()
    whole = ingest.prefiltered(texts, prefilter).withColumn("obj", F.when(~by_line, F.try_parse_json("value")))
    shape = F.schema_of_variant("obj")
    one = whole.filter(shape.startswith("OBJECT")).select("file", "dir", F.lit(0).cast("long").alias("line"), "obj")
    many = whole.filter(shape.startswith("ARRAY")).select("file", "dir", F.posexplode(F.try_variant_get("obj", "$", "array<variant>")).alias("line", "obj"))
    many = many.filter(F.schema_of_variant("obj").startswith("OBJECT")).withColumn("line", (F.col("line") + 1).cast("long"))
    lines = whole.filter("obj is null").select("file", "dir", F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("line", (F.col("line") + 1).cast("long"))
    return one.unionByName(many).unionByName(ingest.decoded(lines).select("file", "dir", "line", "obj"))


def zstd_jsonl(spark: SparkSession, paths: Iterable[str], prefilter: tuple[str, ...] = (), bytes: int = local.BYTES) -> DataFrame:
    """Lines (from 0) of files of zstd frames. Each frame is cut into lines by itself, and what follows its last line break counts as a line."""
    paths = list(paths)
    return _numbered(*_local_lines(spark, paths, "frames", _json_line(prefilter), prefilter, bytes), 0) if paths else _none(spark)


def records(spark: SparkSession, m: Manifest, paths: list[str]) -> DataFrame:
    """Decoded records of a manifest's files: file, dir, line, obj."""
    if m.kind == "json":
        docs = documents(spark, paths, m.prefilter)
        return ingest.flattened(docs, m.json_rows) if m.json_rows else docs
    if m.kind == "sqlite":
        from ledgerlark.sources import sqlite

        databases = [p for p in paths if not (p.endswith(("-wal", "-shm")) and p[:-4] in paths)]
        rows = sqlite.scan(spark, databases, m.query, m.json_column)
        return ingest.decoded(rows.select("file", "dir", "line", "value"))
    lines = zstd_jsonl(spark, paths, m.prefilter) if m.kind == "zstd-jsonl" else jsonl(spark, paths, m.prefilter)
    return ingest.decoded(lines)
