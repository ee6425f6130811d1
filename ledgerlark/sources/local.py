"""A Spark data source over local files: ranges of zstd frames or of lines, and whole files.

Spark has no reader for zstd frames that follow each other, and its own readers pass over files whose name begins
with _ or a dot. A file is cut into byte ranges, and each is a partition: it has the frames, or lines, that begin in
it. Frames are decoded one at a time; one that is damaged costs itself alone, as the next begins at the next magic
number. A range holds one frame in memory.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, start bigint, at bigint, value string, total bigint"
MAGIC = b"\x28\xb5\x2f\xfd"
BYTES = 32 << 20  #: of a range
BLOCK = 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    f.seek(at)
    while data := f.read(BLOCK):
        yield at, data
        at += len(data)


def _find(f, at: int, stop: int, what: bytes = MAGIC) -> int:
    """Where `what` next begins, from at and before stop; -1 if nowhere."""
    tail = b""
    for begin, data in _blocks(f, at):
        # what may lie across two blocks
        k = (tail + data).find(what)
        if k >= 0:
            found = begin - len(tail) + k
            return found if found < stop else -1
        if begin >= stop:
            break
        tail = (tail + data)[-(len(what) - 1) :] if len(what) > 1 else b""
    return -1


def _frame(f, at: int) -> tuple[bytes, int] | None:
    """The text of the frame that begins at a position, and its end; None if it is damaged."""
    import zstandard

    d = zstandard.ZstdDecompressor().decompressobj()
    parts = []
    try:
        for begin, data in _blocks(f, at):
            parts.append(d.decompress(data))
            if d.eof:
                return b"".join(parts), begin + len(data) - len(d.unused_data)
    except zstandard.ZstdError:
        pass
    return None


def framed(path: str) -> bool:
    """Whether a file has frames. Nearly all of those begin with one."""
    with open(path, "rb") as f:
        return _find(f, 0, os.path.getsize(path)) >= 0


def frames(path: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Position and text of each whole frame that begins in the range."""
    high = os.path.getsize(path) if high is None else high
    with open(path, "rb") as f:
        at = _find(f, low, high)
        while at >= 0:
            found = _frame(f, at)
            if found:
                yield at, found[0]
            at = _find(f, found[1] if found else at + len(MAGIC), high)


def lines(path: str, low: int, high: int) -> Iterator[bytes]:
    """Lines that begin in the range."""
    with open(path, "rb") as f:
        f.seek(max(low - 1, 0))
        if low:
            f.readline()  # the last line of the range before, or its end
        while f.tell() < high and (line := f.readline()):
            yield line.removesuffix(b"\n")


class Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.kind, self.bytes = json.loads(options["paths"]), options["kind"], int(options.get("bytes", BYTES))
        self.wanted = [w.encode() for w in json.loads(options.get("wanted", "[]"))]

    def partitions(self):
        out = []
        for p in self.paths:
            if not os.path.isfile(p):
                continue  # it went since it was listed
            size = max(1, os.path.getsize(p))
            with open(p, "rb") as f:
                whole = self.kind == "whole" or (self.kind == "frames" and MAGIC not in f.read(BLOCK))
            step = size if whole else self.bytes
            out += [Range(p, low, min(low + step, size)) for low in range(0, size, step)]
        return out

    def _pieces(self, part: Range) -> Iterator[tuple[int, Iterable[bytes]]]:
        if self.kind == "frames" and part.low == 0 and not framed(part.path):
            # plain text under the same kind
            yield 0, lines(part.path, 0, os.path.getsize(part.path))
        elif self.kind == "frames":
            for at, text in frames(part.path, part.low, part.high):
                yield at, text.split(b"\n")
        elif self.kind == "lines":
            yield part.low, lines(part.path, part.low, part.high)
        else:
            with open(part.path, "rb") as f:
                yield 0, [f.read()]

    def read(self, part):
        rows: list[tuple] = []
        held = 0
        for start, pieces in self._pieces(part):
            n = 0
            for n, piece in enumerate(pieces, 1):
                if self.wanted and not any(w in piece for w in self.wanted):
                    continue
                rows.append((part.path, start, n - 1, piece.decode("utf-8", "replace"), None))
                held += len(piece)
                if held > BLOCK:
                    yield _batch(rows)
                    rows, held = [], 0
            rows.append((part.path, start, None, None, n))
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "at", "value", "total"])


class LocalSource(DataSource):
    """Options: paths (a JSON list), kind (frames, lines or whole), bytes (of a range), wanted (a JSON list of texts, one of which a line must have)."""

    @classmethod
    def name(cls):
        return "ledgerlark_local"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def scan(spark: SparkSession, paths: Iterable[str], kind: str, wanted: Iterable[str] = (), bytes: int = BYTES) -> DataFrame:
    """file, start (of its frame or range), at (number within that) and value of every line, or of whole files; and for each frame or range a row that only has the total of its lines."""
    spark.dataSource.register(LocalSource)
    return spark.read.format("ledgerlark_local").options(paths=json.dumps(list(paths)), kind=kind, wanted=json.dumps(list(wanted)), bytes=bytes).load()
