"""How frequent word n-grams are, as a count sketch of fixed size.

Every n-gram of every text counts, once in each of ROWS rows of cells. A cell holds its n-grams' counts
together, so what the typical cell of its row holds, the median, is taken off again: what
stands above it are frequent n-grams, however many rare ones the corpus has. Of an
n-gram's cells the lower one counts, as the other may be shared with a frequent one. The sketch
orders n-grams and estimates costs; results never depend on its being exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm import _words as W
from ledgerlark.llm._shared import bound_batches, freed_shuffles

ROWS = 2
BITS = 19
CELLS = ROWS << BITS
CHUNK = 1 << 12
SALTS = 16  #: partial sums of a chunk, which are added up in a second step
STEPS = 4  #: levels of a count for each doubling


def cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each n-gram in the two rows."""
    return (h >> W.U(64 - BITS)).astype(np.int64), ((h >> W.U(64 - 2 * BITS)) & W.U((1 << BITS) - 1)).astype(np.int64) + (1 << BITS)


def add(total: np.ndarray, h: np.ndarray) -> None:
    """Counts n-grams in: total has CELLS cells."""
    for k, at in enumerate(cells(h)):
        total[k << BITS : (k + 1) << BITS] += np.bincount(at - (k << BITS), minlength=1 << BITS)


def lower(cell: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each n-gram the lower of its cells' values (or of their bits)."""
    a, b = cells(h)
    return np.minimum(cell[a], cell[b])


@dataclass
class Levels:
    level: np.ndarray  #: of each cell, uint8: STEPS * log2(1 + count beyond the row's median), rounded
    total: float  #: n-grams counted


def gram_levels(docs: DataFrame, n: int, lower: bool, text: str = "text") -> Levels:
    """The sketch of the n-grams of docs. 1 MB, whatever the input."""
    bound_batches(docs.sparkSession)

    def count(stream):
        total = np.zeros(CELLS, np.int64)
        for _, raw, at in W.batches(text)(stream):
            words = W.Words(raw, at)
            add(total, W.windows(words.hashes(lower), n)[W.whole(words.first, n)])
        for k, part in chunks(total):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["chunk", "counts"])

    return collect_levels(docs.select(F.col(text)).mapInArrow(count, "chunk int, counts binary"))


def chunks(total: np.ndarray):
    """(chunk, bytes) of counts."""
    kind = np.uint32 if total.max() < 1 << 32 else np.uint64
    for k in range(0, CELLS, CHUNK):
        if (part := total[k : k + CHUNK]).any():
            yield k // CHUNK, part.astype(kind).tobytes()


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * CHUNK else np.uint64).astype(np.int64)


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    """One row for each value of `by`."""
    names = [*by, "counts"]

    def add_up(stream):
        sums: dict[tuple, np.ndarray] = {}
        for batch in stream:
            for *key, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                part = _read(raw)
                sums[tuple(key)] = sums[tuple(key)] + part if tuple(key) in sums else part
        for key, total in sums.items():
            kind = np.uint32 if total.max() < 1 << 32 else np.uint64
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in key), pa.array([total.astype(kind).tobytes()], pa.binary())], names)

    return parts.repartition(*by).mapInArrow(add_up, ", ".join([*(f"{c} int" for c in by), "counts binary"]))


def collect_levels(parts: DataFrame) -> Levels:
    """Levels from all tasks' chunks, added up in two steps. 8 bytes a cell reach the driver."""

    # the salt is a column, as a Python operator on top of the one that counts would double the task's Python workers, which live on
    some = _summed(parts.select("chunk", (F.spark_partition_id() % SALTS).alias("salt"), "counts"), "chunk", "salt")
    total = np.zeros(CELLS, np.int64)
    with freed_shuffles(parts.sparkSession):
        for row in _summed(some.select("chunk", "counts"), "chunk").collect():
            total[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = _read(row.counts)
    level = np.zeros(CELLS, np.uint8)
    for k in range(ROWS):
        row = total[k << BITS : (k + 1) << BITS]
        beyond = np.maximum(row - np.median(row), 0.0)
        level[k << BITS : (k + 1) << BITS] = np.minimum(255, np.round(STEPS * np.log2(1.0 + beyond)))
    return Levels(level, float(total[: 1 << BITS].sum()))


def times(levels: np.ndarray) -> np.ndarray:
    """The counts back from levels, to within a tenth or so."""
    return np.exp2(levels / STEPS) - 1
