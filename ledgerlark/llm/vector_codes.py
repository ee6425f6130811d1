"""Product codes of vectors: Lloyd's rounds in integers, with Elkan's bounds kept from round to round.

Vectors become integers and are cut into equal parts; each position has a codebook. A row's state holds,
for each part, its entry, an upper bound of the distance to that entry and a lower bound of the distance
to every entry. A round shifts the bounds by how far entries moved, and only where neither
upper < lower nor 2 * upper < distance between entries holds are squared distances computed, in
integers; both tests are strict, so entries at equal distance are always compared exactly and the
lower index wins. Upper bounds are rounded up and lower bounds down, so pruning never changes a result.

Each round is two jobs over the state table in the folder of spark.checkpoint.dir: assignment writes the next state, and
sums come from its parts and codes alone, one row for each task and entry, added up by Spark. The driver
holds the codebooks only (parts * entries rows). Rounds end early when no entry moves, as nothing would change any more.

Cases: rows whose vector is null or has null or non-finite components are left out. Vectors that are
shorter than the longest, or whose length parts doesn't divide, count as filled up with zeros. Components beyond 2^25 after scaling
count as 2^25, so that sums of squares are exact. Rows without vec_id come last among the first entries and keep their rows. Repeated vec_ids are ordered by their vectors. With fewer rows than
entries, codebooks are as short as there are rows. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlark.llm import _vectors as V
from ledgerlark.llm._shared import Tables, bound_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
STATE = "vec_id long, label string, x array<int>, code array<int>, upper array<long>, lower array<long>"


def roots(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of integers, rounded down and up."""
    down = np.sqrt(square.astype(np.float64)).astype(np.int64)
    down -= down * down > square
    down += (down + 1) * (down + 1) <= square
    return down, down + (down * down < square)


@dataclass
class Books:
    """Codebooks (parts, entries, components), how far their entries moved (rounded up), and distances between entries (rounded down)."""

    entries: np.ndarray
    moved: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Books:
        before = entries if before is None else before
        gap = entries[:, :, None] - entries[:, None]
        return cls(entries, roots(((entries - before) ** 2).sum(2))[1], roots((gap**2).sum(3))[0])


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts x (n, parts, components) to every entry of their position."""
    out = np.empty((*x.shape[:2], entries.shape[1]), np.int64)
    for e in range(entries.shape[1]):
        gap = x - entries[:, e]
        out[:, :, e] = np.einsum("npc,npc->np", gap, gap)
    return out


def first(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds from all distances."""
    square = distances(x, books.entries)
    code = square.argmin(2)
    down, up = roots(square)
    return code, np.take_along_axis(up, code[:, :, None], 2)[:, :, 0], down


def pruned(x: np.ndarray, books: Books, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after the entries moved, and the number of distances that were computed for it."""
    part = np.arange(x.shape[1])
    upper = upper + books.moved[part, code]
    lower = np.maximum(lower - books.moved, 0)
    apart = books.apart[part, code]  # of every part: from its entry to the others

    def open_(upper: np.ndarray) -> np.ndarray:
        near = (upper[:, :, None] >= lower) & (2 * upper[:, :, None] >= apart)
        np.put_along_axis(near, code[:, :, None], False, 2)
        return near

    near = open_(upper)
    i, p = np.nonzero(near.any(2))
    gap = x[i, p] - books.entries[p, code[i, p]]
    own = np.einsum("nc,nc->n", gap, gap)
    down, up = roots(own)
    upper[i, p] = up
    lower[i, p, code[i, p]] = down
    near &= open_(upper)
    square = np.full(near.shape, np.iinfo(np.int64).max)
    square[i, p, code[i, p]] = own
    j, q, e = np.nonzero(near)
    gap = x[j, q] - books.entries[q, e]
    square[j, q, e] = np.einsum("nc,nc->n", gap, gap)
    down, up = roots(square[j, q, e])
    lower[j, q, e] = down
    found = square[i, p].argmin(1)
    best = np.take_along_axis(square[i, p], found[:, None], 1)[:, 0]
    code = code.copy()
    code[i, p] = found
    upper[i, p] = roots(best)[1]
    return code, upper, lower, len(own) + len(j)


def _integers(vector: str) -> Column:
    bound = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(V.MOST)), F.lit(-V.MOST))
    # beyond the range of a long, floor saturates
    return F.transform(vector, lambda x: bound(x).cast("int"))


def _assigned(state: DataFrame, books: Books, width: int, new: bool) -> DataFrame:
    """The next state: new if there are no bounds yet."""
    parts, entries = books.entries.shape[:2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = V.matrix(batch["x"], width, np.int64).reshape(batch.num_rows, parts, -1)
            if new:
                code, upper, lower = first(x, books)
            else:
                code, upper, lower = (V.matrix(batch[c], size, np.int64) for c, size in (("code", parts), ("upper", parts), ("lower", parts * entries)))
                code, upper, lower, _ = pruned(x, books, code, upper, lower.reshape(-1, parts, entries))
            lower = lower.reshape(len(code), -1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"], V.lists(code, pa.int32()), V.lists(upper, pa.int64()), V.lists(lower, pa.int64())], names=["vec_id", "label", "x", "code", "upper", "lower"])

    return state.mapInArrow(work, STATE)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Entries as the means of their parts, rounded down; those without parts stay."""
    parts, entries, wide = before.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            x, code = V.matrix(batch["x"], parts * wide, np.int64).reshape(-1, parts, wide), V.matrix(batch["code"], parts, np.int64)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), V.lists(sums[p, e], pa.int64())], names=["part", "entry", "n", "sums"])

    added = state.select("x", "code").mapInArrow(work, "part int, entry int, n long, sums array<long>")
    out = before.copy()
    # parts * entries rows
    for row in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(wide))).alias("sums")).collect():
        out[row["part"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    return out


def codebooks_digest(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def coded(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label (as text), code (an entry for each part) and error (squared distance) of every row that counts, and the codebooks."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "codes")
    rows = embeddings.filter(V.finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), _integers("embedding").alias("x"))
    state = tables.keep(rows)
    width = V.width(state, "x", parts)
    smallest = state.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    if not width or not smallest:
        # no vector, or none with a component
        none = np.zeros((parts, len(smallest), 0), np.int64)
        return state.select("vec_id", "label", F.array_repeat(F.lit(0), parts).alias("code"), F.lit(0).cast("long").alias("error")), none
    start = np.zeros((len(smallest), width), np.int64)
    for k, row in enumerate(smallest):
        start[k, : len(row["x"])] = row["x"]
    books = Books.of(np.ascontiguousarray(start.reshape(len(smallest), parts, -1).swapaxes(0, 1)))
    new = True
    for _ in range(rounds):
        last, state = state, tables.keep(_assigned(state, books, width, new))
        tables.drop(last)
        new, before = False, books.entries
        books = Books.of(_means(state, before), before)
        if not books.moved.any():
            break
    last, state = state, tables.keep(_assigned(state, books, width, new))
    tables.drop(last)
    final = books.entries

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(parts)
        for batch in batches:
            gap = V.matrix(batch["x"], width, np.int64).reshape(-1, parts, width // parts) - final[part, V.matrix(batch["code"], parts, np.int64)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["code"], pa.array((gap**2).sum((1, 2)))], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "x", "code").mapInArrow(errors, "vec_id long, label string, code array<int>, error long"), final


def digests(embeddings: DataFrame) -> DataFrame:
    """vec_id, code in hex, error, label_error (summed over equal labels, nulls together) and the digest of the codebooks."""
    rows, entries = coded(embeddings)
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(entries)).alias("codebooks_sha256"))
