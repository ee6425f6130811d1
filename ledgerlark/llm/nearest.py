"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Equal vectors are one entry, with its smallest ids (as many as an answer can need). Coarse centroids
and, for each four components, a codebook of residuals are fitted on a sample of entries. Every entry gets its cell and
code, and keeps how far its code is from it. A query probes the cells whose centroids have the largest product with it; there, products are estimated from a table of
the query's products with all code words (the query itself isn't quantised). The best FIRST of a bucket are computed exactly by their vectors, and then
every other entry whose estimate may, by SPREAD times the usual error of its code, reach the last place.

How many cells are probed is measured at fitting: as few as hold COVER of the neighbours that sampled
queries have in the sample, whose neighbours are farther away than those in the whole table.

Scale: entries travel once, to buckets of cells; a cell of more than a bucket is split, so no hot
cell is one task. Queries are dealt in blocks, and each block meets the buckets that its queries probe.
Neither answers nor parts of the index depend on the number of partitions. The driver holds the sample (at most
about SAMPLE_BYTES of it) and the centroids. Tables of entries and answers lie in the folder of spark.checkpoint.dir.

Cases: vectors that are null, zero, or have null or non-finite components take no part. Shorter vectors count as filled up with zeros.
Rows that share an id are rows of their own, each a candidate for the other. Rows without id are candidates, after
others at equal score, and never queries. With fewer candidates than asked for, all are found if the probed cells hold them; tables of up to ALL entries are
searched whole. An empty table gives an empty result. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlark.llm import _vectors as V
from ledgerlark.llm._shared import Tables, bound_batches

TOP = 20
EVERY = 20  #: ids divisible by it are queries
SAMPLE_BYTES = 16 << 20  #: of vectors that are fitted on, at four bytes a component: 65,536 of 64
COVER = 0.97
FIRST = 48
SPREAD = 2.0
PAIRS = 1 << 16  #: exact products computed at once
TRIALS = 256
PART = 4  #: components of a code word
WORDS = 256
ROUNDS = 8
ALL = 256
BUCKETS, SMALL = 24, 512  #: buckets of a small table, and entries in one at least


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of the rows of x, at most k; starts from distinct rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(ROUNDS):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        order = np.argsort(at, kind="stable")
        full = np.nonzero(n)[0]
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        c[full] = sums / n[full, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    rows = max(1, (8 << 20) // max(1, len(c)))
    return np.concatenate([(x[i : i + rows] @ c.T - half).argmax(1) for i in range(0, len(x), rows)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    """cells (k, width), words (parts, up to WORDS, PART), and how many cells a query probes."""

    cells: np.ndarray
    words: list[np.ndarray]
    probes: int

    @classmethod
    def fit(cls, sample: np.ndarray, entries: int) -> Index:
        k = 1 if entries <= ALL else min(int(np.ceil(np.sqrt(entries))), max(1, len(sample) // 16))
        cells = _kmeans(sample, k, 1)
        at = _nearest(sample, cells)
        rest = sample - cells[at]
        words = [_kmeans(rest[:, p : p + PART], WORDS, p) for p in range(0, sample.shape[1], PART)]
        return cls(cells, words, _probes(sample, cells, at))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and usual error of a product with a vector of length 1, for each row."""
        at = _nearest(x, self.cells)
        rest = x - self.cells[at]
        code = np.stack([_nearest(rest[:, PART * p : PART * (p + 1)], w) for p, w in enumerate(self.words)], 1).astype(np.uint8)
        for p, w in enumerate(self.words):
            rest[:, PART * p : PART * (p + 1)] -= w[code[:, p]]
        return at, code, np.sqrt((rest * rest).sum(1) / x.shape[1])

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part, the products of queries with its words."""
        return [q[:, PART * p : PART * (p + 1)] @ w.T for p, w in enumerate(self.words)]

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query, best first."""
        return np.argsort(-(q @ self.cells.T), axis=1, kind="stable")[:, : self.probes]


def _probes(sample: np.ndarray, cells: np.ndarray, at: np.ndarray) -> int:
    """How many cells hold COVER of the neighbours within the sample."""
    trial = np.unique(np.linspace(0, len(sample) - 1, TRIALS).astype(int))
    q = sample[trial]
    rank = np.empty((len(q), len(cells)), np.int64)
    np.put_along_axis(rank, np.argsort(-(q @ cells.T), axis=1, kind="stable"), np.arange(len(cells))[None], 1)
    needed = []
    for row, own in enumerate(trial):
        score = sample @ q[row]
        score[own] = -np.inf
        best = np.argpartition(-score, min(TOP, len(score) - 1))[:TOP]
        needed.append(rank[row, at[best]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(COVER * len(needed))))]) + 1


def fill(counts: np.ndarray, most: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals groups out in their order: blocks of each (no block has more than `most`), and for each block its bucket. A bucket is closed once it has `room`."""
    blocks = np.maximum(1, -(-counts // most))
    size = np.repeat(counts / blocks, blocks)
    return blocks, ((np.cumsum(size) - size) // room).astype(np.int64)


def _entries(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors, each with its `most` smallest ids; one id each suffices before the shuffle, as Spark limits groups there too."""
    order = Window.partitionBy("x").orderBy(F.asc_nulls_last("vec_id"))
    first = rows.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n_", "vec_id"))), lambda x: x["vec_id"])
    return first.groupBy("x").agg(ids.alias("ids")).withColumn("entry", F.monotonically_increasing_id())


def _encoded(entries: DataFrame, index: Index, width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code, off = index.encode(V.matrix(batch["x"], width))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("entry", "ids", "x")), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off)], names=["entry", "ids", "x", "cell", "code", "off"])

    kind = dict(entries.dtypes)["x"]
    return entries.select("entry", "ids", "x").mapInArrow(work, f"entry long, ids array<long>, x {kind}, cell int, code binary, off double")


def _asked(queries: DataFrame, index: Index, width: int, bucket: np.ndarray, start: np.ndarray, home: np.ndarray, parts: np.ndarray) -> DataFrame:
    """A row for each query and bucket it probes, with its cells there. home, parts: the first block and the number of blocks of a query's nearest cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            entry = batch["entry"].to_numpy()
            probed = index.probed(V.matrix(batch["x"], width))
            near = probed[:, 0]
            block = home[near] + entry % parts[near]
            row, cells, to = [], [], []
            for i, mine in enumerate(probed):
                blocks = np.concatenate([np.arange(start[c], start[c + 1]) for c in mine])
                where, of = bucket[blocks], np.repeat(mine, start[mine + 1] - start[mine])
                for b in np.unique(where):
                    row.append(i)
                    to.append(b)
                    cells.append(np.unique(of[where == b]))
            sizes = np.concatenate(([0], np.cumsum([len(c) for c in cells])))
            probes = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(cells), pa.int32()))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(block[row], pa.int64()), batch["entry"].take(taken), batch["x"].take(taken), probes], names=["bucket", "block", "query", "x", "cells"])

    kind = dict(queries.dtypes)["x"]
    return queries.mapInArrow(work, f"bucket long, block long, query long, x {kind}, cells array<int>")


def _scan(index: Index, width: int, top: int):
    """Answers of a block of queries in a bucket: for each query its best entries there."""

    def work(lists: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query", "score", "entry", "ids"]
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
        if not lists.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        lists, asked = (t.combine_chunks() for t in (lists, asked))
        # a cell's entries together, in an order that doesn't depend on how they came
        head = lists["ids"].combine_chunks()
        first = head.values.fill_null(np.iinfo(np.int64).max).to_numpy()[head.offsets.to_numpy()[:-1]]
        cell, part = lists["cell"].to_numpy(), lists["part"].to_numpy()
        order = np.lexsort((lists["entry"].to_numpy(), first, part, cell))
        cell, part, first = cell[order], part[order], first[order]
        vectors = V.matrix(lists["x"], width)[order]
        code = np.frombuffer(b"".join(lists["code"].to_pylist()), np.uint8).reshape(len(order), -1)[order]
        edges = np.concatenate(([0], np.nonzero((np.diff(cell) != 0) | (np.diff(part) != 0))[0] + 1, [len(cell)]))
        off = lists["off"].to_numpy()[order]
        queries = V.matrix(asked["x"], width)
        probes = asked["cells"].combine_chunks()
        ends, flat = probes.offsets.to_numpy(), probes.values.to_numpy()
        out_query, out_score, out_entry = [], [], []
        step = max(1, (2 << 20) // max(WORDS * len(index.words), len(order)))

        def exact(q: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.concatenate([(vectors[at[k : k + PAIRS]] * q[of[k : k + PAIRS]]).sum(1) for k in range(0, len(of), PAIRS)] or [np.zeros(0)])

        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            tables, coarse = index.tables(q), q @ index.cells.T
            mine = flat[ends[i] : ends[min(i + step, len(queries))]]
            whose = np.repeat(np.arange(len(q)), np.diff(ends[i : i + step + 1]))
            guess = np.full((len(q), len(order)), -np.inf)
            for a, b in zip(edges[:-1], edges[1:]):
                who = whose[mine == cell[a]]
                if len(who):
                    guess[who, a:b] = coarse[who, cell[a]][:, None] + sum(table[who][:, code[a:b, p]] for p, table in enumerate(tables))
            most = min(FIRST, len(order))
            best = np.argpartition(-guess, most - 1, axis=1)[:, :most]
            of, at = np.repeat(np.arange(len(q)), most), best.reshape(-1)
            there = guess[of, at] > -np.inf
            of, at = of[there], at[there]
            score = exact(q, of, at)
            last = np.full(len(q), -np.inf)  # the score in the last place so far
            if most >= top:
                full = np.full((len(q), most), -np.inf)
                full[there.reshape(len(q), most)] = score
                last = -np.partition(-full, top - 1, axis=1)[:, top - 1]
            hope = guess + SPREAD * np.linalg.norm(q, axis=1)[:, None] * off
            np.put_along_axis(hope, best, -np.inf, 1)
            more_of, more_at = np.nonzero((hope >= last[:, None]) & (hope > -np.inf))
            of, at, score = (np.concatenate(x) for x in ((of, more_of), (at, more_at), (score, exact(q, more_of, more_at))))
            rows = np.lexsort((first[at], -score, of))
            of, at, score = of[rows], at[rows], score[rows]
            near = np.arange(len(of)) - np.searchsorted(of, of) < top
            out_query.append(asked["query"].to_numpy()[i + of[near]])
            out_score.append(score[near])
            out_entry.append(order[at[near]])
        if not out_query:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        taken = lists.select(["entry", "ids"]).take(pa.array(np.concatenate(out_entry)))
        return pa.Table.from_arrays([pa.array(np.concatenate(out_query)), pa.array(np.concatenate(out_score)), taken["entry"], taken["ids"]], names=names)

    return work


def neighbours(embeddings: DataFrame, top: int = TOP, every: int = EVERY, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the `top` nearest found for each row whose id is divisible by `every`, itself left out."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "nearest")
    some = F.exists(vector, lambda x: x != 0)
    rows = embeddings.filter(V.finite(vector) & some).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("x"))
    entries = tables.keep(_entries(rows, top + 1))
    n, longest = entries.agg(F.count("*"), F.max(F.size("x"))).first()
    width = -(-(longest or 1) // PART) * PART
    room = max(1024, SAMPLE_BYTES // (4 * width))
    chosen = entries.select("x", F.xxhash64("x").alias("h"))
    if n > room:
        chosen = chosen.filter(F.pmod("h", F.lit(1 << 20)) < F.lit(-(-(room << 20) // n)))
    drawn = chosen.orderBy("h", "x").select("x").toArrow()  # about `room` rows
    if not n or not drawn.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index.fit(V.matrix(drawn["x"], width), n)
    k = len(index.cells)
    lists = tables.keep(_encoded(entries, index, width))

    # cells next to each other along the axis of most spread share a bucket
    axis = np.linalg.svd(index.cells - index.cells.mean(0), full_matrices=False)[2][0]
    order = np.argsort(index.cells @ axis, kind="stable")
    place = np.empty(k, np.int64)
    place[order] = np.arange(k)
    counts = np.zeros(k, np.int64)
    for row in lists.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    most = max(SMALL, min(room, -(-n // BUCKETS)))
    blocks, bucket_of = fill(counts[order], room, most)
    begin = np.concatenate(([0], np.cumsum(blocks)))
    # for each cell by number: where its blocks begin, in an array of their buckets
    start = np.zeros(k + 1, np.int64)
    start[1:] = np.cumsum(blocks[place])
    bucket = np.concatenate([bucket_of[begin[place[c]] : begin[place[c] + 1]] for c in range(k)])
    of_block = spark.createDataFrame([(c, int(j), int(bucket[start[c] + j])) for c in range(k) for j in range(start[c + 1] - start[c])], "cell int, part int, bucket long")
    split = spark.createDataFrame([(c, int(start[c + 1] - start[c])) for c in range(k)], "cell int, parts int")
    dealt = lists.join(split, "cell").withColumn("part", F.pmod(F.xxhash64("x"), "parts").cast("int")).join(of_block, ["cell", "part"])

    asking = rows.filter(F.col("vec_id") % every == 0).join(entries.select("x", "entry"), "x").select("vec_id", "entry")
    asking = tables.keep(asking)
    queries = lists.join(asking.select("entry").distinct(), "entry", "left_semi").select("entry", "x", "cell")
    per_cell = np.zeros(k, np.int64)
    for row in queries.groupBy("cell").count().collect():
        per_cell[row["cell"]] = row["count"]
    parts, block_of = fill(per_cell[order], room, room)
    # a query goes by its best cell, which is near the one that it is in; numbers of blocks follow from the order of cells
    first_block = np.concatenate(([0], np.cumsum(parts)))[:-1]
    home, shares = block_of[first_block][place], parts[place]
    asked = tables.keep(_asked(queries.select("entry", "x"), index, width, bucket, start, home, shares))
    # names of their own: both sides of the cogroup come from the same table
    pairs = asked.select(F.col("bucket").alias("of"), F.col("block").alias("meets")).distinct()
    met = dealt.join(pairs, F.col("bucket") == F.col("of")).select("of", "meets", "entry", "ids", "x", "cell", "part", "code", "off")
    answers = met.groupBy("of", "meets").cogroup(asked.groupBy("bucket", "block")).applyInArrow(_scan(index, width, top + 1), "query long, score double, entry long, ids array<long>")
    answers = tables.keep(answers)

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    each = answers.select("query", "score", (F.col("entry") == F.col("query")).alias("same"), F.explode("ids").alias("vec_id"))
    nearest = each.withColumn("n_", F.row_number().over(best)).filter(F.col("n_") <= top + 1)
    found = nearest.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n_", "score", "vec_id", "same"))).alias("found"))
    lists_of = asking.withColumnRenamed("vec_id", "query_id").join(found, F.col("entry") == F.col("query"))
    own = F.array_position(F.transform("found", lambda f: F.coalesce(f["same"] & (f["vec_id"] == F.col("query_id")), F.lit(False))), F.lit(True)).cast("int")
    others = F.when(F.col("own") > 0, F.concat(F.slice("found", F.lit(1), F.col("own") - 1), F.slice("found", F.col("own") + 1, F.size("found")))).otherwise(F.col("found"))
    out = lists_of.withColumn("own", own).select("query_id", F.posexplode(F.slice(others, 1, top)).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
