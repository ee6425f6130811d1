"""Mixing sources to target weights by Pfair scheduling.

The mix is a sequence of slots, and each slot holds one block of documents of one source. A
source with weight w (the weights add up to 1) releases its j-th block at slot
floor((j - 1) / w) and has to have it placed by ceil(j / w). In each slot the released block
with the earliest deadline goes first. All deadlines can be met, so after any number t of slots
each source has been given w * t blocks to within less than one.

Weights are met in documents: the mix is as short as holds every document of each source, and source
i gets D_i rows of it. Its blocks run on across the end of the source, which begins again there, so
every slot is full but a source's last, and a source is short or over by less than a block. By default a source's target is its number of documents to
the power TEMPER, which brings small sources up a little.

Blocks have the same size whatever the mix, and the rule is one for all sizes. The state of the schedule after t slots is the number of
blocks that each source has been given, nothing else. So the driver only runs through the schedule once to note that state after every
PERIOD slots (integers on the heap of as many entries as there are sources; a second or two for a million slots, which hold 64 million documents), and each period is then
made by a task of its own from the state at its begin. Documents find their block by
rank, which takes no global order: ranks are counted in
buckets of a hash of doc_id, and buckets are added up. A bucket's blocks are looked up for the bucket and not for each document, so
documents move once.

Cases: a null source is a source of its own. Rows that share a doc_id (or have a null one) count as often as they occur; among
themselves they are ordered by a hash of their columns. Sources with target weight 0 or without a target get no slot. An empty table gives an empty mix.
Extra columns are kept by mix() and ignored by plan(). Texts aren't looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlark.llm._shared import partitions

BLOCK = 64  #: documents in a block
PERIOD = 1 << 17  #: slots that a task makes
TEMPER = 0.9
BUCKET = 4096  #: documents of a bucket in which ranks are counted, about


def run(slots: list[int], placed: list[int], start: int, stop: int) -> Iterator[int]:
    """The source of each slot from start to stop. slots: how many of the sum of slots each source gets; placed: how many it has had before start, and when this ends, before stop."""
    total = sum(slots)
    # release and deadline of each source's next block
    waiting = [(placed[i] * total // n, i) for i, n in enumerate(slots) if placed[i] < n]
    heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(start, stop):
        while waiting and waiting[0][0] <= t:
            _, i = heappop(waiting)
            heappush(ready, (-(-(placed[i] + 1) * total // slots[i]), i))
        _, i = heappop(ready)
        yield i
        placed[i] += 1
        if placed[i] < slots[i]:
            heappush(waiting, (placed[i] * total // slots[i], i))


def schedule(slots: list[int]) -> list[int]:
    """The source of each slot."""
    return list(run(slots, [0] * len(slots), 0, sum(slots)))


def states(slots: list[int], period: int) -> list[list[int]]:
    """How many blocks each source has had at the begin of each period."""
    placed, total = [0] * len(slots), sum(slots)
    out = []
    for start in range(0, total, period):
        out.append(list(placed))
        if start + period < total:
            deque(run(slots, placed, start, start + period), maxlen=0)
    return out


def allot(blocks: list[int], weights: list[float]) -> list[int]:
    """Rows (or blocks) of each source in the mix: in proportion to the weights, in as short a mix as holds every one of each source with a weight."""
    exact = [Fraction(w).limit_denominator(1 << 30) if b else Fraction(0) for w, b in zip(weights, blocks)]
    if not any(exact):
        return [0] * len(blocks)
    scale = max(b / w for w, b in zip(exact, blocks) if w)
    # rounding up keeps every one
    return [max(b, -(-(w * scale).numerator // (w * scale).denominator)) if w else 0 for w, b in zip(exact, blocks)]


@dataclass
class Schedule:
    """slots: source_no, nth (of the source's blocks, from 0) and slot; sources, a row for each: group_, source_no, docs_, rows_ (in the mix)."""

    slots: DataFrame
    sources: DataFrame
    block: int
    total: int


def _group(source: str | None) -> str:
    """A source without null, as a key."""
    return "" if source is None else f"s{source}"


def _schedule(docs: DataFrame, weights: dict[str | None, float] | None, block: int) -> Schedule:
    spark = docs.sparkSession
    # a row for each source
    counts = sorted(((r.source, r.n) for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()), key=lambda x: (x[0] is None, x[0]))
    target = [float(n) ** TEMPER if weights is None else float(weights.get(s, 0.0)) for s, n in counts]
    given = allot([n for _, n in counts], target)
    slots = [-(-n // block) for n in given]
    total, period = sum(slots), PERIOD

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start, placed in zip(batch["start"].to_pylist(), batch["placed"].to_pylist()):
                before = np.array(placed)
                stop = min(start + period, total)
                order = np.fromiter(run(slots, placed, start, stop), np.int32, stop - start)
                nth = np.empty(len(order), np.int64)
                for i in np.unique(order):
                    mine = np.flatnonzero(order == i)
                    nth[mine] = before[i] + np.arange(len(mine))
                yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(nth), pa.array(np.arange(start, stop))], names=["slot_of", "nth", "slot"])

    begins = [(k * period, placed) for k, placed in enumerate(states(slots, period))]
    periods = spark.createDataFrame(begins, "start long, placed array<long>").repartition(max(1, min(len(begins), 4 * partitions(spark))))
    sources = [(_group(s), i, n, given[i]) for i, (s, n) in enumerate(counts) if given[i]]
    return Schedule(periods.mapInArrow(work, "slot_of int, nth long, slot long"), spark.createDataFrame(sources, "group_ string, source_no int, docs_ long, rows_ long"), block, total)


def _placed(docs: DataFrame, key: str, plan: Schedule) -> DataFrame:
    """docs with epoch, slot and position, a row for each time a document is in the mix. In each source documents are in the order that a hash of doc_id gives, and for rows of one doc_id a hash of the row."""
    n = docs.count()
    buckets = max(1, n // BUCKET)
    hashed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)))
    hashed = hashed.withColumn("bucket_", F.expr(f"(({key} >> 1) + {1 << 62}) div {max(1, (1 << 63) // buckets + 1)}"))
    # a key without nulls, so the window and the join deal rows out alike and rows move once
    hashed = hashed.withColumn("group_", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    sizes = hashed.groupBy("group_", "bucket_").agg(F.count("*").alias("n_"))
    # buckets of a source, one row each
    before = F.sum("n_").over(Window.partitionBy("group_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before_", F.coalesce(before, F.lit(0))).join(plan.sources, "group_")
    times = offsets.withColumn("epoch", F.explode(F.expr("sequence(0L, (rows_ - 1 - before_) div docs_)"))).withColumn("from_", F.col("before_") + F.col("epoch") * F.col("docs_"))
    spans = times.withColumns({"first_": F.expr(f"from_ div {plan.block}"), "last_": F.expr("least(from_ + n_, rows_) - 1")}).withColumn("last_", F.expr(f"last_ div {plan.block}"))
    blocks = spans.withColumn("block_no", F.explode(F.sequence("first_", "last_"))).join(plan.slots, (F.col("source_no") == F.col("slot_of")) & (F.col("block_no") == F.col("nth")))
    own = ["group_", "bucket_", "epoch", "from_", "first_", "rows_"]
    slots = F.transform(F.array_sort(F.collect_list(F.struct("slot"))), lambda x: x["slot"])  # a source's blocks are in the order of their slots
    looked = blocks.groupBy(*own).agg(slots.alias("slots_"))
    inside = F.row_number().over(Window.partitionBy("group_", "bucket_").orderBy(key, "doc_id", F.xxhash64(*docs.columns))) - 1
    joined = hashed.withColumn("inside_", inside).join(looked, ["group_", "bucket_"]).withColumn("at_", F.col("from_") + F.col("inside_")).filter("at_ < rows_")
    slot = F.expr(f"slots_[cast(at_ div {plan.block} - first_ as int)]")
    return joined.withColumn("slot", slot).withColumns({"position": F.col("slot") * plan.block + F.col("at_") % plan.block, "epoch": F.col("epoch").cast("int")})


def plan(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, epoch, slot and position (unique; the mix is in its order), a row for each time a document is in the mix."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    return _placed(rows, "h_", _schedule(rows, weights, block)).select("doc_id", "source", "epoch", "slot", "position")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs in the order of the mix: partition by partition, and in each one from the top. Rows of sources that begin again occur again."""
    spark = docs.sparkSession
    names = docs.columns
    clash = {c: f"kept{k}_" for k, c in enumerate(names)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.struct(*(F.col(f"`{c}`").alias(clash[c]) for c in names)).alias("row_"))
    plan = _schedule(rows, weights, block)
    parts = partitions(spark)
    placed = _placed(rows, "h_", plan).select("position", F.expr(f"cast(slot * {parts} div {max(1, plan.total)} as int)").alias("part_"), "row_")
    ordered = placed.repartitionById(parts, F.col("part_")).sortWithinPartitions("position")
    return ordered.select(*(F.col(f"row_.{clash[c]}").alias(c) for c in names))
