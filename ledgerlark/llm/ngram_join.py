"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document's set holds the hashes (64 bits) of its distinct word shingles,
rarest first by a sketch of the corpus counts. Two sets of n and m shingles that are
similar enough share need(n, m) of them, and so share l of the first
n - ceil(t n) + l of each. Each document chooses the l of 1 to MOST_MATCHES with
the lowest estimated cost: the postings of its longer prefix have to be
read, but a candidate must share l of them before it is verified. A pair has to
share as many as the lower of its two documents asks for, the first of them early enough to
leave room for the rest (position filter), and its sizes must agree (size filter).
Candidates are verified exactly, on the sets of their whole texts.

Equal sets form one class from the start. Links among classes are looked for in two
rounds, and never as all pairs of a group:

1. in each posting list, every class against the one with the fewest rare shingles, if
   the two meet that way in as many lists as they ask for;
2. in lists whose classes are not yet in one component, pairs of
   different components. One of a pair is always outside the list's largest
   component, so only classes outside it are paired with the others. Lists of up to LIST classes
   are joined; longer ones are compared in blocks of BLOCK_BYTES, where shared prefix shingles are counted in
   memory and only pairs that share enough of them come out.

In round 2 a pair has to share as many shingles of its prefixes as its two sizes ask for, which is
the more the closer they are. No link between components is missed, so the components are exact. Posting
lists that may be long (by the sketch) are found by pre-aggregation and a join
that Spark can split; the others are short by the sketch's estimate.

Cases: null or empty texts have no shingles and link with nothing, not with each other
either. Texts of fewer than SHINGLE words are one shingle. Rows with a null doc_id
link with nothing and get a null component_id. Rows that share a doc_id are each judged
by their own text. Ties and repeated rows belong to one class. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlark.llm import _sketch, _words as W
from ledgerlark.llm._components import components
from ledgerlark.llm._shared import Tables, bound_batches, partitions

SHINGLE = 4
PERCENT = 85
MOST_MATCHES = 4
VERIFY_COST = 8.0  #: of a candidate, in postings read
POSTING_COST = 4.0  #: of one more posting, in postings read
LIST = 128  #: classes of a list whose pairs are joined
BLOCK_BYTES = 1 << 20  #: prefixes of a block
PAIRS_AT_ONCE = 1 << 18  #: pairs of a block whose shared shingles are counted at once
LONG_LIST = 1024  #: a shingle that may be in more sets than this is looked up by a join that can be split


def _sets(words: W.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin (n + 1)."""
    h = words.hashes(lower=True)
    n = words.counts()
    ok = W.whole(words.first, shingle)
    g, row = W.windows(h, shingle)[ok], words.row()[: len(ok)][ok]
    for k in range(1, shingle):
        short = np.flatnonzero(n == k)
        if len(short):
            g = np.append(g, W.windows(h, k, base=0xA0761D6478BD642F + 2 * k)[words.first[short]])
            row = np.append(row, short)
    order = W.by_row(row, g, len(n))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(n) + 1))


def _prints(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set."""
    n = np.diff(first).astype(W.U)
    return tuple(W.mix(W.sums(W.mix(g ^ W.U(k)), first) + n * W.U(k)).view(np.int64) for k in (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7))


def _scan(shingle: int):
    """One pass: each document's set size and fingerprints, and the counts of all shingles."""

    def work(stream):
        total = np.zeros(_sketch.CELLS, np.int64)
        for rows, raw, at in W.batches("text")(stream):
            g, first = _sets(W.Words(raw, at), shingle)
            _sketch.add(total, g)
            one, two = _prints(g, first)
            n = len(rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(one), pa.array(two), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _SCANNED_NAMES)
        for k, counts in _sketch.chunks(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([k], pa.int32()), pa.array([counts], pa.binary())], _SCANNED_NAMES)

    return work


_SCANNED = "doc_id long, n long, f long, f2 long, chunk int, counts binary"
_SCANNED_NAMES = ["doc_id", "n", "f", "f2", "chunk", "counts"]


def _matches(size: np.ndarray, first: np.ndarray, estimate: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each text the number of prefix matches to ask for, by estimated cost. estimate: sets that hold each shingle besides this one."""
    total = np.zeros(len(estimate) + 1)
    np.cumsum(estimate, out=total[1:])
    best, choice = np.full(len(size), np.inf), np.ones(len(size), np.int64)
    for k in range(1, MOST_MATCHES + 1):
        end = first[:-1] + np.minimum(prefix + k, size)
        read = total[end] - total[first[:-1]]
        cost = POSTING_COST * k + read * (1 + VERIFY_COST / k)
        better = cost < best
        best, choice = np.where(better, cost, best), np.where(better, k, choice)
    return choice


def _postings(levels: bytes, shingle: int, percent: int, long_list: float):
    """A row for each shingle of each prefix. facts: size of the set << 32 | place in it << 3 | matches asked for."""

    def work(stream):
        level = np.frombuffer(levels, np.uint8)
        for rows, raw, at in W.batches("text")(stream):
            g, first = _sets(W.Words(raw, at), shingle)
            f, f2 = _prints(g, first)
            size = np.diff(first)
            # a smaller set is similar to equal ones only; equal sets of this slice need one entry, of a row that may link
            able = np.flatnonzero((size > 0) & (100 * size >= percent * (size + 1)) & rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            fresh = np.zeros(len(size), bool)
            if len(able):
                fresh[able[np.unique(np.stack([f[able], f2[able]]), axis=1, return_index=True)[1]]] = True
            rank = _sketch.lower(level, g)
            row = np.repeat(np.arange(len(size)), size)
            order = W.by_row(row, rank, len(size))
            g, rank = g[order], rank[order]
            count = _sketch.times(rank)
            prefix = size - (percent * size + 99) // 100
            ask = _matches(size, first, np.maximum(count - 1, 0), prefix)
            take = np.where(fresh, np.minimum(prefix + ask, size), 0)
            own = np.repeat(np.arange(len(size)), take)
            pos = W.spread(take)
            index = first[own] + pos
            facts = size[own] << 32 | pos << 3 | ask[own]
            yield pa.RecordBatch.from_arrays([pa.array(g[index].view(np.int64)), pa.array(f[own]), pa.array(facts), pa.array(count[index] > long_list)], ["token", "f", "facts", "long_list"])

    return work


def _texts(shingle: int):
    """doc_id, f and the words of each text, compressed."""

    def work(stream):
        squeeze = zstandard.ZstdCompressor(level=1)
        for rows, raw, at in W.batches("text")(stream):
            words = W.Words(raw, at)
            f, _ = _prints(*_sets(words, shingle))
            flat, edge = words.joined()
            flat = memoryview(flat)
            z = [squeeze.compress(flat[a:b]) for a, b in zip(edge[words.first[:-1]].tolist(), edge[words.first[1:]].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(f), pa.array(z, pa.binary())], ["doc_id", "f", "z"])

    return work


def _verify(shingle: int, percent: int):
    """Keeps the pairs whose sets are similar enough."""

    def work(stream):
        loose = zstandard.ZstdDecompressor()
        for batch in stream:
            for part in _parts(batch):
                index: dict[bytes, int] = {}
                a, b = ([index.setdefault(x, len(index)) for x in part.column(c).to_pylist()] for c in ("za", "zb"))
                sets: list[np.ndarray] = []
                for texts in _runs([loose.decompress(z) for z in index]):
                    g, first = _sets(W.Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])), shingle)
                    sets += np.split(g, first[1:-1])
                good = []
                for k, (i, j) in enumerate(zip(a, b)):
                    x, y = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
                    at = np.searchsorted(y, x)
                    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                    if 100 * both >= percent * (len(x) + len(y) - both) and both:
                        good.append(k)
                yield part.take(pa.array(good, pa.int64())).select(["u", "v"])
        W.give_back()

    return work


def _parts(batch: pa.RecordBatch, most: int = 8 << 20):
    """Pairs whose compressed texts have about `most` bytes decompressed, at five to one."""
    size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("za", "zb"))
    total = np.cumsum(size) * 5
    lo = 0
    while lo < len(batch):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _runs(texts: list[bytes]):
    """texts in runs of about a slice's bytes."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > W.SLICE_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _facts(prefix: str = "") -> list[Column]:
    facts = F.col(f"{prefix}facts")
    return [F.shiftright(facts, 32).alias("n"), F.shiftright(facts, 3).bitwiseAND(F.lit((1 << 29) - 1)).alias("pos"), facts.bitwiseAND(F.lit(7)).alias("ask")]


def _may_link(a: str, b: str, percent: int) -> Column:
    """Size and position filter on the first shingle that a and b share; later ones may fail it."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.expr(f"({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (n - F.col(f"{a}.pos") >= need) & (m - F.col(f"{b}.pos") >= need)


def _asked(percent: int) -> str:
    """How many shingles of their prefixes two sets that are similar enough share, at least; SQL of n_a, n_b, ask_a, ask_b.

    What is left behind a prefix of p of n shingles is n - p. The set whose prefix ends first, in the order
    of all shingles, shares nothing of its prefix outside the other's, so the prefixes share need - (n - p) at least.
    """
    left = [f"greatest(0, ({percent} * n_{x} + 99) div 100 - ask_{x})" for x in "ab"]
    need = f"(({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})"
    return f"greatest(least(ask_a, ask_b), {need} - greatest({left[0]}, {left[1]}))"


def _matching(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough shingles."""
    sides = [prefixes.select(F.col("f").alias(f"f{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "ask", "prefix"))) for x in "ab"]
    both = pairs.join(sides[0], "fa").join(sides[1], "fb")
    return both.filter(F.expr(f"size(array_intersect(prefix_a, prefix_b)) >= {_asked(percent)}")).select("fa", "fb")


def _block(percent: int):
    """Pairs of one pair of blocks of a list that are of different components and share enough shingles of their prefixes."""

    def work(table: pa.Table) -> pa.Table:
        def side(block: int) -> dict:
            rows = table.filter(pc.equal(table.column("block"), block))
            prefix = rows.column("prefix").combine_chunks()
            out = {c: rows.column(c).to_numpy() for c in ("f", "comp", "n", "pos", "ask")}
            size = pc.list_value_length(prefix).to_numpy(zero_copy_only=False)
            return out | {"token": prefix.flatten().to_numpy(zero_copy_only=False), "row": np.repeat(np.arange(len(size)), size)}

        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        a, b = side(lo), side(hi)
        order = np.argsort(b["token"], kind="stable")
        token, row = b["token"][order], b["row"][order]
        left, right = np.searchsorted(token, a["token"], "left"), np.searchsorted(token, a["token"], "right")
        begin = np.searchsorted(a["row"], np.arange(len(a["f"]) + 1))
        wide = len(b["f"])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, PAIRS_AT_ONCE // max(1, wide))
        for lo_row in range(0, len(a["f"]), step):
            hi_row = min(lo_row + step, len(a["f"]))
            both = np.zeros(step * wide, np.int32)
            i, last = begin[lo_row], begin[hi_row]
            met = np.cumsum((right - left)[i:last])
            k = 0
            while k < len(met):
                # about a million meetings at a time
                j = max(k + 1, int(np.searchsorted(met, (met[k - 1] if k else 0) + (1 << 20), "right")))
                count = (right - left)[i + k : i + j]
                index = np.repeat(left[i + k : i + j], count) + W.spread(count)
                both += np.bincount(np.repeat(a["row"][i + k : i + j] - lo_row, count) * wide + row[index], minlength=len(both)).astype(np.int32)
                k = j
            pair = np.flatnonzero(both)
            x, y = pair // wide + lo_row, pair % wide
            n, m, ask_a, ask_b = a["n"][x], b["n"][y], a["ask"][x], b["ask"][y]
            need = (percent * (n + m) + 99 + percent) // (100 + percent)
            rest = np.maximum(np.maximum((percent * n + 99) // 100 - ask_a, (percent * m + 99) // 100 - ask_b), 0)
            good = both[pair] >= np.maximum(np.minimum(ask_a, ask_b), need - rest)
            good &= (a["comp"][x] != b["comp"][y]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (n - a["pos"][x] >= need) & (m - b["pos"][y] >= need)
            found.append((a["f"][x[good]], b["f"][y[good]]))
        u, v = (np.concatenate([np.zeros(0, np.int64), *(pair[k] for pair in found)]) for k in (0, 1))
        return pa.table({"fa": np.minimum(u, v), "fb": np.maximum(u, v)})

    return work


def _open_pairs(open_lists: DataFrame, prefixes: DataFrame, tables: Tables, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a shingle of their prefixes, and as many as they ask for. open_lists: token, f, n, pos, ask, comp, top and the list's k classes with p shingles in their prefixes."""
    short, long = open_lists.filter(F.col("k") <= LIST), open_lists.filter(F.col("k") > LIST)
    a, b = short.filter("comp != top").alias("a"), short.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.top")) | (F.col("a.f") < F.col("b.f"))) & _may_link("a", "b", percent))
    pairs = tables.keep(met.select(F.least("a.f", "b.f").alias("fa"), F.greatest("a.f", "b.f").alias("fb")).distinct())
    out = _matching(pairs, prefixes, percent)
    if not long.isEmpty():
        blocks = F.expr(f"cast((8 * p + 64 * k) div {BLOCK_BYTES} + 1 as int)")
        rows = long.join(prefixes.select("f", "prefix"), "f").withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(f), blocks) as int)"))
        dealt = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        found = dealt.select("token", "lo", "hi", "block", "f", "comp", "n", "pos", "ask", "prefix").groupBy("token", "lo", "hi").applyInArrow(_block(percent), "fa long, fb long")
        out = out.unionByName(found).distinct()
    return out


def similar(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    tables = Tables(spark, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = tables.keep(docs.mapInArrow(_scan(shingle), _SCANNED))
    levels = _sketch.collect_levels(scanned.filter("chunk is not null").select("chunk", "counts")).level
    sets = scanned.filter("chunk is null").select("doc_id", "n", "f", "f2")
    classes = tables.keep(sets.filter("n > 0 and doc_id is not null").groupBy("f", "f2").agg(F.min("doc_id").alias("rep")))

    sent = tables.keep(docs.mapInArrow(_postings(levels.tobytes(), shingle, percent, LONG_LIST), "token long, f long, facts long, long_list boolean"))
    lists = tables.keep(_shared_lists(sent, partitions(spark)))
    tables.drop(sent)
    wanted = lists.select("f").distinct().join(classes.select("f", "rep"), "f")
    texts = docs.mapInArrow(_texts(shingle), "doc_id long, f long, z binary")
    texts = tables.keep(texts.join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "f"]).select("f", F.col("doc_id").alias("rep"), "z"))

    def links(pairs: DataFrame) -> DataFrame:
        right = pairs.join(texts.select(F.col("f").alias("fb"), F.col("rep").alias("v"), F.col("z").alias("zb")), "fb")
        both = right.join(texts.select(F.col("f").alias("fa"), F.col("rep").alias("u"), F.col("z").alias("za")), "fa").filter("u != v")
        return tables.keep(both.select("u", "v", "za", "zb").mapInArrow(_verify(shingle, percent), "u long, v long"))

    entries = lists.select("token", "f", "head", *_facts(), "head_facts")
    head = entries.filter("f != head").select("f", "head", "n", "pos", "ask", F.struct(*_facts("head_")).alias("h"))
    head = head.select(F.struct("n", "pos", "ask").alias("a"), F.col("h").alias("b"), "f", "head")
    star = head.groupBy("f", "head").agg(F.count("*").alias("both"), F.min(F.least("a.ask", "b.ask")).alias("ask"), F.max(_may_link("a", "b", percent)).alias("may")).filter("may and both >= ask")
    first = links(star.select(F.col("head").alias("fa"), F.col("f").alias("fb")))
    comps = components(first, tables)

    own = texts.select("f", F.col("rep").alias("node")).join(comps, "node", "left").select("f", F.coalesce("comp", "node").alias("comp"))
    placed = tables.keep(entries.drop("head", "head_facts").join(own, "f"))
    asked = F.expr(f"least(n, n - ({percent} * n + 99) div 100 + ask)")
    largest = placed.groupBy("token", "comp").agg(F.count("*").alias("k"), F.sum(asked).alias("p")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("k").alias("k"), F.sum("p").alias("p"))
    open_lists = tables.keep(placed.join(largest.filter("comps > 1").drop("comps"), "token"))
    concerned = open_lists.select("f").distinct()
    prefixes = placed.join(concerned, "f").groupBy("f").agg(F.max("n").alias("n"), F.max("ask").alias("ask"), F.collect_set("token").alias("prefix"))
    prefixes = tables.keep(prefixes)
    second = links(_open_pairs(open_lists, prefixes, tables, percent))
    comps = components(first.unionByName(second), tables)
    for done in (lists, placed, open_lists, prefixes, texts):
        tables.drop(done)

    roots = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("f", "f2", F.coalesce("comp", "rep").alias("root"))
    linked = sets.filter("n > 0 and doc_id is not null").join(roots, ["f", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    alone = sets.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _shared_lists(sent: DataFrame, parts: int) -> DataFrame:
    """Postings whose shingle at least two different sets have, each with its list's head: the set that has the shingle earliest."""
    early = F.struct(F.shiftright("facts", 3).bitwiseAND(F.lit((1 << 29) - 1)).alias("pos"), "f", "facts")
    w = Window.partitionBy("token")
    short = sent.filter("not long_list").repartition(parts, "token").withColumns({"low": F.min("f").over(w), "high": F.max("f").over(w), "first": F.min(early).over(w)})
    short = short.filter("low != high").select("token", "f", "facts", F.col("first.f").alias("head"), F.col("first.facts").alias("head_facts"))
    long = sent.filter("long_list").select("token", "f", "facts").distinct()
    heads = long.groupBy("token").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.min(early).alias("first")).filter("low != high")
    long = long.join(heads.select("token", F.col("first.f").alias("head"), F.col("first.facts").alias("head_facts")), "token")
    return short.distinct().unionByName(long)
