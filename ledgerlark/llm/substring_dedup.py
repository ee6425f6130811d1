"""Removal of passages that a document with a smaller id has as well.

Super-k-mer partitioning: a window is WINDOW consecutive words. Its minimiser
is the run of GRAM words in it with the smallest hash, where runs that are
frequent in the corpus (by a sketch) rank behind all others.
Consecutive windows that share a minimiser travel as one packed string to the
minimiser's bucket, so equal windows of all documents meet there. The bucket
sorts its windows by hash, compares those with equal hashes byte by byte and
finds the smallest doc_id of each window.

Memory: there are as many buckets as hold BUCKET_BYTES of packed strings each, by the corpus's
number of words. A task gets its buckets one after the other, as Spark has sorted them, and
holds one at a time. A bucket of more than PASS_BYTES isn't sorted there: its windows
are written out with 128 bits of hash, and Spark's own aggregation and joins, which
combine before the shuffle, spill and split, find the smallest doc_id of each.

Disk: the more buckets, the less a slice sends to each, so packed strings are compressed with a
dictionary, trained on the first part of some texts (it decides sizes only), and numbers travel in as few
bytes as they need. Fingerprints of texts travel only if rows share a doc_id.

Hot groups: equal packed strings of one slice of a document scan are merged before the
shuffle. Where more than INLINE documents share one there, only the smallest
doc_id goes to the bucket, and later slices of the task send none with a larger one; the rest is joined with the
bucket's answer, in a join that Spark can split. A minimiser that occurs in a large part of the
corpus is chosen only by windows that consist of such runs altogether.

Cases: null or empty texts have no words. Texts with fewer than WINDOW words
keep all. Rows with a null doc_id neither lose words nor make others lose any.
Rows that share a doc_id are judged each by its own text: a row loses what a smaller
doc_id has, and nothing for the sake of rows of its own doc_id. Repeated rows lose the same words.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm import _sketch, _words as W
from ledgerlark.llm._shared import Tables, bound_batches, freed_shuffles, partitions

WINDOW = 13
GRAM = 4
RUN = 64  #: most windows in a packed string
INLINE = 4  #: most occurrences of a packed string that a slice sends to its bucket
HEAVY_SHARE = 2.0**-13  #: of all n-grams; a cell of the sketch above it holds frequent ones
WORD_BYTES = 24  #: packed bytes for each word of the corpus, about
BUCKET_BYTES = 12 << 20  #: packed bytes of a bucket, about
PASS_BYTES = 48 << 20  #: packed bytes that a task sorts by itself
MOST_PARTS = 1 << 15  #: tasks that buckets are dealt to; beyond it a task has several, one after the other
COMPARED = 100_000  #: windows whose words are compared at once
REMEMBERED = 100_000  #: hot strings whose smallest doc_id a task keeps
SQUEEZE = 3  #: level of zstd that packed strings travel with
SAMPLE_TEXTS, SAMPLE_CHARS = 1000, 4096  #: texts, and of each the characters, that the dictionary of packed strings is trained on
DICTIONARY_BYTES = 32 << 10
NONE = np.iinfo(np.int64).max

_SENT = "part int, bucket long, kind byte, key binary, data binary"
_FOUND = "kind byte, doc_id long, print long, start int, len int, key binary, data binary, h long, h2 long"
RANGE, SPOTS, ANSWER, WINDOWS = 0, 1, 2, 3


def heavy_cells(docs: DataFrame, gram: int) -> tuple[bytes, float]:
    """One bit for each cell of the sketch: does it hold more than HEAVY_SHARE of all n-grams? And how many n-grams there are, about."""
    sketch = _sketch.gram_levels(docs, gram, lower=False)
    return np.packbits(_sketch.times(sketch.level) > max(64.0, HEAVY_SHARE * sketch.total)).tobytes(), sketch.total


def _runs(words: W.Words, window: int, gram: int, heavy: np.ndarray):
    """First word, windows and minimiser of each super-k-mer."""
    m = len(words) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, W.U)
    g = W.windows(words.hashes(), gram)
    top = W.U(1 << 63)
    g = np.where(_sketch.lower(heavy, g), g | top, g & ~top)
    width = window - gram + 1
    low, span = g, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    ok = W.whole(words.first, window)
    row = words.row()[:m]
    new = np.ones(m, bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    new |= (np.arange(m) - begin) % RUN == 0
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, m))
    # windows of a run are all inside one text or none is
    good = ok[at]
    return at[good], size[good], low[at[good]]


def _ints(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, none if all are 0; that number comes first."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (0, 1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + (x.astype(f"<u{width}").tobytes() if width else b"")


def _read_ints(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """What _ints() wrote at `at`, as int64, and where it ends."""
    width = raw[at]
    x = np.frombuffer(raw, f"<u{width}", n, at + 1).astype(W.U).view(np.int64) if width else np.zeros(n, np.int64)
    return x, at + 1 + n * width


def _pack(entries: list[bytes], hot: np.ndarray, counts: np.ndarray, rows: np.ndarray, docs: np.ndarray, prints: np.ndarray, pos: np.ndarray) -> bytes:
    """Packed strings with their occurrences: a position in one of the rows (doc_id, fingerprint of the text) that follow once each."""
    used, at = np.unique(rows, return_inverse=True)
    low = docs[used].min()
    # differences to the smallest id wrap around, and back again when they are read
    numbers = (np.array([len(entries), len(rows), len(used)]), counts - 1, hot, (docs[used] - low).view(W.U), prints[used].view(W.U), at, pos)
    return b"".join((struct.pack("<q", low), *map(_ints, numbers), b"\n".join(entries)))


class Blob:
    """What _pack() has packed."""

    def __init__(self, raw: bytes):
        (n, m, rows), at = _read_ints(raw, 8, 3)
        counts, at = _read_ints(raw, at, int(n))
        hot, at = _read_ints(raw, at, int(n))
        docs, at = _read_ints(raw, at, int(rows))
        prints, at = _read_ints(raw, at, int(rows))
        row, at = _read_ints(raw, at, int(m))
        pos, at = _read_ints(raw, at, int(m))
        self.counts, self.hot = counts + 1, hot.astype(bool)
        self.docs = (docs + np.int64(struct.unpack_from("<q", raw)[0]))[row]
        self.prints = prints[row]
        self.pos = pos.astype(np.int32)
        self.text = memoryview(raw)[at:]

    def windows(self, window: int):
        """Hash, a second hash, entry, first and last byte of each window."""
        data = np.frombuffer(self.text, np.uint8)
        cut = np.flatnonzero(data == 0x0A)
        words = W.Words(data, np.concatenate(([0], cut + 1, [len(data)])))
        at = np.flatnonzero(W.whole(words.first, window))
        h = words.hashes()
        second = lambda: W.windows(words.hashes(base=0xD1342543DE82EF95), window, base=0xAF251AF3B0F025B5)[at].view(np.int64)
        return W.windows(h, window)[at], second, words.row()[at], words.start[at], words.end[at + window - 1]


def _hot_key(entry: bytes) -> bytes:
    return hashlib.blake2b(entry, digest_size=16).digest()


def _dictionary(docs: DataFrame) -> bytes:
    """A dictionary for zstd, from a bounded sample; empty if there is too little text for one."""
    some = docs.filter("text is not null").select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(SAMPLE_TEXTS)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.text.encode() for r in some.collect()], level=SQUEEZE).as_bytes()
    except zstandard.ZstdError:
        return b""


def _sender(heavy_bits: bytes, window: int, gram: int, buckets: int, parts: int, dictionary: bytes = b""):
    def send(stream):
        heavy = np.unpackbits(np.frombuffer(heavy_bits, np.uint8)).astype(bool)
        common = zstandard.ZstdCompressionDict(dictionary)
        if dictionary:
            common.precompute_compress(level=SQUEEZE)
        squeeze = zstandard.ZstdCompressor(level=SQUEEZE, dict_data=common)
        known_hot: dict[bytes, int] = {}
        turn = 0
        for rows, raw, at in W.batches("text")(stream):
            ids = rows.column("doc_id")
            use_row = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            prints = rows.column("print").to_numpy(zero_copy_only=False)
            # a row that a slice repeats adds nothing
            valid = np.flatnonzero(use_row)
            if not len(valid):
                continue
            _, first_row = np.unique(np.stack([ids[valid], prints[valid]]), axis=1, return_index=True)
            use_row = np.zeros(len(ids), bool)
            use_row[valid[first_row]] = True
            words = W.Words(raw, at)
            begin, size, least = _runs(words, window, gram, heavy)
            row = np.searchsorted(words.first, begin, "right") - 1
            use = use_row[row]
            begin, size, least, row = begin[use], size[use], least[use], row[use]
            if not len(begin):
                continue
            flat, edge = words.joined()
            flat = flat.tobytes()
            index: dict[bytes, int] = {}
            code = np.fromiter((index.setdefault(flat[a:b], len(index)) for a, b in zip(edge[begin].tolist(), (edge[begin + size + window - 1] - 1).tolist())), np.int64, len(begin))
            packed = list(index)
            del index, flat
            order = np.lexsort((ids[row], code))
            count = np.bincount(code, minlength=len(packed))
            ends = np.cumsum(count)
            spot_row, pos = row[order], (begin - words.first[row])[order]
            bucket = (least[order[ends - count]] % W.U(buckets)).astype(np.int64)
            hot = count > INLINE
            send_entry = np.ones(len(packed), bool)
            rank = W.spread(count)
            out = ([], [], [], [], [])
            for e in np.flatnonzero(hot):
                a, b = ends[e] - count[e], ends[e]
                key = _hot_key(packed[e])
                smallest = int(ids[spot_row[a]])
                seen = known_hot.get(key)
                if seen is not None and seen <= smallest:
                    # the bucket has this string from here with an id that is as small
                    send_entry[e] = False
                else:
                    if seen is not None or len(known_hot) < REMEMBERED:
                        known_hot[key] = smallest
                    a += 1
                if a < b:
                    r = spot_row[a:b]
                    # any part will do: they only pass through
                    turn += 1
                    spots = ids[r].tobytes() + prints[r].tobytes() + pos[a:b].astype(np.int32).tobytes()
                    for x, v in zip(out, ((key[0] + turn) % parts, -1, SPOTS, key, spots)):
                        x.append(v)
            inline = (~np.repeat(hot, count) | (rank == 0)) & np.repeat(send_entry, count)
            sent = np.where(send_entry, np.where(hot, 1, count), 0)
            spot_row, pos, of = spot_row[inline], pos[inline], np.repeat(bucket, count)[inline]
            entries = np.flatnonzero(send_entry)
            by, by_spot = entries[np.argsort(bucket[entries], kind="stable")], np.argsort(of, kind="stable")
            present, first = np.unique(bucket[by], return_index=True)
            spot = np.append(np.searchsorted(of[by_spot], present), len(of))
            for k, (p, a, b) in enumerate(zip(present.tolist(), first, np.append(first[1:], len(by)))):
                e, s = by[a:b], by_spot[spot[k] : spot[k + 1]]
                data = squeeze.compress(_pack([packed[x] for x in e.tolist()], hot[e], sent[e], spot_row[s], ids, prints, pos[s]))
                for x, v in zip(out, (p % parts, p, RANGE, None, data)):
                    x.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int8(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["part", "bucket", "kind", "key", "data"])

    return send


def _found(kind: int, n: int, **columns) -> pa.RecordBatch:
    """n rows of _FOUND; columns that aren't given are null."""
    kinds = {"doc_id": pa.int64(), "print": pa.int64(), "start": pa.int32(), "len": pa.int32(), "key": pa.binary(), "data": pa.binary(), "h": pa.int64(), "h2": pa.int64()}
    made = [pa.array(np.asarray(columns[c]).astype(k.to_pandas_dtype()) if isinstance(columns[c], np.ndarray) else columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *made], ["kind", *kinds])


def _bucket(window: int, most: int, dictionary: bytes = b""):
    def work(stream):
        loose = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        held: list[bytes] = []
        now, total, over = None, 0, False
        for batch in stream:
            kinds, buckets = batch.column("kind").to_pylist(), batch.column("bucket").to_pylist()
            keys, data = batch.column("key"), batch.column("data")
            if spots := [k for k, x in enumerate(kinds) if x == SPOTS]:
                yield _found(SPOTS, len(spots), key=[keys[k].as_py() for k in spots], data=[data[k].as_py() for k in spots])
            for k, x in enumerate(kinds):
                if x != RANGE:
                    continue
                if buckets[k] != now:
                    if held:
                        yield from _sorted_bucket([Blob(r) for r in held], window)
                    held, now, total, over = [], buckets[k], 0, False
                raw = loose.decompress(data[k].as_py())
                if over:
                    yield _windows(Blob(raw), window)
                    continue
                held.append(raw)
                total += len(raw)
                if total > most:
                    over = True
                    for raw in held:
                        yield _windows(Blob(raw), window)
                    held = []
            del batch, keys, data
        if held:
            yield from _sorted_bucket([Blob(r) for r in held], window)
        W.give_back()

    return work


def _offsets(entry: np.ndarray, begin: np.ndarray, blob: Blob) -> np.ndarray:
    """Which window of its packed string each one is: the spaces between its first byte and the string's."""
    text = np.frombuffer(blob.text, np.uint8)
    spaces = np.cumsum(text == 0x20)
    cut = np.concatenate(([0], np.flatnonzero(text == 0x0A) + 1))
    at = spaces[np.maximum(begin - 1, 0)] * (begin > 0)
    base = cut[entry]
    return at - spaces[np.maximum(base - 1, 0)] * (base > 0)


def _windows(blob: Blob, window: int) -> pa.RecordBatch:
    """A row for each window of each occurrence: hashes, document, first word; for hot strings the key, and in len which window it is."""
    h, second, entry, begin, _ = blob.windows(window)
    offset = _offsets(entry, begin, blob)
    windows_of = np.bincount(entry, minlength=len(blob.counts))
    wfirst = np.cumsum(windows_of) - windows_of
    own = np.repeat(np.arange(len(blob.counts)), blob.counts)
    reach = windows_of[own]
    index = np.repeat(wfirst[own], reach) + W.spread(reach)
    spot = np.repeat(np.arange(len(own)), reach)
    texts = bytes(blob.text).split(b"\n") if blob.hot.any() else []
    key_of = {int(e): _hot_key(texts[e]) for e in np.flatnonzero(blob.hot)}
    keys = [key_of.get(e) for e in own[spot].tolist()] if key_of else pa.nulls(len(spot), pa.binary())
    return _found(WINDOWS, len(spot), doc_id=blob.docs[spot], print=blob.prints[spot], start=blob.pos[spot] + offset[index], len=offset[index], key=keys, h=h.view(np.int64)[index], h2=second()[index])


def _smallest(blobs: list[Blob], window: int):
    """For each window of the blobs the smallest doc_id that has it; where each blob's windows begin; entry and first byte of each."""
    hs, least, spans = [], [], []
    for blob in blobs:
        h, _, entry, a, b = blob.windows(window)
        hs.append(h)
        # the first occurrence of an entry has its smallest id
        least.append(blob.docs[np.cumsum(blob.counts) - blob.counts][entry] if len(entry) else np.zeros(0, np.int64))
        spans.append((entry.astype(np.int32), a.astype(np.int32), b.astype(np.int32)))
    h, least = np.concatenate(hs), np.concatenate(least)
    edge = np.cumsum([0] + [len(x) for x in hs])
    del hs
    order = np.argsort(h)
    same = np.diff(h[order].view(np.int64)) == 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    del order, same
    # equal hashes: the words themselves decide, for a share of the hashes at a time
    shares = max(1, -(-int(twice.sum()) // COMPARED))
    twice = np.flatnonzero(twice)
    for share in range(shares):
        mine = twice[(h[twice] >> W.U(40)) % W.U(shares) == W.U(share)]
        code_of: dict[bytes, int] = {}
        codes = []
        for k, blob in enumerate(blobs):
            at = mine[np.searchsorted(mine, edge[k]) : np.searchsorted(mine, edge[k + 1])] - edge[k]
            if len(at):
                _, a, b = spans[k]
                text = bytes(blob.text)
                codes += [code_of.setdefault(text[x:y], len(code_of)) for x, y in zip(a[at].tolist(), b[at].tolist())]
        code = np.array(codes, np.int64)
        smallest = np.full(len(code_of), NONE, np.int64)
        np.minimum.at(smallest, code, least[mine])
        del code_of, codes
        least[mine] = smallest[code]
    return least, edge, spans


def _sorted_bucket(blobs: list[Blob], window: int):
    """Ranges of the occurrences at hand, and answers for those that aren't."""
    least, edge, spans = _smallest(blobs, window)
    answered: set[bytes] = set()
    for k, blob in enumerate(blobs):
        entry, begin, _ = spans[k]
        counts, docs = blob.counts, blob.docs
        m = least[edge[k] : edge[k + 1]]
        windows_of = np.bincount(entry, minlength=len(counts))
        wfirst = np.cumsum(windows_of) - windows_of
        some = np.zeros(len(counts), bool)
        if len(counts):
            last = docs[np.cumsum(counts) - 1]
            some[entry[m < last[entry]]] = True
        if not some.any() and not blob.hot.any():
            continue
        offset = _offsets(entry, begin, blob)
        # occurrences of entries with a window that someone has before
        own = np.repeat(np.arange(len(counts)), counts)
        take = some[own]
        own, doc, prints, pos = own[take], docs[take], blob.prints[take], blob.pos[take].astype(np.int64)
        reach = windows_of[own]
        index = np.repeat(wfirst[own], reach) + W.spread(reach)
        found = _spots(doc, prints, pos, reach, m[index] < np.repeat(doc, reach), offset[index], window)
        if found is not None:
            yield _found(RANGE, len(found[0]), **dict(zip(("doc_id", "print", "start", "len"), found)))
        if blob.hot.any():
            whole = bytes(blob.text).split(b"\n")
            keys, starts, lows = [], [], []
            for e in np.flatnonzero(blob.hot):
                key = _hot_key(whole[e])
                if key not in answered:
                    answered.add(key)
                    s = slice(wfirst[e], wfirst[e] + windows_of[e])
                    keys += [key] * int(windows_of[e])
                    starts.append(offset[s])
                    lows.append(m[s])
            if keys:
                yield _found(ANSWER, len(keys), key=keys, start=np.concatenate(starts), doc_id=np.concatenate(lows))


def _spots(doc, prints, begin, reach, on, offset, window):
    """Ranges of marked windows, joined where one follows another."""
    if not on.any():
        return None
    row = np.repeat(np.arange(len(doc)), reach)
    at = np.flatnonzero(on)
    row, offset = row[at], offset[at]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1
    return doc[row[a]], prints[row[a]], begin[row[a]] + offset[a], offset[b] - offset[a] + window


def _hot_ranges(window: int):
    """(doc_id, print, start, len) from the spots of hot packed strings and what their bucket found."""

    def work(stream):
        for batch in stream:
            for spots, mins in zip(batch.column("spots"), batch.column("mins")):
                spots, m = spots.as_py(), np.array(mins.as_py(), np.int64)
                n = len(spots) // 20
                doc, prints = np.frombuffer(spots, np.int64, n), np.frombuffer(spots, np.int64, n, 8 * n)
                begin = np.frombuffer(spots, np.int32, n, 16 * n).astype(np.int64)
                reach = np.full(n, len(m))
                on = np.tile(m, n) < np.repeat(doc, len(m))
                if (found := _spots(doc, prints, begin, reach, on, W.spread(reach), window)) is not None:
                    yield _found(RANGE, len(found[0]), **dict(zip(("doc_id", "print", "start", "len"), found))).select(["doc_id", "print", "start", "len"])

    return work


def shared_ids(docs: DataFrame) -> bool:
    """Do rows share a doc_id? Reads that column only."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null")
    with freed_shuffles(docs.sparkSession):
        return not ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _keyed(docs: DataFrame, shared: bool) -> DataFrame:
    """doc_id, text and a fingerprint of the text, which tells rows of one doc_id apart; 0 where none share one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.xxhash64("text") if shared else F.lit(0).cast("long")).alias("print"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, pass_bytes: int = PASS_BYTES, shared: bool | None = None) -> DataFrame:
    """doc_id, print (xxhash64 of the text, or 0 where no rows share a doc_id: see shared_ids()), start, len: ranges of words (counted from 0) to remove; ranges of a row may overlap."""
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = _keyed(docs, shared_ids(docs) if shared is None else shared)
    dictionary = _dictionary(docs)
    heavy, total = heavy_cells(docs, gram)
    buckets = max(partitions(spark), int(WORD_BYTES * total / bucket_bytes) + 1)
    parts = min(buckets, MOST_PARTS)  # a part has every MOST_PARTS-th bucket
    sent = docs.mapInArrow(_sender(heavy, window, gram, buckets, parts, dictionary), _SENT)
    dealt = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket")
    found = Tables(spark, "substrings").keep(dealt.mapInArrow(_bucket(window, pass_bytes, dictionary), _FOUND))
    # buckets that no task sorts
    loose = found.filter(F.col("kind") == WINDOWS)
    lows = loose.groupBy("h", "h2").agg(F.min("doc_id").alias("low"))
    met = loose.join(lows, ["h", "h2"])
    rest = met.filter("low < doc_id").select("doc_id", "print", "start", F.lit(window).alias("len"))
    answers = found.filter(F.col("kind") == ANSWER).select("key", F.col("start").alias("nth"), F.col("doc_id").alias("low"))
    answers = answers.unionByName(met.filter("key is not null").select("key", F.col("len").alias("nth"), "low"))
    # a string has at most RUN windows
    answers = answers.groupBy("key", "nth").agg(F.min("low").alias("low")).groupBy("key").agg(F.expr("transform(array_sort(collect_list(struct(nth, low))), x -> x.low)").alias("mins"))
    spots = found.filter(F.col("kind") == SPOTS).select("key", F.col("data").alias("spots"))
    hot = spots.join(answers, "key").mapInArrow(_hot_ranges(window), "doc_id long, print long, start int, len int")
    return found.filter(F.col("kind") == RANGE).select("doc_id", "print", "start", "len").unionByName(rest).unionByName(hot)


def _covered(rows: pa.RecordBatch, words: W.Words) -> np.ndarray:
    """Which words the last column's ranges cover."""
    gone = np.zeros(len(words) + 1, np.int32)
    ranges = rows.column(rows.num_columns - 1)
    size = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if size.sum():
        flat = ranges.flatten()
        start, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        row = np.repeat(np.arange(len(size)), size)
        a = np.minimum(words.first[row] + start, words.first[row + 1])
        b = np.minimum(a + length, words.first[row + 1])
        np.add.at(gone, a, 1)
        np.add.at(gone, b, -1)
    return np.cumsum(gone)[:-1] > 0


def with_ranges(docs: DataFrame, ranges: DataFrame, shared: bool) -> DataFrame:
    """docs with array<struct<start, len>> as its last column, null where nothing goes; shared as for the ranges."""
    name, own_id, own_print = "ranges", "ranged_id", "ranged_print"
    while {name, own_id, own_print} & set(docs.columns):
        name, own_id, own_print = name + "_", own_id + "_", own_print + "_"
    # a set: rows that are repeated have the same ranges
    grouped = ranges.groupBy(F.col("doc_id").alias(own_id), F.col("print").alias(own_print)).agg(F.collect_set(F.struct("start", "len")).alias(name))
    same = docs["doc_id"].cast("long") == F.col(own_id)
    if shared:
        same &= F.xxhash64(docs["text"]) == F.col(own_print)
    return docs.join(grouped, same, "left").select(*(docs[c] for c in docs.columns), name)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs, with every repeated word gone from `text`. A text that loses words has its other words joined by single spaces; others stay as they are."""
    names = docs.columns
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = shared_ids(docs)
    joined = with_ranges(typed, repeated_ranges(docs, window, gram, shared=shared), shared)
    schema = typed.select(*names).schema

    def cut(stream):
        for rows, raw, at in W.batches("text")(stream):
            words = W.Words(raw, at)
            gone = _covered(rows, words)
            keep = np.flatnonzero(~gone)
            flat, edge = words.joined(keep)
            first = np.searchsorted(keep, words.first)
            some = np.add.reduceat(np.append(gone, False), np.minimum(words.first[:-1], len(gone))) * (words.counts() > 0) if len(rows) else []
            texts = rows.column("text").to_pylist()
            for k in np.flatnonzero(some):
                texts[k] = flat[edge[first[k]] : max(edge[first[k]], edge[first[k + 1]] - 1)].tobytes().decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(texts, rows.schema.field("text").type) if n == "text" else rows.column(n) for n in names], names)

    return joined.mapInArrow(cut, schema)


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = shared_ids(base)
    joined = with_ranges(base, repeated_ranges(base, window, gram, bucket_bytes, pass_bytes, shared), shared)

    def digest(stream):
        for rows, raw, at in W.batches("text")(stream):
            words = W.Words(raw, at)
            gone = _covered(rows, words)
            keep = np.flatnonzero(~gone)
            flat, edge = words.joined(keep)
            flat = memoryview(flat)
            first = np.searchsorted(keep, words.first)
            n = words.counts()
            a, b = edge[first[:-1]], np.maximum(edge[first[:-1]], edge[first[1:]] - 1)
            sha = [hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n.astype(np.int64)), pa.array((n - np.diff(first)).astype(np.int64)), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
