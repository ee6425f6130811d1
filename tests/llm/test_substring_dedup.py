import hashlib
import random
import re

import numpy as np
import pytest

from ledgerlark.llm import _sketch, substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """(doc_id, n_words, n_removed, sha256) by the definition."""
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)] + ["the", "a"] * 40
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for d in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        if r.random() < 0.4:
            a = r.randrange(0, 30)
            at = r.randrange(0, len(w) + 1)
            w[at:at] = passage[a : a + r.randrange(10, 40)]
        rows.append((d, r.choice([" ", "\n", "  ", " \t"]).join(w)))
        if r.random() < 0.2:
            rows.append((1000 + d, rows[-1][1]))
    return rows + [(5001, None), (5002, ""), (5003, " \n\t"), (5004, "spam " * 400), (5005, "spam " * 300), (None, rows[3][1]), (5006, "x" * 200_000 + " y")]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.digests(df)) == brute(rows, 13)


def test_hot_strings_and_passes(spark, monkeypatch):
    rows = [(d, " ".join(f"p{i}" for i in range(40)) + f" own{d} tail") for d in range(150)] + corpus(5, 60)
    df = spark.createDataFrame([(d + 7000 if k < 150 else d, t) for k, (d, t) in enumerate(rows)], "doc_id long, text string")
    want = brute([(r.doc_id, r.text) for r in df.collect()], 13)
    assert got(S.digests(df)) == want
    ranges = S.repeated_ranges(df, pass_bytes=2000)
    assert ranges.count() > 0
    whole = {(r.doc_id, i) for r in S.repeated_ranges(df).collect() for i in range(r.start, r.start + r.len)}
    assert {(r.doc_id, i) for r in ranges.collect() for i in range(r.start, r.start + r.len)} == whole


def test_no_window_reaches_into_the_next_text(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        # pairs of neighbours that occur twice: what crosses from one to the next repeats as well
        pair = [" ".join(f"v{r.randrange(40)}" for _ in range(r.randrange(13, 30))) for _ in range(2)]
        rows += [(4 * k + i, t) for i, t in enumerate(pair + [pair[0] + f" x{k}", pair[1]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(S.digests(df)) == brute(rows, 13)
    lengths = {d: len(t.split()) for d, t in rows}
    assert all(x.start + x.len <= lengths[x.doc_id] for x in S.repeated_ranges(df).collect())


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(empty).collect() == []
    odd = spark.createDataFrame([(2, "a b c", 7, "x"), (1, None, 8, "y"), (2, "a b c", 9, None)], "doc_id long, text string, ranges int, start string")
    assert [tuple(r)[:3] for r in sorted(S.digests(odd).collect(), key=str)] == [(1, 0, 0), (2, 3, 0), (2, 3, 0)]


def test_removal_keeps_other_columns(spark):
    shared = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"a {shared}  b", 5), (2, f"c\n{shared} d", 6), (3, "x  y", 7)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, ranges int"))
    assert out.columns == ["doc_id", "text", "ranges"]
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "c d", 6), rows[2]]


@pytest.mark.parametrize("pass_bytes", [S.PASS_BYTES, 1000])
def test_rows_that_share_a_doc_id_lose_only_their_own(spark, pass_bytes):
    r = random.Random(3)
    words = [f"v{k}" for k in range(60)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    a, b = some(40), some(40)
    rows = [(1, a), (2, a), (2, b), (2, a), (3, b + " " + a)]
    for k in range(60):
        # many rows under few ids, hot strings among them
        rows.append((k % 5 + 10, r.choice([a, b, some(30)]) + " " + some(r.randrange(25))))
    rows += [(None, a), (None, b)] + [(40, a)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.digests(df, pass_bytes=pass_bytes)) == brute(rows, 13)
    assert (2, 40, 0, hashlib.sha256(b.encode()).hexdigest()) in got(S.digests(df))


def test_grams_are_counted_by_one_python_operator_a_task(spark, monkeypatch):
    plans, summed = [], _sketch._summed
    monkeypatch.setattr(_sketch, "_summed", lambda parts, *by: plans.append(parts._jdf.queryExecution().executedPlan().toString()) or summed(parts, *by))
    df = spark.createDataFrame([(f"a b c d{k % 3}",) for k in range(50)], "text string").repartition(20)
    assert _sketch.gram_levels(df, 2, lower=False).total == 150
    # the first sum reads the counts, the second the first's sums
    assert [len(re.findall(r"(?m)^[^(\n]*\bMapInArrow\b", x)) for x in plans] == [1, 2]


@pytest.mark.parametrize("width", [0, 1, 2, 4, 8])
def test_packed_numbers_come_back(width):
    top = (1 << 8 * width) - 1
    values = np.array([0, top, top // 3, top], np.uint64)
    raw = S._ints(values)
    assert len(raw) == 1 + width * len(values)
    back, at = S._read_ints(b"ab" + raw + b"rest", 2, len(values))
    assert (back.view(np.uint64) == values).all() and at == 2 + len(raw)


def test_packed_strings_come_back():
    docs, prints = np.array([-(2**63), 2**63 - 1, 5, 0]), np.array([-1, 2**62, 0, 7])
    rows, pos = np.array([0, 1, 3, 1]), np.array([0, 70_000, 3, 1])
    blob = S.Blob(S._pack([b"a b", b"c d"], np.array([True, False]), np.array([1, 3]), rows, docs, prints, pos))
    assert (blob.docs == docs[rows]).all() and (blob.prints == prints[rows]).all() and (blob.pos == pos).all()
    assert blob.counts.tolist() == [1, 3] and blob.hot.tolist() == [True, False] and bytes(blob.text) == b"a b\nc d"


def test_what_travels_stays_small_in_many_buckets(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice(["tha", "en", "ing", "ly", "er", "on"]) for _ in range(r.randrange(1, 5))) for _ in range(3000)]
    docs = spark.createDataFrame([(10_000 + d, " ".join(r.choice(vocabulary) for _ in range(400))) for d in range(600)], "doc_id long, text string").coalesce(1)
    size = sum(len(x.text) for x in docs.collect())
    heavy, _ = S.heavy_cells(docs, 4)
    dictionary = S._dictionary(docs)
    assert 0 < len(dictionary) <= S.DICTIONARY_BYTES
    sent = {}
    for buckets in (20, 2000):
        rows = S._keyed(docs, S.shared_ids(docs)).mapInArrow(S._sender(heavy, 13, 4, buckets, buckets, dictionary), S._SENT)
        sent[buckets] = sum(len(x.data) for x in rows.collect())
    assert sent[20] < 0.9 * size
    assert sent[2000] < 1.3 * sent[20]


@pytest.mark.parametrize("shared", [False, True])
def test_a_row_without_id_hides_none(spark, shared):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(None, passage), (None, "x y"), (0, passage), (5, passage + " end")] + [(7, "a"), (7, "b")] * shared
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert S.shared_ids(df) == shared
    assert got(S.digests(df)) == brute(rows, 13)
