import random
import re

import pytest

from ledgerlark.llm import ngram_join as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(smallest.get(root(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else smallest[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups, extra):
    r = random.Random(seed)
    vocabulary = [f"Wort{i}" for i in range(500)]
    rows = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 7, 12, 40, 90, 200]))]
        for _ in range(r.choice([1, 2, 6, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(w))
                if r.random() < 0.5:
                    w[k] = r.choice(vocabulary)
                else:
                    w.insert(k, r.choice(vocabulary))
            if r.random() < 0.2:
                w = [x.upper() for x in w]
            rows.append(" ".join(w))
    rows += ["", None, " \n", "one two three", "One TWO\tthree", "one two", "a b c d e f", "a b c d e f g"] + [f"t{i} " + "same " * 30 for i in range(5)]
    rows += [" ".join([f"p{i}" for i in range(60)] + [f"{r.choice('abcdefgh')}{k}" for k in range(3)]) for _ in range(extra)]
    r.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def got(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 25, 40)
    assert got(N.similar(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_long_lists_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 3)
    rows = corpus(3, 15, 60)
    assert got(N.similar(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(spark):
    assert N.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(5, "a b c d e", "f"), (4, "a b c d e", None), (4, "a b c d e", "n"), (None, "a b c d e", "x"), (3, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, f string")
    assert got(N.similar(df)) == sorted([(5, 2, 4), (4, 2, 4), (4, 2, 4), (None, 2, None), (3, 0, 3)], key=str)


def test_copies_behind_a_row_without_an_id_still_link(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (7, text), (9, text + " end"), (8, text)]
    assert got(N.similar(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == brute(rows)


def test_open_lists_of_unlinked_sets(spark, monkeypatch):
    # many texts that share half of their words and aren't similar, among them some that are
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for d in range(90):
        own = [f"o{d}x{k}" for k in range(30)]
        rows.append((d, " ".join(own + shared)))
        if d % 9 == 0:
            rows.append((200 + d, " ".join(own[1:] + shared)))
    rows += [(400 + d, " ".join(shared[d:] + shared[:d])) for d in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(N.similar(df)) == want
    monkeypatch.setattr(N, "LIST", 2)
    monkeypatch.setattr(N, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 50)
    assert got(N.similar(df)) == want
