import math
import random
import re
import zlib

import numpy as np

from ledgerlark.llm import quality_gam as G, quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def corpus():
    r = random.Random(4)
    vocabulary = ["ab", "é", "Das#", "x|y", "lang", "word", "ünï", "<b>", "q"]
    rows = []
    for d in range(150):
        lines = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 9))]
        rows.append((d, "\n".join(lines + lines[: r.randrange(0, 3)]), r.choice(["en", None]), r.choice(["s", "t"])))
    return rows + [(900, None, "en", "s"), (901, "", None, None), (None, "a b", "en", "s"), (902, " \n \t", "en", "s"), (903, "a b c d e f g h " * 50, "en", "s"), (904, "z" * 100_000, "en", "s")]


def test_rules_against_brute_force(spark):
    rows = corpus()
    out = R.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    got = sorted((tuple(x)[:7] for x in out), key=str)
    want = []
    for d, t, _, _ in rows:
        n = brute(t)
        want.append((d, *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert got == sorted(want, key=str)
    assert all(not (x.kept and x.base_failed) and (x.kept == (x.failed_rule is None)) for x in out)


def test_fences_adapt_to_the_group(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for d in range(900):
        code = d % 3 == 0  # one source is full of symbols
        junk = d % 50 == 1
        w = [word() + ("##" if code and k % 2 else "") + ("$$$" if junk else "") for k in range(80)]
        rows.append((d, " ".join(w), "en", "code" if code else "prose"))
    kept = {x.doc_id: x.kept for x in R.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[d] for d in kept if d % 50 != 1)
    assert not any(kept[d] for d in kept if d % 50 == 1 and d % 3)


def test_quantiles_of_merged_sketches(spark):
    rows = [(i, "w " * (i % 90 + 10), "en", f"s{i % 2}") for i in range(400)]
    measured = R.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    whole = R._fences(R.sketch(measured), ["lang"]).first()
    parts = R.sketch(measured.filter("doc_id < 100")).unionByName(R.sketch(measured.filter("doc_id >= 100")))
    assert R._fences(parts, ["lang"]).first() == whole
    x = np.array([t.count("w") / (t.count("w") + 20) for _, t, _, _ in rows])
    want = np.log(np.quantile(x, 0.5)) + R.SPREAD * (np.log(np.quantile(x, 0.75)) - np.log(np.quantile(x, 0.5)))
    assert abs(whole.max_word_length - want) < 2 * R.SPREAD * np.log(R.GAMMA)


def exact_verdicts(rows, measured):
    """doc_id -> kept, by quantiles of the bins of all values, sorted."""
    bin_of = lambda x: math.ceil(math.log(x) / math.log(R.GAMMA)) if x > 0 else R.ZERO

    def fence(group, m):
        x = sorted(bin_of(v[m]) for v in group)
        at = lambda q: x[max(0, math.ceil(q * len(x) - 1e-9) - 1)]
        mid = at(0.5)
        spread = next(((at(q) - mid) * scale for q, scale in R.UPPER if at(q) > mid), 0.0)
        return None if mid == R.ZERO else mid * math.log(R.GAMMA) + max(R.SPREAD * spread * math.log(R.GAMMA), R.leeway(R.MEASURES[m][1])) + math.log(2 / (R.GAMMA + 1))

    def drawn(own, n, towards):
        known = [v for v in (own, towards) if v is not None]
        return n / (n + R.SHRINK) * own + R.SHRINK / (n + R.SHRINK) * towards if len(known) == 2 else known[0] if known else None

    out = {}
    for x in measured:
        own = [y for y in measured if (y.lang, y.source) == (x.lang, x.source)]
        lang = [y for y in measured if y.lang == x.lang]
        base = x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words
        high = {m: drawn(fence(own, m), len(own), drawn(fence(lang, m), len(lang), fence(measured, m))) for m in R.MEASURES}
        out[x.doc_id] = not base and all(h is None or x[m] <= R.GAMMA * math.exp(h) for m, h in high.items())
    return out


def test_verdicts_against_quantiles_of_all_values(spark):
    r = random.Random(8)
    rows = []
    for d in range(160):
        w = [r.choice(["plain", "words", "Name", "a", "tree,"]) + r.choice(["", "", "", "#", "!!"][: 3 + d % 3]) for _ in range(r.randrange(15, 90))]
        rows.append((d, " ".join(w) + "\n" + " ".join(w[:9]) * (d % 7 == 0), r.choice(["en", "de", None]), r.choice(["s", "t", None])))
    rows += [(200 + d, "one text that many share, word for word, as it is a copy of what a source has had in its first place " * 2, "en", "copies") for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = exact_verdicts(rows, R.measure(df).collect())
    got = {x.doc_id: x.kept for x in R.verdicts(df).collect()}
    assert got == want and len(set(want.values())) == 2


def test_no_cutoff_is_fixed(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fences = R.thresholds(R.measure(docs)).collect()
    assert all(len({f[f"max_{m}"] for f in fences}) > len(fences) // 2 for m in R.MEASURES)
    quality = {x.doc_id: x.quality for x in labels.collect()}
    out = R.verdicts(docs).collect()
    good = [x.kept for x in out if quality.get(x.doc_id) == 1 and not x.base_failed]
    bad = [x.kept for x in out if quality.get(x.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.03 * len(bad)


def test_rules_of_no_rows(spark):
    assert R.verdicts(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_gam_learns_tables_and_a_pair(monkeypatch):
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.625) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.fit(x, y)
    assert (1, 0) in model.pairs
    right = lambda m: ((m.score(x) >= 0.5) == (y > 0)).mean()
    assert right(model) > 0.9
    monkeypatch.setattr(G, "PAIRS", 0)
    assert right(G.fit(x, y)) < 0.75
    assert np.allclose(model.score(x[:5]), np.concatenate([model.score(x[i : i + 1]) for i in range(5)]))


def test_gam_query(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "house", "of", "green", "tree", "was", "old"]) + "." * (k % 9 == 8) for k in range(60))
    rows = [(i, good() if i % 4 else "BUY!! NOW!! " * 30, "en", "s", 1) for i in range(400)] + [(None, "x", None, None, 0), (1000, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(None, 1, 0), (2, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in G.scores(docs, labels).collect()}
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out.values())
    assert all(out[i].predicted == (i % 4 > 0) for i in range(400))
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    none = G.scores(docs, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert G.scores(docs.limit(0), labels).collect() == []


def test_gam_doesn_t_depend_on_the_order_of_repeated_ids(spark):
    rows = [(i % 60, f"{'good words of a text ' * (i % 7 + 1)}{'!#' * (i % 5)}") for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    found = []
    for k in (0, 77, 180):
        docs = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string").repartition(3)
        found.append(sorted((x.doc_id, x.score) for x in G.scores(docs, labels).collect()))
    assert found[0] == found[1] == found[2]


def test_scores_against_adding_up():
    from bisect import bisect_right

    r = np.random.default_rng(3)
    x = np.round(r.random((500, 4)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0.8).astype(float)
    model = G.fit(x, y)
    assert model.pairs
    for row, got in zip(x[:60], model.score(x[:60])):
        total = model.base + sum(table[bisect_right(cuts.tolist(), v)] for cuts, table, v in zip(model.cuts, model.tables, row))
        for (a, b), table in zip(model.pairs, model.pair_tables):
            total += table[bisect_right(model.pair_cuts[a].tolist(), row[a])][bisect_right(model.pair_cuts[b].tolist(), row[b])]
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-12


def test_trees_against_all_cuts():
    r = np.random.default_rng(6)
    for _ in range(30):
        g, h = r.normal(size=(5, 6)), r.random((5, 6)) + 0.1
        gain, leaves = G._pair_tree(g, h)
        part = lambda a, b, c, d: g[a:b, c:d].sum() ** 2 / (h[a:b, c:d].sum() + 1)
        tries = {(i, j): part(0, i, 0, j) + part(0, i, j, 6) + part(i, 5, 0, j) + part(i, 5, j, 6) - part(0, 5, 0, 6) for i in range(1, 5) for j in range(1, 6)}
        (i, j), best = max(tries.items(), key=lambda x: x[1])
        assert abs(gain - max(best, 0)) < 1e-9
        if best > 0:
            assert abs(leaves[0, 0] - g[:i, :j].sum() / (h[:i, :j].sum() + 1)) < 1e-9 and abs(leaves[-1, -1] - g[i:, j:].sum() / (h[i:, j:].sum() + 1)) < 1e-9
