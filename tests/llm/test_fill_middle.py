import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlark.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(u) for u in (units[:a], units[a:b], units[b:])]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = parts
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    r = random.Random(11)
    pieces = ["ein", "Wort", "öß", "😀", " ", " ", "<P", "S>", "<", ">", "<M", "$1", "\\", "\x00", "\x1c"]
    space = [" ", "\n", "\t", "\r\n", "\x0b\x0c", "   "]
    out = ["".join(r.choice(pieces) + r.choice(["", *space]) for _ in range(r.choice([1, 2, 5, 30]))) for _ in range(400)]
    return [*out, None, "", " ", "\n\n ", "one", " lead", "trail \n", "a <P> b", "<S>", "x<M>", "<P", "word " * 60_000, "x" * 300_000, " " * 200_000]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_brute_force(spark):
    rows = [(7 * i - 50, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (None, None), (3, "repeated text"), (3, "repeated text")]
    got = M.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for d, t in rows:
        n, form, p, m, output = brute(d, t)
        want.append((d, n, form, p, m, digest(output), digest(t or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {"plain", "spm", "psm"} == {x[2] for x in want}


def test_rearranged_texts_come_back_at_any_rate(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = M.transformed(spark.createDataFrame(rows, "doc_id long, text string"), seed=5, rate=100, spm=50)
    out = df.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert all(x["back"] == (x["text"] or "") for x in out)
    assert all(x["prefix"] + x["middle"] + x["suffix"] == x["text"] for x in out if x["form"] != "plain")
    forms = [x["form"] for x in out if x["text"] and not re.search("<[PSM]>", x["text"])]
    assert "plain" not in forms and forms.count("spm") > 100 and forms.count("psm") > 100


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 9, "mine")], "doc_id long, text string, lang string, n int, output string")
    out = M.transformed(df)
    assert out.columns[:3] == ["doc_id", "text", "lang"] and len(set(out.columns)) == len(out.columns)
    assert out.first()["n"] == 3 and out.first()["lang"] == "x"
    assert M.digests(df).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert M.digests(df.limit(0)).count() == 0


def test_plan_is_native_and_without_shuffle(spark):
    df = M.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all") == 1
