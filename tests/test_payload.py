"""The payload's blocks and the comparison of payloads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import compare as C, payload as P, warehouse as W
from ledgerlark.plans import warehouse_store
from ledgerlark.plans.kept import kept
from ledgerlark.plans.numbering import placed

TURNS = "session_id string, tool string, model_raw string, started_at long, status string, has_usage boolean, cache_read long, cache_write long, input long, output long, reasoning long, total long"
DAY = 86_400_000


def turns(spark, n=400):
    r = random.Random(3)
    rows = []
    for _ in range(n):
        used, c = r.random() < 0.9, [r.randrange(50) for _ in range(5)]
        at = r.choice([None, 0, r.randrange(1, 800_000), r.randrange(40 * DAY)])
        rows.append((f"s{r.randrange(60)}", "pi", r.choice(["openai/m-1", "m-1", "azure-m-2--int", "x", "", None]), at, r.choice(["error", "completed", None]), used, *((*c, sum(c[:4])) if used else (0,) * 6)))
    return spark.createDataFrame(rows, TURNS).withColumn("model_canon", __import__("ledgerlark.functions.models", fromlist=["x"]).canonical_model(F.col("model_raw")))


def payload(spark, zone="UTC"):
    t = turns(spark)
    sessions = spark.createDataFrame([(f"s{k}", f"title {k}", f"p{k % 4}" if k % 5 else None, k * DAY, k * DAY + 7) for k in range(64)], "id string, title string, project string, created_at long, updated_at long")
    messages = spark.createDataFrame([(f"s{k % 9}", "user" if k % 2 else "toolResult", "read" if k % 4 == 0 else "", k % 8 == 0) for k in range(40)], "session_id string, name string, tool string, is_error boolean")
    prices = spark.createDataFrame([("m-1", 1.0, 2.0, None, None), ("x", None, 3.0, None, None)], "model_canon string, price_input double, price_output double, price_cache_read double, price_cache_write double")
    ext = spark.createDataFrame([("codex", "gpt", "a", "2026-01-01T00:00:00Z", "2026-01-01", 5, 0, 0, 1, 6), ("codex", "gpt", "b", "2026-01-03T00:00:00Z", "2026-01-03", 7, 0, 0, 1, 8)], "tool string, model string, session string, ts string, d string, input long, cache_read long, cache_write long, output long, total long")
    ext_prices = spark.createDataFrame([("gpt", 2.0, 4.0, None, None)], "model string, price_input double, price_output double, price_cache_read double, price_cache_write double")
    commits = spark.createDataFrame([("/r/a", "p1", 3), ("/r/b", None, 9)], "root string, project string, commits long")
    source = {"generated_at": "2026-02-01", "db_path": "/home/me/.pi/pi.sqlite", "dir": "/home/me/.pi", "db_version": 12, "db_size": 1 << 20, "wal_size": 0, "prices_fetched_at": "2026-01-30"}
    return t, sessions, P.Payload(t, sessions, messages, prices, ext, ext_prices, commits, source, "/home/me", zone)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kathmandu"])
def test_blocks_equal_their_own_passes(spark, zone):
    t, sessions, p = payload(spark, zone)
    same(p.totals().select(*W.totals(t).columns), W.totals(t))
    same(p.days(), W.days(t, zone))
    same(p.day_model(), W.day_model(t, zone))
    same(p.hours(), W.hours(t, zone))
    same(p.projects(), W.projects(t, sessions))
    m = W.models(t)
    same(p.models().withColumn("raw_ids", F.array_join("raw_ids", "|")).select(*m.columns), m)
    raw = p.models().select("key", F.explode("raw_usage").alias("r")).select("key", "r.*")
    same(raw, W.model_raw(t).withColumn("rid", F.col("rid")))
    same(p.models().select("key", F.explode("statuses").alias("s")).select("key", "s.*"), W.model_status(t))
    usage = W.session_usage(t, sessions)
    same(p.sessions_all().select(*usage.columns), usage)
    same(p.sessions_top().select(*usage.columns), W.top_sessions(usage))


def test_one_scan_of_turns(spark):
    t, _, p = payload(spark)
    assert P.grains(t)._jdf.queryExecution().executedPlan().toString().count("Expand") == 1
    assert p.models()._jdf.queryExecution().executedPlan().toString().count("session_id") == 0


def test_rows_and_document(spark, tmp_path):
    _, _, p = payload(spark)
    whole = kept(p.rows(), "rows")
    rows = whole.select("block", "place", F.to_json("value").alias("v")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.block, r.place)):
        by.setdefault(r.block, []).append(json.loads(r.v))
        assert r.place == len(by[r.block])
    doc = json.loads(p.document().first()[0])
    assert set(by) == {*doc, "sessionsAll"} == set(p.blocks())
    gone = lambda x: {k: gone(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [gone(v) for v in x] if isinstance(x, list) else x
    for name, value in doc.items():
        assert gone(by[name]) == gone(value if isinstance(value, list) else [value]), name
    assert by["sessions"] == by["sessionsAll"][:40] and len(by["sessionsAll"]) == doc["sessionCount"]["sessions"] > 40
    totals = [s["total"] for s in by["sessionsAll"]]
    assert totals == sorted(totals, reverse=True)
    assert doc["meta"]["range_start"] == "" or doc["meta"]["range_start"][:10] <= "2026-01-01"
    assert doc["pricingMeta"]["models"] == len(doc["models"]) and [m["key"] for m in doc["pricing"]] == ["m-1"]
    assert doc["external"][0]["tool"] == "codex" and abs(doc["external"][0]["cost"] - (12 * 2 + 2 * 4) / 1e6) < 1e-12
    assert warehouse_store.publish_payload(spark, p, f"{tmp_path}/payload") == 1
    shown = warehouse_store.Warehouse.open(spark, f"{tmp_path}/payload")
    assert json.loads(warehouse_store.payload_json(shown)) == doc
    assert [r.id for r in shown.table("sessionsAll").orderBy("place").collect()] == [x["id"] for x in by["sessionsAll"]]
    assert C.prefix_broken(whole).count() == 0
    assert C.nested_differences(C.payload_entries(whole), C.payload_entries(whole)).count() == 0


def entries(spark, doc):
    return spark.createDataFrame([("", json.dumps(doc))], "path string, v string").select("path", F.parse_json("v").alias("value"))


def document():
    return {
        "meta": {"range": {"start": "2026-01-01", "end": None}, "version": 12, "flag": True},
        "models": [{"key": "a", "total": 10, "raw_usage": [{"rid": "x/a", "total": 4}, {"rid": "a", "total": 6}]}, {"key": "b", "total": 0.5, "raw_usage": []}],
        "dayModel": [{"d": "2026-01-01", "key": "a", "n": 1}, {"d": "2026-01-01", "key": "b", "n": 2}],
        "list": [1, [2, {"deep": [3]}], "x"],
        "empty": {},
    }


def paths(x, at=()):
    if isinstance(x, dict | list):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            yield from paths(v, (*at, k))
    elif x is not None:
        yield at


def changed(doc, at, value):
    doc = json.loads(json.dumps(doc))
    x = doc
    for k in at[:-1]:
        x = x[k]
    x[at[-1]] = value
    return doc


def test_every_perturbed_leaf_is_listed(spark):
    """Each leaf in turn is changed, set to null and, if a number, moved within the tolerance."""
    doc = document()
    left = entries(spark, doc)
    every = sorted(r.path for r in C.leaves(left).collect())
    assert every == sorted(["meta.range.start", "meta.version", "meta.flag", "models[a].key", "models[a].total", "models[a].raw_usage[x/a].rid", "models[a].raw_usage[x/a].total", "models[a].raw_usage[a].rid", "models[a].raw_usage[a].total", "models[b].key", "models[b].total", "dayModel[2026-01-01|a].d", "dayModel[2026-01-01|a].key", "dayModel[2026-01-01|a].n", "dayModel[2026-01-01|b].d", "dayModel[2026-01-01|b].key", "dayModel[2026-01-01|b].n", "list[0]", "list[1][0]", "list[1][1].deep[0]", "list[2]"])
    cases, want = [], []
    for n, at in enumerate(p for p in paths(doc) if not {"key", "rid", "d"} & {p[-1]}):
        old = doc
        for k in at:
            old = old[k]
        new = (not old) if isinstance(old, bool) else old + 1 if isinstance(old, int | float) else old + "!"
        cases += [changed(doc, at, new), changed(doc, at, None)]
        want += [(str(old).lower() if isinstance(old, bool) else str(old), str(new).lower() if isinstance(new, bool) else str(new)), (str(old).lower() if isinstance(old, bool) else str(old), None)]
        if n > 0:
            break
    every_one = doc
    for at in paths(doc):
        if not {"key", "rid", "d"} & {at[-1]}:
            every_one = changed(every_one, at, "new")
    assert sorted(r.path for r in C.nested_differences(left, entries(spark, every_one)).collect()) == [p for p in every if p.rpartition(".")[2] not in ("key", "rid", "d")]
    for case, (a, b) in zip(cases, want):
        got = C.nested_differences(left, entries(spark, case)).collect()
        assert [(r.left_value, r.right_value) for r in got] == [(a, b)]


def test_order_moves_and_tolerance(spark):
    doc = document()
    moved = json.loads(json.dumps(doc))
    moved["models"].reverse()
    moved["models"][1]["raw_usage"].reverse()
    moved["models"][0]["total"] = 0.5 + 1e-12
    assert C.nested_differences(entries(spark, doc), entries(spark, moved)).count() == 0
    moved["models"].append({"key": "c", "total": 1})
    del moved["dayModel"][0]
    got = sorted((r.path, r.left_value, r.right_value) for r in C.nested_differences(entries(spark, doc), entries(spark, moved)).collect())
    assert got == [("dayModel[2026-01-01|a].d", "2026-01-01", None), ("dayModel[2026-01-01|a].key", "a", None), ("dayModel[2026-01-01|a].n", "1", None), ("models[c].key", None, "c"), ("models[c].total", None, "1")]
    twice = json.loads(json.dumps(doc))
    twice["dayModel"][1]["key"] = "a"  # two entries with one key
    assert {r.path for r in C.nested_differences(entries(spark, doc), entries(spark, twice)).collect()} == {f"dayModel[2026-01-01|{k}].{f}" for k in "ab" for f in ("d", "key", "n")}


def reads(df):
    """How often a plan reads its input."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_entries_are_opened_once(spark):
    df = spark.createDataFrame([("", "1")], "path string, v string").rdd.toDF("path string, v string").select("path", F.parse_json("v").alias("value"))
    assert reads(C.leaves(df)) == 1
    assert reads(C.nested_differences(df, df)) == 2


def test_differences_by_whatever_entries(spark):
    """One side is a document, the other its parts; names hold brackets and dots, entries share beginnings, and some levels are too deep."""
    doc = document() | {"deep": json.loads("[" * 11 + '{"a": "x"}' + "]" * 11), "a[b": {"c.d": 1, "e]": [2, 3]}, "ids": [{"id": "s]1"}], "tools": [{"name": "a"}, {"name": "a"}], "none": None}
    whole = entries(spark, doc)
    parts = [(f"models[{m['key']}]", m) for m in doc["models"]] + [(k, v) for k, v in doc.items() if k not in ("models", "list", "deep")] + [(f"list[{i}]", v) for i, v in enumerate(doc["list"])]
    parts = [p for p in parts if p[0] != "meta"] + [("meta.range", doc["meta"]["range"]), ("meta", {k: v for k, v in doc["meta"].items() if k != "range"})]
    split = lambda rows: spark.createDataFrame([(p, json.dumps(v)) for p, v in rows], "path string, v string").select("path", F.parse_json("v").alias("value"))
    deep = C.leaves(whole).filter("path like 'deep%'").collect()
    assert [(r.path, r.value) for r in deep] == [("deep" + "[0]" * 7, '[[[[{"a":"x"}]]]]')]
    for cut in (1, 2):
        got = {(r.path, r.left_value, r.right_value) for r in C.nested_differences(whole, split(parts), cut=cut).collect()}
        assert got == {(deep[0].path, deep[0].value, None)}
        # a part given twice, and one that lacks
        got = {(r.path, r.left_value, r.right_value) for r in C.nested_differences(whole, split([*parts, ("meta", {"flag": True, "version": 13})][1:]), cut=cut).collect()}
        assert got == {(deep[0].path, deep[0].value, None), ("meta.flag", "true", "true|true"), ("meta.version", "12", "12|13")} | {(r.path, r.value, None) for r in C.leaves(whole).filter("path like 'models[a]%'").collect()}
    empty = spark.createDataFrame([("x", None)], "path string, v string").select("path", F.parse_json("v").alias("value"))
    assert C.leaves(empty).count() == 0 and C.nested_differences(empty, empty).count() == 0


def test_units_give_the_leaves(spark):
    """Whichever way a unit is opened, its leaves have the text of leaves()."""
    texts = ["1", "1.50", "-0.0", "1e2", "1E400", "1e-7", "9" * 30, "9" * 50, "0.0000001", "true", "null", '"x\\u0001\\u001f\\n\\u007f/é\\"\\\\"', '"TIMESTAMP"', '{"a": {"b": [1, 2.0]}}', '{"TIMESTAMP": 1}', "[]", "{}", "[1, \"x\", [2], null]"]
    texts += ["[" * 9 + t + "]" * 9 for t in texts] + [f'{{"tools": [{{"name": {t}}}, {{"name": null}}, 5], "days": {{"x": {t}}}, "a]": [{{"c": {t}}}]}}' for t in texts]
    parsed = spark.createDataFrame([(f"p{k}" if k % 2 else f"models[{k}]", t) for k, t in enumerate(texts)], "path string, v string").select("path", F.parse_json("v").alias("value"))
    typed = spark.sql("""SELECT name AS path, value FROM (SELECT stack(7, 'date', CAST(date'2020-01-01' AS variant), 'ts', CAST(timestamp'2020-01-01 00:00:00' AS variant), 'ntz', CAST(timestamp_ntz'2020-01-01 00:00:00.5' AS variant), 'nan', CAST(double('NaN') AS variant),
      'float', CAST(float(0.1) AS variant), 'decimal', CAST(CAST(1.50 AS decimal(10, 4)) AS variant), 'binary', CAST(CAST('ab' AS binary) AS variant)) AS (name, value))""")
    inner = typed.groupBy().agg(F.collect_list("value").alias("x")).select(F.lit("tools[q]").alias("path"), F.to_variant_object(F.struct("x")).alias("value"))
    every = parsed.union(typed).union(inner).union(typed.select(F.concat(F.lit("models[z].raw_usage["), "path", F.lit("]")), F.to_variant_object(F.array(F.struct(F.col("value").alias("rid"), F.col("value").alias("v")))))).localCheckpoint()
    nothing = every.limit(0)
    want = {}
    for r in C.leaves(every).collect():
        want.setdefault(r.path, []).append(r.value)
    for cut in (1, 2):
        assert {r.path: r.left_value for r in C.nested_differences(every, nothing, cut=cut).collect()} == {p: "|".join(sorted(v)) for p, v in want.items()}
    assert C.nested_differences(every, every).count() == 0


def test_prefix_rule(spark):
    rows = [("sessionsAll", k, json.dumps({"id": k})) for k in range(1, 46)] + [("sessions", k, json.dumps({"id": k})) for k in range(1, 41)]
    df = lambda r: spark.createDataFrame(r, "block string, place long, v string").select("block", "place", F.parse_json("v").alias("value"))
    assert C.prefix_broken(df(rows)).count() == 0
    bad = rows[:-2] + [("sessions", 39, json.dumps({"id": 39, "title": "t"})), ("sessions", 41, json.dumps({"id": 41}))]
    assert sorted((r.place, r.head is None, r.whole is None) for r in C.prefix_broken(df(bad)).collect()) == [(39, False, False), (40, True, False), (41, False, True)]


def test_places(spark):
    r = random.Random(1)
    values = [r.randrange(10**6) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    got = sorted((x.place, x.id) for x in placed(df, [F.desc("v"), F.col("id")]).collect())
    assert got == [(k + 1, i) for k, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)))]
    assert placed(df.limit(0), [F.col("id")]).count() == 0
