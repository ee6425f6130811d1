import json
import os
import sqlite3
import subprocess

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerlark.operators import cli_sessions, ingest as I, resolve as R, rollups as Y, sequences as S
from ledgerlark.plans import collect as K
from ledgerlark.plans.versions import Versions
from ledgerlark.sources import git, paths as P, readers, sqlite
from ledgerlark.streaming import usage as U

MANIFEST = {"id": "tool", "kind": "jsonl", "prefilter": '"usage"', "require": ["message.usage"], "dedup": ["message.id", "requestId"],
            "fields": {"model": ["message.model"], "session": ["sessionId", "$dir"], "time": ["timestamp"], "input": ["message.usage.in"], "cacheRead": ["message.usage.cr"], "output": ["message.usage.out"], "reasoning": ["message.usage.think"]}}


def line(i, n, **more):
    return json.dumps({"timestamp": "2026-05-01T10:00:00Z", "message": {"id": i, "model": "m", "usage": {"in": n, "out": 1}}} | more)


def manifest(folder, **more):
    return I.Manifest.of(MANIFEST | {"paths": [f"{folder}/**/*.jsonl"]} | more)


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_values(spark):
    raw = [{"a": {"b": 5.9}}, {"a": {"b": " 12.7 "}}, {"a": {"b": True}}, {"a": {"b": ""}, "c": 7}, {"a": None, "c": "x"}, {}, {"a": {"b": 0}, "c": 9}, {"a": {"b": [1, 2]}}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(raw)], "k int, value string")
    out = I.decoded(df).orderBy("k").select(I.to_int(I.first_of(F.col("obj"), ("a.b", "c"))).alias("n"), I.shown(I.first_of(F.col("obj"), ("a.b", "c"))).alias("s")).collect()
    assert [r.n for r in out] == [5, 12, 1, 7, 0, 0, 0, 0]
    assert [r.s for r in out][2:7] == ["True", "7", "x", None, "0"]
    assert [r[0] for r in I.decoded(df).filter("k = 7").select(I.dig(F.col("obj"), "a.b[1]", "bigint")).collect()] == [2]
    times = spark.createDataFrame([("1788934623096",), ("12",), ("2026-01-01",), (None,)], "t string").select(I.time_text(F.col("t"))).collect()
    assert [r[0] for r in times] == ["2026-09-09T06:17:03.096Z", None, "2026-01-01", None]


def test_requirements(spark):
    m = I.Manifest("x", require=("u",), where={"t": "a", "n": 1, "f": True, "z": None})
    rows = [{"u": {"q": 1}, "t": "a", "n": 1.0, "f": True}, {"u": {}, "t": "a", "n": 1, "f": True}, {"u": [], "t": "a", "n": 1, "f": True}, {"u": "", "t": "a", "n": 1, "f": True}, {"u": 1, "t": "b", "n": 1, "f": True}, {"u": 1, "t": "a", "n": 2, "f": True}, {"u": 1, "t": "a", "n": 1, "f": False}, {"u": 0, "t": "a", "n": 1, "f": True}, {"u": 1, "t": "a", "n": 1, "f": True, "z": 3}]
    df = I.decoded(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "k int, value string"))
    assert sorted(r.k for r in df.filter(I.required(m, F.col("obj"))).collect()) == [0, 7]


def test_normalisation(spark):
    m = I.Manifest.of({"id": "t", "fields": {"model": ["m"], "session": ["s"], "time": ["ts"], "input": ["i"], "cacheRead": ["c"], "output": ["o"], "reasoning": ["r"]}, "inputSubtract": ["c"], "outputAdd": ["r"], "reasoningIsSubsetOfOutput": False, "dedup": ["id"]})
    rows = [{"id": 1, "i": 10, "c": 4, "o": 2, "r": 5}, {"id": 2, "i": 1, "c": 4, "o": 0}, {"i": 0}, {"id": None, "i": 3, "m": "x", "s": "y"}]
    df = I.decoded(spark.createDataFrame([("f", "d", k, json.dumps(r)) for k, r in enumerate(rows)], "file string, dir string, line long, value string"))
    out = I.normalized(df, m).orderBy("line").collect()
    assert [(r.input, r.cache_read, r.output, r.reasoning, r.has_usage) for r in out] == [(6, 4, 7, 5, True), (0, 4, 0, 0, True), (0, 0, 0, 0, False), (3, 0, 0, 0, True)]
    assert [(r.model, r.session, r.dedup_key) for r in out] == [("(unknown)", "d", "t:1"), ("(unknown)", "d", "t:2"), ("(unknown)", "d", "t:f#2"), ("x", "y", "t:f#3")]


def test_cached_equals_full(spark, tmp_path):
    home = str(tmp_path)
    write(f"{home}/logs/a.jsonl", line("1", 10), line("1", 99), line("2", 0), "not json", '{"no": 1}', line("x", 0, requestId="r"))
    write(f"{home}/logs/b.jsonl", line("2", 500), line("3", 2), line("1", 77))
    m = manifest("{home}/logs")
    rows = lambda df: sorted((r.dedup_key, r.input, r.output) for r in df.collect())
    full = rows(K.usage_records(spark, [m], home))
    assert full == [("tool:1:", 10, 1), ("tool:2:", 0, 1), ("tool:3:", 2, 1), ("tool:x:r", 0, 1)]
    cache = f"{home}/cache"
    assert rows(K.usage_records(spark, [m], home, cache=cache)) == full
    files = P.files(m, home)
    assert K.cached_contributions(spark, m, files, cache)[1] == []
    write(f"{home}/logs/b.jsonl", line("4", 8))
    assert K.cached_contributions(spark, m, files, cache)[1] == [f"{home}/logs/b.jsonl"]
    assert rows(K.usage_records(spark, [m], home, cache=cache)) == rows(K.usage_records(spark, [m], home))
    os.remove(f"{home}/logs/a.jsonl")
    K.cached_contributions(spark, m, P.files(m, home), cache)
    assert len(Versions(spark, f"{cache}/tool").current()[1]["files"]) == 1
    assert K.changed(f"{home}/state.json", [m], home) == ["tool"] and K.changed(f"{home}/state.json", [m], home) == []


def test_documents_and_nested_rows(spark, tmp_path):
    write(f"{tmp_path}/s/one.json", json.dumps({"sessionId": "S", "model": "M", "messages": [{"id": "a", "tokens": {"input": 3}}, {"id": "b", "model": None}, 5]}))
    write(f"{tmp_path}/s/two.json", json.dumps([{"k": 1}, 2, {"k": 3}]))
    write(f"{tmp_path}/s/three.json", '{"k": 4}', '{"k": 5}')
    docs = readers.documents(spark, sorted(str(p) for p in (tmp_path / "s").iterdir()))
    got = sorted((os.path.basename(r.file), r.line, r.dir) for r in docs.select("file", "line", "dir").collect())
    assert got == [("one.json", 0, "s"), ("three.json", 1, "s"), ("three.json", 2, "s"), ("two.json", 1, "s"), ("two.json", 3, "s")]
    rows = I.flattened(docs, "messages").select("line", *(I.dig(F.col("obj"), k).alias(k) for k in ("id", "sessionId", "model"))).orderBy("line").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "S", "M"), (1, "b", "S", None)]


def test_zstd_frames(spark, tmp_path):
    c = zstandard.ZstdCompressor()
    whole = c.compress(b'{"a": 1}\n{"a": 2}\n') + c.compress(b'{"a": 3}\n')
    (tmp_path / "x.zstd").write_bytes(whole + c.compress(b'{"a": 4}\n' * 500)[:-9])
    (tmp_path / "y.zstd").write_bytes(b'{"a": 9}\n')
    got = readers.zstd_jsonl(spark, [str(tmp_path / "x.zstd"), str(tmp_path / "y.zstd")]).orderBy("file", "line").collect()
    assert [(r.line, r.value) for r in got] == [(0, '{"a": 1}'), (1, '{"a": 2}'), (3, '{"a": 3}'), (0, '{"a": 9}')]


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "u.db")
    db.execute("create table t (id integer, model text, data text, raw blob)")
    db.executemany("insert into t values (?, ?, ?, ?)", [(1, "a", '{"model": "b", "n": 5}', b"z"), (2, "c", "[]", None)])
    db.commit()
    rows = [json.loads(r.value) for r in sqlite.scan(spark, [str(tmp_path / "u.db")], "select * from t order by id", "data").orderBy("line").collect()]
    assert [(r["model"], r.get("n"), r["raw"]) for r in rows] == [("b", 5, "z"), ("c", None, None)] and rows[0]["$dir"] == tmp_path.name
    with pytest.raises(Exception, match="u.db"):
        sqlite.scan(spark, [str(tmp_path / "u.db")], "select nothing from nowhere").count()
    m = I.Manifest.of({"id": "s", "kind": "sqlite", "db": f"{tmp_path}/u.db", "query": "select id, model, 4 as i from t", "fields": {"model": ["model"], "input": ["i"], "output": ["o"]}})
    assert K.usage_records(spark, [m], str(tmp_path)).count() == 2


def test_paths(tmp_path):
    env = {"DATA": "/d", "X": "x"}
    assert P.expand("~/a/$DATA/${X}/%X%/%%/%NONE%/{home}", "/h", env) == "/h/a//d/x/x/%/%NONE%//h"
    assert P.expand("%APPDATA%/b", "/h", {}, "linux") == "/h/.local/share/b" and P.expand("%AppData%/b", "/h", {}, "darwin") == "/h/Library/Application Support/b"
    assert P.expand("%LOCALAPPDATA%|%APPDATA%|%ProgramData%", "/h", {"XDG_STATE_HOME": "/s", "XDG_CONFIG_HOME": "/c", "XDG_DATA_HOME": ""}, "linux") == "/s|/c|/h/.local/share"
    assert P.expand("%USERPROFILE%|%HOMEPATH%|%HOMEDRIVE%", "/h", {"HOME": "/me"}, "linux") == "/me|%HOMEPATH%|%HOMEDRIVE%" and P.expand("%APPDATA%", "/h", {}, "win32") == "%APPDATA%"
    m = I.Manifest.of({"id": "m", "paths": ["%NONE%/a", "%NONE%/b"]})
    assert P.unresolved(m, "/h", {}) == ["NONE"] and P.unresolved(I.Manifest.of({"id": "m", "paths": ["%NONE%/a", "/b"]}), "/h", {}) == []
    a, b = I.Manifest.of({"id": "a"}), I.Manifest.of({"id": "b"})
    assert P.claim([(a, ["1", "2"]), (b, ["2", "3"])]) == ({"a": ["1", "2"], "b": ["3"]}, {"b": [("2", "a")]})
    assert I.Manifest.of({"id": "q", "kind": "odd", "driver": "none"}).problems() == ["unknown kind odd", "no paths", "unknown driver none", "no field model", "no field input", "no field output"]
    for name, i in (("b.json", "two"), ("a.json", "one")):
        (tmp_path / name).write_text(json.dumps({"id": i}))
    assert [m.id for m in P.load_manifests(tmp_path)] == ["one", "two"] and [m.id for m in P.load_manifests(tmp_path, ["two"])] == ["two"]


def test_counter_logs(spark):
    rows = [("f", 1, "d1", 10, 10, None), ("f", 2, "d1", 15, 5, None), ("f", 3, "d2", None, None, "m"), ("f", 4, "d2", 18, 3, None), ("f", 5, "d3", 4, 4, None), ("f", 6, "d3", 4, 4, None), ("g", 1, "d1", 7, 7, None)]
    log = spark.createDataFrame(rows, "file string, line long, day string, total long, last long, context_model string")
    deltas = S.counter_deltas(log)
    assert [(r.delta, r.reset, r.parked) for r in deltas.orderBy("file", "line").collect()] == [(10, False, True), (5, False, True), (3, False, False), (4, True, False), (0, False, False), (7, False, True)]
    got = sorted((r.file, r.model, r.day, r.tokens) for r in S.counter_records(deltas).collect())
    assert got == [("f", "m", "d1", 15), ("f", "m", "d2", 3), ("f", "m", "d3", 4), ("g", "(unknown)", "d1", 7)]


def at(s):
    return f"2026-03-01T00:00:{s:02d}.000Z"


def msg(i, s, role, **m):
    return {"type": "message", "id": i, "timestamp": at(s), "message": {"role": role} | m}


def test_cli_sessions(spark, tmp_path):
    use = lambda n: {"input": n, "output": 2 * n, "cacheRead": 0, "cacheWrite": 1, "reasoning": 0}
    a = [
        {"type": "session", "version": 3, "id": "A", "timestamp": at(0), "cwd": "D:\\p\\alpha"},
        {"type": "model_change", "id": "mc", "timestamp": at(0), "modelId": "azure-big--int"},
        msg("s", 1, "system"),
        msg("a0", 2, "assistant", usage=use(1), stopReason="stop"),
        msg("u1", 3, "user"),
        msg("a1", 4, "assistant", model="openai/other", usage=use(2), stopReason="toolUse", content=[{"type": "toolCall", "id": "c1", "name": "read"}, {"type": "toolCall", "id": "c2", "name": "read"}]),
        msg("r1", 5, "toolResult", toolCallId="c1", isError=True),
        msg("a2", 6, "assistant", usage=use(3), stopReason="refusal"),
        msg("a2", 7, "assistant", usage=use(100)),
        {"type": "compaction", "id": "k", "timestamp": at(8), "usage": use(4)},
        msg("a3", 9, "assistant", usage=use(5)),
    ]
    write(f"{tmp_path}/A.jsonl", *map(json.dumps, a), '{"type": "message", "id": "cut')
    write(f"{tmp_path}/A.revisions.jsonl", json.dumps(msg("rev", 3, "assistant", usage=use(10**6))))
    write(f"{tmp_path}/B.jsonl", json.dumps({"type": "session", "id": "B", "timestamp": at(0)}), json.dumps(msg("bu", 1, "user")))
    write(f"{tmp_path}/C.jsonl", json.dumps({"type": "session", "id": "C", "timestamp": at(0)}), json.dumps(msg("cu", 1, "assistant", usage=use(1))))
    lines = I.decoded(readers.jsonl(spark, sorted(str(p) for p in tmp_path.iterdir())))
    out = cli_sessions.collect(lines, known=spark.createDataFrame([("C",)], "id string"))
    assert [(r.id, r.project, r.model_raw, r.created_at % 60000, r.updated_at % 60000, r.turns, r.messages) for r in out["sessions"].collect()] == [("A", "alpha", "azure-big--int", 0, 9000, 3, 7)]
    turns = out["turns"].orderBy("started_at").collect()
    assert [(r.model_raw, r.model_canon, r.status, r.started_at % 60000, r.ended_at % 60000, r.input, r.total) for r in turns] == [
        ("azure-big--int", "big", "completed", 2000, 2000, 1, 4),
        ("azure-big--int", "big", "error", 3000, 9000, 10, 33),
        ("azure-big--int", "big", "completed", 8000, 8000, 4, 13),
    ]
    assert sorted(map(tuple, out["roles"].collect())) == [("assistant", 4, 1), ("system", 1, 0), ("toolResult", 1, 1), ("user", 1, 0)]
    assert [tuple(r) for r in out["tools"].collect()] == [("read", 2, 1)]
    s = out["stats"].first()
    assert (s.files, s.sessions, s.skipped_dup, s.skipped_empty) == (3, 1, 1, 1)


def test_git(spark, tmp_path):
    def run(where, *a, **env):
        subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", "-C", str(where), *a], check=True, capture_output=True, env=os.environ | env)

    a, b = tmp_path / "a b", tmp_path / "empty"
    for folder in (a / "sub", b):
        os.makedirs(folder)
    for folder in (a, b):
        run(folder, "init")
    for day, subject in (("03", "zeta\tpart"), ("03", "alpha"), ("05", "Größe"), ("03", "late, of an old day")):
        run(a, "commit", "--allow-empty", "-m", subject, GIT_AUTHOR_DATE=f"2026-04-{day}T10:00:00Z")
    log = git.commits(spark, [str(a), str(a / "sub"), str(b), "/"], since="1990-01-01")
    root = os.path.realpath(a)
    assert [tuple(r) for r in log.orderBy("n").collect()] == [(root, 0, "2026-04-03", "late, of an old day"), (root, 1, "2026-04-05", "Größe"), (root, 2, "2026-04-03", "alpha"), (root, 3, "2026-04-03", "zeta\tpart")]
    assert log.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, Y.commits_by_day(log, 2, "n").collect())) == [(root, "2026-04-03", 3, "late, of an old day|alpha"), (root, "2026-04-05", 1, "Größe")]
    assert git.repositories({"z": str(a), "m": str(a / "sub"), "none": "/", "": ""}) == [(root, "m", ["z"])]
    assert git.commits(spark, ["/"]).count() == 0


@pytest.fixture
def catalogue(spark):
    rows = [("openai/g", "openai", "g", None, 2.0), ("azure/g", "azure", "g", "openai/g", 3.0), ("relay/g", "relay", "g", None, 1.0), ("openrouter/openai/g", "openrouter", "openai/g", None, 9.0), ("azure/d", "azure", "d", None, None), ("deepseek/d", "deepseek", "d", None, 0.4), ("only/u", "only", "u", None, None)]
    return spark.createDataFrame(rows, "full_id string, provider string, model string, canonical_id string, price_input double")


def test_resolution(spark, catalogue):
    ids = ["g", "azure-g", "relay/g", "d", "u", "none", "openai/g--int", "azure/d"]
    got = {r.model: (r.full_id, r.priced) for r in R.resolve(spark.createDataFrame([(i,) for i in ids], "model string"), catalogue).collect()}
    assert got == {"g": ("openai/g", True), "azure-g": ("azure/g", True), "relay/g": ("relay/g", True), "d": ("deepseek/d", True), "u": ("only/u", False), "openai/g--int": ("openai/g", True), "azure/d": ("azure/d", False)}


def test_price_models(spark):
    prices = spark.createDataFrame([("v/k3", ["kimi-k3"], 1.0), ("x", [], None)], "target string, aliases array<string>, price_input double")
    got = {r.model: (r.target, r.via) for r in R.price_models(spark.createDataFrame([("Kimi-K3",), ("k3--int",), ("x",), ("y:free",), ("zz",)], "model string"), prices).collect()}
    assert got == {"Kimi-K3": ("v/k3", "catalogue"), "k3--int": ("v/k3", "catalogue"), "x": (None, "unpriced"), "y:free": (None, "free"), "zz": (None, "unpriced")}


def test_stream(spark, tmp_path):
    rows = [("t", "k", "2026-01-01 10:05:00", 1), ("t", "k", "2026-01-01 10:06:00", 1), ("t", "l", "2026-01-01 10:59:00", 5), ("t", "m", "2026-01-03 12:00:00", 7), ("t", "n", "2026-01-06 12:00:00", 7)]
    df = spark.createDataFrame(rows, "tool string, dedup_key string, ts string, total long").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(len(rows)):
        df.filter(F.col("dedup_key") == rows[k][1]).write.mode("overwrite").parquet(f"{tmp_path}/in/{rows[k][1]}")
    folder = f"{tmp_path}/in/*"
    stream = U.hourly(U.deduplicated(U.read(spark, folder, df.schema, 1)))
    U.write(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = sorted((str(r.hour), r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert ("2026-01-01 10:00:00", 2, 6) in got


def test_sinks(spark, tmp_path):
    K.write_json(f"{tmp_path}/a/x.json", {"v": 1})
    K.write_json(f"{tmp_path}/a/x.json", {"v": 2}, backup=True)
    assert [json.load(open(f"{tmp_path}/a/x.json{s}"))["v"] for s in ("", ".bak")] == [2, 1]
