"""Counter logs, the own database, refreshes and failures of sources."""

import glob
import json
import os
import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import catalogue as C, ingest as I
from ledgerlark.operators.drivers import DRIVERS
from ledgerlark.plans import collect as K
from ledgerlark.plans.refresh import Refresher
from ledgerlark.sources import own_store, paths as P, readers, sqlite

FIELDS = {"model": ["model"], "input": ["input_tokens"], "cacheRead": ["cached_input_tokens"], "cacheWrite": ["cache_write_input_tokens"], "output": ["output_tokens"], "reasoning": ["reasoning_output_tokens"]}
ROLLOUT = {"id": "roll", "driver": "codex", "prefilter": ['"token', '"turn_context"', '"session_meta"'], "fields": FIELDS}


def count(day, n_in, out, cached, write=0, last=None, **more):
    total = {"input_tokens": n_in, "output_tokens": out, "cached_input_tokens": cached, "cache_write_input_tokens": write, "total_tokens": n_in + out} | more
    return json.dumps(({"timestamp": f"{day}T10:00:00.000Z"} if day else {}) | {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total} | ({"last_token_usage": last} if last is not None else {})}})


def context(model, **more):
    return json.dumps({"type": "turn_context", "payload": {"model": model} | more})


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def collected(spark, home, cache=None):
    m = I.Manifest.of(ROLLOUT | {"paths": ["{home}/logs/**/*.jsonl"]})
    rows = K.usage_records(spark, [m], str(home), cache=cache).collect()
    return sorted((r.model, r.session, r.ts[:10] if r.ts else None, r.input, r.cache_read, r.cache_write, r.output, r.reasoning) for r in rows)


def test_usage_before_the_first_model(spark, tmp_path):
    """Two logs that grow unevenly and name their model late; one starts again before it does."""
    write(f"{tmp_path}/logs/p/one.jsonl", count("2026-07-30", 40, 3, 12), count("2026-07-30", 95, 7, 12), count("2026-08-02", 31, 5, 6, last={"input_tokens": 31, "output_tokens": 5, "cached_input_tokens": 6}), context("late"), count("2026-08-02", 33, 6, 7))
    write(f"{tmp_path}/logs/q/two.jsonl", count("2026-07-31", 18, 2, 0), context("other"), count("2026-07-31", 18, 2, 0))
    assert collected(spark, tmp_path) == [("late", "p", "2026-07-30", 83, 12, 0, 7, 0), ("late", "p", "2026-08-02", 1, 1, 0, 1, 0), ("late", "p", "2026-08-02", 25, 6, 0, 5, 0), ("other", "q", "2026-07-31", 18, 0, 0, 2, 0)]


def test_a_day_only_in_the_file_s_name(spark, tmp_path):
    write(f"{tmp_path}/logs/r/rollout-2026-09-17T23-5.jsonl", count(None, 64, 9, 20), count("2026-09-18", 70, 9, 24), context("m-x"))
    assert collected(spark, tmp_path) == [("m-x", "r", "2026-09-17", 44, 20, 0, 9, 0), ("m-x", "r", "2026-09-18", 2, 4, 0, 0, 0)]


def test_resets_sessions_and_no_model(spark, tmp_path):
    last = {"input_tokens": 7, "output_tokens": 2, "cached_input_tokens": 1, "reasoning_output_tokens": 9}
    write(
        f"{tmp_path}/logs/d/a.jsonl",
        json.dumps({"type": "session_meta", "payload": {"id": "s1"}}), context("m1", session_id="other"), count("2026-05-01", 100, 10, 50, 20, reasoning_output_tokens=4),
        # one counter of five goes down
        count("2026-05-01", 120, 12, 49, 20, last=last), count("2026-05-02", 120, 12, 49, 20), count("2026-05-02", 20, 2, 9, 2), count("2026-05-02", 10, 1, 9, 2, last={}), context("m2"), count("2026-05-03", 15, 3, 9, 2), '{"type": "event_msg", "payload": {"type": "token_count", "info": null}}',
    )
    write(f"{tmp_path}/logs/e/b.jsonl", count("2026-05-01", 5, 1, 0), count("2026-05-01", 6, 2, 0))
    assert collected(spark, tmp_path) == sorted([("m1", "s1", "2026-05-01", 30, 50, 20, 10, 4), ("m1", "s1", "2026-05-01", 6, 1, 0, 2, 2), ("m2", "s1", "2026-05-03", 5, 0, 0, 2, 0), ("(unknown)", "e", "2026-05-01", 6, 0, 0, 2, 0)])


def test_duplicate_keys_count_as_the_last(spark, tmp_path):
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    write(f"{tmp_path}/logs/a.jsonl", '{"id": 1, "n": 1, "n": 2}', '{"id": 2, "n": 3}', "{" + '"x": "' + "y" * (17 << 20) + '"}', '{"id": 4, "n": 5}')
    out = I.decoded(readers.jsonl(spark, [f"{tmp_path}/logs/a.jsonl"])).select("line", I.dig(F.col("obj"), "n", "int").alias("n")).collect()
    assert sorted(map(tuple, out)) == [(1, 2), (2, 3), (4, 5)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    write(f"{tmp_path}/a.jsonl", *(json.dumps({"n": k, "pad": "x" * 90}) for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = readers.jsonl(spark, [f"{tmp_path}/a.jsonl"])
        assert lines.rdd.getNumPartitions() > 1 or spark.read.text(f"{tmp_path}/a.jsonl").rdd.getNumPartitions() > 1
        out = I.decoded(lines).select("line", I.dig(F.col("obj"), "n", "int").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(out) == 3000 and all(r.line == r.n + 1 for r in out)


def test_where_compares_structures(spark):
    rows = [{"u": {"a": 1, "b": [1, "x"]}}, {"u": {"b": [1, "x"], "a": 1}}, {"u": {"a": 1}}, {"u": "{'a': 1, 'b': [1, 'x']}"}]
    df = I.decoded(spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "k int, value string"))
    assert sorted(r.k for r in df.filter(I.required(I.Manifest("x", where={"u": {"a": 1, "b": [1, "x"]}}), F.col("obj"))).collect()) == [0, 1]


def test_manifests_with_problems_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown driver none"):
        K.usage_records(spark, [I.Manifest.of(ROLLOUT | {"paths": ["x"], "driver": "none"})], str(tmp_path))


def test_one_job_for_all_missing_files(spark, tmp_path):
    m = I.Manifest.of({"id": "t", "paths": ["{home}/logs/*.jsonl"], "dedup": ["id"], "fields": {"model": ["m"], "input": ["i"], "output": ["o"]}})
    for k in range(12):
        write(f"{tmp_path}/logs/{k}.jsonl", *([json.dumps({"id": f"{k}-{j}", "i": j}) for j in range(k)] or ["no record"]))
    cache = f"{tmp_path}/cache"
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("collection"))
    spark.sparkContext.setJobGroup("collection", "")
    df, read = K.cached_contributions(spark, m, P.files(m, str(tmp_path)), cache)
    first = jobs()
    spark.sparkContext.setJobGroup("other", "")
    assert len(read) == 12 and df.count() == sum(range(12)) and first <= 8
    again, read = K.cached_contributions(spark, m, P.files(m, str(tmp_path)), cache)
    assert read == [] and again.count() == df.count()


def database(path):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    db = sqlite3.connect(path)
    db.executescript(
        """PRAGMA user_version = 12; PRAGMA journal_mode = WAL;
        CREATE TABLE projects (id integer, path text, name text); INSERT INTO projects VALUES (1, '/w/a', 'a'), (2, NULL, 'b');
        CREATE TABLE sessions (id text, title text, project_id integer, model_id text, mode text, thinking_level text, created_at integer, updated_at integer);
        INSERT INTO sessions VALUES ('s1', 't', 1, 'm', 'agent', 'high', 5, 6), ('s2', NULL, 9, NULL, NULL, NULL, NULL, NULL);
        CREATE TABLE turns (session_id text, model_id text, started_at integer, ended_at integer, status text, usage_json text, input_tokens integer);
        INSERT INTO turns VALUES ('s1', 'openai/m-1', 5, 6, 'completed', '{"inputTokens": 3, "outputTokens": 2, "cacheReadTokens": 1, "totalTokens": 6}', 99), ('s1', '', NULL, NULL, NULL, NULL, 9);
        CREATE TABLE messages (id integer, session_id text, role text, tool_name text, is_error integer);
        INSERT INTO messages VALUES (1, 's1', 'user', NULL, 0), (2, 's1', 'toolResult', 'read', 1), (3, 's1', 'toolResult', 'read', 0), (4, 's2', 'user', '', 0);"""
    )
    db.commit()
    return db


def test_own_database(spark, tmp_path):
    home = str(tmp_path)
    writer = database(f"{home}/.pi/pi.sqlite")
    database(f"{home}/.config/pi/pi.sqlite").close()
    found = own_store.detect(home, {})
    assert [os.path.basename(os.path.dirname(s.database)) for s in found] == [".pi", "pi"] and found[0].wal_size > 0 and found[1].modified == 0
    # what a writer has not committed isn't read, and doesn't disturb
    writer.execute("INSERT INTO turns VALUES ('s1', 'x', 1, 1, '', NULL, 1)")
    t = own_store.load(spark, found[0].database)
    writer.rollback()
    assert sorted((r.session_id, r.model_raw, r.model_canon, r.started_at, r.total, r.input, r.reasoning, r.has_usage) for r in t["turns"].collect()) == [("s1", "(none)", "(none)", 0, 0, 0, 0, False), ("s1", "openai/m-1", "m-1", 5, 6, 3, 0, True)]
    assert sorted((r.id, r.title, r.project, r.turns, r.messages, r.updated_at, r.thinking) for r in t["sessions"].collect()) == [("s1", "t", "a", 2, 3, 6, "high"), ("s2", "", "(无项目)", 0, 1, 0, None)]
    assert sorted(map(tuple, t["projects"].collect())) == [(1, "a", "/w/a"), (2, "b", "")]
    assert sorted(map(tuple, t["tools"].collect())) == [("read", 2, 1)] and sorted(map(tuple, t["roles"].collect())) == [("toolResult", 2, 1), ("user", 2, 0)]
    assert own_store.version(found[0].database) == 12
    assert not glob.glob(os.path.join(__import__("tempfile").gettempdir(), f"{sqlite.PREFIX}*/db"))


def test_databases_that_fail_are_reported(spark, tmp_path):
    good, bad = f"{tmp_path}/good.db", f"{tmp_path}/bad.db"
    db = sqlite3.connect(good)
    db.executescript("CREATE TABLE t (a integer); INSERT INTO t VALUES (1), (2)")
    db.close()
    with open(bad, "wb") as f:
        f.write(b"not a database at all" * 100)
    with pytest.raises(Exception, match="bad.db"):
        sqlite.scan(spark, [good, bad], "select a from t", errors="raise").collect()
    assert sqlite.scan(spark, [good, bad], "select a from t", errors="skip").count() == 2
    out = sqlite.scan(spark, [good, bad], "select a from t", errors="report").collect()
    assert sorted(r.value for r in out if r.error is None and r.file == good)[0].startswith('{"a": 1')
    assert [r.file for r in out if r.error] == [bad]


def test_workspaces(spark, tmp_path):
    home = str(tmp_path)
    os.makedirs(f"{home}/w/one/.git")
    os.makedirs(f"{home}/w/two")
    os.makedirs(f"{home}/.zcode/cli/db")
    db = sqlite3.connect(f"{home}/.zcode/cli/db/db.sqlite")
    db.executescript(f"CREATE TABLE session (directory text); INSERT INTO session VALUES ('{home}/w/one'), ('{home}/w/one'), ('{home}/w/two'), ('')")
    db.close()
    assert list(map(tuple, own_store.workspaces(spark, home).collect())) == [("one", f"{home}/w/one")]


def test_refreshes_are_shared():
    gate, ran, now = threading.Event(), [], [100.0]
    shown = []
    r = Refresher(lambda root: (gate.wait(5), ran.append(root)), lambda root: bool(shown), clock=lambda: now[0])
    gate.set()
    assert r.request("a") and ran == ["a"]  # nothing to show yet: waited for
    shown.append(1)
    assert not r.request("a")  # too soon
    now[0] += 15
    gate.clear()
    assert r.request("a") and not r.request("a") and ran == ["a"]
    gate.set()
    for _ in range(100):
        if not r.running:
            break
        time.sleep(0.02)
    assert ran == ["a", "a"] and not r.request("") and not r.request("a")

    def fail(root):
        raise ValueError(root)

    broken = Refresher(fail, lambda root: False)
    assert broken.request("x") and str(broken.errors["x"]) == "x"


def test_price_tables(spark):
    doc = {"b": {"models": {"lab/m": {"name": "M", "cost": {"input": 1, "cache_read": 0.1}}, "n": {"canonical_model_id": "a/n"}}}, "a": {"models": {}}, "c": {}}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    out = sorted(C.parsed(df).select("full_id", "leaf", "name", "canonical_id", "price_input", "price_output", "price_cache_read").collect())
    assert list(map(tuple, out)) == [("b/lab/m", "m", "M", None, 1.0, None, 0.1), ("b/n", "n", "", "a/n", None, None, None)]
    table = {"fetchedAt": "2026-05-01", "models": [{"target": "x", "cost": {"input": 1}}, {"cost": {}}, {"target": "x", "cost": {"input": 2}}, {"target": ""}]}
    out = C.curated(spark.createDataFrame([(json.dumps(table),)], "value string")).collect()
    assert [(r.target, r.price_input, r.fetched_at) for r in out] == [("x", 2.0, "2026-05-01")]
    ages = C.freshness(spark.createDataFrame([("a", "2026-05-01T10", True), ("b", "2026-05-03", True), ("c", "5", True), ("d", None, False)], "path string, fetched_at string, there boolean"), "2026-05-10")
    assert [tuple(r) for r in ages.orderBy("path").collect()] == [("a", 9, True, "old"), ("b", 7, False, ""), ("c", None, True, "unreadable"), ("d", None, True, "missing")]


def test_drivers_are_found_by_name():
    assert set(DRIVERS) == {"codex"}
