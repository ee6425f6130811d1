"""Files with odd names, caches, versions and refreshes."""

import json
import os

import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlark.operators import cli_sessions, ingest as I
from ledgerlark.plans import collect as K, incremental, warehouse_store
from ledgerlark.plans.versions import Conflict, Versions
from ledgerlark.sources import cli, local, paths as P, readers

NAMES = ["Application Support/x 1.jsonl", "Größe/é#1%20+z.jsonl", "p[1]{q}/w?.jsonl", "n/_u.jsonl", "n/.h.jsonl", "100%/a,b.jsonl", "a\\b/c.jsonl", "😀/=&;'.jsonl"]
FIELDS = {"model": ["m"], "session": ["$none"], "input": ["i"], "output": ["o"]}


def tool(folder, name="tool", **more):
    return I.Manifest.of({"id": name, "paths": [f"{folder}/*.jsonl"], "dedup": ["id"], "fields": FIELDS} | more)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def line(i, n):
    return json.dumps({"id": i, "m": "m", "i": n})


def rows(df):
    return sorted((r.file, r.line, r.session, r.dedup_key, r.input) for r in df.collect())


def test_odd_names(spark, tmp_path):
    for k, name in enumerate(NAMES):
        write(f"{tmp_path}/{name}", f"{line(f'{k}a', 1)}\n{line(f'{k}b', 2)}")
    m = tool(tmp_path)
    files = P.files(m, str(tmp_path))
    assert files == sorted(f"{tmp_path}/{n}" for n in NAMES)
    want = sorted((f"{tmp_path}/{n}", j + 1, n.split("/")[0], f"tool:{k}{'ab'[j]}", j + 1) for k, n in enumerate(NAMES) for j in range(2))
    assert rows(K.contributions(spark, m, files)) == want
    cache = f"{tmp_path}/the cache/ä#%"
    df, read = K.cached_contributions(spark, m, files, cache)
    assert rows(df) == want and read == files
    df, read = K.cached_contributions(spark, m, files, cache)
    assert rows(df) == want and read == []
    docs = readers.documents(spark, files).select("file", "line").collect()
    assert sorted(map(tuple, docs)) == [(f, j) for f in files for j in (1, 2)]


def test_white_space_around_lines(spark, tmp_path):
    text = ["\t{}", "{}\t", " {}", "{}\r", "\v{}", " {} ", "{}", "", "　", "x{}", "[{}]", "﻿{}"]
    write(f"{tmp_path}/a.jsonl", "\n".join(t.replace("{}", line(k, k)) for k, t in enumerate(text)))
    got = readers.jsonl(spark, [f"{tmp_path}/a.jsonl"]).collect()
    assert sorted(r.line for r in got) == [1, 2, 3, 4, 5, 6, 7, 11]
    assert sorted(r.line for r in I.decoded(readers.jsonl(spark, [f"{tmp_path}/a.jsonl"])).collect()) == [1, 2, 3, 4, 5, 6, 7]
    # what was trimmed when it was read need not be trimmed to be decoded
    raw = spark.createDataFrame([(k, t.replace("{}", "{}")) for k, t in enumerate(text)], "k int, value string")
    assert sorted(r.k for r in I.decoded(raw).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_lines_without_a_window(spark, tmp_path):
    """Several splits of several files in one task, lines that aren't kept, and a carriage return inside a line."""
    for f in range(3):
        write(f"{tmp_path}/{f}.jsonl", "\n".join(json.dumps({"id": k, "f": f}) if k % 3 else f"noise\r{k}" for k in range(900 * f + 5)) + "\n" * (f % 2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        df = readers.jsonl(spark, [f"{tmp_path}/{f}.jsonl" for f in range(3)], ('"id"',))
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((json.loads(r.value)["f"], json.loads(r.value)["id"] + 1) for r in got) == sorted((int(r.file[-7]), r.line) for r in got)
    assert len(got) == sum(1 for f in range(3) for k in range(900 * f + 5) if k % 3)
    # the window is over splits, which have a sum of lines, not over lines
    assert plan.index("Window") < plan.index("count") and "row_number" not in plan


def frame(*lines):
    return zstandard.ZstdCompressor().compress("".join(x + "\n" for x in lines).encode())


def test_frames_are_ranges(spark, tmp_path):
    parts = [frame(*(json.dumps({"f": f, "k": k, "pad": os.urandom(200).hex()}) for k in range(f % 5))) for f in range(60)]
    broken = bytearray(parts[31])
    broken[len(broken) // 2 :] = b"\0" * (len(broken) - len(broken) // 2)
    parts[31] = bytes(broken)
    path = f"{tmp_path}/a b.zstd"
    with open(path, "wb") as f:
        f.write(b"".join(parts) + frame('{"f": 60}')[:-3])
    number, want = 0, []
    for f in range(60):
        if f != 31:
            want += [(f, k, number + k) for k in range(f % 5)]
            number += f % 5 + 1
    df = readers.zstd_jsonl(spark, [path], bytes=4096)
    assert local.scan(spark, [path], "frames", bytes=4096).rdd.getNumPartitions() > 5
    assert sorted((json.loads(r.value)["f"], json.loads(r.value)["k"], r.line) for r in df.collect()) == sorted(want)
    assert readers.zstd_jsonl(spark, [path], ('"k": 3',), bytes=4096).count() == sum(1 for f, k, _ in want if k == 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: b.replace(b"\n", b"")), max_size=12), st.integers(1, 50), st.booleans())
def test_ranges_hold_each_line_once(tmp_path_factory, content, step, ended):
    path = str(tmp_path_factory.mktemp("ranges") / "x")
    data = b"\n".join(content) + b"\n" * ended
    with open(path, "wb") as f:
        f.write(data)
    size = max(1, len(data))
    got = [x for low in range(0, size, step) for x in local.lines(path, low, min(low + step, size))]
    assert got == (data.split(b"\n")[:-1] if data.endswith(b"\n") else data.split(b"\n") if data else [])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=8), st.integers(1, 90), st.integers(0, 2))
def test_ranges_hold_each_frame_once(tmp_path_factory, content, step, junk):
    path = str(tmp_path_factory.mktemp("frames") / "x")
    data = b"".join(zstandard.ZstdCompressor(level=1).compress(c) + b"?" * junk for c in content)
    with open(path, "wb") as f:
        f.write(data)
    got = [x for low in range(0, len(data), step) for _, x in local.frames(path, low, min(low + step, len(data)))]
    assert got == content


def test_cache_of_files_that_change(spark, tmp_path):
    home = str(tmp_path)
    for k in range(6):
        write(f"{home}/l/{k} ü%.jsonl", "".join(line(f"{k}-{j}", j) + "\n" for j in range(k)))
    m, cache = tool(f"{home}/l"), f"{home}/c"
    again = lambda: K.cached_contributions(spark, m, P.files(m, home), cache)
    full = lambda: rows(K.contributions(spark, m, P.files(m, home)))
    assert len(again()[1]) == 6
    write(f"{home}/l/2 ü%.jsonl", "")  # cut off
    write(f"{home}/l/4 ü%.jsonl", "".join(line(f"5-{j}", 70 + j) + "\n" for j in range(9)))  # other records, some of another file
    write(f"{home}/l/new.jsonl", line("0", 3))
    os.remove(f"{home}/l/5 ü%.jsonl")
    df, read = again()
    assert [os.path.basename(p) for p in read] == ["2 ü%.jsonl", "4 ü%.jsonl", "new.jsonl"] and rows(df) == full()
    assert rows(K.usage_records(spark, [m], home, cache=cache)) == rows(K.usage_records(spark, [m], home))
    assert again()[1] == []
    # a tool that is read in another way doesn't find what was read before
    other = tool(f"{home}/l", fields=FIELDS | {"output": ["i"]})
    assert len(K.cached_contributions(spark, other, P.files(other, home), cache)[1]) == 6
    os.remove(f"{home}/l/new.jsonl")
    assert K.cached_contributions(spark, m, [f"{home}/l/new.jsonl"], cache)[0].count() == 0


def test_cache_stays_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MOST_BATCHES", 3)
    m, home = tool(tmp_path), str(tmp_path)
    for k in range(6):
        write(f"{home}/{k}.jsonl", line(k, k))
        df, read = K.cached_contributions(spark, m, P.files(m, home), f"{home}/c")
        assert len(read) == 1 and df.count() == k + 1
    v = Versions(spark, f"{home}/c/tool")
    assert len(v.folders(v.current()[1])) <= 3 and v.numbers() == [5, 6]
    assert set(os.listdir(f"{home}/c/tool/data")) > v.folders(v.current()[1]) and v.vacuum(1, 0)
    assert set(os.listdir(f"{home}/c/tool/data")) == v.folders(v.current()[1])


def test_reader_between_two_builds(spark, tmp_path):
    root = f"{tmp_path}/ware house"
    with pytest.raises(FileNotFoundError):
        warehouse_store.Warehouse.open(spark, root)
    build = lambda n: {"a": spark.range(n), "b": spark.range(n).select((F.col("id") * 2).alias("x y"), (F.col("id") % 2).alias("p")), "none": spark.range(0)}
    assert warehouse_store.publish(spark, build(3), root) == 1
    old = warehouse_store.Warehouse.open(spark, root)
    assert warehouse_store.publish(spark, build(5), root, {"b": ["p"]}) == 2
    assert (old.table("a").count(), old.table("b").count()) == (3, 3)
    # a build that fails on its second table leaves what is published
    failing = build(9) | {"b": spark.range(9).select(F.raise_error(F.lit("no")).alias("x y"), F.lit(1).alias("p"))}
    with pytest.raises(Exception, match="no"):
        warehouse_store.publish(spark, failing, root)
    new = warehouse_store.Warehouse.open(spark, root)
    assert new.number == 2 and new.tables == ["a", "b", "none"] and sorted(r["x y"] for r in new.table("b").collect()) == [0, 2, 4, 6, 8] and new.table("none").count() == 0
    warehouse_store.publish(spark, build(7), root)
    assert (old.number, new.table("a").count()) == (1, 5) and Versions(spark, root).numbers() == [2, 3]


def test_two_writers(spark, tmp_path):
    v = Versions(spark, f"{tmp_path}/v")
    assert v.current() == (0, {}) and v.commit(0, {"who": "ä"}) == 1
    with pytest.raises(Conflict):
        Versions(spark, f"{tmp_path}/v").commit(0, {"who": "b"})
    assert v.current() == (1, {"who": "ä"}) and sorted(os.listdir(f"{tmp_path}/v/versions"))[-1] == "000000000001.json"
    assert not [n for n in os.listdir(f"{tmp_path}/v/versions") if n.startswith(".") and not n.endswith(".crc")]


def test_refresh_of_what_changed(spark, tmp_path):
    home = str(tmp_path)
    tools = [tool(f"{home}/{t}", t) for t in "abcde"]
    for t in "abcde":
        for k in range(3):
            write(f"{home}/{t}/{k}.jsonl", "".join(line(f"{j}", 10 * j + k) + "\n" for j in range(k, 4)))
    found = lambda: {m.id: [P.stamp(p) for p in P.files(m, home)] for m in tools}
    use = incremental.Usage(spark, f"{home}/use")
    first = use.refresh(tools, found())
    assert (first.number, first.parsed, first.reused, first.files_read) == (1, list("abcde"), [], dict.fromkeys("abcde", 3))
    assert use.refresh(tools, found()) == incremental.Refreshed(1, [], list("abcde"), {})
    write(f"{home}/b/1.jsonl", line("9", 900))
    write(f"{home}/d/7.jsonl", line("0", 800) + "\n" + line("8", 80))
    os.remove(f"{home}/e/0.jsonl")
    before = Versions(spark, f"{home}/use/usage").current()[1]["folders"]
    third = use.refresh(tools, found())
    after = Versions(spark, f"{home}/use/usage").current()[1]["folders"]
    assert (third.parsed, third.reused, third.files_read) == (["b", "d", "e"], ["a", "c"], {"b": 1, "d": 1, "e": 0})
    assert {k for k in before if before[k] == after[k]} == {"totals:a", "cube:a", "totals:c", "cube:c"}
    whole = incremental.Usage(spark, f"{home}/whole")
    whole.refresh(tools, found(), full=True)
    assert sorted(map(tuple, use.totals().collect())) == sorted(map(tuple, whole.totals().collect()))
    assert sorted(map(str, use.cube().collect())) == sorted(map(str, whole.cube().collect()))
    got = {r.tool: (r.calls, r.input, r.files, r.dropped) for r in use.totals().collect()}
    # of file 0 id 0 has no usage; the copies in 1 and 2 are dropped
    assert got["a"] == (3, 60, 3, 5) and got["b"] == (4, 960, 3, 2) and got["d"] == (4, 140, 4, 6)
    for t in "ce":
        for n in os.listdir(f"{home}/{t}"):
            os.remove(f"{home}/{t}/{n}")
    last = use.refresh(tools, found())
    assert last.parsed == [] and {r.tool for r in use.totals().collect()} == {"a", "b", "d"}


def test_warehouse_is_rebuilt_when_its_files_change(spark, tmp_path):
    write(f"{tmp_path}/db", "1")
    made = []
    again = lambda: incremental.rebuilt(spark, f"{tmp_path}/w", [P.stamp(f"{tmp_path}/db")], lambda: made.append(1) or {"t": spark.range(len(made))})
    assert again() and not again()
    write(f"{tmp_path}/db", "22")
    assert again() and made == [1, 1] and warehouse_store.Warehouse.open(spark, f"{tmp_path}/w").table("t").count() == 2


def test_session_logs_below_several_roots(spark, tmp_path):
    """Parts of one session lie in both roots; what the first root has comes first, whatever the paths are called."""
    stamp = lambda k: f"2026-03-01T00:00:{k:02d}.000Z"
    message = lambda i, k, role, n=0: json.dumps({"type": "message", "id": i, "timestamp": stamp(k), "message": {"role": role, "model": "m", "stopReason": "stop", "usage": {"input": n}} if role == "assistant" else {"role": role}})
    one, two = f"{tmp_path}/z first", f"{tmp_path}/a second"
    write(f"{one}/x/S.jsonl", "\n".join([json.dumps({"type": "session", "id": "first", "timestamp": stamp(0), "cwd": "/w/one"}), message("u", 1, "user"), message("a", 2, "assistant", 5)]))
    write(f"{one}/b/S.jsonl", message("b", 3, "assistant", 7))
    write(f"{two}/S.jsonl", "\n".join([json.dumps({"type": "session", "id": "second", "timestamp": stamp(0)}), message("a", 2, "assistant", 1000), message("c", 4, "assistant", 11)]))
    write(f"{one}/x/S.revisions.jsonl", message("r", 2, "assistant", 10**6))
    write(f"{one}/x/S.txt", message("t", 2, "assistant", 10**6))
    assert cli.session_files([one, f"{tmp_path}/none", two, f"{one}/x"]) == [(0, f"{one}/b/S.jsonl"), (0, f"{one}/x/S.jsonl"), (2, f"{two}/S.jsonl")]
    out = cli_sessions.collect(cli.scan(spark, [one, two]))
    assert [(r.id, r.project, r.turns) for r in out["sessions"].collect()] == [("first", "one", 1)]
    assert [r.input for r in out["turns"].collect()] == [23]
    assert [(r.files, r.dirs, r.sessions) for r in out["stats"].collect()] == [(3, 2, 1)]
    swapped = cli_sessions.collect(cli.scan(spark, [two, one]))
    assert [(r.id, r.project) for r in swapped["sessions"].collect()] == [("second", "one")] and [r.input for r in swapped["turns"].collect()] == [1018]
    os.makedirs(f"{tmp_path}/h/.config/pi/agent/sessions")
    assert cli.roots(f"{tmp_path}/h") == [f"{tmp_path}/h/.config/pi/agent/sessions"] and cli_sessions.collect(cli.scan(spark, [f"{tmp_path}/none"]))["sessions"].count() == 0
