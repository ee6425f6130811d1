"""One refresh over an own database, session logs and external tools."""

import json
import os

from ledgerlark.operators import ingest as I
from ledgerlark.plans import touch as T
from ledgerlark.plans.incremental import Usage
from ledgerlark.plans.warehouse_store import Warehouse
from tests.test_sources import database


def write(path, *rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n")


def session(ident, n):
    stamp = "2026-03-01T00:00:0{}.000Z".format
    return [
        {"type": "session", "id": ident, "timestamp": stamp(0), "cwd": "/w/logs"},
        {"type": "message", "id": "u", "timestamp": stamp(1), "message": {"role": "user"}},
        {"type": "message", "id": "a", "timestamp": stamp(2), "message": {"role": "assistant", "model": "openai/x", "stopReason": "stop", "usage": {"input": n}, "content": [{"type": "toolCall", "id": "c", "name": "read"}]}},
        {"type": "message", "id": "r", "timestamp": stamp(3), "message": {"role": "toolResult", "toolCallId": "c", "isError": True}},
    ]


def test_touch(spark, tmp_path):
    home, root = f"{tmp_path}/my home", f"{tmp_path}/cache"
    m = I.Manifest.of({"id": "ext", "paths": ["{home}/ext/*.jsonl"], "dedup": ["id"], "fields": {"model": ["m"], "input": ["i"], "output": ["o"]}})
    write(f"{home}/ext/a.jsonl", {"id": 1, "m": "gpt", "i": 5})
    again = lambda: T.touch(spark, root, [m], home, {})
    start = again()
    assert (start.usage.parsed, start.usage.files_read, start.rebuilt, start.source) == (["ext"], {"ext": 1}, False, "")
    assert [(r.tool, r.input) for r in Usage(spark, root).totals().collect()] == [("ext", 5)]
    writer = database(f"{home}/.pi/pi.sqlite")
    writer.execute("pragma wal_checkpoint(truncate)")
    logs = f"{home}/.pi/agent/sessions"
    write(f"{logs}/one.jsonl", *session("l1", 7))
    write(f"{logs}/two.jsonl", *session("s1", 1000))  # the database has it
    first = again()
    assert (first.rebuilt, first.usage.reused, first.source) == (True, ["ext"], f"{home}/.pi/pi.sqlite")
    assert not again().rebuilt
    w = Warehouse.open(spark, f"{root}/warehouse")
    assert sorted((r.session_id, r.tool, r.model_canon, r.total) for r in w.table("turns").collect()) == [("l1", "pi-cli", "x", 7), ("s1", "pi", "(none)", 0), ("s1", "pi", "m-1", 6)]
    assert sorted((r.id, r.project, r.turns, r.messages) for r in w.table("sessions").collect()) == [("l1", "logs", 1, 3), ("s1", "a", 2, 3), ("s2", "(无项目)", 0, 1)]
    assert sorted((r.name, r.n, r.errors) for r in w.table("roles").collect()) == [("assistant", 1, 0), ("toolResult", 3, 2), ("user", 3, 0)]
    assert sorted((r.name, r.n, r.errors) for r in w.table("tools").collect()) == [("read", 3, 2)]
    assert sorted(r.name for r in w.table("projects").collect()) == ["a", "b", "logs"]
    assert {r.k: r.v for r in w.table("cli_info").collect()} == {"dirs": 1, "files": 2, "sessions": 1, "turns": 1, "skippedDup": 1, "skippedEmpty": 0, "tokenTotal": 7}
    write(f"{logs}/one.jsonl", *session("l1", 70))
    write(f"{home}/ext/b.jsonl", {"id": 1, "m": "gpt", "i": 500}, {"id": 2, "m": "gpt", "i": 6})
    last = again()
    assert last.rebuilt and last.usage.files_read == {"ext": 1}
    assert [(r.input, r.dropped) for r in Usage(spark, root).totals().collect()] == [(11, 1)]
    assert w.table("turns").filter("tool = 'pi-cli'").first().total == 7  # an open reader keeps its version
    assert Warehouse.open(spark, f"{root}/warehouse").table("turns").filter("tool = 'pi-cli'").first().total == 70
    assert T.touch(spark, root, [m], home, {}, full=True).usage.parsed == ["ext"]
    writer.close()
