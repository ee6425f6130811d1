"""Growing logs of running totals: any cut into batches gives what the whole logs give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import ingest as I
from ledgerlark.operators.drivers import DRIVERS
from ledgerlark.streaming import rollouts

MANIFEST = I.Manifest.of({"id": "grow", "driver": "codex", "paths": ["-"], "fields": {"model": ["model"], "input": ["input_tokens"], "cacheRead": ["cached_input_tokens"], "output": ["output_tokens"], "reasoning": ["reasoning_output_tokens"]}})
LINES = "file string, dir string, line long, value string"


def log(r, file):
    total = dict.fromkeys(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"), 0)
    for n in range(r.randrange(1, 25)):
        what = r.random()
        if what < 0.12:
            body = {"type": "turn_context", "payload": {"model": r.choice(["", "m1", "m2"]), "session_id": r.choice(["", "c1"])}}
        elif what < 0.2:
            body = {"type": "session_meta", "payload": {"id": f"meta{n}"}}
        else:
            own = {c: r.randrange(20) for c in total}
            if r.random() < 0.15:
                total = dict.fromkeys(total, 0)  # begun again
            total = {c: total[c] + own[c] * r.choice([0, 1, 1]) for c in total}
            info = {"total_token_usage": total} | ({"last_token_usage": own} if r.random() < 0.8 else {})
            body = {"type": "event_msg", "payload": {"type": "token_count", "info": info if r.random() < 0.95 else None}}
            if r.random() < 0.8:
                body["timestamp"] = f"2026-0{r.randrange(1, 4)}-11T00:00:00Z"
        yield file, r.choice(["", "d"]) if n == 0 else "d", n + 1, json.dumps(body)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_the_whole(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [x for k in range(25) for x in log(r, f"/l/rollout-2026-05-{k + 1:02d}T{k}.jsonl" if k % 2 else f"/l/{k}.jsonl")]
    at = {}
    for row in rows:
        at.setdefault(row[0], sorted(r.randrange(0, 26) for _ in range(3)))
    for batch in range(4):
        part = [x for x in rows if sum(x[2] > c for c in at[x[0]]) == batch]
        r.shuffle(part)
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = rollouts.records(I.decoded(lines), MANIFEST)
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(300)
    columns = ["dedup_key", "file", "line", "model", "session", F.substring("ts", 1, 10).alias("d"), *rollouts.SUMS, "resets"]
    got = rollouts.latest(spark.read.schema(out.schema).parquet(f"{tmp_path}/out")).select(*columns)
    want = DRIVERS["codex"](I.decoded(spark.createDataFrame(rows, LINES)), MANIFEST).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {x.model for x in want.collect()} >= {"m1", "m2", "(unknown)"}
