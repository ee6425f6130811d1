"""Logs of running totals as a stream: what each log's next lines add, from the state that its last ones left."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlark.functions.models import UNKNOWN_MODEL
from ledgerlark.operators.drivers import MONOTONE, TOKENS, events, rollout_day
from ledgerlark.operators.warehouse import last_wins

SUMS = ("input", "cache_read", "cache_write", "output", "reasoning")
ROW = f"file string, line bigint, model string, session string, ts string, {', '.join(f'{c} bigint' for c in SUMS)}, resets int, seen bigint"
STATE = "meta string, context string, model string, before string, parked string"
NAMES = [c.split()[0] for c in ROW.split(", ")]


class Log:
    """One log's state: the ids and the model in force, the totals of its last counting line, and the sums of each day before its first model."""

    def __init__(self, file: str, fields: dict[str, str], kept: tuple | None):
        self.file, self.fields = file, fields
        self.meta, self.context, self.model, before, parked = kept or (None, None, None, None, "{}")
        self.before: dict | None = json.loads(before) if before else None
        self.parked: dict[str, list] = json.loads(parked)  # day: line, session, sums, resets
        self.changed: set[str] = set()

    def kept(self) -> tuple:
        return self.meta, self.context, self.model, json.dumps(self.before) if self.before else None, json.dumps(self.parked)

    def _grown(self, total: dict, last: dict | None) -> tuple[dict | None, bool]:
        before, self.before = self.before or {}, total
        if any(total[c] < before.get(c, total[c]) for c in MONOTONE):
            return last, True
        return {c: v - before.get(c, 0) for c, v in total.items()}, False

    def line(self, x) -> Iterator[tuple]:
        """Rows that a line adds for good."""
        self.meta = x.meta_id or self.meta
        self.context = self.context or x.context_id
        if x.model:
            if not self.model:
                yield from self.waiting(x.line, x.model, self.parked)
                self.parked, self.changed = {}, set()
            self.model = x.model
        if x.total is None:
            return
        delta, reset = self._grown(json.loads(x.total), json.loads(x.last) if x.last else None)
        if delta is None:
            return
        n = {t: delta.get(self.fields[t], 0) for t in TOKENS}
        sums = [max(n["input"] - n["cacheRead"] - n["cacheWrite"], 0), n["cacheRead"], n["cacheWrite"], n["output"], min(n["reasoning"], n["output"])]
        if not sum(sums):
            return
        session = self.meta or self.context or x.dir or self.file
        if self.model:
            yield (self.file, x.line, self.model, session, x.ts, *sums, int(reset), x.line)
            return
        day = x.day or ""
        old = self.parked.get(day)
        self.parked[day] = [*old[:2], [a + b for a, b in zip(old[2], sums)], old[3] + reset] if old else [x.line, session, sums, int(reset)]
        self.changed.add(day)

    def waiting(self, seen: int, model: str, days: Iterable[str]) -> Iterator[tuple]:
        """Rows of days before the first model."""
        for day in days:
            line, session, sums, resets = self.parked[day]
            yield (self.file, line, model, session, day or None, *sums, resets, seen)


def records(lines: DataFrame, manifest) -> DataFrame:
    """Usage rows of a stream of decoded lines (file, dir, line, obj), each log's in their order, from one batch to the next.

    Rows have the keys of drivers.rollout and `seen`, the line at which they were known. A day before a log's first model is sent
    again when it grows, under an unknown model, and once more when the model is named: of each key the row seen last counts (latest).
    """
    fields = {t: (manifest.fields.get(t) or ("",))[0] for t in TOKENS}
    counters = tuple(dict.fromkeys([*MONOTONE, *(f for f in fields.values() if f)]))
    found = events(lines, counters).withColumn("day", rollout_day(F.col("ts"), F.col("file")))
    some = found.filter(F.coalesce("meta_id", "context_id", "model").isNotNull() | F.col("total").isNotNull())
    text = some.select("file", "dir", "line", "ts", "day", "meta_id", "context_id", "model", *(F.to_json(F.col(c).dropFields("empty")).alias(c) for c in ("total", "last")))

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = Log(key[0], fields, state.get if state.exists else None)
        batch = pd.concat(list(batches)).sort_values("line")
        batch = batch.astype(object).where(batch.notna(), None)
        rows: list[tuple] = []
        seen = 0
        for x in batch.itertuples(index=False):
            rows += log.line(x)
            seen = x.line
        rows += log.waiting(seen, UNKNOWN_MODEL, sorted(log.changed))
        state.update(log.kept())
        yield pd.DataFrame(rows, columns=NAMES)

    out = text.groupBy("file").applyInPandasWithState(work, ROW, STATE, "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({"tool": F.lit(manifest.id), "dedup_key": F.concat(F.lit(f"{manifest.id}:"), "file", F.lit("#"), "line"), "has_usage": F.lit(True)})


def latest(rows: DataFrame) -> DataFrame:
    """Of what the stream has written, the row of each key that was seen last."""
    return last_wins(rows, "dedup_key", "seen").drop("seen")
