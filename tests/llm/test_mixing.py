from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st

from ledgerlark.llm import mixing as M


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9).filter(any))
def test_deviation_is_less_than_a_block(slots):
    order, total, have = M.schedule(slots), sum(slots), Counter()
    assert Counter(order) == Counter({i: n for i, n in enumerate(slots) if n})
    for t, i in enumerate(order, 1):
        have[i] += 1
        assert all(abs(have[k] - Fraction(n * t, total)) < 1 for k, n in enumerate(slots))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0.01, 1)), min_size=1, max_size=6))
def test_every_block_is_in_the_mix(sources):
    blocks, weights = map(list, zip(*sources))
    slots = M.allot(blocks, weights)
    assert all(n >= b for n, b in zip(slots, blocks)) and any(n == b for n, b in zip(slots, blocks))
    exact = max(b / w for b, w in zip(blocks, weights))
    assert all(n - 1.001 <= w * exact <= n + 0.001 for n, w in zip(slots, weights))


def docs(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else ("b", "c", None)[i // 3 % 3], i * 2) for i in range(3000)]
    rows += [(5, "t5 again", "big", 0), (None, "no id", "big", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot long")


def test_plan(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 100)
    weights = {"big": 0.4, "b": 0.3, "c": 0.2, None: 0.1}
    out = sorted(M.plan(docs(spark), weights, block=10).collect(), key=lambda x: x.position)
    assert len({x.position for x in out}) == len(out)
    times = Counter((x.doc_id, x.source) for x in out)
    assert {d for d, _ in times} == {*range(3000), None} and times[(5, "big")] == 2 * times[(1, "big")]
    slots = {x.slot: x.source for x in out}
    have = Counter()
    total = Counter(slots.values())
    for t in range(len(slots)):
        have[slots[t]] += 1
        assert all(abs(have[s] - Fraction(n * (t + 1), len(slots))) < 1 for s, n in total.items())
    assert all(abs(total[s] / len(slots) - w) < 0.01 for s, w in weights.items())
    # a document is repeated only after all of its source have been
    for s in total:
        epochs = [x.epoch for x in out if x.source == s]
        assert epochs == sorted(epochs)
    assert max(Counter((x.slot) for x in out).values()) <= 10


def test_mix_keeps_rows_and_columns(spark):
    table = docs(spark)
    mixed = M.mix(table, block=16)
    assert mixed.schema == table.schema
    want = Counter(map(tuple, table.collect()))
    got = Counter(map(tuple, mixed.collect()))
    assert set(got) == set(want) and all(got[r] >= n for r, n in want.items())
    plan = sorted(M.plan(table.filter("doc_id is not null and text != 't5 again'"), block=16).collect(), key=lambda x: x.position)
    assert [x.doc_id for x in M.mix(table.filter("doc_id is not null and text != 't5 again'"), block=16).collect()] == [x.doc_id for x in plan]


def test_edges(spark):
    empty = docs(spark).limit(0)
    assert M.plan(empty).collect() == [] and M.mix(empty).collect() == []
    one = M.plan(docs(spark), {"c": 1.0}).collect()
    assert {x.source for x in one} == {"c"} and len(one) == 333


def test_shares_of_rows(spark):
    sizes = {"big": 3000, "small": 10, "odd": 65}
    table = spark.createDataFrame([(k, s) for s, n in sizes.items() for k in range(n)], "doc_id long, source string")
    out = M.plan(table, {"big": 0.5, "small": 0.3, "odd": 0.2}).collect()
    have = Counter(x.source for x in out)
    assert have == {"big": 3000, "small": 1800, "odd": 1200}
    times = Counter((x.source, x.doc_id) for x in out)
    assert all(have[s] // n <= times[s, k] <= -(-have[s] // n) for s, n in sizes.items() for k in range(n))
    assert len({x.position for x in out}) == len(out)


def test_a_tiny_source_does_not_stretch_the_mix(spark):
    sizes = {"a": 6000, "b": 2000, "c": 65, "d": 1}
    table = spark.createDataFrame([(k, s) for s, n in sizes.items() for k in range(n)], "doc_id long, source string")
    assert len(M.plan(table).collect()) < 1.1 * sum(sizes.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=9).filter(any), st.integers(1, 90))
def test_periods_make_the_whole_schedule(slots, period):
    out = []
    for k, placed in enumerate(M.states(slots, period)):
        out += M.run(slots, placed, k * period, min((k + 1) * period, sum(slots)))
    assert out == M.schedule(slots)


@pytest.mark.parametrize("docs", [[10**8, 1000], [10**8, 10**8, 3 * 10**7, 640], [7 * 10**7, 64, 65, 1]])
def test_deviation_in_mixes_of_many_periods(docs):
    """Every border, and every slot of some periods, at sizes where shares are far from whole blocks a period."""
    rows = M.allot(docs, [float(n) ** M.TEMPER for n in docs])
    slots = [-(-n // M.BLOCK) for n in rows]
    total, period = sum(slots), 1 << 17
    every = M.states(slots, period)
    assert len(every) > 8
    for k, placed in enumerate(every):
        t = k * period
        assert sum(placed) == t and all(abs(p * total - n * t) < total for p, n in zip(placed, slots))
    for k in (1, len(every) // 2, len(every) - 1):
        placed = list(every[k])
        for t, _ in enumerate(M.run(slots, placed, k * period, min((k + 1) * period, total)), k * period):
            # what has been given before slot t
            assert all(abs(p * total - n * t) < total for p, n in zip(placed, slots))


def test_a_mix_of_many_periods(spark, monkeypatch):
    monkeypatch.setattr(M, "PERIOD", 32)
    weights = {"big": 0.4, "b": 0.3, "c": 0.2, None: 0.1}
    out = sorted(M.plan(docs(spark), weights, block=4).collect(), key=lambda x: x.position)
    slots = {x.slot: x.source for x in out}
    total, have = Counter(slots.values()), Counter()
    assert len(slots) > 10 * 36 and sorted(slots) == list(range(len(slots)))
    for t in range(len(slots)):
        have[slots[t]] += 1
        assert all(abs(have[s] - Fraction(n * (t + 1), len(slots))) < 1 for s, n in total.items())
    assert all(abs(total[s] / len(slots) - w) < 1 / 32 for s, w in weights.items())
    assert {(x.doc_id, x.source) for x in out} == {(r.doc_id, r.source) for r in docs(spark).collect()}
    assert len({x.position for x in out}) == len(out)


def test_rows_of_one_doc_id_keep_their_order(spark):
    rows = [(7, f"t{k}", "a") for k in range(50)] + [(None, f"n{k}", "a") for k in range(50)]
    orders = {tuple(x.text for x in M.mix(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, source string")).collect()) for k in (0, 17, 60)}
    assert len(orders) == 1
