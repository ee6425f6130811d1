import math
import random

import numpy as np
import pytest

from ledgerlark.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def counts(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, top=20, every=20, kind=np.float32):
    """Each query's nearest rows: [(score, vec_id)], by rows."""
    kept = [(i, v) for i, v in rows if counts(v)]
    wide = max((len(v) for _, v in kept), default=0)
    x = np.zeros((len(kept), wide))
    for k, (_, v) in enumerate(kept):
        x[k, : len(v)] = np.asarray(v, kind)
    out = []
    for k, (i, _) in enumerate(kept):
        if i is not None and i % every == 0:
            score = x @ x[k]
            order = sorted((j for j in range(len(kept)) if j != k), key=lambda j: (-round(score[j], 9), kept[j][0] is None, kept[j][0] or 0))
            out.append((i, [(score[j], kept[j][0]) for j in order[:top]]))
    return out


def found(df):
    """Lists by query id; queries that share an id are cut apart at rank 1."""
    rows = sorted((r["query_id"], r["rank"], -r["score"], r["vec_id"]) for r in df.collect())
    out = {}
    for q, k, s, v in rows:
        out.setdefault(q, []).append((k, -s, v))
    return out


def mixture(seed, n, wide, near, spread=0.5):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(near, wide))
    x = centre[r.integers(0, near, n)] + spread * r.normal(size=(n, wide))
    return [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1)[:, None]).tolist())]


def recall(spark, rows, schema="vec_id long, embedding array<float>"):
    got, want = found(N.neighbours(spark.createDataFrame(rows, schema))), brute(rows, kind=np.float64 if "double" in schema else np.float32)
    assert set(got) == {i for i, _ in want}
    hit = total = 0
    exact = {(i, v): s for i, near in want for s, v in near}
    for i, near in want:
        assert [k for k, _, _ in got[i]] == list(range(1, len(near) + 1))
        assert [s for _, s, _ in got[i]] == sorted((s for _, s, _ in got[i]), reverse=True)
        for _, s, v in got[i]:
            if (i, v) in exact:
                assert abs(s - exact[i, v]) < 1e-12
        hit += len({v for _, _, v in got[i]} & {v for _, v in near})
        total += len(near)
    return hit / total


@pytest.mark.parametrize(("n", "wide", "near", "spread"), [(3000, 32, 40, 0.3), (2500, 24, 1, 1.0), (1500, 10, 15, 0.1)])
def test_recall(spark, n, wide, near, spread):
    assert recall(spark, mixture(n, n, wide, near, spread)) >= 0.93


def test_lengths_that_differ_from_one(spark):
    """The largest products belong to long vectors, wherever they point."""
    r = random.Random(4)
    rows = [(i, [x * f for x in v]) for (i, v), f in ((row, r.choice([0.2, 1.0, 3.0])) for row in mixture(9, 2500, 24, 12, 0.4))]
    assert recall(spark, rows, "vec_id long, embedding array<double>") >= 0.9


def test_huge_and_tiny_vectors(spark):
    """One vector far beyond the others is found by all that point its way, and doesn't spoil the rest."""
    rows = mixture(15, 1500, 16, 20, 0.4)
    rows = [(i, [x * (1e30 if i == 7 else 1e-20 if i == 9 else 1.0) for x in v]) for i, v in rows]
    got = found(N.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = brute(rows, kind=np.float64)
    hit = [len({v for _, _, v in got[i]} & {v for _, v in near}) / len(near) for i, near in want]
    assert np.mean(hit) >= 0.9
    assert all((near[0][1] == 7) == (got[i][0][2] == 7) for i, near in want)


def odd():
    rows = mixture(3, 90, 12, 6)
    return rows + [(None, [0.3] * 12), (200, None), (220, [0.0] * 12), (240, [0.1, None] * 6), (260, [float("nan")] * 12), (280, [float("-inf")] * 12), (300, []), (320, [1.0]), (340, [0.5] * 13), (400, [0.25] * 12), (400, [0.25] * 12), (401, [0.25] * 12)]


def test_small_tables_are_searched_whole(spark):
    rows = odd()
    got = sorted((r["query_id"], r["rank"], round(r["score"], 9), r["vec_id"]) for r in N.neighbours(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect() if r["vec_id"] is not None)
    want = sorted((i, k + 1, round(s, 9), v) for i, near in brute(rows) for k, (s, v) in enumerate(near) if v is not None)
    assert got == want


def test_fewer_candidates_than_asked_for(spark):
    rows = mixture(6, 7, 8, 2)
    got = N.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]
    assert N.neighbours(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).count() == 0


def test_hot_vector_and_ties(spark):
    """A third of all rows are one vector: each of them finds the copies with the smallest ids, and so do its neighbours."""
    rows = [(i, v if i % 3 else [1.0] + [0.0] * 15) for i, v in mixture(8, 1500, 16, 10)]
    got = found(N.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    copies = [i for i, _ in rows if i % 3 == 0]
    for q in (0, 60, 600, 1440):
        assert [v for _, _, v in got[q]] == [c for c in copies if c != q][:20]


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(20 * i, [1.0, float(i)], 1, "x", 0.5) for i in range(3)], SCHEMA + ", score string, entry double")
    out = N.neighbours(df)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 6
    assert N.neighbours(df.limit(0)).columns == out.columns and N.neighbours(df.limit(0)).count() == 0
    assert N.neighbours(df.filter("vec_id = 1")).count() == 0
    assert N.neighbours(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_answers_do_not_depend_on_partitions(spark):
    rows = mixture(12, 2000, 16, 20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = sorted(map(tuple, N.neighbours(df.repartition(1)).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert sorted(map(tuple, N.neighbours(df.repartition(7)).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_deals():
    blocks, bucket = N.fill(np.array([10, 0, 250, 40, 40, 40]), 100, 100)
    assert blocks.tolist() == [1, 1, 3, 1, 1, 1] and len(bucket) == 8 and (np.diff(bucket) >= 0).all()
    sizes = np.repeat([10, 0, 250 / 3, 40, 40, 40], blocks)
    assert max(sizes[bucket == b].sum() for b in set(bucket)) < 200
