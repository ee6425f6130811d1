import hashlib
import math
import random

import numpy as np
import pytest

from ledgerlark.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = lambda v: [(v + [0] * (wide * parts - len(v)))[wide * p : wide * (p + 1)] for p in range(parts)]
    kept = [(i, cut(v), g) for i, v, g in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(r[1][p]) for r in order] for p in range(parts)]
    square = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))

    def assign():
        return [[min((square(x[p], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, x, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [r[1][p] for r, f in zip(kept, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for (_, _, g), e in zip(kept, errors):
        total[g] = total.get(g, 0) + e
    return [(i, "".join(f"{e:02x}" for _, e in f), err, total[g], digest) for (i, _, g), f, err in zip(kept, found, errors)]


def vectors(seed, n, wide=24, near=4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(wide)] for _ in range(near)]
    return [(3 * i, [c + r.gauss(0, 0.1) for c in r.choice(centres)], r.choice([None, 1, 2, 3])) for i in range(n)]


CASES = {
    "clusters": vectors(1, 300),
    "few rows": vectors(2, 5),
    "ties": [(i, [random.Random(i % 7).choice([-1.0, 0.0, 1.0]) * (k % 3) for k in range(16)], i % 2) for i in range(200)],
    "copies": [(i, [0.25] * 8 if i % 3 else [i / 1000] * 8, None) for i in range(150)],
    "odd rows": [*vectors(3, 60), (None, [0.1] * 24, 1), (500, None, 1), (501, [0.1, None] + [0.0] * 22, 1), (502, [float("nan")] * 24, 2), (503, [float("inf")] * 24, 2), (504, [], 3), (505, [1.0], 3), (506, [0.5] * 27, None), (9, [0.3] * 24, 1), (9, [0.3] * 24, 1)],
    "large": [(i, [(-1) ** i * 200.0 * i + k for k in range(8)], 0) for i in range(40)],
}


@pytest.mark.parametrize("case", CASES)
def test_brute_force(spark, case):
    rows = CASES[case]
    got = sorted((tuple(r) for r in C.digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, 2, "x", "mine")], SCHEMA + ", code string, error string")
    assert [r["error"] for r in C.digests(df).collect()] == [0]
    assert C.digests(df.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None, 2), (2, [], 2)], SCHEMA)
    assert [(r["vec_id"], r["code"], r["error"]) for r in C.digests(none).collect()] == [(2, "00" * 8, 0)]


def test_huge_components_saturate(spark):
    df = spark.createDataFrame([(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [1e6] * 8, 0)], SCHEMA)
    assert sum(r["error"] for r in C.digests(df).collect()) == 0


def test_pruning_is_exact_and_saves_work():
    r = np.random.default_rng(5)
    centre = r.integers(-3000, 3000, (8, 20, 6))
    x = centre[np.arange(8), r.integers(0, 20, (3000, 8))] + r.integers(-200, 200, (3000, 8, 6))
    entries = np.ascontiguousarray(x[:16].swapaxes(0, 1))
    books = C.Books.of(entries)
    code, upper, lower = C.first(x, books)
    work = []
    for _ in range(6):
        new = entries.copy()
        for p in range(8):
            for e in range(16):
                if (code[:, p] == e).any():
                    new[p, e] = x[code[:, p] == e, p].sum(0) // (code[:, p] == e).sum()
        books, entries = C.Books.of(new, entries), new
        code, upper, lower, n = C.pruned(x, books, code, upper, lower)
        every = C.distances(x, entries)
        assert (code == every.argmin(2)).all()
        assert (np.take_along_axis(every, code[:, :, None], 2)[:, :, 0] <= upper**2).all() and (lower**2 <= every).all()
        work.append(n / every.size)
    assert work[-1] < 0.3, work


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 15, 16, 17, 2**52 + 1, (2**29 + 1) ** 2 - 1, (2**29 + 1) ** 2, (2**29 + 1) ** 2 + 1])
def test_roots(k):
    down, up = C.roots(np.array([k], np.int64))
    assert down[0] == math.isqrt(k) and up[0] == math.isqrt(k) + (math.isqrt(k) ** 2 < k)
