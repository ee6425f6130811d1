"""Compares registered queries with their SQL in DuckDB, as the driver does."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=str)


def difference(spark, duck, query, sql, sf_dir):
    """None, or the first thing that differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    types = dict(zip(rel.columns, map(str, rel.types)))
    off = {c: (t, types[c]) for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]}
    if off:
        return f"types {off}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}; {got[:2]} {want[:2]}"
    return next((f"{a} is not {b}" for a, b in zip(got, want) if a != b), None)
