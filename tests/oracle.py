"""Spark's rows against DuckDB's, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    if isinstance(x, bool | int):
        return float(f"{float(x):.9g}") if not isinstance(x, bool) else x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, sf: str, name: str, query, sql: str) -> int:
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck(sf).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols, (name, sorted(names), cols)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want), (name, len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    diff = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not diff, (name, cols, diff[:3])
    return len(got)
