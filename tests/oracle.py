"""Compare a query with its SQL on DuckDB, independent of row order."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def assert_same(df, con, sql: str) -> int:
    got = bag(df.columns, df.collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    want = bag(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want, f"only here: {list((got - want).items())[:4]}; only in SQL: {list((want - got).items())[:4]}"
    return sum(got.values())
