"""Runs registered queries against their SQL."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[:-8]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{src}')")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if v is None or isinstance(v, (int, bool)):
        return str(v)
    return str(v)


def compare(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    want = Counter(tuple(norm(row[names.index(c)]) for c in cols) for row in res.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}"
