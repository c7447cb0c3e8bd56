"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM read_parquet('{at}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, sql: str, folder: str) -> str:
    """Empty if equal, else what differs."""
    cur = connect(folder).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows(names, cur.fetchall()), rows(df.columns, df.collect())
    if want != got:
        return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:3]}, only SQL {list((want - got).items())[:3]}"
    return ""
