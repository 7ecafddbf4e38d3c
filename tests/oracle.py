"""Runs a query and its SQL on the same tables and compares them as bags."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (Decimal, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6g}" if f % 1 else int(f)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def by_sql(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        if p.suffix == ".parquet":
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def differences(spark, sf: str, query, sql: str) -> str:
    df = query(spark, sf)
    columns, rows = by_sql(sf, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = bag(df.columns, df.collect()), bag(columns, rows)
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}, only there {list((b - a).items())[:3]}"
