"""Run a Spark query and its SQL side by side and describe the first difference."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

from plumbline.sources.tables import SAMPLE_TABLES


def connect(root: str):
    con = duckdb.connect()
    for name in SAMPLE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(_norm(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=repr)


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    described = [(d[0], str(d[1])) for d in cur.description]
    rows = cur.fetchall()
    order = sorted(range(len(described)), key=lambda i: described[i][0])
    bad = [d for d in described if "HUGEINT" in d[1] or "DECIMAL" in d[1]]
    names = [described[i][0] for i in order]
    return names, sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), bad


def difference(df, con, sql: str) -> str | None:
    names, left = spark_rows(df)
    other, right, bad = duck_rows(con, sql)
    if bad:
        return f"types the comparison should not see: {bad}"
    if names != other:
        return f"columns differ: {names} / {other}"
    if len(left) != len(right):
        return f"row counts differ: {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if repr(a) != repr(b):
            return f"rows differ ({names}):\n  {str(a)[:600]}\n  {str(b)[:600]}"
    return None
