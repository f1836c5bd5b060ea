"""Order-insensitive comparison of a Spark result with its DuckDB check SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        con.execute(f"create view {table} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value.is_integer() else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (bytearray, bytes)):
        return bytes(value).hex()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(_plain(row[i])) for i in order) for row in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    got_names = df.columns
    got = _rows(got_names, df.collect())
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = _rows(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"rows spark={sum(got.values())} sql={sum(want.values())} cols={sorted(got_names)}; "
            f"only spark: {list(extra.items())[:3]}; only sql: {list(missing.items())[:3]}"
        )
    return None
