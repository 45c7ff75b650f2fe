"""Compare a Spark result with DuckDB SQL over the same tables, as multisets of rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> int:
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, rows)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs):
        assert a == b, (a, b)
    return len(mine)
