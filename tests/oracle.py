"""Runs a query's SQL in DuckDB and compares rows, columns sorted by name."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    """A value as both engines give it: whole numbers exactly, others as text of nine digits."""
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int) or isinstance(v, decimal.Decimal) and v == v.to_integral_value():
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr([plain(r[i]) for i in order]) for r in found)


def same(frame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    got = rows(frame.columns, frame.collect())
    assert sorted(frame.columns) == sorted(names)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
