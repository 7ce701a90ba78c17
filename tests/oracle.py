"""Compare a Spark result with DuckDB's, ignoring row order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((_plain(r[i]), type(_plain(r[i])).__name__) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """What differs, or None. Empty on both sides is no difference: at the smallest scale some
    tables earn no advice."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    expected = _rows(names, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if actual == expected:
        return None
    extra = list((actual - expected).items())[:3]
    missing = list((expected - actual).items())[:3]
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
        f"only Spark: {extra}; only SQL: {missing}"
    )
