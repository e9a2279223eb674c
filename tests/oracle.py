"""Compare a query with its SQL on the same tables: row count, columns and values."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return "\u0000"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value != int(value) or abs(value) > 1e15 else f"{value:.1f}"
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if isinstance(value, str) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def difference(spark_df, con, sql) -> str | None:
    """What differs, or None."""
    got_columns, got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns, want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
