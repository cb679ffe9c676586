"""Runs a registered query and its check SQL over the same tables and compares."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """An empty string when equal, else what differs."""
    left_cols = df.columns
    left = rows_of(left_cols, df.collect())
    result = con.execute(sql)
    right_cols = [c[0] for c in result.description]
    right = rows_of(right_cols, result.fetchall())
    if sorted(left_cols) != sorted(right_cols):
        return f"columns differ: {sorted(left_cols)} / {sorted(right_cols)}"
    if len(left) != len(right):
        return f"row counts differ: {len(left)} / {len(right)}"
    if not left:
        return "no rows"
    names = sorted(left_cols)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        a, b = wrong[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
        return f"{len(wrong)} of {len(left)} rows differ, first: {cells} in {a}"
    return ""
