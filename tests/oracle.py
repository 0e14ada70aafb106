"""Run a registered query on Spark and its SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from gridsight.queries.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder.rstrip('/')}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat().replace("T00:00:00", "")
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _key(row):
    return tuple((v is not None, str(round(v, 4) if isinstance(v, float) else v)) for v in row)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(row[i]) for i in order] for row in rows), key=_key)


def _same(a, b):
    """(equal within tolerance, equal to the bit)"""
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), a == b
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        parts = [_same(x, y) for x, y in zip(a, b)]
        return all(p[0] for p in parts), all(p[1] for p in parts)
    return a == b, a == b


def compare(spark_df, con, sql: str) -> tuple[str, str]:
    """``ok`` / ``close`` / ``diff`` and a note on the first difference."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = _rows(names, result.fetchall())
    left = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return "diff", f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(left) != len(right):
        return "diff", f"{len(left)} rows against {len(right)}: {left[:2]} / {right[:2]}"
    exact = True
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            near, same = _same(x, y)
            if not near:
                return "diff", f"{sorted(names)}: {a} against {b}"
            exact &= same
    return ("ok" if exact else "close"), f"{len(left)} rows"
