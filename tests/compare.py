"""Holds a query's rows against its SQL in DuckDB, without regard to order."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if isinstance(v, float) else v


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if equal, else the first difference."""
    a_cols, a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b_cols, b = rows([d[0] for d in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} and {b_cols}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in b][:2]} and {[x for x in b if x not in a][:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    return ""
