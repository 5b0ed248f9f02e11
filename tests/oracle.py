"""Holds a query's rows against its DuckDB SQL over the same files."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if glob.glob(f"{sf_dir}/{name}.parquet"):
            path = f"{sf_dir}/{name}.parquet"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((x is None, isinstance(x, str), round(x, 4) if isinstance(x, float) else x) if x is not None else (True, False, 0) for x in row)


def same(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=tolerance) or math.isnan(a) and math.isnan(b)
    return a == b


def compared(table, con: duckdb.DuckDBPyConnection, sql: str, tolerance: float = 2.1e-6) -> tuple[int, list]:
    """Rows, and the first differences."""
    names = sorted(table.columns)
    found = con.execute(sql)
    theirs = sorted(d[0] for d in found.description)
    if names != theirs:
        return 0, [("columns", names, theirs)]
    order = [[d[0] for d in found.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=_key)
    have = sorted((tuple(r) for r in table.select(*(f"`{n}`" for n in names)).collect()), key=_key)
    if len(want) != len(have):
        return len(have), [("rows", len(have), len(want))]
    wrong = [(h, w) for h, w in zip(have, want, strict=True) if not all(same(x, y, tolerance) for x, y in zip(h, w, strict=True))]
    return len(have), wrong[:3]
