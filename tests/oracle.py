"""Side-by-side comparison of a query and its SQL on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(have) != len(want):
        return f"{len(have)} rows and {len(want)}"
    for a, b in zip(have, want):
        if any((abs(x - y) > 2e-5 * max(1, abs(x)) if isinstance(x, (int, float)) and isinstance(y, (int, float)) else x != y) for x, y in zip(a, b)):
            return f"{a} and {b}"
    return ""
