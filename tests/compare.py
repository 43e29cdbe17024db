"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def difference(df, con, sql: str) -> str:
    """Empty if the results are equal, else what differs first."""
    got_names = df.columns
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} and {sorted(names)}"
    order = sorted(names)
    b = sorted(tuple(_norm(r[names.index(c)]) for c in order) for r in want.fetchall())
    a = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only in one: {list(set(a) - set(b))[:3]} / {list(set(b) - set(a))[:3]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{order}: {x} and {y} ({sum(p != q for p, q in zip(a, b, strict=True))} of {len(a)} rows)"
    return "" if a or sql else "no rows"
