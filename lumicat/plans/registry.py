"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Doubles leave a query rounded half up to ``digits``, finer than the steps of exact results: ties are decided alike only
    where sums have no last bit to differ in."""
    c = F.col(c) if isinstance(c, str) else c
    unit = float(10**digits)
    return F.floor(c * unit + 0.5) / unit


def sql_rounded(expression: str, digits: int = 4) -> str:
    unit = f"1e{digits}"
    return f"(floor(({expression}) * {unit} + 0.5e0) / {unit} + 0.0e0)"
