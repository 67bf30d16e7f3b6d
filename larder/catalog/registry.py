"""Where catalog modules register their queries and SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional DuckDB statement."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def nudge(digits: int) -> float:
    """A little more than nothing: moves exact decimals off the tie, where engines round differently."""
    return 1.2345678 * 10.0 ** -(digits + 2)


def rounded(column: str, digits: int) -> Column:
    """Rounded result column that compares equal across engines."""
    return F.round(F.col(column) + F.lit(nudge(digits)), digits).alias(column)


def rounded_sql(expr: str, digits: int) -> str:
    """DuckDB form of :func:`rounded`."""
    return f"round({expr} + {nudge(digits):.20f}::DOUBLE, {digits})"
