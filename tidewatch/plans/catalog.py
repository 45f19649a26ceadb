"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """Doubles rounded, so that two engines' last bits do not matter.

    The nudge moves exact halves (a mean of two microsecond gaps) to one side.
    """
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(F.col(n) + 1e-9, digits) for n in names})


def r(expr: str, name: str | None = None, digits: int = 4) -> str:
    """The same rounding as SQL text."""
    return f"round(({expr}) + 1e-9, {digits}) AS {name or expr}"
