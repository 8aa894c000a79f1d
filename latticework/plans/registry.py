"""Named queries with their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.session import configure

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def register(name: str, operators: str, sql: str | None = None):
    """Decorator: publish a query, the operator ids it covers and its oracle."""

    def wrap(build: Builder) -> Builder:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(configure(spark), folder)

        QUERIES[name] = run
        OPERATORS[name] = operators
        if sql:
            ORACLES[name] = sql
        return build

    return wrap


def r(column: str | Column, digits: int = 6) -> Column:
    """Output rounding; -0.0 becomes 0.0.

    The scaled number is rounded, as the oracle engine does it: rounding the shortest decimal
    text of the number differs from it just below a half.
    """
    column = F.col(column) if isinstance(column, str) else column
    scale = F.lit(10.0**digits)
    return F.round(column * scale) / scale + F.lit(0.0)
