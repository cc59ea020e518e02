"""All registered queries over the population-genomic operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DIGITS = 9


def _round(c: Column, digits: int) -> Column:
    """As F.round, whose decimals cost more than most queries; only values near a tie, or too large, go through it."""
    x = c * float(10**digits)
    return F.when((F.abs(c) < 1e3) & (F.abs(x - F.floor(x) - 0.5) > 1e-3), F.floor(x + 0.5) / float(10**digits)).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to 9 digits, without negative zeros, so that sums in another order compare equal."""
    return df.select(*[(_round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL where there is any. Its result's doubles are rounded."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from .plans import load

    load()


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
