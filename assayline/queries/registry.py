"""Registry of queries and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` states the same result in plain SQL."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round floating results so that summation order does not show."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: _round(F.col(f"`{c}`"), digits, kinds[c] == "double") for c in columns})


def _round(col: Column, digits: int, double: bool = True) -> Column:
    """``F.round``, which goes by the text of each number, where a product is too large or too near to a half to be sure of.

    Elsewhere the nearest whole number of steps is plain, and its quotient is the double that ``F.round`` gives."""
    if not double:
        return F.round(col, digits)
    scaled = col * F.lit(10.0**digits)
    steps = F.rint(scaled)
    sure = (F.abs(scaled) < 1e9) & (F.abs(scaled - steps) < 0.499999)
    return F.when(sure, steps / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(col, digits))
