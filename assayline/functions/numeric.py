"""Binning, ratios and missing-value rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(
    col: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` that holds the value, else NULL.

    ``include_lowest`` closes the first interval on the left.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    above = col >= edges[0] if include_lowest else col > edges[0]
    chain = F.when(~above, F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(col <= upper, F.lit(label))
    return chain


def guarded_ratio(numerator: Column, denominator: Column, guard: float = 0.001) -> Column:
    """``numerator / (denominator + guard)``; NULL where that denominator is zero."""
    return F.try_divide(numerator, denominator + F.lit(guard))


def round_half_even(col: Column, digits: int = 0) -> Column:
    """Round the binary value: scale, take the nearest even whole number, scale back.

    ``bround`` rounds the shortest decimal text instead and differs where the scaled value
    lands on a half.
    """
    return F.rint(col * F.lit(10.0**digits)) / F.lit(10.0**digits)


def missing_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column.

    A NaN would otherwise poison averages and sort above every number.
    """
    nan = F.lit(float("nan"))
    changed = {
        f.name: F.nullif(F.col(f"`{f.name}`"), nan.cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(changed) if changed else df
