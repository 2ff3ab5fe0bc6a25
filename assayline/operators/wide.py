"""One wide aggregate over many columns, returned as one row per column.

Expressions over many columns are handed to Spark as SQL text: one call per column
instead of one per operator keeps the driver's planning time flat on wide tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    return F.col(identifier(name))


def identifier(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string constant as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    """A double constant as SQL text, exact to the last bit."""
    value = float(value)
    return f"{value!r}D" if math.isfinite(value) else f"CAST('{value!r}' AS DOUBLE)"


def present(name: str) -> str:
    """The column as double with NaN counted as missing, as SQL text."""
    return f"nullif(CAST({identifier(name)} AS DOUBLE), CAST('NaN' AS DOUBLE))"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns in table order."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the categorical (text) columns in table order."""
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def stacked_aggregate(
    df: DataFrame, rows: Sequence[dict[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """One aggregation whose result is a row per entry of ``rows``.

    An entry maps output names to aggregate expressions (SQL text); all entries have the
    same names and types. No unpivot precedes the aggregation: the table is read once and
    each task sends one partial row per group.
    """
    if not rows:
        raise ValueError("at least one row is needed")
    structs = [
        "named_struct(" + ", ".join(f"{text(n)}, {e}" for n, e in row.items()) + f") AS m{i}"
        for i, row in enumerate(rows)
    ]
    wide = df.groupBy(*[quoted(b) for b in by]).agg(*[F.expr(s) for s in structs])
    stacked = ", ".join(f"m{i}" for i in range(len(rows)))
    return wide.selectExpr(*[identifier(b) for b in by], f"inline(array({stacked}))")


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: Callable[[str], dict[str, str]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(by..., feature, measures...)``, one per column, from a single pass."""
    return stacked_aggregate(df, [{"feature": text(c), **measures(c)} for c in columns], by)


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-missing values in long form: ``(by..., feature, value)``."""
    cells = ", ".join(f"named_struct('feature', {text(c)}, 'value', {present(c)})" for c in columns)
    return df.selectExpr(*[identifier(b) for b in by], f"inline(array({cells}))").where("value IS NOT NULL")
