"""Outlier fences by the interquartile range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.quantiles import exact_quantiles
from assayline.operators.wide import number, per_column, present, quoted

FENCE = 1.5
POLICIES = ("select", "drop", "clip")


def iqr_fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(by..., feature, q1, q3, lower_bound, upper_bound)``."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], by)
    width = F.col("q1") - F.col("q0")
    return quartiles.select(
        *[quoted(b) for b in by],
        "feature",
        F.col("q0").alias("q1"),
        F.col("q1").alias("q3"),
        (F.col("q0") - FENCE * width).alias("lower_bound"),
        (F.col("q1") + FENCE * width).alias("upper_bound"),
    )


def fit_fences(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Fences as plain numbers: two per column, whatever the size of the table."""
    rows = iqr_fences(df, columns).collect()
    return {r["feature"]: (r["lower_bound"], r["upper_bound"]) for r in rows}


def is_outlier(name: str, fences: Mapping[str, tuple[float, float]]) -> str:
    """Test against the fences as SQL text; a missing value is no outlier."""
    low, high = fences[name]
    return f"coalesce({present(name)} < {number(low)} OR {present(name)} > {number(high)}, false)"


def outlier_report(
    df: DataFrame, columns: Sequence[str], fences: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Rows ``(feature, outliers, percentage, lower_bound, upper_bound)`` in one pass."""
    fences = fences or fit_fences(df, columns)
    return per_column(
        df,
        [c for c in columns if c in fences],
        lambda c: {
            "outliers": f"count_if({is_outlier(c, fences)})",
            "percentage": f"100D * try_divide(CAST(count_if({is_outlier(c, fences)}) AS DOUBLE), count(1))",
            "lower_bound": number(fences[c][0]),
            "upper_bound": number(fences[c][1]),
        },
    )


def treat_outliers(
    df: DataFrame,
    columns: Sequence[str],
    policy: str = "drop",
    fences: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Apply a policy: ``select`` the rows with an outlier in any column, ``drop`` them, or
    ``clip`` the values to the fences."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, expected one of {POLICIES}")
    fences = fences or fit_fences(df, columns)
    known = [c for c in columns if c in fences]
    if policy == "clip":
        clipped = {}
        for c in known:
            low, high = fences[c]
            measured, value = F.expr(present(c)), quoted(c)  # NaN is missing, not above the fence
            clipped[c] = F.when(measured < low, F.lit(low)).when(measured > high, F.lit(high)).otherwise(value)
        return df.withColumns(clipped)
    any_outlier = " OR ".join(is_outlier(c, fences) for c in known) or "false"
    return df.where(any_outlier if policy == "select" else f"NOT ({any_outlier})")
