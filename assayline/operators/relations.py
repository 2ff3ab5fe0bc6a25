"""Relations between columns: cross-tabulation, correlation, trend lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.operators.comoments import product_sums
from assayline.operators.wide import number, per_column, present, quoted

# Share of a sum of squares below which a spread is but rounding.
ROUNDING = 1e-13


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts with one output column per entry of ``values``; absent cells are 0.

    The values are given, which spares the scan that would discover them.
    """
    table = df.where(quoted(rows).isNotNull() & quoted(columns).isNotNull())
    counts = table.groupBy(quoted(rows)).pivot(columns, list(values)).count()
    return counts.fillna(0, subset=[str(v) for v in values])


def correlation_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(feature_x, feature_y, corr)``; each pair uses the rows where both are present.

    Means first. One more scan then adds up products of centred columns, and where there are
    gaps also of their squares and of marks for what is present: the sums of a pair over its own rows
    are products with the other column's marks (see ``comoments``). The number of scans does
    not depend on the number of columns. NULL for a constant column, also one that is constant where the other is present.
    """
    pairs = list(pairs)
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    facts = {r["feature"]: r for r in _extent(df, names).collect()}
    varied = [c for c in names if facts[c]["least"] != facts[c]["greatest"]]
    gaps = [c for c in varied if facts[c]["present"] < facts[c]["rows"]]
    centred = {c: f"({present(c)} - {number(facts[c]['mean'])})" for c in varied}
    cells = {"": "1D", **{c: f"coalesce({centred[c]}, 0D)" for c in varied}}
    cells |= {f"mark {c}": f"CASE WHEN {centred[c]} IS NULL THEN 0D ELSE 1D END" for c in gaps}
    if gaps:
        cells |= {f"square {c}": f"coalesce({centred[c]} * {centred[c]}, 0D)" for c in varied}
    place = {name: i for i, name in enumerate(cells)}
    wanted = [(a, b) for a, b in pairs if a != b and a in centred and b in centred]
    known = set(wanted)
    sums = product_sums(df, list(cells.values())) if wanted else None

    def total(of: str, other: str) -> float:
        """Sum of ``of`` over the rows where the other column is present."""
        return float(sums[place[of], place.get(f"mark {other}", 0)])

    def square(of: str, other: str) -> float:
        return total(f"square {of}", other) if other in gaps else float(sums[place[of], place[of]])

    def pearson(a: str, b: str) -> float | None:
        n = total(f"mark {a}" if a in gaps else "", b)
        return _pearson(n, total(a, b), total(b, a), square(a, b), square(b, a), float(sums[place[a], place[b]]))

    rows = [(a, b, pearson(a, b) if (a, b) in known else (1.0 if a == b and a in centred else None)) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "feature_x string, feature_y string, corr double")


def _pearson(n, x, y, xx, yy, xy) -> float | None:
    if not n:
        return None
    spread_x, spread_y = xx - x * x / n, yy - y * y / n
    # What rounding leaves of a column that does not vary in these rows.
    if spread_x <= ROUNDING * xx or spread_y <= ROUNDING * yy:
        return None
    return max(-1.0, min(1.0, (xy - x * y / n) / math.sqrt(spread_x * spread_y)))


def _extent(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return per_column(
        df,
        names,
        lambda c: {
            "rows": "count(1)",
            "present": f"count({present(c)})",
            "mean": f"coalesce(avg({present(c)}), 0D)",
            "least": f"min({present(c)})",
            "greatest": f"max({present(c)})",
        },
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], lower_only: bool = False) -> DataFrame:
    """Pearson correlations in long form; only one triangle is computed.

    ``lower_only`` leaves out the diagonal and the mirrored half.
    """
    columns = list(columns)
    lower = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    own = [(c, c) for c in columns]
    triangle = correlation_pairs(df, lower if lower_only else lower + own)
    if lower_only:
        return triangle
    # Both orientations come from the few computed rows, not from a second scan.
    swapped = F.struct(
        F.col("feature_y").alias("feature_x"), F.col("feature_x").alias("feature_y"), F.col("corr")
    )
    kept = F.struct("feature_x", "feature_y", "corr")
    both = F.when(F.col("feature_x") == F.col("feature_y"), F.array(kept)).otherwise(F.array(kept, swapped))
    return triangle.select(F.inline(both))


def top_correlated(df: DataFrame, features: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """Rows ``(rank, feature, corr, abs_corr)`` by falling absolute correlation with the target.

    Correlations equal to nine decimals tie and are ordered by name: summation order, which
    depends on the arrival of partial results, must not decide.
    """
    pairs = correlation_pairs(df, [(f, target) for f in features if f != target])
    order = [F.desc_nulls_last(F.round(F.abs("corr"), 9)), F.col("feature_x")]
    ranked = pairs.withColumn("abs_corr", F.abs("corr")).orderBy(*order).limit(k)
    # At most k rows remain, so they may be numbered in one task.
    order = Window.partitionBy().orderBy(*order)
    return ranked.select(
        F.row_number().over(order).alias("rank"), F.col("feature_x").alias("feature"), "corr", "abs_corr"
    )


def trend_line(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows ``(feature, slope, intercept)`` of the least-squares line through each scatter."""
    y = present(target)
    return per_column(
        df,
        features,
        lambda f: {
            "slope": f"regr_slope({y}, {present(f)})",
            "intercept": f"regr_intercept({y}, {present(f)})",
        },
    )
