"""Profiling aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.cleaning import duplicate_count, is_missing, missing_counts
from assayline.operators.quantiles import Search, exact_quantiles, linear_rank
from assayline.operators.relations import top_correlated
from assayline.operators.wide import identifier, numeric_columns, per_column, present, quoted, text
from assayline.session import lookup_join, write_through


def table_info(df: DataFrame) -> DataFrame:
    """Rows ``(position, feature, dtype, non_null, rows, columns)``."""
    dtypes = dict(df.dtypes)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    order = {c: i for i, c in enumerate(df.columns)}
    return per_column(
        df,
        df.columns,
        lambda c: {
            "position": str(order[c]),
            "dtype": text(dtypes[c]),
            "non_null": f"count_if(NOT {is_missing(kinds[c], c)})",
            "rows": "count(1)",
            "columns": str(len(order)),
        },
    )


def head_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in key order; each task keeps its own first ``n`` only."""
    return df.orderBy(*[quoted(c) for c in order]).limit(n)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(feature, count, mean, std, min, q25, q50, q75, max)`` with exact quartiles."""
    columns = list(columns or numeric_columns(df))
    search = Search(df, columns, [], [linear_rank(p) for p in (0.25, 0.5, 0.75)])
    quartiles = search.result().select("feature", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    # Columns without a value have a row too.
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    joined = lookup_join(lookup_join(names, search.moments(), ["feature"]), quartiles, ["feature"])
    return joined.select(
        "feature", F.coalesce("n", F.lit(0)).alias("count"), "mean", "std", F.col("least").alias("min"), "q25", "q50", "q75", F.col("greatest").alias("max")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(quoted(column)).distinct().orderBy(quoted(column))


def value_counts(df: DataFrame, column: str, by_frequency: bool = False) -> DataFrame:
    """Rows ``(column, count)`` without missing values, by value or by falling count."""
    kind = df.schema[column].dataType
    counts = df.where(f"NOT {is_missing(kind, column)}").groupBy(quoted(column)).count()
    order = [F.desc("count"), quoted(column)] if by_frequency else [quoted(column)]
    return counts.orderBy(*order)


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(column, count, percentage)``."""
    counts = write_through(df.groupBy(quoted(column)).count(), "category-counts")
    # The number of rows is a constant of the plan: no window gathers the categories.
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.withColumn("percentage", F.try_divide(F.lit(100.0) * F.col("count"), F.lit(float(total))))


def equality_share(df: DataFrame, column: str, value) -> DataFrame:
    """One row: how many rows equal ``value`` and their percentage."""
    hit = F.coalesce(quoted(column) == F.lit(value), F.lit(False))
    return df.agg(
        F.count_if(hit).alias("count"),
        (F.lit(100.0) * F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1)))).alias("percentage"),
    )


def range_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(feature, min, max, mean)``."""
    return per_column(
        df,
        columns,
        lambda c: {
            "min": f"min({present(c)})",
            "max": f"max({present(c)})",
            "mean": f"avg({present(c)})",
        },
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Rows ``(bin, lower, upper, count)``: equal widths, last bin closed, empty bins kept."""
    value = F.expr(present(column))
    low, high = df.agg(F.min(value), F.max(value)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint")
    if low == high:
        # A constant column gets a range of one around it.
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    counted = (
        df.where(value.isNotNull())
        .groupBy(F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).alias("bin"))
        .count()
    )
    every = spark.range(1, bins + 1).select(F.col("id").alias("bin"))
    return (
        every.join(counted, "bin", "left")
        .select(
            F.col("bin").cast("int").alias("bin"),
            (F.lit(low) + (F.col("bin") - 1) * width).alias("lower"),
            (F.lit(low) + F.col("bin") * width).alias("upper"),
            F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        )
        .orderBy("bin")
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Rows ``(by..., n, q1, median, q3, whisker_low, whisker_high, outliers)``.

    Whiskers end at the furthest value within 1.5 interquartile ranges of the box.
    """
    quartiles = exact_quantiles(df, [column], [0.25, 0.5, 0.75], by)
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    boxes = quartiles.select(
        *[quoted(b) for b in by],
        F.col("n"),
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
        (F.col("q0") - reach).alias("fence_low"),
        (F.col("q2") + reach).alias("fence_high"),
    )
    boxes = write_through(boxes, "boxes")
    slim = df.select(*[quoted(b) for b in by], F.expr(present(column)).alias("value"))
    located = lookup_join(slim.where(F.col("value").isNotNull()), boxes, list(by))
    inside = F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    return located.groupBy(*[quoted(b) for b in by], "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def scatter_points(
    df: DataFrame, feature: str, target: str, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """Point pairs ``(x, y)``; ``fraction`` thins them for drawing."""
    points = df.select(quoted(feature).alias("x"), quoted(target).alias("y"))
    return points if fraction is None else points.sample(fraction=fraction, seed=seed)


def select_numeric(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df, exclude)])


def eda_summary(df: DataFrame, target: str, category: str | None = None, top: int = 5) -> DataFrame:
    """One typed row: shape, columns, target range, missing cells, duplicates, best features."""
    features = numeric_columns(df, exclude=[target])
    total = missing_counts(df).agg(F.sum("missing").alias("missing_values"), F.max("rows").alias("n_rows"))
    duplicates = duplicate_count(df).select("duplicates")
    kind = df.schema[target].dataType
    known = F.expr(f"CASE WHEN NOT {is_missing(kind, target)} THEN {identifier(target)} END")
    extent = df.agg(F.min(known).alias("target_min"), F.max(known).alias("target_max"))
    best = top_correlated(df, features, target, top).agg(
        F.sort_array(F.collect_list(F.struct("rank", "feature", "abs_corr"))).alias("top_features")
    )
    # Four one-row results, brought together by one more aggregate.
    parts = total
    for other in (duplicates, extent, best):
        parts = parts.unionByName(other, allowMissingColumns=True)
    return parts.agg(
        F.max("n_rows").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join([*features, *([category] if category else [])])).alias("features"),
        F.lit(target).alias("target"),
        F.max("target_min").alias("target_min"),
        F.max("target_max").alias("target_max"),
        F.max("missing_values").alias("missing_values"),
        F.max("duplicates").alias("duplicates"),
        F.first("top_features", ignorenulls=True).alias("top_features"),
    )
