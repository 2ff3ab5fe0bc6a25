"""Regression metrics, comparisons and residuals over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.operators.wide import number, present, quoted, stacked_aggregate, text
from assayline.session import write_through

TOLERANCES = (0.5, 1.0, 1.5)


def metric_expressions(actual: str, predicted: str) -> dict[str, str]:
    """Aggregates ``n, mse, mae, rmse, r2`` as SQL text; rows with a missing side are left out.

    R² uses the population variance, whose partial results merge without cancellation. On
    a constant target it is 1 for a perfect and 0 for any other prediction.
    """
    y, p = present(actual), present(predicted)
    error = f"CAST({y} - {p} AS DOUBLE)"
    mse = f"avg({error} * {error})"
    spread = f"var_pop(CASE WHEN {p} IS NOT NULL THEN CAST({y} AS DOUBLE) END)"
    return {
        "n": f"count({error})",
        "mse": mse,
        "mae": f"avg(abs({error}))",
        "rmse": f"sqrt({mse})",
        "r2": f"CASE WHEN count({error}) < 2 THEN CAST(NULL AS DOUBLE)"
        f" WHEN {spread} = 0D THEN CASE WHEN {mse} = 0D THEN 1D ELSE 0D END"
        f" ELSE 1D - try_divide({mse}, {spread}) END",
    }


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """Rows ``(by..., n, mse, mae, rmse, r2)``."""
    return stacked_aggregate(df, [metric_expressions(actual, predicted)], by)


def metrics_of_models(
    df: DataFrame, actual: str, predictions: dict[str, str], by: Sequence[str] = ("split",)
) -> DataFrame:
    """Metrics of several prediction columns from one scan: rows ``(by..., model, n, ...)``."""
    rows = [
        {"model": text(model), **metric_expressions(actual, column)} for model, column in predictions.items()
    ]
    return stacked_aggregate(df, rows, by)


def tolerance_accuracy(
    df: DataFrame, actual: str, predicted: str, tolerances: Sequence[float] = TOLERANCES
) -> DataFrame:
    """Rows ``(tolerance, percentage)`` of predictions no further off than the tolerance.

    Of the rows that have both values; NaN is a missing value.
    """
    error = f"abs({present(actual)} - {present(predicted)})"
    return stacked_aggregate(
        df,
        [
            {
                "tolerance": number(t),
                "percentage": f"100D * avg(CAST({error} <= {number(t)} AS DOUBLE))",
            }
            for t in tolerances
        ],
    )


def prediction_ranges(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: least, greatest and mean of actual and predicted values; NaN is a missing value."""
    return df.agg(
        *[
            how(F.expr(present(column))).alias(f"{side}_{name}")
            for side, column in (("actual", actual), ("predicted", predicted))
            for name, how in (("min", F.min), ("max", F.max), ("mean", F.avg))
        ]
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Add ``residual`` (actual minus predicted) and ``absolute_error``."""
    error = quoted(actual) - quoted(predicted)
    return df.withColumns({"residual": error, "absolute_error": F.abs(error)})


def actual_vs_predicted(
    df: DataFrame, actual: str, predicted: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Point pairs ``(keep..., actual, predicted)`` annotated with their common ``r2``."""
    r2 = regression_metrics(df, actual, predicted).first()["r2"]
    return df.select(
        *[quoted(k) for k in keep],
        quoted(actual).alias("actual"),
        quoted(predicted).alias("predicted"),
        F.lit(r2).cast("double").alias("r2"),
    )


def select_best(results: DataFrame, model: str = "model", score: str = "r2", order: str = "ordinal") -> DataFrame:
    """One row ``(best_model, best_score)``: highest score, the earliest model on a tie."""
    usable = results.where(F.nullif(quoted(score), F.lit(float("nan"))).isNotNull())
    best = F.max_by(quoted(model), F.struct(quoted(score), -quoted(order)))
    return usable.agg(best.alias("best_model"), F.max(quoted(score)).alias("best_score"))


def model_comparison(metrics: DataFrame, training: DataFrame) -> DataFrame:
    """One row per model, best validation R² first.

    ``metrics`` holds ``(model, split, ..., rmse, r2)`` rows, ``training`` holds
    ``(model, cv_mean, cv_std, training_time)``.
    """
    wide = metrics.groupBy("model").agg(
        *[
            F.max(F.when(F.col("split") == split, F.col(name))).alias(f"{split}_{name}")
            for name in ("r2", "rmse")
            for split in ("train", "val", "test")
        ]
    )
    return wide.join(training, "model").orderBy(F.desc_nulls_last("val_r2"), "model")


def score_summary(df: DataFrame, score: str, category: str) -> DataFrame:
    """Rows per category: count and percentage, with total, average and range of all scores."""
    per_category = df.groupBy(quoted(category)).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(quoted(score)).alias("score_sum"),
        F.count(quoted(score)).alias("scored"),
        F.min(quoted(score)).alias("least"),
        F.max(quoted(score)).alias("greatest"),
    )
    per_category = write_through(per_category, "score-summary")
    # Totals are constants of the plan: no window gathers the categories.
    total, score_sum, scored, least, greatest = per_category.agg(
        F.sum("count"), F.sum("score_sum"), F.sum("scored"), F.min("least"), F.max("greatest")
    ).first()
    kind = df.schema[score].dataType
    return per_category.select(
        quoted(category),
        "count",
        F.try_divide(F.lit(100.0) * F.col("count"), F.lit(float(total or 0))).alias("percentage"),
        F.lit(total).cast("bigint").alias("total"),
        F.lit(score_sum / scored if scored else None).cast("double").alias("average"),
        F.lit(least).cast(kind).alias("min_score"),
        F.lit(greatest).cast(kind).alias("max_score"),
    )
