"""Metrics and comparisons on rule-score predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators import evaluate
from assayline.plans.score import score_by_rule
from assayline.queries.registry import query, rounded
from assayline.queries.samples import FROM_CANONICAL, KEY, RULE_OFFSET, SAMPLES, columns, rule_cte, samples

_SCORED = f"WITH {SAMPLES}, {rule_cte()}"
_KEYS = columns(*KEY)


def scored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_by_rule(samples(spark, sf_dir), FROM_CANONICAL, RULE_OFFSET)


_METRICS = """count(*) AS n, round(avg((quality - predicted_quality) ** 2), 6) AS mse,
round(avg(abs(quality - predicted_quality)), 6) AS mae,
round(sqrt(avg((quality - predicted_quality) ** 2)), 6) AS rmse,
round(1 - avg((quality - predicted_quality) ** 2) / var_pop(quality), 6) AS r2"""


@query("regression_metrics", f"{_SCORED} SELECT wine_type, {_METRICS} FROM scored GROUP BY wine_type")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = evaluate.regression_metrics(
        scored_samples(spark, sf_dir), "quality", "predicted_quality", ["wine_type"]
    )
    return rounded(metrics, 6, "mse", "mae", "rmse", "r2")


_WITHIN = " UNION ALL ".join(
    f"""SELECT {t}::DOUBLE AS tolerance,
    round(100.0 * avg(CASE WHEN abs(quality - predicted_quality) <= {t} THEN 1.0 ELSE 0.0 END), 4) AS percentage
    FROM scored"""
    for t in evaluate.TOLERANCES
)


@query("tolerance_accuracy", f"{_SCORED} {_WITHIN}")
def tolerance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate.tolerance_accuracy(scored_samples(spark, sf_dir), "quality", "predicted_quality")
    return rounded(table, 4, "percentage")


@query(
    "prediction_ranges",
    f"""{_SCORED} SELECT min(quality)::DOUBLE AS actual_min, max(quality)::DOUBLE AS actual_max,
    round(avg(quality), 6) AS actual_mean, min(predicted_quality) AS predicted_min,
    max(predicted_quality) AS predicted_max, round(avg(predicted_quality), 6) AS predicted_mean FROM scored""",
)
def prediction_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate.prediction_ranges(scored_samples(spark, sf_dir), "quality", "predicted_quality")
    return rounded(table, 6, "actual_mean", "predicted_mean")


@query(
    "residuals",
    f"""{_SCORED} SELECT {_KEYS}, round(quality - predicted_quality, 6) AS residual,
    round(abs(quality - predicted_quality), 6) AS absolute_error FROM scored""",
)
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate.residuals(scored_samples(spark, sf_dir), "quality", "predicted_quality")
    return rounded(table.select(*KEY, "residual", "absolute_error"), 6, "residual", "absolute_error")


@query(
    "actual_vs_predicted",
    f"""{_SCORED}, fit AS (SELECT 1 - avg((quality - predicted_quality) ** 2) / var_pop(quality) AS r2 FROM scored)
    SELECT {_KEYS}, quality AS actual, predicted_quality AS predicted, round(r2, 6) AS r2 FROM scored, fit""",
)
def actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluate.actual_vs_predicted(scored_samples(spark, sf_dir), "quality", "predicted_quality", KEY)
    return rounded(pairs, 6, "r2")


@query(
    "select_best",
    f"""{_SCORED}, r AS (SELECT quality AS cls, round(1 - avg((alcohol - predicted_quality) ** 2)
      / var_pop(alcohol), 6) AS r2 FROM scored GROUP BY quality),
    b AS (SELECT cls, r2, row_number() OVER (ORDER BY r2 DESC, cls) AS rn FROM r WHERE r2 IS NOT NULL)
    SELECT cls AS best_model, r2 AS best_score FROM b WHERE rn = 1""",
)
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quality class plays the part of a model; the class number is its training order."""
    results = rounded(
        evaluate.regression_metrics(scored_samples(spark, sf_dir), "alcohol", "predicted_quality", ["quality"]),
        6,
        "r2",
    )
    return evaluate.select_best(results, "quality", "r2", "quality")


@query(
    "score_summary",
    f"""{_SCORED}, total AS (SELECT count(*) AS total, round(avg(predicted_quality), 6) AS average,
      min(predicted_quality) AS min_score, max(predicted_quality) AS max_score FROM scored)
    SELECT quality_category, count(*) AS count, round(100.0 * count(*) / any_value(total), 4) AS percentage,
      any_value(total) AS total, any_value(average) AS average, any_value(min_score) AS min_score,
      any_value(max_score) AS max_score
    FROM scored, total GROUP BY quality_category""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluate.score_summary(scored_samples(spark, sf_dir), "predicted_quality", "quality_category")
    return rounded(summary, 6, "average").withColumn("percentage", F.round("percentage", 4))
