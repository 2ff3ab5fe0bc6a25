"""Score post-processing, rule scoring, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import (
    clamp_round,
    half_width,
    interpretation,
    interval_bounds,
    interval_text,
    quality_category,
    rule_score,
)
from assayline.operators.cleaning import impute_median
from assayline.plans.score import score_by_rule
from assayline.queries.evaluation_queries import scored_samples
from assayline.queries.registry import query, table
from assayline.queries.samples import (
    DIRTY,
    FROM_CANONICAL,
    KEY,
    MEASURES,
    RANGES,
    RULE_OFFSET,
    SAMPLES,
    columns,
    dirty_samples,
    key_text,
    rule_cte,
)
from assayline.session import fresh_path
from assayline.spec import SAMPLE_CATEGORIES
from assayline.streaming import read_stream, score_stream

_SCORED = f"WITH {SAMPLES}, {rule_cte()}"
_KEYS = columns(*KEY)


@query(
    "clamp_round",
    """SELECT event_id, CASE WHEN value IS NOT NULL THEN least(greatest(round_even(value / 10, 1), 1), 10) END AS score
    FROM events""",
)
def clamp_round_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", clamp_round(F.col("value") / 10).alias("score"))


@query("quality_category", f"{_SCORED} SELECT {_KEYS}, quality_category FROM scored")
def quality_category_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_samples(spark, sf_dir).select(
        *KEY, quality_category(F.col("predicted_quality")).alias("quality_category")
    )


@query(
    "interpretation",
    f"""{_SCORED} SELECT {_KEYS}, CASE quality_category
    WHEN 'Poor' THEN 'This wine may have noticeable flaws or defects.'
    WHEN 'Average' THEN 'This wine is acceptable but not outstanding.'
    WHEN 'Good' THEN 'This wine should have good to excellent characteristics.' END AS interpretation FROM scored""",
)
def interpretation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = interpretation(F.col("quality_category"))
    return scored_samples(spark, sf_dir).select(*KEY, text.alias("interpretation"))


_BOUNDS = """round_even(greatest(predicted_quality - 0.8, 1), 1) AS low,
round_even(least(predicted_quality + 0.8, 10), 1) AS high"""


@query(
    "score_interval",
    f"""{_SCORED}, b AS (SELECT {_KEYS}, {_BOUNDS} FROM scored)
    SELECT *, printf('%.1f - %.1f', low, high) AS interval FROM b""",
)
def score_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, half = F.col("predicted_quality"), F.lit(0.8)
    low, high = interval_bounds(score, half)
    return scored_samples(spark, sf_dir).select(
        *KEY, low.alias("low"), high.alias("high"), interval_text(score, half).alias("interval")
    )


@query(
    "interval_width",
    "SELECT event_id, coalesce(1.96 * CASE WHEN value >= 10 THEN value END, 0.5) AS half_width FROM events",
)
def interval_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.when(F.col("value") >= 10, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", half_width(spread).alias("half_width"))


@query(
    "rule_score",
    f"""WITH {DIRTY} SELECT {_KEYS}, round(alcohol * 0.35 + 3.5 * 1.2 + fixed_acidity * 0.08
      + sulphates * 1.5 + CASE WHEN wine_type = 'red' THEN 4.0 ELSE 4.8 END, 6) AS score FROM dirty""",
)
def rule_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measurement column is absent (its default applies), another has missing values."""
    rows = dirty_samples(spark, sf_dir).drop("ph")
    return rows.select(*KEY, F.round(rule_score(rows.columns, FROM_CANONICAL), 6).alias("score"))


_DRAW = "(('0x' || substr(draw, {first}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


@query(
    "rule_score_noise",
    f"""WITH {DIRTY}, drawn AS (SELECT *, md5('7:' || {key_text(*KEY)}) AS draw FROM dirty)
    SELECT {_KEYS}, round(alcohol * 0.35 + ph * 1.2 + fixed_acidity * 0.08 + sulphates * 1.5
      + CASE WHEN wine_type = 'red' THEN 4.0 ELSE 4.8 END
      + 0.3 * sqrt(-2 * ln({_DRAW.format(first=1)})) * cos(2 * pi() * {_DRAW.format(first=14)}), 6) AS score FROM drawn""",
)
def rule_score_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule score with a normal draw per key, which a rerun task draws again."""
    rows = dirty_samples(spark, sf_dir)
    return rows.select(*KEY, F.round(rule_score(rows.columns, FROM_CANONICAL, noise_seed=7, noise_key=KEY), 6).alias("score"))


@query(
    "score_rule_batch",
    f"""{_SCORED} SELECT {_KEYS}, predicted_quality, quality_category FROM scored""",
)
def score_rule_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_samples(spark, sf_dir).select(*KEY, "predicted_quality", "quality_category")


CHECKS = " AND ".join(f"coalesce({m} BETWEEN {lo} AND {hi}, false)" for m, (lo, hi) in RANGES.items())
VIOLATIONS = ", ".join(
    f"CASE WHEN NOT coalesce({m} BETWEEN {lo} AND {hi}, false) THEN '{m}' END" for m, (lo, hi) in RANGES.items()
)


@query(
    "score_stream",
    f"""WITH {DIRTY}, {rule_cte("dirty")}
    SELECT {_KEYS}, concat_ws(',', {VIOLATIONS}) AS violations, {CHECKS} AS valid,
      CASE WHEN {CHECKS} THEN predicted_quality END AS predicted_quality,
      CASE WHEN {CHECKS} THEN quality_category END AS quality_category FROM scored""",
)
def score_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty samples arrive as files, are validated and scored, and are read back."""
    arrivals, sink = fresh_path(spark, "arrivals"), fresh_path(spark, "scored-stream")
    rows = dirty_samples(spark, sf_dir)
    rows.write.parquet(arrivals)
    running = score_stream(
        read_stream(spark, arrivals, rows.schema),
        lambda df: score_by_rule(df, FROM_CANONICAL, RULE_OFFSET),
        sink,
        fresh_path(spark, "stream-checkpoint"),
        RANGES,
        SAMPLE_CATEGORIES,
    )
    running.awaitTermination()
    return spark.read.parquet(sink).select(*KEY, "violations", "valid", "predicted_quality", "quality_category")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impute, score by rule, categorise and summarise."""
    from assayline.operators.evaluate import score_summary

    filled = impute_median(dirty_samples(spark, sf_dir), MEASURES)
    scored = score_by_rule(filled, FROM_CANONICAL, RULE_OFFSET)
    return score_summary(scored, "predicted_quality", "quality_category")


_FILLED = ", ".join(f"coalesce({m}, (SELECT median({m}) FROM dirty)) AS {m}" for m in ("chlorides", "alcohol"))


@query(
    "impute_score_summary",
    f"""WITH {DIRTY}, filled AS (SELECT * REPLACE ({_FILLED}) FROM dirty), {rule_cte("filled")},
    total AS (SELECT count(*) AS total, avg(predicted_quality) AS average,
      min(predicted_quality) AS min_score, max(predicted_quality) AS max_score FROM scored)
    SELECT quality_category, count(*) AS count, round(100.0 * count(*) / any_value(total), 4) AS percentage,
      any_value(total) AS total, round(any_value(average), 6) AS average, any_value(min_score) AS min_score,
      any_value(max_score) AS max_score
    FROM scored, total GROUP BY quality_category""",
)
def impute_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).withColumns(
        {"average": F.round("average", 6), "percentage": F.round("percentage", 4)}
    )
