"""Scoring of tables: one output row per input row, without a shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.scores import (
    RULE_HALF_WIDTH,
    clamp_round,
    half_width,
    interpretation,
    interval_text,
    quality_category,
    rule_score,
)
from assayline.functions.text import title
from assayline.models.prediction import predict, predict_with_spread
from assayline.models.training import ModelSet
from assayline.operators.features import schema_differences
from assayline.plans.prepare import Preparation
from assayline.sources.delimited import REJECT, read_delimited, write_delimited

SCORE, CATEGORY = "predicted_quality", "quality_category"
ABSENT = ("default", "flag", "fail")


def score_table(
    df: DataFrame,
    preparation: Preparation,
    trained: ModelSet,
    name: str | None = None,
    clamp: bool = False,
    details: bool = False,
) -> DataFrame:
    """Append the rounded prediction and its category (trained batch scores are not clamped).

    ``details`` clamps and also appends half-width, interval, interpretation and model name,
    the answer given for a single row.
    """
    ready = preparation.transform(df)
    if details:
        ready = predict_with_spread(ready, trained, name, "__raw", "__spread")
    else:
        ready = predict(ready, trained, name, "__raw")
    limits = {} if clamp or details else {"limits": None}
    scored = ready.withColumn(SCORE, clamp_round(F.col("__raw"), **limits))
    scored = scored.withColumn(CATEGORY, quality_category(F.col(SCORE)))
    if details:
        half = half_width(F.col("__spread"))
        scored = scored.withColumns(
            {
                "prediction": F.col("__raw"),
                "half_width": half,
                "interval": interval_text(F.col(SCORE), half),
                "interpretation": interpretation(F.col(CATEGORY)),
                "model_used": title(F.lit(trained.get(name).name)),
            }
        )
    return scored.drop("features", "__raw", "__spread")


def score_by_rule(
    df: DataFrame,
    names: Mapping[str, str] | None = None,
    offset: float = 0.0,
    details: bool = False,
    **options,
) -> DataFrame:
    """Append the clamped rule score and its category."""
    raw = rule_score(df.columns, names, offset=offset, **options)
    scored = df.withColumn(SCORE, clamp_round(raw))
    scored = scored.withColumn(CATEGORY, quality_category(F.col(SCORE)))
    if details:
        half = F.lit(RULE_HALF_WIDTH)
        scored = scored.withColumns(
            {
                "half_width": half,
                "interval": interval_text(F.col(SCORE), half),
                "interpretation": interpretation(F.col(CATEGORY)),
                "model_used": title(F.lit("simple_formula")),
            }
        )
    return scored


def score_batch(
    spark: SparkSession,
    source: str,
    sink: str,
    preparation: Preparation,
    trained: ModelSet,
    name: str | None = None,
    sep: str = ",",
    mode: str = "errorifexists",
    absent: str = "default",
    compression: str | None = None,
) -> DataFrame:
    """Score delimited files into a directory and return a scan of the written rows.

    The files have one header; one that deviates from the others raises. Model columns it lacks are filled as
    ``absent`` says: ``default`` takes 0 for them, as ``align_schema`` does, ``flag`` does so too and names them
    in the text column ``absent_columns``, ``fail`` refuses the batch with their names and those of the columns that nobody knows, as a
    renamed column is both.

    Files that end in the suffix of a codec are read through it; ``compression`` names the one of the written files.
    Every line gives a row. A malformed one keeps its text in column ``malformed_line`` and
    gets no score, since its cells are not what was measured.
    """
    if absent not in ABSENT:
        raise ValueError(f"unknown choice {absent!r}, expected one of {ABSENT}")
    rows = read_delimited(spark, source, preparation.spec.schema(), sep, malformed="keep")
    differences = schema_differences(rows.drop(REJECT), preparation.spec.model_columns)
    if absent == "fail" and differences["missing"]:
        known = {preparation.spec.target, *preparation.spec.key}
        unknown = [c for c in differences["extra"] if c not in known]
        raise ValueError(f"the batch lacks {', '.join(differences['missing'])}; unknown in it: {', '.join(unknown) or 'nothing'}")
    scored = score_table(rows, preparation, trained, name)
    added = [c for c in scored.columns if c not in rows.columns]
    scored = scored.withColumns({c: F.when(F.col(REJECT).isNull(), F.col(c)) for c in added})
    if absent == "flag":
        scored = scored.withColumn("absent_columns", F.lit(", ".join(differences["missing"]) or None).cast("string"))
    write_delimited(scored, sink, mode=mode, compression=compression)
    return read_delimited(spark, sink, scored.schema)
