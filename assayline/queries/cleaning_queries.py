"""Cleaning, names, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators.cleaning import (
    cleaning_report,
    drop_duplicates,
    duplicate_count,
    impute_median,
    missing_counts,
    validate,
)
from assayline.queries.registry import query, rounded, table
from assayline.queries.samples import (
    ALL_COLUMNS,
    DIRTY,
    KEY,
    MEASURES,
    RANGES,
    SAMPLES,
    TO_CANONICAL,
    columns,
    dirty_samples,
    samples,
)
from assayline.sources import canonical_names
from assayline.spec import SAMPLE_CATEGORIES

_SPACED = ", ".join(f'{m} AS "{TO_CANONICAL[m]}"' for m in MEASURES)


@query("canonical_names", f"WITH {SAMPLES} SELECT {columns(*KEY)}, {_SPACED}, wine_type, quality FROM samples")
def canonical_names_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_names(samples(spark, sf_dir))


_LIMITS = ", ".join(
    f"CASE WHEN NOT coalesce({m} BETWEEN {RANGES[m][0]} AND {RANGES[m][1]}, false) THEN '{m}' END"
    for m in RANGES
)


@query(
    "validate_ranges",
    f"""WITH {DIRTY}, checked AS (
      SELECT {columns(*KEY)}, concat_ws(',', {_LIMITS},
        CASE WHEN NOT coalesce(wine_type IN ('red', 'white'), false) THEN 'wine_type' END) AS violations
      FROM (SELECT * REPLACE (total_sulfur_dioxide * 2 AS total_sulfur_dioxide) FROM dirty))
    SELECT *, violations = '' AS valid FROM checked""",
)
def validate_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty_samples(spark, sf_dir)
    rows = rows.withColumn("total_sulfur_dioxide", F.col("total_sulfur_dioxide") * 2)
    return validate(rows, RANGES, SAMPLE_CATEGORIES).select(*KEY, "violations", "valid")


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS rows FROM dirty"
    for c in ALL_COLUMNS
)


@query("missing_counts", f"WITH {DIRTY} {_MISSING}")
def missing_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_counts(dirty_samples(spark, sf_dir))


@query(
    "median_impute",
    f"""WITH {DIRTY} SELECT {columns(*KEY)},
      round(coalesce(chlorides, (SELECT median(chlorides) FROM dirty)), 6) AS chlorides,
      round(coalesce(alcohol, (SELECT median(alcohol) FROM dirty)), 6) AS alcohol, quality
    FROM dirty""",
)
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = impute_median(dirty_samples(spark, sf_dir), ["chlorides", "alcohol"])
    return rounded(filled.select(*KEY, "chlorides", "alcohol", "quality"), 6, "chlorides", "alcohol")


@query(
    "duplicate_count",
    f"""WITH {DIRTY} SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates FROM dirty""",
)
def duplicate_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_count(dirty_samples(spark, sf_dir))


@query(
    "duplicate_documents",
    """WITH d AS (SELECT count(*) AS rows FROM documents),
      u AS (SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT text, lang, source FROM documents))
    SELECT rows, distinct_rows, rows - distinct_rows AS duplicates FROM d, u""",
)
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_count(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("drop_duplicate_documents", "SELECT DISTINCT text, lang, source FROM documents")
def drop_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_duplicates(table(spark, sf_dir, "documents").select("text", "lang", "source"), by_digest=True)


@query("drop_duplicates", f"WITH {DIRTY} SELECT DISTINCT * FROM dirty")
def drop_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_duplicates(dirty_samples(spark, sf_dir))


_CELLS = " + ".join(f"(count(*) - count({m}))" for m in MEASURES)


@query(
    "cleaning_report",
    f"""WITH {DIRTY}, counts AS (
      SELECT {_CELLS} AS cells_filled, count(*) AS rows_before,
        (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS rows_after FROM dirty)
    SELECT *, rows_before - rows_after AS rows_removed FROM counts""",
)
def cleaning_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning_report(dirty_samples(spark, sf_dir), MEASURES)
