"""The demonstration table: ``lineitem`` mapped to the measurement columns by arithmetic.

Each mapping exists twice, as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.queries.registry import table
from assayline.spec import SAMPLE_RANGES, TableSpec

KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
MEASURES = (
    "fixed_acidity",
    "volatile_acidity",
    "citric_acid",
    "residual_sugar",
    "chlorides",
    "free_sulfur_dioxide",
    "total_sulfur_dioxide",
    "density",
    "ph",
    "sulphates",
    "alcohol",
)
SPEC = TableSpec(features=MEASURES, category="wine_type", target="quality", key=KEY)

# Canonical measurement name -> name in the demonstration table, and back.
TO_CANONICAL = {m: ("pH" if m == "ph" else m.replace("_", " ")) for m in MEASURES}
FROM_CANONICAL = {c: m for m, c in TO_CANONICAL.items()}
RANGES = {FROM_CANONICAL[c]: limits for c, limits in SAMPLE_RANGES.items()}
# The unshifted rule score exceeds the upper limit for nearly every row.
RULE_OFFSET = -8.0


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    measured = line.selectExpr(
        *KEY,
        "7.0D + l_discount * 20 AS fixed_acidity",
        "0.1D + l_tax * 10 AS volatile_acidity",
        "l_discount * 5 AS citric_acid",
        "l_quantity / 2 AS residual_sugar",
        "0.02D + l_tax AS chlorides",
        "l_quantity AS free_sulfur_dioxide",
        "l_quantity * 2 + l_linenumber * 10 AS total_sulfur_dioxide",
        "0.99D + l_extendedprice / 1e7D AS density",
        "3.0D + l_linenumber / 10.0D AS ph",
        "0.4D + l_tax * 5 AS sulphates",
        "8.0D + l_quantity / 8 AS alcohol",
        "CASE WHEN l_returnflag = 'A' THEN 'red' ELSE 'white' END AS wine_type",
        f"CAST(conv(substring(md5(concat_ws('|', {', '.join(KEY)})), 1, 4), 16, 10) AS BIGINT) / 65535.0D - 0.5D"
        " AS noise",
    )
    signal = (
        "(alcohol - 8) * 0.3D + (12 - volatile_acidity * 10) * 0.2D + 2 * citric_acid * 0.1D + noise + 3.5D"
    )
    quality = F.expr(f"CAST(least(greatest(rint({signal}), 3D), 9D) AS INT)")
    return measured.withColumn("quality", quality).drop("noise")


SAMPLES = """
measured AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    7.0 + l_discount * 20 AS fixed_acidity,
    0.1 + l_tax * 10 AS volatile_acidity,
    l_discount * 5 AS citric_acid,
    l_quantity / 2 AS residual_sugar,
    0.02 + l_tax AS chlorides,
    l_quantity AS free_sulfur_dioxide,
    l_quantity * 2 + l_linenumber * 10 AS total_sulfur_dioxide,
    0.99 + l_extendedprice / 1e7 AS density,
    CAST(3.0 AS DOUBLE) + l_linenumber / CAST(10.0 AS DOUBLE) AS ph,
    0.4 + l_tax * 5 AS sulphates,
    8.0 + l_quantity / 8 AS alcohol,
    CASE WHEN l_returnflag = 'A' THEN 'red' ELSE 'white' END AS wine_type,
    ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 4))::BIGINT
      / 65535.0 - 0.5 AS noise
  FROM lineitem
),
samples AS (
  SELECT * EXCLUDE (noise),
    CAST(least(greatest(round_even((alcohol - 8) * 0.3 + (12 - volatile_acidity * 10) * 0.2
      + 2 * citric_acid * 0.1 + noise + 3.5, 0), 3), 9) AS INTEGER) AS quality
  FROM measured
)"""


def dirty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with missing cells (line number 7) and repeated rows (line number 1)."""
    clean = samples(spark, sf_dir)
    holes = {c: F.when(F.col("l_linenumber") != 7, F.col(c)) for c in ("chlorides", "alcohol")}
    return clean.withColumns(holes).unionByName(clean.where("l_linenumber = 1"))


DIRTY = (
    SAMPLES
    + """,
dirty AS (
  SELECT * REPLACE (
    CASE WHEN l_linenumber <> 7 THEN chlorides END AS chlorides,
    CASE WHEN l_linenumber <> 7 THEN alcohol END AS alcohol)
  FROM samples
  UNION ALL
  SELECT * FROM samples WHERE l_linenumber = 1
)"""
)


def key_text(*names: str) -> str:
    """The text that a key's digest is made of: length and text of each part, N for NULL."""
    parts = ", ".join(f"coalesce(length({n}::VARCHAR) || ':' || {n}::VARCHAR, 'N')" for n in names)
    return f"concat_ws('|', {parts})"


# Ranks every row of a stratum at once; the engine under test never does.
SPLIT = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || {digest})) AS rn,
    count(*) OVER (PARTITION BY quality) AS n,
    CAST(('0x' || substr(md5('fold:42:' || {digest}), 1, 8))::BIGINT % 3 AS INTEGER) AS fold
  FROM {source}
),
split AS (
  SELECT * EXCLUDE (rn, n),
    CASE WHEN 10 * (rn - 1) < 6 * n THEN 'train' WHEN 10 * (rn - 1) < 8 * n THEN 'val' ELSE 'test' END AS split
  FROM ranked
)"""


def split_cte(source: str = "samples") -> str:
    return SPLIT.format(digest=key_text(*KEY), source=source)


# Filled with medians, duplicates dropped.
CLEANED = (
    DIRTY
    + """,
medians AS (
  SELECT """
    + ", ".join(f"median({m}) AS {m}" for m in MEASURES)
    + """ FROM dirty
),
cleaned AS (
  SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, """
    + ", ".join(f"coalesce(d.{m}, m.{m}) AS {m}" for m in MEASURES)
    + """, wine_type, quality
  FROM dirty d CROSS JOIN medians m
)"""
)

# The rule score, clamped and rounded, with its category.
RULE = """
scored AS (
  SELECT *, CASE WHEN predicted_quality IS NULL THEN NULL WHEN predicted_quality <= 4 THEN 'Poor'
    WHEN predicted_quality <= 6 THEN 'Average' ELSE 'Good' END AS quality_category
  FROM (
    SELECT *, round_even(least(greatest(CAST(-8.0 AS DOUBLE) + alcohol * 0.35 + ph * 1.2
      + fixed_acidity * 0.08 + sulphates * 1.5
      + CASE WHEN wine_type = 'red' THEN 4.0 ELSE 4.8 END, 1), 10), 1) AS predicted_quality
    FROM {source}
  )
)"""


def rule_cte(source: str = "samples") -> str:
    return RULE.format(source=source)


def columns(*names: str) -> str:
    return ", ".join(names)


ALL_COLUMNS = (*KEY, *MEASURES, "wine_type", "quality")
