"""Scans, unions, sinks, generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.operators.profile import eda_summary
from assayline.operators.split import stratified_split
from assayline.plans.score import score_by_rule
from assayline.queries.registry import query, rounded, table
from assayline.queries.samples import (
    ALL_COLUMNS,
    FROM_CANONICAL,
    KEY,
    MEASURES,
    RULE_OFFSET,
    SAMPLES,
    SPEC,
    TO_CANONICAL,
    columns,
    dirty_samples,
    key_text,
    rule_cte,
    samples,
    split_cte,
)
from assayline.queries.profile_queries import EDA_SQL
from assayline.session import fresh_path
from assayline.sources import (
    REJECT,
    read_delimited,
    read_summary,
    synthesise,
    union_tagged,
    write_delimited,
    write_splits,
    write_summary,
)
from assayline.sources.synthetic import EXPONENTIALS, NORMALS

_SPACED = ", ".join(f'{m} AS "{TO_CANONICAL[m]}"' for m in MEASURES)


@query("scan_csv", f"WITH {SAMPLES} SELECT {columns(*ALL_COLUMNS)} FROM samples")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "scan-csv")
    write_delimited(samples(spark, sf_dir), path)
    rows = read_delimited(spark, path, samples(spark, sf_dir).schema)
    return rows.toDF(*[FROM_CANONICAL.get(c, c) for c in rows.columns])


_BAD = "CASE WHEN l_linenumber <> 5 THEN alcohol END"


@query("scan_rejects", f"WITH {SAMPLES} SELECT {columns(*KEY)}, {_BAD} AS alcohol, wine_type, l_linenumber = 5 AS malformed FROM samples")
def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are no numbers: their lines are kept and told apart."""
    path = fresh_path(spark, "scan-rejects")
    rows = samples(spark, sf_dir).select(*KEY, "alcohol", "wine_type")
    spoilt = F.when(F.col("l_linenumber") == 5, F.concat(F.lit("x"), F.col("alcohol"))).otherwise(F.col("alcohol").cast("string"))
    write_delimited(rows.withColumn("alcohol", spoilt), path)
    read = read_delimited(spark, path, rows.schema, malformed="keep")
    return read.select(*KEY, "alcohol", "wine_type", F.col(REJECT).isNotNull().alias("malformed"))


@query(
    "scan_csv_semicolon",
    f"WITH {SAMPLES} SELECT {columns(*KEY)}, {_SPACED}, wine_type, quality FROM samples",
)
def scan_csv_semicolon(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "scan-csv-semicolon")
    spaced = samples(spark, sf_dir).withColumnsRenamed(TO_CANONICAL)
    write_delimited(spaced, path, sep=";")
    return read_delimited(spark, path, spaced.schema, sep=";")


@query(
    "union_tagged",
    f"""WITH {SAMPLES} SELECT {columns(*KEY)}, alcohol, quality,
    CASE WHEN wine_type = 'white' THEN citric_acid END AS citric_acid, wine_type FROM samples""",
)
def union_tagged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    red = rows.where("wine_type = 'red'").select(*KEY, "alcohol", "quality")
    white = rows.where("wine_type = 'white'").select("quality", *KEY, "citric_acid", "alcohol")
    return union_tagged({"red": red, "white": white}, "wine_type")


def _uniform_sql(digest: str, first: int = 1) -> str:
    return f"((('0x' || substr({digest}, {first}, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def _digest_sql(name: str) -> str:
    return f"md5('42:{name}:' || {key_text(*KEY)})"


def _normal_sql(name: str, mean: float, deviation: float) -> str:
    digest = _digest_sql(name)
    return (
        f"({mean} + {deviation} * (sqrt(-2.0 * ln({_uniform_sql(digest)}))"
        f" * cos(2.0 * pi() * ({_uniform_sql(digest, 14)}))))"
    )


_DRAWN = ", ".join(
    [f'{_normal_sql(n, *moments)} AS "{n}"' for n, moments in NORMALS.items()]
    + [f'(-{s} * ln({_uniform_sql(_digest_sql(n))})) AS "{n}"' for n, s in EXPONENTIALS.items()]
)
_ROUNDED = ", ".join(f'round("{n}", 5) AS "{n}"' for n in [*NORMALS, *EXPONENTIALS])


@query(
    "synth_samples",
    f"""WITH drawn AS (
      SELECT {columns(*KEY)}, {_DRAWN},
        CASE WHEN {_uniform_sql(_digest_sql('wine_type'))} < 0.5 THEN 'red' ELSE 'white' END AS wine_type,
        {_normal_sql('noise', 0.0, 0.5)} AS noise
      FROM (SELECT DISTINCT {columns(*KEY)} FROM lineitem)
    )
    SELECT {columns(*KEY)}, {_ROUNDED}, wine_type,
      CAST(round_even(least(greatest((alcohol - 8) * 0.3 + (12 - "volatile acidity" * 10) * 0.2
        + "citric acid" * 2 * 0.1 + noise + 5.5, 3), 9), 0) AS INTEGER) AS quality
    FROM drawn""",
)
def synth_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated sample per distinct key of the table."""
    keys = table(spark, sf_dir, "lineitem").select(*KEY).distinct()
    return rounded(synthesise(keys, KEY), 5, *NORMALS, *EXPONENTIALS)


@query(
    "sink_csv_roundtrip",
    f"""WITH {SAMPLES}, {rule_cte()} SELECT {columns(*ALL_COLUMNS)}, predicted_quality, quality_category
    FROM scored""",
)
def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "scored-csv")
    scored = score_by_rule(samples(spark, sf_dir), FROM_CANONICAL, RULE_OFFSET)
    write_delimited(scored, path)
    rows = read_delimited(spark, path, scored.schema)
    return rows.toDF(*[FROM_CANONICAL.get(c, c) for c in rows.columns])


@query(
    "sink_split_roundtrip",
    f"WITH {SAMPLES}, {split_cte()} SELECT {columns(*ALL_COLUMNS)}, split FROM split",
)
def sink_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "splits-csv")
    split = stratified_split(samples(spark, sf_dir), SPEC.target, KEY)
    write_splits(split, path)
    return spark.read.csv(path, header=True, schema=split.schema)


@query("sink_json_summary", EDA_SQL)
def sink_json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "summary-json")
    table_ = dirty_samples(spark, sf_dir).drop(*KEY)
    summary = eda_summary(table_, "quality", "wine_type")
    write_summary(summary, path)
    read = read_summary(spark, path, summary.schema)
    best = F.array_join(F.transform("top_features", lambda f: f["feature"]), ",")
    return read.withColumn("top_features", best)
