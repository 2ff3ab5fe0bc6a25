"""Scoring of rows that arrive over time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from assayline.functions.text import normalise_category
from assayline.operators.cleaning import validate
from assayline.operators.wide import quoted

Scorer = Callable[[DataFrame], DataFrame]


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """Stream of the files that appear in a directory."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def score_stream(
    rows: DataFrame,
    scorer: Scorer,
    sink: str,
    checkpoint: str,
    ranges: Mapping[str, tuple[float, float]],
    domains: Mapping[str, Sequence[str]] | None = None,
    names: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Validate, score and append rows; the same ``scorer`` serves batch tables.

    Rows out of range are kept with their violations and without a score. All steps are
    per row, so there is no state and no watermark; the checkpoint makes the file sink
    exactly-once across restarts.
    """
    for column in domains or {}:
        name = (names or {}).get(column, column)
        rows = rows.withColumn(name, normalise_category(quoted(name)))
    checked = validate(rows, ranges, domains, names)
    scored = scorer(checked)
    added = [c for c in scored.columns if c not in checked.columns]
    scored = scored.withColumns({c: F.when(F.col("valid"), quoted(c)) for c in added})
    return (
        scored.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(sink)
    )
