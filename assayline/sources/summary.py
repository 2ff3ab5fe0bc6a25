"""JSON sink for one-row summary records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a summary (one row, nested values allowed) as JSON."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_summary(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.json(path, schema=schema)
