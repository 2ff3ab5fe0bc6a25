"""Feature columns: target separation, label codes, schema alignment, standardisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.operators.wide import identifier, number, per_column, quoted
from assayline.session import lookup_join, write_through


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


@dataclass(frozen=True)
class Labels:
    """Codes 0..k-1 of the sorted labels, as a written ``(label, code)`` table.

    The planner knows its size and broadcasts it where it is small; a vocabulary of any size
    is used in the same way.
    """

    table: DataFrame | None = None

    def encode(self, df: DataFrame, column: str, unseen: int = 0) -> DataFrame:
        """Replace ``column`` by its code; NULL and labels not seen at fit get ``unseen``."""
        if self.table is None:
            return df.withColumn(column, F.lit(unseen))
        names = df.columns
        joined = df.join(self.table.select(F.col("label").alias("__label"), F.col("code").alias("__code_of")), quoted(column) == F.col("__label"), "left")
        code = F.coalesce("__code_of", F.lit(unseen)).cast("int").alias(column)
        return joined.select(*[code if c == column else quoted(c) for c in names])


def fit_labels(df: DataFrame, column: str) -> Labels:
    """Learn label codes; a vocabulary of any size is numbered without one global sort task."""
    labels = df.where(quoted(column).isNotNull()).select(quoted(column).alias("label")).distinct()
    numbered = number_sorted(labels, "label", "code").withColumn("code", F.col("code").cast("int"))
    return Labels(write_through(numbered, "label-codes"))


def number_sorted(df: DataFrame, column: str, number: str) -> DataFrame:
    """Number distinct values 0.. in sorted order, one range of values per task.

    The ranges are fixed in a written table first, so that offsets and positions refer
    to the same ones even if tasks are rerun.
    """
    ranged = df.repartitionByRange(column).withColumn("range_id", F.spark_partition_id())
    ranged = write_through(ranged, "labels")
    sizes = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("size"))
    running = Window.partitionBy().orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range_id", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("before"))
    offsets = write_through(offsets, "label-offsets")
    inside = Window.partitionBy("range_id").orderBy(column)
    numbered = ranged.withColumn("position", F.row_number().over(inside)).join(offsets, "range_id")
    return numbered.select(column, (F.col("before") + F.col("position") - 1).alias(number))


def align_schema(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Exactly ``columns`` in that order: absent ones become ``default``, others are dropped."""
    return df.select(
        *[quoted(c) if c in df.columns else F.lit(default).cast(T.DoubleType()).alias(c) for c in columns]
    )


def schema_differences(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    return {
        "missing": [c for c in columns if c not in df.columns],
        "extra": [c for c in df.columns if c not in columns],
    }


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one pass; a zero deviation becomes 1."""
    rows = per_column(
        df,
        columns,
        lambda c: {
            "mean": f"avg(CAST({identifier(c)} AS DOUBLE))",
            "deviation": f"stddev_pop(CAST({identifier(c)} AS DOUBLE))",
        },
    ).collect()
    return {r["feature"]: (r["mean"] or 0.0, r["deviation"] or 1.0) for r in rows}


def scale(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``(x - mean) / deviation``; a narrow projection with constants."""
    return df.withColumns(
        {c: F.expr(f"({identifier(c)} - {number(m)}) / {number(s)}") for c, (m, s) in scaler.items()}
    )
