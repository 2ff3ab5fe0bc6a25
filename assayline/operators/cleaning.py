"""Missing values, duplicates, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.operators.quantiles import exact_quantiles
from assayline.operators.wide import identifier, number, numeric_columns, per_column, quoted, text
from assayline.session import write_through

_FLOATING = (T.DoubleType, T.FloatType)


def is_missing(kind: T.DataType, name: str) -> str:
    """Test for NULL or NaN as SQL text."""
    test = f"{identifier(name)} IS NULL"
    return f"({test} OR isnan({identifier(name)}))" if isinstance(kind, _FLOATING) else test


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(feature, missing, rows)``, one per column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return per_column(
        df,
        columns or df.columns,
        lambda c: {"missing": f"count_if({is_missing(kinds[c], c)})", "rows": "count(1)"},
    )


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column (one number per column reaches the driver)."""
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {r["feature"]: r["q0"] for r in rows}


def fill_missing(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Replace NULL and NaN by a constant per column; a narrow projection."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    filled = {}
    for name, value in values.items():
        kind = kinds[name]
        # A median of whole numbers may be fractional, so integer columns turn into doubles
        # only where they have to.
        if isinstance(kind, T.IntegralType) and not float(value).is_integer():
            kind = T.DoubleType()
        choice = f"CASE WHEN {is_missing(kinds[name], name)} THEN {number(value)} ELSE {identifier(name)} END"
        filled[name] = F.expr(f"CAST({choice} AS {kind.simpleString()})")
    return df.withColumns(filled) if filled else df


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill numeric columns with the medians of this very table."""
    return fill_missing(df, fit_medians(df, columns or numeric_columns(df)))


def row_digest(df: DataFrame) -> Column:
    """256-bit digest of all columns; NULL is a value, and lengths keep columns apart.

    Floating zeros of either sign are equal, as they are to Spark's grouping.
    """
    parts = []
    for f in df.schema.fields:
        value = quoted(f.name)
        if isinstance(f.dataType, _FLOATING):
            value = value + F.lit(0.0)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("N")))
    return F.sha2(F.concat_ws(";", *parts), 256)


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row ``(rows, distinct_rows, duplicates)``.

    Only digests of rows are shuffled, so long texts stay where they are. Equal rows are
    counted on the map side first: however often one row repeats, a task sends it once.
    """
    return (
        df.select(F.unhex(row_digest(df)).alias("digest")).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("distinct_rows"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        )
    )


def drop_duplicates(df: DataFrame, by_digest: bool = False) -> DataFrame:
    """Keep one of the rows that are equal in every column (NULLs compare equal).

    Whole rows are shuffled, dealt out by a hash of all their columns before they are compared: a task that reads a table
    holds none of them, however many it reads, and copies of one row, however many, pass a single place of their task.
    That is too much for wide rows, as with texts, most of which occur once: ``by_digest``
    shuffles the digests of all rows first, and then whole rows only among those whose digest is repeated.
    The table of repeated digests is written, so the planner knows its size: it is broadcast where it is
    small, and tasks that read the table leave the other rows where they are.
    """
    if not by_digest:
        if any("map<" in f.dataType.simpleString() for f in df.schema.fields):
            return df.dropDuplicates()  # maps have no hash
        rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        return rows.repartition(*rows.columns).dropDuplicates().toDF(*df.columns)
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    rows = rows.withColumn("digest", F.unhex(row_digest(rows)))
    counts = rows.select("digest").groupBy("digest").count()
    repeated = write_through(counts.where("count > 1").select(F.col("digest").alias("repeated")), "repeated-digests")
    again = rows.join(repeated, F.col("digest") == F.col("repeated"), "left_semi").drop("digest").dropDuplicates()
    once = rows.join(repeated, F.col("digest") == F.col("repeated"), "left_anti").drop("digest")
    return once.unionByName(again).toDF(*df.columns)


def cleaning_report(df: DataFrame, fill_columns: Sequence[str] | None = None) -> DataFrame:
    """One row: missing cells filled, rows before, after and removed by cleaning."""
    columns = fill_columns or numeric_columns(df)
    cells = missing_counts(df, columns).agg(F.sum("missing").alias("filled"))
    counts = duplicate_count(impute_median(df, columns))
    # Two one-row aggregates side by side, brought together by one more aggregate.
    parts = cells.unionByName(counts, allowMissingColumns=True)
    return parts.agg(
        F.max("filled").alias("cells_filled"),
        F.max("rows").alias("rows_before"),
        F.max("distinct_rows").alias("rows_after"),
        F.max("duplicates").alias("rows_removed"),
    )


def violations(
    ranges: Mapping[str, tuple[float, float]],
    domains: Mapping[str, Sequence[str]] | None = None,
    names: Mapping[str, str] | None = None,
) -> Column:
    """Comma-joined names of the columns out of range or domain (missing counts as out)."""
    names = names or {}
    accepted = {
        name: f"{identifier(names.get(name, name))} BETWEEN {number(low)} AND {number(high)}"
        for name, (low, high) in ranges.items()
    }
    for name, allowed in (domains or {}).items():
        accepted[name] = f"{identifier(names.get(name, name))} IN ({', '.join(text(a) for a in allowed)})"
    tests = [f"CASE WHEN coalesce({test}, false) THEN NULL ELSE {text(n)} END" for n, test in accepted.items()]
    return F.expr(f"concat_ws(',', {', '.join(tests)})")


def validate(df: DataFrame, ranges, domains=None, names=None) -> DataFrame:
    """Add ``violations`` (empty text for a valid row) and ``valid``."""
    checked = df.withColumn("violations", violations(ranges, domains, names))
    return checked.withColumn("valid", F.col("violations") == "")
