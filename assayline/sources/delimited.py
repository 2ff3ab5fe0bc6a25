"""Delimited text scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.functions.numeric import missing_as_null
from assayline.sources.names import ALIASES, canonical_names

# Text of a malformed line, NULL for a sound one.
REJECT = "malformed_line"
FILE_ROWS = 2_000_000
_MODES = {"keep": "PERMISSIVE", "fail": "FAILFAST", "drop": "DROPMALFORMED"}


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    sep: str = ",",
    malformed: str = "fail",
) -> DataFrame:
    """Scan delimited files with a header, by column *name*.

    Spark would match a given schema to the file by position. Here the header decides
    the order, each name takes its type and its spelling from ``schema``, and
    columns unknown to the schema stay text. Without a schema the types are inferred,
    which costs one more scan. Empty cells and NaN arrive as NULL.

    With a schema a line may hold text where a number should be. ``malformed`` says what
    becomes of it: ``fail`` raises; ``keep`` adds the text column ``malformed_line``, which holds
    the line and is NULL for a sound one; ``drop`` leaves such lines out. See ``rejects``.
    """
    if malformed not in _MODES:
        raise ValueError(f"unknown choice {malformed!r}, expected one of {tuple(_MODES)}")
    options = {"header": True, "sep": sep}
    if schema is None:
        return missing_as_null(canonical_names(spark.read.csv(path, inferSchema=True, **options)))
    types = {f.name: f.dataType for f in schema.fields}
    # A name of the schema in whatever spelling a header may use for it.
    spelled = {ALIASES.get(n, n): n for n in types} | {n: n for n in types}
    header = spark.read.csv(path, **options).columns
    names = {h: spelled.get(h, spelled.get(ALIASES.get(h, h))) for h in header}
    by_header = T.StructType([T.StructField(h, types[n] if n else T.StringType()) for h, n in names.items()])
    if malformed == "keep":
        by_header = by_header.add(REJECT, T.StringType())
        options["columnNameOfCorruptRecord"] = REJECT
    # enforceSchema=False: a file whose header deviates raises instead of shifting columns.
    scan = spark.read.csv(path, schema=by_header, enforceSchema=False, mode=_MODES[malformed], **options)
    return missing_as_null(canonical_names(scan, {h: n or ALIASES.get(h, h) for h, n in names.items()}))


def rejects(rows: DataFrame) -> DataFrame:
    """The malformed lines of a scan that kept them, as one text column."""
    # A scan parses only the columns that are used, so all of them take part in the filter.
    touched = F.hash(*[F.col(f"`{c}`") for c in rows.columns if c != REJECT]) >= -(2**31)
    return rows.where(F.col(REJECT).isNotNull() & touched).select(REJECT)


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", compression: str | None = None) -> None:
    """Write a directory of delimited part files, each with a header.

    ``compression`` names a codec of Spark's, such as ``gzip``. One task reads such a file from end to end, so a file then holds
    no more than ``FILE_ROWS`` rows.
    """
    options = {"compression": compression, "maxRecordsPerFile": FILE_ROWS} if compression else {}
    df.write.mode(mode).options(**options).csv(path, header=True, sep=sep)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """Write one delimited directory per split in a single pass."""
    df.write.mode(mode).partitionBy(split).csv(path, header=True)
