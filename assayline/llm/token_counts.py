"""Token counts through a digest cache.

A text's content is normalised (runs of ASCII white space become one blank, outer ones go),
which no count depends on, and digested. Digests are joined to a table of stored counts for
the same tokenizer version; only distinct contents without a count are encoded, and their
counts are appended to the table.

Defined results: NULL text is an empty text with 0 bytes and 0 tokens; equal rows give equal
results, once per row; texts of any length are counted whole, and an empty table gives an empty one; the first use finds
an empty cache. Extra columns pass through, whatever their names; the count takes the place of a column of its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.columns import given_back, number_of, numbered
from assayline.llm.tokenizer import WordEncoder
from assayline.llm.workers import held, small_batches
from assayline.session import write_through

CHUNK = 256
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def version(definition: str) -> str:
    """Digest of a tokenizer definition: counts of another version are never used."""
    return hashlib.sha256(definition.encode()).hexdigest()


def stored_counts(df: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; one row per digest.

    Appending the same count twice, as two runs at a time may, does no harm.
    """
    spark = df.sparkSession
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE_SCHEMA)
    return table.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, definition: str, cache: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add column ``out`` with the number of tokens of ``text``; fills ``cache`` on the way.

    ``cache`` is the path of a Parquet table in storage that all executors share. Counting
    misses is a job of its own, ended by the append, before the counts are joined back.
    """
    spark = df.sparkSession
    name = version(definition)
    WordEncoder(definition)
    shared = spark.sparkContext.broadcast(definition)
    content = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    digested = df.select(content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    # One text per digest leaves each task; the stored side is joined in the same partitioning.
    distinct = digested.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(stored_counts(df, cache, name), "digest", "left_anti")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("words", name), lambda: WordEncoder(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                counts = [len(ids) // encoder.width for ids in encoder.encode_many(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * part.num_rows), part.column(0), pa.array(counts, pa.int64())],
                    names=["tokenizer", "digest", "n_tokens"],
                )

    with small_batches(spark):
        misses.mapInArrow(counted, CACHE_SCHEMA).write.mode("append").parquet(cache)
    source, own = numbered(df), F.col(number_of(df, text))
    key = F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(own, F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), 256))
    # A plain table on this side lets Spark split the join at a digest that very many rows have.
    counts = write_through(stored_counts(df, cache, name), "counts").withColumnRenamed("digest", "digest_")
    joined = source.withColumn("digest", key).join(counts, F.col("digest") == F.col("digest_"), "left")
    return given_back(joined, df.columns, {out: "n_tokens"})
