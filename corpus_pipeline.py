"""Preparing a corpus for training: five stages from raw documents to token ids.

1. quality classifier: documents below the limit of the learnt score go
2. n-gram Jaccard join: of each group of near duplicates the smallest id stays
3. secret scans: secrets in the kept texts are redacted
4. mixing sources: each document is repeated as its source's weight asks; none is lost
5. BPE encoding: token ids, checked by decoding them

All stages but the last return the columns of the documents. Each is judged on its input as
it is: statistics, models and weights are those of the rows that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import bpe, jaccard, mixing, quality_classifier, secrets
from assayline.llm.workers import small_batches
from assayline.session import intermediates, write_through

TOKENIZER = "byte_bpe_50k.json"
MOST_PASSES = 2.0

# The classifier is trained and the model of text is iterative, which SQL cannot express.
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, width=5, numerator=80, denominator=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(mixing.mix(docs, mixing.Target(repetition=MOST_PASSES)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, exact); ids are packed little-endian unsigned 32-bit integers.

    ``exact`` says that decoding gives the text again, as it must.
    """
    definition = bpe.read_definition(public_tokenizers.path(TOKENIZER))
    rows = docs.select("doc_id", "lang", "source", "text").withColumn("expected", F.sha2(F.coalesce("text", F.lit("")), 256))
    # Written between, so that no task keeps two workers busy at once.
    encoded = write_through(bpe.encode(rows, definition).drop("text"), "packed-ids")
    decoded = bpe.decode(encoded, definition)
    return decoded.select(
        "doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("expected")).alias("exact"),
    )


STAGES = [
    ("quality classifier", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
    ("token ids", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's intermediate tables go when its result is written, and the result of the stage before with them.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    with small_batches(spark):
        for name, stage in STAGES:
            with intermediates(spark) as written:
                docs = write_through(stage(spark, docs, sf_dir), name.replace(" ", "-"))
                result = written.pop()
                written += last
            last = [result]
    return docs
