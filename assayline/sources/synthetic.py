"""Synthetic samples with a known signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.randomness import hash_exponential, hash_normal, hash_uniform, key_digest

# Distribution of each measurement.
NORMALS = {
    "fixed acidity": (7.5, 1.5),
    "volatile acidity": (0.5, 0.2),
    "citric acid": (0.3, 0.2),
    "chlorides": (0.08, 0.03),
    "free sulfur dioxide": (30.0, 15.0),
    "total sulfur dioxide": (100.0, 40.0),
    "density": (0.996, 0.003),
    "pH": (3.3, 0.3),
    "sulphates": (0.6, 0.2),
    "alcohol": (10.5, 1.5),
}
EXPONENTIALS = {"residual sugar": 3.0}
CATEGORIES = ("red", "white")
# What the target takes from alcohol, volatile acidity and citric acid.
ALCOHOL_BASE, ALCOHOL_WEIGHT = 8.0, 0.3
ACIDITY_BASE, ACIDITY_SCALE, ACIDITY_WEIGHT = 12.0, 10.0, 0.2
CITRIC_SCALE, CITRIC_WEIGHT = 2.0, 0.1
# Intercept, noise deviation and limits of the target.
TARGET_INTERCEPT = 5.5
TARGET_NOISE = 0.5
TARGET_LIMITS = (3.0, 9.0)
# Columns that are drawn in one step, and a number of partitions that no table has.
STEP = 7
NO_FEWER = 1 << 24
NOISE = "__noise"


def synthesise(keys: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """One synthetic sample per row of ``keys``, drawn from a digest of its key.

    The draws do not depend on partitioning, so a rerun task yields the same rows. Columns are drawn a few at a time:
    the code of one projection of all of them is a method beyond the 8,000 bytes up to which the JVM compiles any, and is interpreted.
    A ``coalesce`` that joins no partitions stands between, since neighbouring projections become one.
    """
    ids = [F.col(f"`{k}`") for k in key]

    def digest(name: str):
        return key_digest(f"{seed}:{name}", *ids)

    measures = {n: hash_normal(digest(n), *moments) for n, moments in NORMALS.items()}
    measures |= {n: hash_exponential(digest(n), scale) for n, scale in EXPONENTIALS.items()}
    measures["wine_type"] = F.when(hash_uniform(digest("wine_type")) < 0.5, CATEGORIES[0]).otherwise(
        CATEGORIES[1]
    )
    measures[NOISE] = hash_normal(digest("noise"), 0.0, TARGET_NOISE)
    drawn, names = keys.select(*ids), list(measures)
    for first in range(0, len(names), STEP):
        drawn = drawn.withColumns({n: measures[n] for n in names[first : first + STEP]}).coalesce(NO_FEWER)
    signal = (
        (F.col("alcohol") - ALCOHOL_BASE) * ALCOHOL_WEIGHT
        + (ACIDITY_BASE - F.col("volatile acidity") * ACIDITY_SCALE) * ACIDITY_WEIGHT
        + F.col("citric acid") * CITRIC_SCALE * CITRIC_WEIGHT
        + F.col(NOISE)
        + TARGET_INTERCEPT
    )
    low, high = TARGET_LIMITS
    target = F.rint(F.least(F.greatest(signal, F.lit(low)), F.lit(high))).cast("int")
    return drawn.withColumn("quality", target).drop(NOISE)


def synthetic_samples(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return synthesise(spark.range(n).withColumnRenamed("id", "sample_id"), ["sample_id"], seed)
