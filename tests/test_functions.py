from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.functions import (
    clamp_round,
    cut,
    guarded_ratio,
    half_width,
    interval_text,
    missing_as_null,
    normalise_category,
    quality_category,
    rule_score,
    title,
)
from assayline.functions.scores import SCORE_RANGE
from assayline import session


def values(df, column):
    return [r[column] for r in df.collect()]


def test_cut_closes_right_edges_and_optionally_the_lowest(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.0, 4.5, 6.0, 10.0, 10.5, None)], "x double")
    closed = cut(F.col("x"), [0, 4, 6, 10], ["low", "medium", "high"], include_lowest=True)
    opened = cut(F.col("x"), [0, 4, 6, 10], ["low", "medium", "high"])
    assert values(df.select(closed.alias("c")), "c") == [None, "low", "low", "medium", "medium", "high", None, None]
    assert values(df.select(opened.alias("c")), "c")[:2] == [None, None]


def test_rounding_equals_numpy_on_ties_and_near_ties(spark):
    numbers = [2.25, 2.35, 5.35, 6.949999999999999, 6.85, 0.05, 0.15, 8.75, -1.25, 3.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = values(df.select(clamp_round(F.col("x"), limits=None).alias("r")), "r")
    assert got == np.round(np.array(numbers), 1).tolist()


def test_clamp_keeps_missing_missing(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (55.0,), (4.44,)], "x double")
    assert values(df.select(clamp_round(F.col("x")).alias("r")), "r") == [None, SCORE_RANGE[0], SCORE_RANGE[1], 4.4]


def test_categories_split_at_four_and_six(spark):
    df = spark.createDataFrame([(4.0,), (4.1,), (6.0,), (6.1,), (None,)], "x double")
    got = values(df.select(quality_category(F.col("x")).alias("c")), "c")
    assert got == ["Poor", "Average", "Average", "Good", None]


def test_interval_is_clamped_and_unknown_spread_has_a_fallback(spark):
    df = spark.createDataFrame([(9.8, 0.5), (1.2, None), (None, 0.1)], "s double, d double")
    half = half_width(F.col("d"))
    got = values(df.select(interval_text(F.col("s"), half).alias("i")), "i")
    assert got == ["8.8 - 10.0", "1.0 - 1.7", None]


def test_ratio_guard_and_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -0.001)], "a double, b double")
    assert values(df.select(guarded_ratio(F.col("a"), F.col("b")).alias("r")), "r") == [1000.0, None]


def test_text_forms(spark):
    df = spark.createDataFrame([("random_forest", "  ReD ")], "a string, b string")
    row = df.select(title(F.col("a")).alias("t"), normalise_category(F.col("b")).alias("c")).first()
    assert (row.t, row.c) == ("Random Forest", "red")


def test_nan_becomes_null(spark):
    df = missing_as_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, i int"))
    assert [r["x"] for r in df.orderBy("i").collect()] == [None, 2.0]


def test_rule_score_defaults_by_absent_column_only(spark):
    df = spark.createDataFrame([(9.4, 0.56, "red"), (None, 0.56, "white")], "alcohol double, sulphates double, wine_type string")
    got = values(df.select(rule_score(df.columns).alias("s")), "s")
    assert abs(got[0] - (9.4 * 0.35 + 3.5 * 1.2 + 7 * 0.08 + 0.56 * 1.5 + 4.0)) < 1e-12
    assert got[1] is None


def test_rule_score_of_the_default_sample(spark):
    df = spark.createDataFrame([(9.4, 3.51, 7.4, 0.56, "red")], "alcohol double, pH double, `fixed acidity` double, sulphates double, wine_type string")
    assert abs(values(df.select(rule_score(df.columns).alias("s")), "s")[0] - 12.934) < 1e-9


def test_rule_noise_is_reproducible(spark):
    df = spark.range(500).withColumn("alcohol", F.lit(10.0))
    noisy = df.select("id", rule_score(df.columns, noise_seed=3, noise_key=["id"]).alias("s"))
    first = sorted(map(tuple, noisy.collect()))
    assert first == sorted(map(tuple, df.repartition(7).select("id", rule_score(df.columns, noise_seed=3, noise_key=["id"]).alias("s")).collect()))
    assert 0.2 < np.std([s for _, s in first]) < 0.4


def test_intermediate_tables_go_and_results_stay(spark):
    before = session.write_through(spark.range(3), "kept-before")
    with session.intermediates(spark) as written:
        step = session.write_through(spark.range(5), "step")
        with session.intermediates(spark) as inner:
            session.write_through(step, "inner")
        result = session.write_through(step.selectExpr("id * 2 AS id"), "result")
        paths = [*inner, *written[:-1]]
        written.pop()
    after = session.write_through(spark.range(2), "kept-after")
    assert len(paths) == 3 and not any(Path(p).exists() for p in paths)
    assert (before.count(), result.count(), after.count()) == (3, 5, 2)
    with pytest.raises(ValueError):
        with session.intermediates(spark) as written:
            session.write_through(spark.range(1), "of-a-failure")
            raise ValueError
    assert Path(written[0]).exists()
