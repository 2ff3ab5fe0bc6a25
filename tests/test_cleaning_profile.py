from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayline.operators import profile
from assayline.operators.cleaning import (
    cleaning_report,
    drop_duplicates,
    duplicate_count,
    impute_median,
    missing_counts,
    validate,
)
from assayline.operators.outliers import fit_fences, outlier_report, treat_outliers
from assayline.operators.relations import correlation_matrix, crosstab, top_correlated, trend_line

NAN = float("nan")


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1.0, 1, "a"), (2.0, 2, "a"), (3.0, None, "b"), (10.0, 9, None), (None, 4, "b"), (NAN, 5, "b"), (2.0, 2, "a")]
    return spark.createDataFrame(rows, "x double, i int, c string")


def test_missing_counts_count_nan(small):
    assert {r.feature: r.missing for r in missing_counts(small).collect()} == {"x": 2, "i": 1, "c": 1}


def test_median_is_interpolated_over_present_values(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (3.0, 4), (10.0, 9), (None, None)], "x double, i int")
    row = impute_median(df).where("i = 3").first()
    assert row is not None and row.x == 2.5


def test_fractional_median_of_whole_numbers_widens_the_column(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    assert sorted(r.i for r in impute_median(df).collect()) == [1.0, 1.5, 2.0]


def test_duplicates(small):
    row = duplicate_count(small).first()
    assert (row.rows, row.distinct_rows, row.duplicates) == (7, 6, 1)
    assert drop_duplicates(small).count() == 6
    report = cleaning_report(small, ["x", "i"]).first()
    assert (report.cells_filled, report.rows_before, report.rows_removed) == (3, 7, 1)


def test_duplicates_of_an_empty_table(spark):
    row = duplicate_count(spark.createDataFrame([], "x double")).first()
    assert (row.rows, row.distinct_rows, row.duplicates) == (0, 0, 0)


def test_validation_names_every_violation(small):
    checked = validate(small, {"x": (0.0, 5.0), "i": (1, 4)}, {"c": ("a", "b")})
    assert [r.violations for r in checked.collect()] == ["", "", "i", "x,i,c", "x", "x,i", ""]


def test_describe_equals_pandas(spark):
    random = np.random.default_rng(5)
    frame = pd.DataFrame({"a": random.normal(size=501), "b": random.integers(0, 9, 501).astype(float)})
    frame.loc[::7, "a"] = None
    want = frame.describe()
    got = {r.feature: r for r in profile.describe_numeric(spark.createDataFrame(frame)).collect()}
    for c in ("a", "b"):
        r = got[c]
        mine = [r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]]
        assert np.allclose(mine, want[c].to_numpy(), rtol=1e-12)


def test_outlier_policies(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(20), 500]] + [(None,)], "x double")
    fences = fit_fences(df, ["x"])
    assert outlier_report(df, ["x"], fences).first().outliers == 1
    assert [r.x for r in treat_outliers(df, ["x"], "select", fences).collect()] == [500.0]
    assert treat_outliers(df, ["x"], "drop", fences).count() == 21
    assert treat_outliers(df, ["x"], "clip", fences).agg(F.max("x")).first()[0] == fences["x"][1]
    with pytest.raises(ValueError):
        treat_outliers(df, ["x"], "other", fences)


def test_correlation_equals_pandas_with_pairwise_gaps(spark):
    random = np.random.default_rng(6)
    frame = pd.DataFrame(random.normal(size=(400, 4)) + 1e6, columns=list("abcd"))
    frame["b"] += frame["a"]
    frame.loc[::3, "a"] = None
    frame.loc[::5, "c"] = None
    frame["e"] = 0.1
    want = frame.corr()
    got = correlation_matrix(spark.createDataFrame(frame).repartition(3), list("abcde"))
    for r in got.collect():
        expected = want.loc[r.feature_x, r.feature_y]
        if "e" in (r.feature_x, r.feature_y):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(expected, abs=1e-9)
    lower = correlation_matrix(spark.createDataFrame(frame), list("abc"), lower_only=True)
    assert sorted((r.feature_x, r.feature_y) for r in lower.collect()) == [("b", "a"), ("c", "a"), ("c", "b")]


def test_top_correlated_excludes_the_target_and_breaks_ties_by_name(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("y"), (-F.col("id") * 2.0).alias("b"), (F.col("id") * 3.0).alias("a")
    )
    assert [r.feature for r in top_correlated(df, ["y", "b", "a"], "y").orderBy("rank").collect()] == ["a", "b"]


def test_crosstab_fills_absent_cells(spark):
    df = spark.createDataFrame([("r", 3), ("r", 3), ("w", 5)], "t string, q int")
    got = {r["t"]: (r["3"], r["4"], r["5"]) for r in crosstab(df, "t", "q", [3, 4, 5]).collect()}
    assert got == {"r": (2, 0, 0), "w": (0, 0, 1)}


def test_histogram_equals_numpy(spark):
    random = np.random.default_rng(8)
    numbers = random.normal(size=3000).round(3)
    counts, edges = np.histogram(numbers, bins=20)
    got = profile.histogram(spark.createDataFrame([(float(x),) for x in numbers], "x double"), "x").collect()
    assert sum(r["count"] for r in got) == 3000
    assert [r["count"] for r in got] == counts.tolist()
    assert np.allclose([r.lower for r in got], edges[:-1])


def test_histogram_of_a_constant(spark):
    got = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x").collect()
    assert sum(r["count"] for r in got) == 2 and got[0].lower == 1.5


def test_box_whiskers_end_at_data_points(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 5, 100]], "g string, v double")
    box = profile.box_stats(df, "v", ["g"]).first()
    assert (box.whisker_low, box.whisker_high, box.outliers) == (1.0, 5.0, 1)


def test_trend_line(spark):
    df = spark.range(10).select(F.col("id").alias("x"), (F.col("id") * 2 + 1).alias("y"))
    line = trend_line(df, ["x"], "y").first()
    assert line.slope == pytest.approx(2.0) and line.intercept == pytest.approx(1.0)


def test_value_counts_orders(small):
    assert [(r["c"], r["count"]) for r in profile.value_counts(small, "c", by_frequency=True).collect()] == [("a", 3), ("b", 3)]


def test_summary_is_one_typed_row(small):
    row = profile.eda_summary(small, "i", "c").first()
    assert (row.n_rows, row.n_columns, row.missing_values, row.duplicates) == (7, 3, 4, 1)
    assert [f.feature for f in row.top_features] == ["x"]


def test_nan_is_missing_everywhere(spark):
    from assayline.operators import cleaning, evaluate, outliers, profile

    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (nan, 2.0), (3.0, nan), (None, 4.0)], "v double, p double")
    info = {r["feature"]: r["non_null"] for r in profile.table_info(df).collect()}
    assert info == {"v": 2, "p": 3}
    assert [(r["v"], r["count"]) for r in profile.value_counts(df, "v").collect()] == [(1.0, 1), (3.0, 1)]
    clipped = outliers.treat_outliers(df, ["v"], "clip", {"v": (0.0, 2.0)})
    assert [r["v"] for r in clipped.where("v is not null and not isnan(v)").collect()] == [1.0, 2.0]
    metrics = evaluate.regression_metrics(df, "v", "p").first()
    assert metrics["n"] == 1 and metrics["mse"] == 0.0
    assert cleaning.missing_counts(df, ["v"]).first()["missing"] == 2


def test_duplicates_are_told_by_digests(spark):
    from assayline.operators.cleaning import duplicate_count

    rows = [("a", None, 0.0), ("a", None, -0.0), ("a|", "b", 1.0), ("a", "|b", 1.0), (None, "a", float("nan")), (None, "a", float("nan")), ("", None, None), (None, "", None)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert duplicate_count(df).first().asDict() == {"rows": 8, "distinct_rows": df.distinct().count(), "duplicates": 8 - df.distinct().count()}
    plan = duplicate_count(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" in plan


def test_share_needs_no_single_task(spark):
    from assayline.operators.profile import category_share

    shares = category_share(spark.range(1000).selectExpr("id % 7 AS c"), "c")
    assert abs(sum(r["percentage"] for r in shares.collect()) - 100) < 1e-9
    assert "SinglePartition" not in shares._jdf.queryExecution().executedPlan().toString()
