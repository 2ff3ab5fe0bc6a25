"""Correlation with gaps from one scan of products, and metrics of rows with missing values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from assayline.operators import evaluate, relations


def gapped(columns, rows, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, columns)) + rng.normal(size=(rows, 1)) * 2 + rng.uniform(-1e7, 1e7, columns)
    base[rng.random(base.shape) < 0.15] = np.nan
    return pd.DataFrame(base, columns=[f"c {i}" for i in range(columns)])


def test_sixty_gapped_columns_take_one_scan_of_products(spark, monkeypatch):
    frame = gapped(60, 300, 1)
    calls = []
    plain = relations.product_sums
    monkeypatch.setattr(relations, "product_sums", lambda df, cells: (calls.append(len(cells)), plain(df, cells))[1])
    found = relations.correlation_matrix(spark.createDataFrame(frame).repartition(3), list(frame.columns))
    want = frame.corr()
    rows = found.collect()
    assert len(rows) == 3600 and calls == [1 + 3 * 60]
    for r in rows:
        assert r["corr"] == pytest.approx(want.loc[r["feature_x"], r["feature_y"]], abs=1e-7)


def test_columns_that_do_not_vary_where_both_are_present(spark):
    rows = [(1.0, 5.0, 1.0, 7.0), (2.0, None, 2.0, 7.0), (3.0, 5.0, None, 7.0), (4.0, 5.0, None, 7.0), (None, 9.0, 4.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["feature_x"], r["feature_y"]): r["corr"] for r in relations.correlation_matrix(df, list("abcd")).collect()}
    # b is 5 wherever a is present, d is constant, and a and c share two rows.
    assert got["a", "b"] is None and got["d", "d"] is None and got["a", "d"] is None
    assert got["a", "c"] == pytest.approx(1.0) and got["c", "a"] == pytest.approx(1.0) and got["b", "b"] == 1.0
    assert relations.correlation_matrix(df.limit(0), ["a", "b"]).where("corr IS NOT NULL").count() == 0


def test_missing_values_take_no_part_in_any_metric(spark):
    nan = float("nan")
    df = spark.createDataFrame([(5.0, 5.2), (6.0, nan), (nan, 4.0), (None, 1.0), (7.0, 8.2)], "y double, p double")
    shares = {r["tolerance"]: r["percentage"] for r in evaluate.tolerance_accuracy(df, "y", "p").collect()}
    assert shares == {0.5: 50.0, 1.0: 50.0, 1.5: 100.0}
    row = evaluate.prediction_ranges(df, "y", "p").first()
    assert (row["actual_max"], row["predicted_max"], row["predicted_min"]) == (7.0, 8.2, 1.0)
    assert row["actual_mean"] == 6.0 and row["predicted_mean"] == pytest.approx(4.6)
    empty = evaluate.tolerance_accuracy(df.limit(0), "y", "p").collect()
    assert {r["percentage"] for r in empty} == {None}
