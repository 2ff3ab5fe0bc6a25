"""Penalised linear models from centred sums of products, against numpy and on columns far from 0."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from assayline.models import MODELS, PenalisedRegression, gram, load_models, predict, save_models, train_all, training
from assayline.models.gram import fold_sums
from assayline.models.training import cross_validate, grid_points
from assayline.operators.comoments import product_sums
from assayline.session import fresh_path


def vectors(spark, x, y, folds=3):
    rows = [([float(v) for v in r], float(t), i % folds) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "x array<double>, quality double, fold int").repartition(4)
    return frame.withColumn("features", array_to_vector("x")).withColumn("split", F.lit("train"))


def ridge_by_hand(x, y, alpha):
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    return w, y.mean() - x.mean(axis=0) @ w


def test_product_sums_of_rows_and_of_none(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, -1.0)], "a double, b double")
    assert product_sums(df, ["a", "b", "1"]).tolist() == [[10.0, -1.0, 4.0], [-1.0, 5.0, 1.0], [4.0, 1.0, 2.0]]
    assert product_sums(df.limit(0), ["a", "b"]).tolist() == [[0.0, 0.0], [0.0, 0.0]]


@pytest.mark.parametrize("one_scan", [True, False])
def test_columns_with_a_large_mean_lose_nothing(spark, one_scan):
    x = np.array([[1e9 + i % 10] for i in range(3000)])
    rows = vectors(spark, x, x[:, 0] - 1e9)
    errors = cross_validate(rows, MODELS["ridge"].build(1), [{"alpha": 1.0}], "quality", one_scan=one_scan)[0]
    assert max(errors) < 1e-6
    estimator = PenalisedRegression(alpha=1.0, summed_loss=True, labelCol="quality", solver="sums" if one_scan else "iterative")
    model = estimator.fit(rows)
    worst = model.transform(rows).agg(F.max(F.abs(F.col("prediction") - F.col("quality")))).first()[0]
    assert worst < 1e-3 and abs(model.coefficients[0] - 1) < 1e-3


def test_fits_and_errors_equal_numpy_at_full_width(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 11)) * rng.uniform(0.1, 100, 11) + rng.uniform(-1e4, 1e4, 11)
    x[:, 4] = x[:, 3] * 2  # collinear
    y = x[:, 0] / 50 + np.round(rng.normal(size=400), 2)
    rows = vectors(spark, x, y)
    for alpha in (0.1, 100.0):
        model = PenalisedRegression(alpha=alpha, summed_loss=True, labelCol="quality").fit(rows)
        assert isinstance(model, LinearRegressionModel)
        w, b = ridge_by_hand(x, y, alpha)
        assert np.allclose(model.coefficients.toArray(), w, rtol=1e-6, atol=1e-9) and np.isclose(model.intercept, b, rtol=1e-8)
    points = grid_points(MODELS["ridge"].grid)
    found = cross_validate(rows, MODELS["ridge"].build(1), points, "quality")
    fold = np.arange(400) % 3
    for p, errors in zip(points, found, strict=True):
        for held, error in enumerate(errors):
            w, b = ridge_by_hand(x[fold != held], y[fold != held], p["alpha"])
            assert np.isclose(error, np.mean((y[fold == held] - x[fold == held] @ w - b) ** 2), rtol=1e-8)


@pytest.mark.parametrize(("model", "share"), [("lasso", 1.0), ("elastic_net", 0.5)])
def test_absolute_penalties_reach_their_optimum(spark, model, share):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) + 50
    y = 2 * x[:, 1] - x[:, 2] + rng.normal(size=300)
    rows = vectors(spark, x, y)
    for alpha in (0.01, 0.5):
        fitted = PenalisedRegression(alpha=alpha, l1_share=share, labelCol="quality").fit(rows)
        other = PenalisedRegression(alpha=alpha, l1_share=share, labelCol="quality", solver="iterative").fit(rows)
        w = fitted.coefficients.toArray()
        assert np.allclose(w, other.coefficients.toArray(), atol=1e-4)
        slope = ((y - x @ w - fitted.intercept)[:, None] * x).mean(axis=0) - alpha * (1 - share) * w
        assert np.allclose(slope[w != 0], alpha * share * np.sign(w[w != 0]), atol=1e-8)
        assert (np.abs(slope[w == 0]) <= alpha * share + 1e-8).all()


def test_sums_of_folds_missing_labels_and_other_folds(spark):
    rows = [([1.0, 2.0], 1.0, 0), ([2.0, 1.0], 3.0, 1), ([4.0, 4.0], 5.0, 7), ([4.0, 4.0], 6.0, -1), ([9.0, 9.0], None, 0), ([8.0, 8.0], 2.0, None)]
    frame = spark.createDataFrame(rows, "x array<double>, y double, fold int").withColumn("features", array_to_vector("x"))
    assert [s.n for s in fold_sums(frame, "y", "fold", 2)] == [1.0, 1.0, 2.0]
    assert [s.n for s in fold_sums(frame, "y", None, 1)] == [5.0]
    assert fold_sums(frame.limit(0), "y", "fold", 2) == []
    with pytest.raises(ValueError, match="fold 0"):
        cross_validate(frame.where("fold <> 0"), MODELS["ridge"].build(1), [{}], "y", folds=2)
    with pytest.raises(ValueError, match="no labelled rows"):
        PenalisedRegression(labelCol="y").fit(frame.where("y IS NULL"))


def test_models_from_sums_can_be_saved_and_loaded(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    rows = vectors(spark, x, x @ [1.0, 2.0, 3.0] + rng.normal(size=200))
    rows = rows.withColumn("split", F.when(F.rand(1) < 0.3, "val").otherwise("train"))
    trained = train_all(rows, "quality", ["ridge", "lasso"], tune=True)
    path = fresh_path(spark, "models")
    save_models(trained, spark, path)
    loaded = load_models(spark, path)
    for name in ("ridge", "lasso"):
        one, other = (predict(rows, t, name).agg(F.sum("prediction")).first()[0] for t in (trained, loaded))
        assert one == other


def test_search_and_last_fit_share_their_sums(spark, monkeypatch):
    from assayline.models import gram, train_one

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3)) + 1e5
    rows = vectors(spark, x, x[:, 0] + rng.normal(size=200))
    calls = []
    plain = gram.product_sums
    monkeypatch.setattr(gram, "product_sums", lambda df, cells: (calls.append(1), plain(df, cells))[1])
    entry = train_one(rows, "ridge", "quality")
    assert len(calls) == 1
    alone = PenalisedRegression(alpha=entry.best_params["alpha"], summed_loss=True, labelCol="quality").fit(rows)
    assert np.allclose(entry.model.coefficients.toArray(), alone.coefficients.toArray(), rtol=1e-9) and np.isclose(entry.model.intercept, alone.intercept, rtol=1e-9)
    # Rows of no fold belong to the last fit alone.
    loose = rows.withColumn("fold", F.when(F.col("fold") < 2, F.col("fold")))
    calls.clear()
    other = train_one(loose, "ridge", "quality", folds=2)
    assert len(calls) == 2
    again = PenalisedRegression(alpha=other.best_params["alpha"], summed_loss=True, labelCol="quality").fit(loose)
    assert np.allclose(other.model.coefficients.toArray(), again.coefficients.toArray(), rtol=1e-9)


def test_linear_models_of_one_table_share_their_sums(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [([float(v) for v in rng.normal(size=3)], float(rng.normal()), i % 3, "train" if i % 5 else "val") for i in range(200)]
    frame = spark.createDataFrame(rows, "x array<double>, y double, fold int, split string").withColumn("features", array_to_vector("x"))
    taken = []
    monkeypatch.setattr(training, "fold_sums", lambda *a: taken.append(1) or gram.fold_sums(*a))
    shared = train_all(frame, "y", ["ridge", "lasso", "elastic_net"])
    assert len(taken) == 1
    for name, entry in shared.models.items():
        alone = training.train_one(frame, name, "y")
        assert (entry.best_params, entry.cv_mean, entry.cv_std) == (alone.best_params, alone.cv_mean, alone.cv_std)
        assert entry.model.coefficients.toArray().tolist() == alone.model.coefficients.toArray().tolist()
