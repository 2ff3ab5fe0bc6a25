from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from assayline.models import (
    MODELS,
    ModelConfig,
    PenalisedRegression,
    load_models,
    predict,
    predict_with_spread,
    quick_train,
    save_models,
    train_all,
    train_one,
)
from assayline.models.training import evaluate_models, feature_importance, grid_points
from assayline.operators import evaluate
from assayline.plans.prepare import Preparation, assemble, fit_preparation
from assayline.plans.score import score_table
from assayline.plans.train import train_job, training_summary
from assayline.spec import SAMPLE_SPEC, TableSpec

SPEC = TableSpec(SAMPLE_SPEC.features, SAMPLE_SPEC.category, SAMPLE_SPEC.target, key=("sample_id",))
TINY = {
    **MODELS,
    "random_forest": ModelConfig(
        lambda seed: RandomForestRegressor(numTrees=4, maxDepth=3, featureSubsetStrategy="all", seed=seed),
        {"maxDepth": [2, 3]},
    ),
    "gradient_boosting": ModelConfig(lambda seed: GBTRegressor(maxIter=2, maxDepth=2, seed=seed)),
}


@pytest.fixture(scope="module")
def prepared(synthetic):
    from assayline.session import write_through

    rows, preparation = fit_preparation(synthetic, SPEC)
    return write_through(rows, "test-prepared"), preparation


@pytest.fixture(scope="module")
def vectors(prepared):
    return assemble(prepared[0], SPEC.model_columns)


@pytest.fixture(scope="module")
def trained(vectors):
    return train_all(
        vectors, "quality", ["random_forest", "gradient_boosting", "ridge", "nobody"], tune=False, models=TINY
    )


def closed_form_ridge(x, y, alpha):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(axis=0) @ w


def descend(x, y, alpha, share):
    """Coordinate descent for the penalised mean-squared loss."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = math.copysign(max(abs(rho) - alpha * share, 0.0), rho) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - share))
    return w


@pytest.fixture(scope="module")
def regression(spark):
    random = np.random.default_rng(2)
    x = random.normal(size=(200, 3)) * [1.0, 3.0, 0.5]
    y = x @ [1.0, -0.5, 2.0] + random.normal(size=200) + 4.0
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    return x, y, assemble(df, ["a", "b", "c"])


@pytest.mark.parametrize("alpha", [0.1, 10.0, 100.0])
def test_ridge_equals_the_closed_form(regression, alpha):
    x, y, df = regression
    model = PenalisedRegression(alpha=alpha, summed_loss=True, labelCol="y").fit(df)
    w, intercept = closed_form_ridge(x, y, alpha)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-8)
    assert model.intercept == pytest.approx(intercept, abs=1e-8)


@pytest.mark.parametrize("alpha,share", [(0.01, 1.0), (0.5, 1.0), (0.3, 0.5), (0.3, 0.2)])
def test_lasso_and_elastic_net_equal_coordinate_descent(regression, alpha, share):
    x, y, df = regression
    model = PenalisedRegression(alpha=alpha, l1_share=share, labelCol="y").fit(df)
    assert np.allclose(model.coefficients.toArray(), descend(x, y, alpha, share), atol=1e-5)


def test_fit_multiple_equals_single_fits(regression):
    _, _, df = regression
    estimator = PenalisedRegression(labelCol="y", summed_loss=True)
    maps = [{estimator.alpha: a} for a in (0.1, 5.0)]
    for i, model in estimator.fitMultiple(df, maps):
        assert np.allclose(model.coefficients.toArray(), estimator.fit(df, maps[i]).coefficients.toArray())


def test_reference_grids():
    assert {n: len(grid_points(c.grid)) for n, c in MODELS.items()} == {
        "random_forest": 12, "gradient_boosting": 8, "ridge": 4, "lasso": 4, "elastic_net": 4,
    }


def test_preparation_standardises_train_rows(prepared, synthetic):
    rows, preparation = prepared
    assert rows.count() == synthetic.count()
    train = rows.where("split = 'train'").toPandas()
    for c in SPEC.model_columns:
        assert train[c].mean() == pytest.approx(0.0, abs=1e-9)
        assert train[c].std(ddof=0) == pytest.approx(1.0, abs=1e-9)
    assert {r["label"] for r in preparation.labels.table.collect()} == {"red", "white"}


def test_outlier_policy_of_the_preparation(synthetic):
    everything = synthetic.count()
    dropped, _ = fit_preparation(synthetic, SPEC, outliers="drop")
    clipped, _ = fit_preparation(synthetic, SPEC, outliers="clip")
    assert 0.5 * everything < dropped.count() < everything == clipped.count()


def test_transform_equals_fit_and_never_drops_rows(spark, prepared, synthetic):
    rows, preparation = prepared
    again = preparation.transform(synthetic).select("sample_id", "features")
    both = assemble(rows, SPEC.model_columns).select("sample_id", F.col("features").alias("f")).join(again, "sample_id")
    assert all(np.allclose(r.f.toArray(), r.features.toArray()) for r in both.limit(200).collect())
    doubled = synthetic.limit(5).unionByName(synthetic.limit(5))
    assert preparation.transform(doubled).count() == 10


def test_transform_fills_gaps_and_absent_columns(prepared, synthetic):
    _, preparation = prepared
    broken = synthetic.limit(3).withColumns({"alcohol": F.lit(None).cast("double"), "wine_type": F.lit("rose")}).drop("pH")
    names = SPEC.model_columns
    for r in preparation.transform(broken).collect():
        mean, sd = preparation.scaler["alcohol"]
        assert r.features[names.index("alcohol")] == pytest.approx((preparation.medians["alcohol"] - mean) / sd)
        mean, sd = preparation.scaler["pH"]
        assert r.features[names.index("pH")] == pytest.approx(-mean / sd)


def test_preparation_survives_saving(spark, prepared, synthetic, tmp_path):
    _, preparation = prepared
    preparation.save(spark, str(tmp_path / "p"))
    loaded = Preparation.load(spark, str(tmp_path / "p"))
    assert (loaded.medians, loaded.scaler, loaded.spec) == (preparation.medians, preparation.scaler, preparation.spec)
    assert sorted(loaded.labels.table.collect()) == sorted(preparation.labels.table.collect())


def test_failures_are_recorded_and_the_best_is_chosen(spark, trained, vectors):
    assert set(trained.models) == {"random_forest", "gradient_boosting", "ridge"}
    assert "unknown model" in trained.errors["nobody"]
    val = {r.model: r.r2 for r in evaluate_models(trained, vectors, "quality", ["val"]).collect()}
    assert trained.best_name == max(val, key=val.get)
    assert val["ridge"] > 0.4  # the generated target has a linear signal
    assert trained.training_table(spark).where("error IS NOT NULL").count() == 1
    with pytest.raises(ValueError):
        trained.get("nobody")
    with pytest.raises(ValueError):
        train_one(vectors, "nobody", "quality")


def test_metrics_equal_the_evaluator(trained, vectors):
    test = vectors.where("split = 'test'")
    row = evaluate_models(trained, vectors, "quality", ["test"]).where("model = 'ridge'").first()
    scored = predict(test, trained, "ridge")
    for name in ("mse", "mae", "rmse", "r2"):
        assert row[name] == pytest.approx(RegressionEvaluator(labelCol="quality", metricName=name).evaluate(scored))


def test_tuning_reports_the_best_point(vectors):
    entry = train_one(vectors, "random_forest", "quality", models=TINY)
    assert entry.best_params in [{"maxDepth": 2}, {"maxDepth": 3}]
    assert entry.cv_mean > 0 and entry.cv_std >= 0


def test_spread_equals_running_every_tree(trained, vectors):
    model = trained.models["random_forest"].model
    rows = predict_with_spread(vectors.limit(50), trained, "random_forest").collect()
    forest = {r.sample_id: r.prediction for r in model.transform(vectors).select("sample_id", "prediction").collect()}
    for r in rows:
        votes = [t.predict(r.features) for t in model.trees]
        assert r.prediction == pytest.approx(np.mean(votes)) == pytest.approx(forest[r.sample_id])
        assert r.spread == pytest.approx(np.std(votes))


def test_spread_of_other_models(trained, vectors):
    assert predict_with_spread(vectors.limit(1), trained, "ridge").first().spread == 0.0
    assert predict_with_spread(vectors.limit(1), trained, "gradient_boosting").first().spread is None


def test_importance_is_sorted(spark, trained):
    rows = feature_importance(spark, trained.models["random_forest"], SPEC.model_columns).collect()
    assert len(rows) == 12 and sum(r.importance for r in rows) == pytest.approx(1.0)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    with pytest.raises(ValueError):
        feature_importance(spark, trained.models["ridge"], SPEC.model_columns)


def test_models_survive_saving(spark, trained, vectors, tmp_path):
    path = str(tmp_path / "m")
    save_models(trained, spark, path)
    loaded = load_models(spark, path)
    assert loaded.best_name == trained.best_name and loaded.errors == trained.errors
    for name in trained.models:
        before = predict(vectors, trained, name).agg(F.sum("prediction")).first()[0]
        assert predict(vectors, loaded, name).agg(F.sum("prediction")).first()[0] == pytest.approx(before)


def test_quick_training_is_usable_at_once(vectors):
    trained = quick_train(vectors, "quality", "ridge")
    assert trained.get().best_params == {}


def test_scoring_is_one_stage_without_python(prepared, trained, synthetic):
    _, preparation = prepared
    for name, details in (("random_forest", True), ("ridge", False), ("gradient_boosting", True)):
        scored = score_table(synthetic, preparation, trained, name, details=details)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        # The labels' table is broadcast; no row of the scored table moves.
        assert "Exchange" not in plan.replace("BroadcastExchange", "") and "Python" not in plan
        assert scored.count() == synthetic.count()


def test_details_of_a_scored_row(prepared, trained, synthetic):
    _, preparation = prepared
    row = score_table(synthetic.limit(1), preparation, trained, "gradient_boosting", details=True).first()
    assert row.half_width == 0.5 and row.model_used == "Gradient Boosting"
    assert row.interval == f"{row.predicted_quality - 0.5:.1f} - {row.predicted_quality + 0.5:.1f}"


def test_job_trains_once(spark, synthetic, tmp_path):
    path = str(tmp_path / "job")
    _, first = train_job(synthetic, SPEC, path, ["ridge", "lasso"])
    _, second = train_job(synthetic.limit(0), SPEC, path, ["ridge", "lasso"])
    assert first.models["ridge"].training_time == second.models["ridge"].training_time
    summary = training_summary(spark, path).collect()
    assert [r.val_r2 for r in summary] == sorted((r.val_r2 for r in summary), reverse=True)
    assert sum(r.is_best for r in summary) == 1


def test_job_without_a_key_column(spark, synthetic, tmp_path):
    rows = synthetic.drop("sample_id")
    preparation, trained = train_job(rows.unionByName(rows.limit(50)), SAMPLE_SPEC, str(tmp_path / "job"), ["ridge"])
    scored = score_table(rows.limit(7), preparation, trained)
    assert scored.count() == 7 and scored.columns == [*rows.columns, "predicted_quality", "quality_category"]


def test_constant_target_and_missing_predictions(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 1.0, None)], "g string, y double, p double")
    got = {r.g: r for r in evaluate.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert got["a"].r2 == 1.0 and got["b"].r2 == 0.0 and got["c"].r2 is None and got["c"].n == 0


def test_select_best_prefers_the_first_on_a_tie(spark):
    df = spark.createDataFrame([("x", 0.5, 1), ("y", 0.5, 0), ("z", float("nan"), 2)], "model string, r2 double, ordinal int")
    assert evaluate.select_best(df).first().best_model == "y"


def test_one_scan_search_equals_the_scans_per_fold(spark, synthetic):
    from assayline.models.catalogue import MODELS
    from assayline.models.training import cross_validate, grid_points
    from assayline.operators.split import fold_of
    from assayline.plans.prepare import assemble

    columns = ["alcohol", "chlorides", "density"]
    rows = assemble(synthetic, columns).withColumn("fold", fold_of(["id"] if "id" in synthetic.columns else synthetic.columns)).select("features", "quality", "fold")
    for name in ("ridge", "lasso", "elastic_net"):
        points = grid_points(MODELS[name].grid)
        fast = cross_validate(rows, MODELS[name].build(1), points, "quality")
        slow = cross_validate(rows, MODELS[name].build(1), points, "quality", one_scan=False)
        assert np.allclose(fast, slow, rtol=1e-5)


@pytest.mark.parametrize(("folds", "outliers"), [(5, None), (3, "drop"), (3, "clip")])
def test_job_takes_folds_and_outlier_policies(spark, synthetic, tmp_path, folds, outliers):
    from assayline.plans.train import train_job
    from assayline.spec import SAMPLE_SPEC

    _, trained = train_job(synthetic, SAMPLE_SPEC, str(tmp_path / "job"), ["ridge"], folds=folds, outliers=outliers)
    assert trained.best_name == "ridge" and not trained.errors


def test_job_refuses_what_it_does_not_know(spark, synthetic, tmp_path):
    from assayline.plans.train import train_job
    from assayline.spec import SAMPLE_SPEC

    for options in ({"colour": 1}, {"folds": 1}, {"outliers": "hide"}):
        with pytest.raises((TypeError, ValueError)):
            train_job(synthetic, SAMPLE_SPEC, str(tmp_path / "job"), ["ridge"], **options)


def test_rule_scoring_of_a_given_table_has_no_exchange(spark):
    from assayline.queries import QUERIES

    plan = QUERIES["score_rule_batch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_malformed_lines_get_a_row_without_score(spark, prepared, trained, tmp_path):
    from assayline.plans.score import score_batch

    _, preparation = prepared
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("alcohol,chlorides,wine_type\n9.5,0.08,red\nabc,0.08,white\n10.0,,red\n")
    rows = score_batch(spark, str(tmp_path / "in"), str(tmp_path / "out"), preparation, trained, "ridge").collect()
    assert len(rows) == 3
    bad = [r for r in rows if r["malformed_line"]]
    assert len(bad) == 1 and bad[0]["predicted_quality"] is None
    assert all(r["predicted_quality"] is not None for r in rows if not r["malformed_line"])


def test_a_preparation_takes_each_digest_once(spark, synthetic):
    """Draws and folds are written with the cleaned rows; fits and labels after that read them, and give the old sides."""
    from assayline.operators.split import fold_of, stratified_split
    from assayline.plans import prepare

    rows, _ = fit_preparation(synthetic, SPEC)
    assert "md5" not in rows._jdf.queryExecution().optimizedPlan().toString()
    cleaned, _ = prepare.clean(synthetic, SPEC)
    before = stratified_split(cleaned, SPEC.target, SPEC.key).withColumn("fold", fold_of(SPEC.key))
    sides = lambda df: sorted(map(tuple, df.select(*SPEC.key, "split", "fold").collect()))
    assert sides(rows) == sides(before)


def test_a_job_can_share_a_preparation(spark, synthetic, tmp_path, monkeypatch):
    from assayline.plans import train

    prepared = fit_preparation(synthetic, SPEC)
    monkeypatch.setattr(train, "fit_preparation", lambda *a, **k: pytest.fail("prepared again"))
    preparation, trained = train_job(synthetic, SPEC, str(tmp_path / "job"), ["ridge"], prepared=prepared)
    assert preparation.digest() == prepared[1].digest() and trained.best_name == "ridge"
