"""Ensembles as tables of nodes, the spread over the trees, and the training journal."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from assayline.models import MODELS, ModelConfig, ModelSet, Trained, predict_with_spread, train_one, training
from assayline.models.trees import (
    Spread,
    audit_nodes,
    boosted_leaf_means,
    importance_of_nodes,
    leaf_values,
    node_table,
    spread_gaps,
)
from assayline.plans.prepare import assemble
from assayline.plans.train import train_job, training_journal, training_summary
from assayline.session import write_through
from assayline.spec import SAMPLE_SPEC

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(600, 3)), 1)
    y = np.round(2 * x[:, 0] + (x[:, 1] > 0) + rng.normal(size=600) / 4)
    data = [([float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)]
    return write_through(spark.createDataFrame(data, "x array<double>, y double").withColumn("features", array_to_vector("x")), "tree-rows")


@pytest.fixture(scope="module")
def forest(rows):
    return RandomForestRegressor(numTrees=7, maxDepth=6, labelCol="y", seed=3).fit(rows)


@pytest.fixture(scope="module")
def boosted(rows):
    return GBTRegressor(maxIter=5, maxDepth=3, labelCol="y", seed=3).fit(rows)


def test_nodes_of_sound_ensembles_pass_the_audit(spark, forest, boosted):
    for model, trees in ((forest, 7), (boosted, 5)):
        nodes = node_table(spark, model)
        assert nodes.count() == model.totalNumNodes
        audit = audit_nodes(nodes).collect()
        assert len(audit) == trees and sum(r["nodes"] for r in audit) == model.totalNumNodes
        assert all(tuple(r)[2:] == (0, 0, 0, 0) for r in audit)
    with pytest.raises(ValueError):
        node_table(spark, LinearRegression)


@pytest.mark.parametrize(
    ("change", "wrong"),
    [
        ({"prediction": "prediction + 0.01"}, "wrong_means"),
        ({"gain": "gain * 1.01"}, "wrong_gains"),
        ({"gain": "-gain"}, "wrong_order"),
        ({"n": "n + CASE WHEN feature IS NULL THEN 1 ELSE 0 END"}, "wrong_counts"),
    ],
)
def test_audit_finds_what_is_wrong(spark, forest, change, wrong):
    nodes = node_table(spark, forest).withColumns({c: F.when(F.col("tree") == 2, F.expr(e)).otherwise(F.col(c)) for c, e in change.items()})
    found = {r["tree"]: r[wrong] for r in audit_nodes(nodes).collect()}
    assert found[2] > 0 and sum(found.values()) == found[2]


def test_importances_from_gains_equal_the_models(spark, forest, boosted):
    for model, per_tree in ((forest, True), (boosted, False)):
        found = {r["feature"]: r["importance"] for r in importance_of_nodes(node_table(spark, model), COLUMNS, per_tree).collect()}
        assert [found[c] for c in COLUMNS] == pytest.approx(model.featureImportances.toArray().tolist())


def test_a_tree_of_one_leaf_has_no_importance(spark, rows):
    model = RandomForestRegressor(numTrees=2, maxDepth=0, labelCol="y", seed=3).fit(rows)
    found = importance_of_nodes(node_table(spark, model), COLUMNS).collect()
    assert sorted(r["feature"] for r in found) == COLUMNS and {r["importance"] for r in found} == {0.0}


def test_spread_of_companion_forests_equals_that_of_all_trees(spark, rows, forest):
    scored = Spread(spark, forest).transform(rows, "mean", "deviation").collect()
    for r in scored[:200]:
        votes = [t.predict(r["features"]) for t in forest.trees]
        assert r["mean"] == pytest.approx(np.mean(votes), abs=1e-12) and r["deviation"] == pytest.approx(np.std(votes), abs=1e-9)


def test_spread_of_trees_that_agree_is_nothing(spark, rows):
    far = rows.withColumn("y", F.col("y") + 1e6)
    model = RandomForestRegressor(numTrees=3, maxDepth=4, bootstrap=False, featureSubsetStrategy="all", labelCol="y", seed=3).fit(far)
    scored = Spread(spark, model).transform(rows, "mean", "deviation")
    assert scored.agg(F.max("deviation")).first()[0] == 0.0


def test_plan_of_a_spread_does_not_grow_with_the_trees(spark, rows):
    sizes = []
    for trees in (2, 12):
        model = RandomForestRegressor(numTrees=trees, maxDepth=3, labelCol="y", seed=3).fit(rows)
        plan = Spread(spark, model).transform(rows, "mean", "deviation")._jdf.queryExecution().executedPlan().toString()
        sizes.append(len(plan))
        assert "Exchange" not in plan and "Python" not in plan
    assert abs(sizes[0] - sizes[1]) < 50


def test_training_without_validation_fits_once(rows):
    frame = rows.select("features", F.col("y").alias("quality"), F.lit(0).alias("fold"), F.lit("train").alias("split"))
    entry = train_one(frame, "tree", "quality", tune=False, validate=False, models={"tree": ModelConfig(lambda seed: RandomForestRegressor(numTrees=1, seed=seed))})
    assert entry.cv_mean is None and entry.cv_std is None and entry.model.getNumTrees == 1


def test_journal_of_a_job_and_of_one_that_failed_first(spark, synthetic, tmp_path):
    path = str(tmp_path / "job")
    broken = ModelConfig(lambda seed: RandomForestRegressor(numTrees=1, maxBins=1))
    with pytest.raises(RuntimeError):
        train_job(synthetic, SAMPLE_SPEC, path, ["broken"], models={"broken": broken})
    with pytest.raises(Exception):
        training_summary(spark, path).collect()
    train_job(synthetic, SAMPLE_SPEC, path, ["broken", "ridge"], models={"broken": broken, "ridge": MODELS["ridge"]})
    # Loading writes nothing down.
    train_job(synthetic, SAMPLE_SPEC, path, ["ridge"])
    journal = training_journal(spark, path).collect()
    assert [r["phase"] for r in journal] == ["read", "prepare", "train broken", "train ridge", "evaluate", "save"]
    assert all(r["seconds"] > 0 for r in journal) and journal[0]["rows"] == synthetic.count()
    assert journal[2]["rows"] is None and journal[3]["rows"] < journal[1]["rows"]
    summary = training_summary(spark, path).collect()
    assert len(summary) == 1 and summary[0]["rows_read"] == synthetic.count()
    info = spark.read.parquet(f"{path}/table")
    assert info.count() == len(synthetic.columns)


def test_leaves_are_followed_batch_by_batch(spark):
    """Means of what boosting left and gaps of the spread, against NumPy over collected leaves, without a shuffle of rows."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (300, 3))
    y = x[:, 0] * 2 + x[:, 1] ** 2 + rng.normal(0, 0.1, 300)
    rows = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y)], ["features", "y"]).coalesce(3)
    boosted = GBTRegressor(maxIter=4, maxDepth=2, stepSize=0.05, labelCol="y", seed=1).fit(rows)
    nodes = node_table(spark, boosted)
    values = leaf_values(nodes)
    weights = np.array(boosted.treeWeights)
    collected = boosted.copy().setLeafCol("at").transform(rows).select("y", "at").collect()
    expected: dict[tuple[int, int], list[float]] = {}
    for r in collected:
        gone = 0.0
        for t, leaf in enumerate(int(v) for v in r["at"]):
            expected.setdefault((t, leaf), []).append(r["y"] if t == 0 else 2 * (r["y"] - gone))
            gone += weights[t] * values[t, leaf]
    found = boosted_leaf_means(rows, boosted, "y", values, weights)
    got = {(r["tree"], r["leaf"]): r["mean"] for r in found.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - np.mean(v)) < 1e-9 for k, v in expected.items())
    told = {(r["tree"], r["leaf"]): r["prediction"] for r in nodes.where("feature IS NULL").selectExpr(
        "tree", "row_number() OVER (PARTITION BY tree ORDER BY node) - 1 AS leaf", "prediction").collect()}
    assert all(abs(got[k] - told[k]) < 1e-6 for k in got)

    forest = RandomForestRegressor(numTrees=5, maxDepth=3, labelCol="y", seed=1).fit(rows)
    trained = ModelSet({"f": Trained("f", forest, {}, None, None, 0.0)}, best_name="f")
    scored = predict_with_spread(rows.unionByName(rows), trained)  # repeated rows count as well
    votes = leaf_values(node_table(spark, forest))
    gaps = spread_gaps(scored, forest, "prediction", "spread", votes).collect()
    assert sum(r["mismatches"] for r in gaps) == 0 and max(r["spread"] for r in gaps) > 0
    off = scored.withColumn("spread", F.col("spread") + F.when(F.col("y") > 0, 0.01).otherwise(0.0))
    wrong = sum(r["mismatches"] for r in spread_gaps(off, forest, "prediction", "spread", votes).collect())
    assert wrong == 2 * int((y > 0).sum())
    plan = spread_gaps(scored, forest, "prediction", "spread", votes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate " not in plan


def test_boosting_deals_out_the_rows_of_large_partitions(spark, monkeypatch):
    monkeypatch.setattr(training, "TASK_ROWS", 100)
    rows = assemble(spark.range(1_050).selectExpr("CAST(id % 17 AS DOUBLE) AS x", "CAST(id % 17 AS DOUBLE) AS y", "'train' AS split", "0 AS fold").coalesce(1), ["x"])
    seen = []
    plain = GBTRegressor.fitMultiple
    monkeypatch.setattr(GBTRegressor, "fitMultiple", lambda self, df, maps: (seen.append(df), plain(self, df, maps))[1])
    config = ModelConfig(lambda seed: GBTRegressor(maxIter=2, maxDepth=5, seed=seed))
    trained = training.quick_train(rows, "y", "trees", models={"trees": config}, validate=False)
    (given,) = seen
    assert given.rdd.getNumPartitions() == 11 and given.count() == 1_050
    assert max(row["count"] for row in given.groupBy(F.spark_partition_id()).count().collect()) <= 100
    assert trained.models["trees"].model.getNumTrees == 2
    assert training.dealt_out(rows, 2_000).rdd.getNumPartitions() == 1
