"""Forests grown over binned rows, against MLlib's own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from assayline.models import ModelConfig, forest, train_one
from assayline.models.forest import binned_rows, fit_forest, grows
from assayline.session import write_through


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=700), rng.integers(0, 5, 700), rng.integers(0, 2, 700), np.zeros(700)])
    y = np.round(2 * x[:, 0] + x[:, 1] + rng.normal(size=700))
    data = [(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)]
    frame = spark.createDataFrame(data, "x array<double>, y double").repartition(3).withColumn("features", array_to_vector("x"))
    return write_through(frame.withColumn("fraction", F.col("y") / 7 + 0.1).withColumn("large", F.col("y") * 1e5), "forest-rows")


def nodes(spark, model, tmp_path, name):
    path = str(tmp_path / name)
    model.write().save(path)
    return [tuple(r) for r in spark.read.parquet(f"{path}/data").selectExpr("treeID", "nodeData.*").orderBy("treeID", "id").collect()]


def settings(**others):
    return RandomForestRegressor(**({"numTrees": 7, "maxDepth": 6, "featureSubsetStrategy": "all", "maxBins": 16, "labelCol": "y", "seed": 9} | others))


@pytest.mark.parametrize(
    "others",
    [
        {},
        {"maxDepth": 30, "minInstancesPerNode": 3},
        {"maxDepth": 0},
        {"bootstrap": False, "minInfoGain": 0.05},
        {"bootstrap": False, "subsamplingRate": 0.5, "minWeightFractionPerNode": 0.02},
        {"maxBins": 400, "maxDepth": 3, "numTrees": 2},
        {"labelCol": "large"},
    ],
)
def test_trees_are_those_of_mllib(spark, rows, tmp_path, others):
    estimator = settings(**others)
    assert grows(estimator)
    ours, theirs = fit_forest(rows, estimator), estimator.fit(rows)
    assert nodes(spark, ours, tmp_path, "ours") == nodes(spark, theirs, tmp_path, "theirs")
    assert ours.featureImportances == theirs.featureImportances and ours.getNumTrees == theirs.getNumTrees
    assert ours.extractParamMap().keys() == theirs.extractParamMap().keys() and ours.getMaxDepth() == estimator.getMaxDepth()
    same = ours.transform(theirs.transform(rows, {theirs.predictionCol: "told"})).where("told = prediction")
    assert same.count() == rows.count()


def test_targets_that_are_not_whole(rows):
    estimator = settings(labelCol="fraction")
    ours, theirs = fit_forest(rows, estimator), estimator.fit(rows)
    both = ours.transform(theirs.transform(rows, {theirs.predictionCol: "told"}))
    assert both.agg(F.max(F.abs(F.col("told") - F.col("prediction")))).first()[0] < 0.2
    assert ours.trees[0].depth == theirs.trees[0].depth


def test_little_memory_gives_the_same_trees(spark, rows, tmp_path, monkeypatch):
    estimator = settings()
    whole = nodes(spark, fit_forest(rows, estimator), tmp_path, "whole")
    for name, value in {"HELD": 3_000, "SENT": 1_500, "BRANCHES": 3, "CHUNK_ROWS": 50, "TASK_ROWS": 200, "SHIFT": 64.0, "MOST_TOTAL": 300.0, "JOINT_CELLS": 1}.items():
        monkeypatch.setattr(forest, name, value)
    assert nodes(spark, fit_forest(rows, estimator), tmp_path, "parts") == whole


def test_a_task_takes_few_trees_and_reads_their_draws_alone(rows, monkeypatch):
    estimator = settings()
    binned = binned_rows(rows, estimator)
    monkeypatch.setattr(forest, "HELD", 2 * 24 * sum(binned.widths))
    trees = [forest.Tree.root() for _ in range(7)]
    groups = forest._groups(binned, trees)
    assert [i for g in groups for i, _, _ in g] == list(range(7)) and max(map(len, groups)) <= 2
    read = forest._sums(binned, trees, groups[0], 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "draws0" in read and "Project [n" in read
    # A byte per row for each feature and tree beside the target.
    widest = binned.chunks.selectExpr("sum(length(bins) + length(y) + length(draws0) + length(draws1)) / sum(n)").first()[0]
    assert widest == 4 + 8 + 7 and binned.rows == rows.count()


def test_training_grows_forests_without_mllib_passes(rows, monkeypatch):
    monkeypatch.setattr(RandomForestRegressor, "fitMultiple", lambda *_: pytest.fail("MLlib read the rows once per group of nodes"))
    frame = rows.select("features", "y", F.lit(0).alias("fold"), F.lit("train").alias("split"))
    entry = train_one(frame, "forest", "y", tune=False, validate=False, models={"forest": ModelConfig(lambda seed: settings(seed=seed))})
    assert entry.model.getNumTrees == 7 and entry.model.totalNumNodes > 7


def test_what_is_left_to_mllib(rows):
    assert not grows(settings(numTrees=1)) and not grows(settings(featureSubsetStrategy="onethird")) and not grows(settings(weightCol="y"))
    named = rows.withColumn("name", F.when(F.col("y") > 0, "a").otherwise("b"))
    indexed = StringIndexer(inputCol="name", outputCol="code").fit(named).transform(named).drop("features")
    frame = VectorAssembler(inputCols=["code", "y"], outputCol="features").transform(indexed)
    estimator = settings()
    assert binned_rows(frame, estimator) is None
    assert fit_forest(frame, estimator).getNumTrees == 7


def test_rows_without_a_target_fail_as_before(rows):
    broken = rows.withColumn("y", F.when(F.col("y") < 100, F.lit(None).cast("double")))
    with pytest.raises(Exception):
        fit_forest(broken, settings())
    with pytest.raises(Exception):
        fit_forest(rows.limit(0), settings())
