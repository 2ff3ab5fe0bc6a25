"""Grid search with given folds, training of several models, choice of the best."""

from __future__ import annotations

import inspect
import itertools
import json
import logging
import math
import statistics
import time
from collections.abc import Callable, Mapping, Sequence
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.models.catalogue import DEFAULT_MODELS, MODELS, ModelConfig
from assayline.models.forest import fit_forest, grows
from assayline.models.gram import Sums, cross_validate_linear, fold_sums
from assayline.models.regression import PenalisedRegression
from assayline.operators.evaluate import metrics_of_models

log = logging.getLogger(__name__)

TRAINING_SCHEMA = (
    "model string, ordinal int, best_params string, cv_mean double, cv_std double, "
    "training_time double, error string"
)
# Rows that a task of boosting keeps in memory through all rounds.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Trained:
    """One fitted model with the outcome of its search."""

    name: str
    model: Model
    best_params: dict
    cv_mean: float | None
    cv_std: float | None
    training_time: float
    # What is worked out from the model when first needed.
    derived: dict = field(default_factory=dict, compare=False, repr=False)


@dataclass
class ModelSet:
    """Fitted models by name, the failures, and the best of them on validation rows."""

    models: dict[str, Trained] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    best_name: str | None = None

    def get(self, name: str | None = None) -> Trained:
        name = name or self.best_name
        if name is None:
            raise ValueError("no trained model available")
        if name not in self.models:
            raise ValueError(f"model {name} not found")
        return self.models[name]

    def training_table(self, spark: SparkSession) -> DataFrame:
        """Rows ``(model, ordinal, best_params, cv_mean, cv_std, training_time, error)``."""
        rows = [
            (t.name, i, json.dumps(t.best_params, sort_keys=True), t.cv_mean, t.cv_std, t.training_time, None)
            for i, t in enumerate(self.models.values())
        ]
        rows += [(n, len(self.models) + i, None, None, None, None, e) for i, (n, e) in enumerate(self.errors.items())]
        return spark.createDataFrame(rows, TRAINING_SCHEMA)


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def cross_validate(
    df: DataFrame,
    estimator: Estimator,
    points: Sequence[dict],
    label: str,
    fold: str = "fold",
    folds: int = 3,
    parallelism: int = 4,
    one_scan: bool = True,
    sums: dict | None = None,
) -> list[list[float]]:
    """Mean squared error per grid point and fold.

    ``CrossValidator`` would check a given fold column with a Python function per row and
    scan the held-out rows once per grid point. Here one scan per fold scores all points, and
    penalised linear models need two in all (see ``gram``); ``one_scan=False`` is for
    tables of so many columns that their products are too many. ``sums`` is an empty dict at first: calls for the same rows,
    folds and label that are given the same one take the sums of linear models once.
    """
    if isinstance(estimator, PenalisedRegression):
        if one_scan and estimator.getOrDefault("solver") == "sums":
            return cross_validate_linear(_sums_once(sums, df, label, fold, folds, estimator.getFeaturesCol()), estimator, points, folds)
        estimator = estimator.copy({estimator.solver: "iterative"})
    errors: list[list[float]] = [[] for _ in points]
    for held_out in range(folds):
        training = df.where(F.col(fold) != held_out)
        validation = df.where(F.col(fold) == held_out)
        fitted = _fit_points(training, estimator, points, label, parallelism)
        columns = {}
        for i, model in enumerate(fitted):
            columns[str(i)] = f"__p{i}"
            validation = model.transform(validation, {model.predictionCol: f"__p{i}"})
        for row in metrics_of_models(validation, label, columns, by=()).collect():
            if row["mse"] is None:
                raise ValueError(f"fold {held_out} holds no labelled rows")
            errors[int(row["model"])].append(row["mse"])
    return errors


def _sums_once(known: dict | None, df: DataFrame, label: str, fold: str, folds: int, features: str) -> list[Sums]:
    if known is None:
        return fold_sums(df, label, fold, folds, features)
    if features not in known:
        known[features] = fold_sums(df, label, fold, folds, features)
    return known[features]


def dealt_out(df: DataFrame, task_rows: int) -> DataFrame:
    """The rows in partitions of about ``task_rows`` at most; left as they are where these would not be more."""
    parts = math.ceil(df.count() / task_rows)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def _fit_points(df, estimator, points, label, parallelism) -> list[Model]:
    if isinstance(estimator, GBTRegressor):
        # MLlib keeps the rows of a partition as objects, many times the size of the file that they came from, and reads them
        # anew in each level of each round. A forest would send the sums of its many nodes once per partition instead.
        df = dealt_out(df, TASK_ROWS)
    maps = [
        {**{estimator.getParam(k): v for k, v in point.items()}, estimator.labelCol: label} for point in points
    ]
    if grown := [estimator.copy(m) for m in maps if grows(estimator.copy(m))]:
        if len(grown) == len(maps):
            return [fit_forest(df, e) for e in grown]
    fits = estimator.fitMultiple(df, maps)
    if parallelism <= 1 or len(points) == 1:
        return [model for _, model in sorted(fits, key=lambda f: f[0])]
    with ThreadPool(min(parallelism, len(points))) as pool:
        take = inheritable_thread_target(df.sparkSession)(lambda _: next(fits))
        return [model for _, model in sorted(pool.imap_unordered(take, points), key=lambda f: f[0])]


def train_one(
    df: DataFrame,
    name: str,
    label: str,
    tune: bool = True,
    models: Mapping[str, ModelConfig] = MODELS,
    seed: int = 42,
    folds: int = 3,
    fold: str = "fold",
    split: str = "split",
    parallelism: int = 4,
    one_scan: bool = True,
    validate: bool = True,
    sums: dict | None = None,
) -> Trained:
    """Search the grid by cross-validation on the train rows, refit the best point on all of them.

    ``df`` holds ``features``, ``label``, ``fold`` and ``split``. Without tuning the
    defaults are validated the same way, as a grid of one point; ``validate=False`` then leaves
    the validation out, with its one fit per fold, and ``cv_mean`` and ``cv_std`` stay empty. ``sums`` is as for ``cross_validate``.
    """
    if name not in models:
        raise ValueError(f"unknown model: {name}")
    started = time.monotonic()
    config = models[name]
    estimator = config.build(seed)
    points = grid_points(config.grid) if tune and config.grid else [{}]
    train = df.where(F.col(split) == "train").select("features", label, fold)
    parts = []
    if validate or len(points) > 1:
        if one_scan and isinstance(estimator, PenalisedRegression) and estimator.getOrDefault("solver") == "sums":
            parts = _sums_once(sums, train, label, fold, folds, estimator.getFeaturesCol())
            errors = cross_validate_linear(parts, estimator, points, folds)
        else:
            errors = cross_validate(train, estimator, points, label, fold, folds, parallelism, one_scan)
        mean, best = min((statistics.fmean(e), i) for i, e in enumerate(errors))
        deviation = statistics.pstdev(errors[best])
    else:
        mean, best, deviation = None, 0, None
    whole = sum(parts[1:], parts[0]) if parts else None
    if whole and whole.n == whole.labelled:
        # The folds hold all rows, so their sums are those of the last fit too.
        chosen = {estimator.getParam(k): v for k, v in points[best].items()}
        model = estimator.copy({**chosen, estimator.labelCol: label}).fit_sums(train, whole)
    else:
        model = _fit_points(train, estimator, [points[best]], label, 1)[0]
    return Trained(
        name=name,
        model=model,
        best_params=points[best],
        cv_mean=mean,
        cv_std=deviation,
        training_time=time.monotonic() - started,
    )


def train_all(
    df: DataFrame,
    label: str,
    names: Sequence[str] = DEFAULT_MODELS,
    tune: bool = True,
    phase: Callable[[str], AbstractContextManager] = nullcontext,
    **options,
) -> ModelSet:
    """Train several models; one that fails is recorded and skipped. Then choose the best.

    Unknown options raise before any training; if no model is left, the recorded errors are
    raised. Each model is trained inside ``phase(name)``.
    """
    if unknown := set(options) - set(inspect.signature(train_one).parameters):
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    trained = ModelSet()
    # The models see the same rows, so linear ones share their sums.
    options.setdefault("sums", {})
    for name in names:
        try:
            with phase(name):
                trained.models[name] = train_one(df, name, label, tune, **options)
        except Exception as failure:  # noqa: BLE001 - any failure of one model is reported as such
            log.warning("training %s failed: %s", name, failure)
            trained.errors[name] = str(failure)
    if names and not trained.models:
        raise RuntimeError("; ".join(f"{name}: {error}" for name, error in trained.errors.items()))
    choose_best(trained, df, label, options.get("split", "split"))
    return trained


def quick_train(df: DataFrame, label: str, name: str = "random_forest", **options) -> ModelSet:
    """One model with its defaults."""
    trained = ModelSet(models={name: train_one(df, name, label, tune=False, **options)})
    trained.best_name = name
    return trained


def with_predictions(trained: ModelSet, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Add one prediction column per model; returns it with the column names by model."""
    columns = {}
    for name, entry in trained.models.items():
        columns[name] = f"prediction_{name}"
        df = entry.model.transform(df, {entry.model.predictionCol: columns[name]})
    return df, columns


def evaluate_models(
    trained: ModelSet, df: DataFrame, label: str, splits: Sequence[str] = ("train", "val", "test"), split: str = "split"
) -> DataFrame:
    """Rows ``(split, model, n, mse, mae, rmse, r2)``: all models and splits from one scan."""
    scored, columns = with_predictions(trained, df.where(F.col(split).isin(*splits)))
    return metrics_of_models(scored, label, columns, by=[split])


def choose_best(trained: ModelSet, df: DataFrame, label: str, split: str = "split") -> None:
    """Set the best model: highest validation R², the first trained one on a tie."""
    if not trained.models:
        return
    rows = evaluate_models(trained, df, label, ["val"], split).collect()
    scores = {r["model"]: r["r2"] for r in rows}
    best = None
    for name in trained.models:
        score = scores.get(name)
        if score is not None and score == score and (best is None or score > scores[best]):
            best = name
    trained.best_name = best


def feature_importance(
    spark: SparkSession, entry: Trained, columns: Sequence[str], k: int | None = None
) -> DataFrame:
    """Rows ``(feature, importance)`` of a tree model by falling importance."""
    if not hasattr(entry.model, "featureImportances"):
        raise ValueError(f"{entry.name} has no feature importances")
    weights = entry.model.featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(columns, weights)), "feature string, importance double")
    table = table.orderBy(F.desc("importance"), "feature")
    return table if k is None else table.limit(k)
