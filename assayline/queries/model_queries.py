"""Models of all columns. SQL solves the linear ones and grows the trees by itself (see ``model_sql``)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.models import (
    MODELS,
    ModelConfig,
    ModelSet,
    PenalisedRegression,
    load_models,
    predict,
    predict_with_spread,
    quick_train,
    save_models,
    train_all,
    train_one,
)
from assayline.models.catalogue import MAX_BINS, step_size
from assayline.models.training import (
    cross_validate,
    evaluate_models,
    feature_importance,
    grid_points,
    with_predictions,
)
from assayline.models.trees import audit_nodes, boosted_leaf_means, importance_of_nodes, leaf_values, node_table, spread_gaps
from assayline.operators.evaluate import model_comparison
from assayline.operators.split import fold_of, stratified_split
from assayline.plans.prepare import Preparation, assemble, fit_preparation
from assayline.plans.score import score_batch, score_table
from assayline.plans.train import train_job, training_journal, training_summary
from assayline.queries import model_sql as M
from assayline.queries.registry import query, rounded
from assayline.queries.samples import (
    KEY,
    RANGES,
    SAMPLES,
    SPEC,
    columns,
    dirty_samples,
    samples,
    split_cte,
)
from assayline.queries.scoring_queries import CHECKS, VIOLATIONS
from assayline.session import fresh_path, write_through
from assayline.sources import write_delimited
from assayline.spec import SAMPLE_CATEGORIES
from assayline.streaming import read_stream, score_stream

_KEYS = columns(*KEY)
LINEAR = ("ridge", "lasso", "elastic_net")


def _tree(**settings) -> ModelConfig:
    """A forest of one tree of all rows, which SQL can grow too."""
    return ModelConfig(
        lambda seed: RandomForestRegressor(
            numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxBins=MAX_BINS, seed=seed, **settings
        )
    )


# The catalogue's forest at the least depth of its grid: unlimited trees of noisy targets grow with the table.
FOREST = ModelConfig(lambda seed: MODELS["random_forest"].build(seed).setMaxDepth(MODELS["random_forest"].grid["maxDepth"][0]))
# What the whole job trains: a tree and a line that SQL knows, or the forest and the line.
JOB = {"random_forest": _tree(maxDepth=3), "ridge": MODELS["ridge"]}
FULL_JOB = {"random_forest": FOREST, "ridge": MODELS["ridge"]}

_shared: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable):
    """Fit once per session and directory; several queries look at the same models."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def _split_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        split = stratified_split(samples(spark, sf_dir), "quality", KEY)
        return write_through(split.withColumn("fold", fold_of(KEY)), "split-samples")

    return _once(spark, sf_dir, "split", make)


def _alcohol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble(_split_samples(spark, sf_dir), ["alcohol"])


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Preparation]:
    def make():
        prepared, preparation = fit_preparation(dirty_samples(spark, sf_dir), SPEC)
        return write_through(prepared, "prepared"), preparation

    return _once(spark, sf_dir, "prepared", make)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble(_prepared(spark, sf_dir)[0], SPEC.model_columns)


def _linear(spark: SparkSession, sf_dir: str) -> ModelSet:
    """Tuned linear models of quality on all columns, and one name that nobody configured."""
    return _once(spark, sf_dir, "linear", lambda: train_all(_vectors(spark, sf_dir), "quality", [*LINEAR, "support_vector"]))


def _boosting(spark: SparkSession, sf_dir: str) -> ModelSet:
    """The catalogue's boosted trees."""
    def make():
        entry = train_one(_vectors(spark, sf_dir), "gradient_boosting", "quality", tune=False, validate=False)
        return ModelSet({entry.name: entry}, best_name=entry.name)

    return _once(spark, sf_dir, "boosting", make)


# --- penalised lines of all columns -----------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    train = _vectors(spark, sf_dir).where("split = 'train'")
    estimator = MODELS[model].build(42)
    points = [{estimator.alpha: a, estimator.labelCol: "quality"} for a in MODELS[model].grid["alpha"]]
    rows = []
    for i, line in estimator.fitMultiple(train, points):
        numbers = [*line.coefficients.toArray().tolist(), line.intercept]
        rows += [(points[i][estimator.alpha], c, w) for c, w in zip([*SPEC.model_columns, "intercept"], numbers, strict=True)]
    fitted = rounded(spark.createDataFrame(rows, "alpha double, feature string, weight double"), 4, "weight")
    return fitted.withColumn("weight", F.col("weight") + 0.0)


def _lines_sql(model: str) -> str:
    names = ", ".join(f"'{c}'" for c in [*SPEC.model_columns, "intercept"])
    return f"""{M.linear((model,))} SELECT alpha, [{names}][i] AS feature, round(list_append(w, b)[i], 4) + 0.0 AS weight
    FROM fits, range(1, {M.WIDTH + 2}) t(i) WHERE held = -1"""


@query("fit_ridge", _lines_sql("ridge"))
def fit_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "ridge")


@query("fit_lasso", _lines_sql("lasso"))
def fit_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "lasso")


@query("fit_elastic_net", _lines_sql("elastic_net"))
def fit_elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, "elastic_net")


@query(
    "grid_search",
    f"""{M.linear()} SELECT cv.model, cv.alpha, round(cv.cv_mean, 5) AS cv_mean, round(cv.cv_std, 5) AS cv_std,
    cv.alpha = best.alpha AS is_best FROM cv JOIN best USING (model)""",
)
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of the linear models' grids with its cross-validated error, and the choice."""
    train = _vectors(spark, sf_dir).where("split = 'train'")
    rows, sums = [], {}
    for name in LINEAR:
        points = grid_points(MODELS[name].grid)
        errors = cross_validate(train, MODELS[name].build(42), points, "quality", sums=sums)
        chosen = _linear(spark, sf_dir).models[name].best_params["alpha"]
        rows += [(name, p["alpha"], *e, p["alpha"] == chosen) for p, e in zip(points, errors)]
    table = spark.createDataFrame(rows, "model string, alpha double, e0 double, e1 double, e2 double, is_best boolean")
    mean = (F.col("e0") + F.col("e1") + F.col("e2")) / 3.0
    spread = F.sqrt(sum((F.col(e) - mean) * (F.col(e) - mean) for e in ("e0", "e1", "e2")) / 3.0)
    return table.select("model", "alpha", F.round(mean, 5).alias("cv_mean"), F.round(spread, 5).alias("cv_std"), "is_best")


@query(
    "cv_scores",
    f"""{M.linear(("ridge",))} SELECT 'ridge' AS model, round(cv_mean, 5) AS cv_mean, round(cv_std, 5) AS cv_std
    FROM cv WHERE model = 'ridge' AND alpha = 1""",
)
def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated error of a model with its defaults."""
    entry = train_one(_vectors(spark, sf_dir), "ridge", "quality", tune=False)
    table = spark.createDataFrame(
        [(entry.name, entry.cv_mean, entry.cv_std)], "model string, cv_mean double, cv_std double"
    )
    return rounded(table, 5, "cv_mean", "cv_std")


@query(
    "train_all",
    f"""{M.linear()}, o AS (SELECT * FROM (VALUES ('ridge', 0), ('lasso', 1), ('elastic_net', 2)) t(model, ordinal))
    SELECT o.model, o.ordinal, params AS best_params, round(cv_mean, 5) AS cv_mean, round(cv_std, 5) AS cv_std,
      CAST(NULL AS VARCHAR) AS error FROM best JOIN o USING (model)
    UNION ALL SELECT 'support_vector', 3, NULL, NULL, NULL, 'unknown model: support_vector'""",
)
def train_all_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _linear(spark, sf_dir).training_table(spark).drop("training_time")
    return rounded(table, 5, "cv_mean", "cv_std")


_BY_SPLIT = ", ".join(f"round(max({m}) FILTER (WHERE split = '{s}'), 5) AS {s}_{m}" for m in ("r2", "rmse") for s in ("train", "val", "test"))


@query(
    "model_comparison",
    f"""{M.tuned()} SELECT model, {_BY_SPLIT}, round(any_value(cv_mean), 5) AS cv_mean, round(any_value(cv_std), 5) AS cv_std
    FROM metrics JOIN best USING (model) GROUP BY model""",
)
def model_comparison_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = _linear(spark, sf_dir)
    metrics = evaluate_models(trained, _vectors(spark, sf_dir), "quality")
    table = trained.training_table(spark).select("model", "cv_mean", "cv_std", "training_time")
    compared = model_comparison(metrics, table).drop("training_time")
    return rounded(compared, 5, *[c for c in compared.columns if c != "model"])


@query(
    "evaluate_test",
    f"""{M.tuned()} SELECT model, n, round(mse, 5) AS mse, round(mae, 5) AS mae, round(rmse, 5) AS rmse,
    round(r2, 5) AS r2 FROM metrics WHERE split = 'test'""",
)
def evaluate_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluate_models(_linear(spark, sf_dir), _vectors(spark, sf_dir), "quality", ["test"])
    return rounded(table.drop("split"), 5, "mse", "mae", "rmse", "r2")


@query(
    "quick_train",
    f"""{M.linear(("ridge",))} SELECT {_KEYS}, round(b + list_inner_product(w, x), 4) AS prediction FROM data, fits
    WHERE split = 'val' AND held = -1 AND alpha = 1""",
)
def quick_train_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    trained = quick_train(rows, "quality", "ridge")
    scored = predict(rows.where("split = 'val'"), trained)
    return rounded(scored.select(*KEY, "prediction"), 4, "prediction")


@query(
    "predict_named",
    f"""{M.tuned(("lasso",))} SELECT {_KEYS}, round(p, 3) AS prediction FROM predicted
    WHERE model = 'lasso' AND split = 'test'""",
)
def predict_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).where("split = 'test'")
    scored = predict(rows, _linear(spark, sf_dir), "lasso")
    return rounded(scored.select(*KEY, "prediction"), 3, "prediction")


@query(
    "model_roundtrip",
    f"""{M.tuned()} SELECT {_KEYS}, w.model AS best_model, round(p, 4) AS prediction
    FROM predicted JOIN winner w USING (model) WHERE split = 'val'""",
)
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save all models, load them, predict with the loaded best one."""
    path = fresh_path(spark, "models")
    save_models(_linear(spark, sf_dir), spark, path)
    loaded = load_models(spark, path)
    scored = predict(_vectors(spark, sf_dir).where("split = 'val'"), loaded)
    named = scored.select(*KEY, F.lit(loaded.best_name).alias("best_model"), "prediction")
    return rounded(named, 4, "prediction")


# --- the whole job on all columns -------------------------------------------------------

_RIDGE_FIT = "ridge AS (SELECT w, b FROM fits WHERE model = 'ridge' AND held = -1 AND alpha = 1)"
# The tree and the line of the job, what they predict, and the better one on validation rows.
_JOB = f"""{M.linear(("ridge",))}, {_RIDGE_FIT}, {M.TRAIN}, {M.tree("t", "train", "y")},
{M.walk("by_tree", "t", "data", f"{_KEYS}, y, split", "p")},
predicted AS (SELECT 'ridge' AS model, split, y, b + list_inner_product(w, x) AS p FROM data, ridge
  UNION ALL SELECT 'random_forest', split, y, p FROM by_tree),
{M.METRICS}, {M.FRESH}, {M.walk("fresh_tree", "t", "fresh", _KEYS, "p")},
answers AS MATERIALIZED (SELECT {_KEYS}, 'ridge' AS model, b + list_inner_product(w, x) AS p FROM fresh, ridge
  UNION ALL SELECT {_KEYS}, 'random_forest', p FROM fresh_tree)"""


def _fold_tree(held: int) -> str:
    """The tree of the other two folds, and its error on the one left out."""
    return f"""train{held} AS MATERIALIZED (SELECT row_number() OVER () AS r, x, y::DOUBLE AS y FROM data WHERE split = 'train' AND fold <> {held}),
{M.tree(f"f{held}", f"train{held}", "y")},
held{held} AS (SELECT x, y FROM data WHERE split = 'train' AND fold = {held}), {M.walk(f"on{held}", f"f{held}", f"held{held}", "y", "p")}"""


_JOB_CV = f"""{", ".join(_fold_tree(h) for h in range(3))},
tree_errors AS ({" UNION ALL ".join(f"SELECT avg((y - p) ** 2) AS mse FROM on{h}" for h in range(3))}),
scores AS (SELECT 'random_forest' AS model, avg(mse) AS cv_mean, stddev_pop(mse) AS cv_std FROM tree_errors
  UNION ALL SELECT model, cv_mean, cv_std FROM cv WHERE model = 'ridge' AND alpha = 1)"""


def _job(spark: SparkSession, sf_dir: str):
    def make():
        path = fresh_path(spark, "job")
        rows = dirty_samples(spark, sf_dir)
        train_job(rows, SPEC, path, list(JOB), models=JOB)
        # The second call finds the artefacts and only loads them.
        return path, *train_job(rows, SPEC, path, list(JOB), models=JOB)

    return _once(spark, sf_dir, "job", make)


@query(
    "train_job",
    f"{_JOB} SELECT {_KEYS}, model = (SELECT model FROM winner) AS is_best, model, round(p, 4) AS prediction FROM answers",
)
def train_job_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepare, train, save, load, then predict the unprepared rows with each model."""
    _, preparation, trained = _job(spark, sf_dir)
    ready = preparation.transform(dirty_samples(spark, sf_dir))
    scored = None
    for name in JOB:
        named = predict(ready, trained, name).select(*KEY, F.lit(name == trained.best_name).alias("is_best"), F.lit(name).alias("model"), "prediction")
        scored = named if scored is None else scored.unionByName(named)
    return rounded(scored, 4, "prediction")


@query(
    "training_summary",
    f"""{_JOB}, {_JOB_CV} SELECT model, {_BY_SPLIT},
      '{{}}' AS best_params, round(any_value(cv_mean), 5) AS cv_mean, round(any_value(cv_std), 5) AS cv_std,
      model = (SELECT model FROM winner) AS is_best, '{",".join(SPEC.model_columns)}' AS features,
      (SELECT count(*) FROM dirty) AS rows_read, (SELECT count(*) FROM data) AS rows_prepared
    FROM metrics JOIN scores USING (model) GROUP BY model""",
)
def training_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _, _ = _job(spark, sf_dir)
    summary = training_summary(spark, path).drop("training_time", "total_time")
    return rounded(summary, 5, *[c for c, t in summary.dtypes if t == "double"])


@query(
    "training_journal",
    f"""WITH {M.DATA} SELECT ordinal, phase, CASE WHEN phase = 'read' THEN (SELECT count(*) FROM dirty)
      WHEN starts_with(phase, 'train') THEN (SELECT count(*) FROM data WHERE split = 'train') ELSE (SELECT count(*) FROM data) END AS rows,
      true AS timed, true AS in_order
    FROM (VALUES (0, 'read'), (1, 'prepare'), (2, 'train random_forest'), (3, 'train ridge'), (4, 'evaluate'), (5, 'save')) t(ordinal, phase)""",
)
def training_journal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job wrote down: every phase once, in order, with its rows and a time that passed."""
    path, _, _ = _job(spark, sf_dir)
    before = F.lag(F.col("started") + F.make_interval(secs=F.col("seconds"))).over(Window.partitionBy().orderBy("ordinal"))
    journal = training_journal(spark, path)
    return journal.select("ordinal", "phase", "rows", (F.col("seconds") > 0).alias("timed"), F.coalesce(F.col("started") >= before - F.expr("INTERVAL 1 MILLISECOND"), F.lit(True)).alias("in_order"))


_GRADE = "CASE WHEN s <= 4 THEN 'Poor' WHEN s <= 6 THEN 'Average' ELSE 'Good' END"


@query(
    "score_batch",
    f"""{_JOB}, scored AS (SELECT {_KEYS}, round_even(p, 1) AS s FROM answers JOIN winner USING (model))
    SELECT {_KEYS}, s AS predicted_quality, {_GRADE} AS quality_category FROM scored""",
)
def score_batch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed files of all columns in, such files out, with the artefacts of the job."""
    _, preparation, trained = _job(spark, sf_dir)
    source, sink = fresh_path(spark, "batch-in"), fresh_path(spark, "batch-out")
    write_delimited(dirty_samples(spark, sf_dir).drop("quality"), source, compression="gzip")
    return score_batch(spark, source, sink, preparation, trained, compression="gzip").select(*KEY, "predicted_quality", "quality_category")


def _details_sql(model: str) -> str:
    return f"""{_JOB}, raw AS (SELECT * FROM answers WHERE model = {model}),
    scored AS (SELECT *, least(greatest(round_even(p, 1), 1), 10) AS s FROM raw)
    SELECT {_KEYS}, round(p, 4) AS prediction, s AS predicted_quality, {_GRADE} AS quality_category,
      CAST(0.0 AS DOUBLE) AS half_width, printf('%.1f - %.1f', s, s) AS interval,
      CASE WHEN s <= 4 THEN 'This wine may have noticeable flaws or defects.'
        WHEN s <= 6 THEN 'This wine is acceptable but not outstanding.'
        ELSE 'This wine should have good to excellent characteristics.' END AS interpretation,
      CASE model WHEN 'ridge' THEN 'Ridge' ELSE 'Random Forest' END AS model_used FROM scored"""


def _details(spark: SparkSession, sf_dir: str, name: str | None) -> DataFrame:
    _, preparation, trained = _job(spark, sf_dir)
    rows = dirty_samples(spark, sf_dir)
    scored = score_table(rows, preparation, trained, name, details=True)
    return rounded(scored.drop(*[c for c in rows.columns if c not in KEY]), 4, "prediction")


@query("score_details", _details_sql("(SELECT model FROM winner)"))
def score_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full answer per row from the best model: score, half-width, interval, interpretation, model."""
    return _details(spark, sf_dir, None)


@query("score_details_forest", _details_sql("'random_forest'"))
def score_details_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer from the forest, which is one tree here and so has no spread."""
    return _details(spark, sf_dir, "random_forest")


@query(
    "score_stream_model",
    f"""{M.linear(("ridge",))}, {_RIDGE_FIT}, {M.STREAMED},
    scored AS (SELECT *, round_even(b + list_inner_product(w, x), 1) AS s FROM streamed, ridge)
    SELECT {_KEYS}, concat_ws(',', {VIOLATIONS}) AS violations, {CHECKS} AS valid,
      CASE WHEN {CHECKS} THEN s END AS predicted_quality, CASE WHEN {CHECKS} THEN {_GRADE} END AS quality_category FROM scored""",
)
def score_stream_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive as files, scored by the ridge model that the job saved."""
    _, preparation, trained = _job(spark, sf_dir)
    arrivals, sink = fresh_path(spark, "arrivals"), fresh_path(spark, "scored-stream")
    rows = dirty_samples(spark, sf_dir)
    rows.write.parquet(arrivals)
    score_stream(
        read_stream(spark, arrivals, rows.schema), lambda df: score_table(df, preparation, trained, "ridge"),
        sink, fresh_path(spark, "stream-checkpoint"), RANGES, SAMPLE_CATEGORIES,
    ).awaitTermination()
    return spark.read.parquet(sink).select(*KEY, "violations", "valid", "predicted_quality", "quality_category")


# --- trees ----------------------------------------------------------------------------


def _stump_cte(name: str, source: str, target: str) -> str:
    """Best single threshold of x for ``target``: greatest between-side sum of squares."""
    return f"""{name}_by AS (SELECT x, count(*) AS n, sum({target}) AS s FROM {source} GROUP BY x),
{name}_cum AS (SELECT x, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl,
  sum(n) OVER () AS n, sum(s) OVER () AS s FROM {name}_by),
{name} AS (SELECT x AS cut, sl / nl AS low, (s - sl) / (n - nl) AS high FROM {name}_cum WHERE nl < n
  ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, x LIMIT 1)"""


_SPLIT = f"{SAMPLES}, {split_cte()}, data AS (SELECT {_KEYS}, alcohol AS x, quality AS y, split, fold FROM split)"
_STUMP = f"{_SPLIT}, train AS (SELECT x, y FROM data WHERE split = 'train'), {_stump_cte('t0', 'train', 'y')}"


@query(
    "forest_stump",
    f"""WITH {_STUMP} SELECT {_KEYS}, round(CASE WHEN x <= cut THEN low ELSE high END, 5) AS prediction,
    CAST(0.0 AS DOUBLE) AS spread FROM data, t0""",
)
def forest_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of one unsampled stump, whose threshold and leaves SQL can find."""
    rows = _alcohol(spark, sf_dir)
    config = ModelConfig(
        lambda seed: RandomForestRegressor(
            numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all", maxBins=MAX_BINS, seed=seed
        )
    )
    trained = quick_train(rows, "quality", "stump", models={"stump": config})
    scored = predict_with_spread(rows, trained)
    return rounded(scored.select(*KEY, "prediction", "spread"), 5, "prediction")


@query(
    "boosted_stumps",
    f"""WITH {_STUMP}, left_over AS (SELECT x, y - CASE WHEN x <= cut THEN low ELSE high END AS r FROM train, t0),
    {_stump_cte("t1", "left_over", "r")}
    SELECT {_KEYS}, round(CASE WHEN x <= t0.cut THEN t0.low ELSE t0.high END
      + 0.1 * CASE WHEN x <= t1.cut THEN t1.low ELSE t1.high END, 5) AS prediction FROM data, t0, t1""",
)
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boosting rounds of stumps at learning rate 0.1."""
    rows = _alcohol(spark, sf_dir)
    config = ModelConfig(
        lambda seed: GBTRegressor(
            maxIter=2, maxDepth=1, stepSize=step_size(0.1), lossType="squared", maxBins=MAX_BINS, seed=seed
        )
    )
    trained = quick_train(rows, "quality", "stumps", models={"stumps": config})
    return rounded(predict(rows, trained).select(*KEY, "prediction"), 5, "prediction")


@query(
    "forest_tree",
    f"""WITH {M.DATA}, {M.TRAIN}, {M.tree("t", "train", "y")}, {M.walk("answer", "t", "data", f"{_KEYS}, split", "p")}
    SELECT {_KEYS}, split, round(p, 5) AS prediction FROM answer""",
)
def forest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of depth three on all columns: SQL searches every threshold of every column in every node."""
    rows = _vectors(spark, sf_dir)
    trained = quick_train(rows, "quality", "tree", models={"tree": _tree(maxDepth=3)}, validate=False)
    return rounded(predict(rows, trained).select(*KEY, "split", "prediction"), 5, "prediction")


_ROUNDS = 3


def _boosted_sql() -> str:
    steps, rows, target = [], "train", "y"
    for k in range(_ROUNDS):
        rate = 1.0 if k == 0 else 0.1
        steps += [M.tree(f"b{k}", rows, target), M.walk(f"step{k}", f"b{k}", rows, f"r, {target}", "p"),
                  f"left{k} AS MATERIALIZED (SELECT r, x, {target} - {rate} * p AS rest FROM step{k})"]
        rows, target = f"left{k}", "rest"
    steps.append("answer0 AS (SELECT *, 0.0 AS total FROM data)")
    for k in range(_ROUNDS):
        rate = 1.0 if k == 0 else 0.1
        steps += [M.walk(f"walked{k}", f"b{k}", f"answer{k}", f"{_KEYS}, split, total", "p"),
                  f"answer{k + 1} AS MATERIALIZED (SELECT {_KEYS}, split, x, total + {rate} * p AS total FROM walked{k})"]
    return f"WITH {M.DATA}, {M.TRAIN}, {', '.join(steps)} SELECT {_KEYS}, split, round(total, 4) AS prediction FROM answer{_ROUNDS}"


@query("boosted_trees", _boosted_sql())
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boosting rounds of trees of depth three on all columns at learning rate 0.1."""
    rows = _vectors(spark, sf_dir)
    config = ModelConfig(
        lambda seed: GBTRegressor(
            maxIter=_ROUNDS, maxDepth=3, stepSize=step_size(0.1), lossType="squared", maxBins=MAX_BINS, seed=seed
        )
    )
    trained = quick_train(rows, "quality", "trees", models={"trees": config}, validate=False)
    return rounded(predict(rows, trained).select(*KEY, "split", "prediction"), 4, "prediction")


@query(
    "feature_importance",
    f"""WITH {M.DATA}, {M.TRAIN}, {M.tree("t", "train", "y")}, {M.importances("t")}
    SELECT feature, round(importance, 5) AS importance FROM importances""",
)
def feature_importance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of the job's tree, whose gains SQL adds up by itself."""
    entry = _job(spark, sf_dir)[2].models["random_forest"]
    return rounded(feature_importance(spark, entry, SPEC.model_columns), 5, "importance")


# --- ensembles of the catalogue's size ----------------------------------------------------


def _full_job(spark: SparkSession, sf_dir: str):
    def make():
        path = fresh_path(spark, "job-full")
        # Queries that look at the forest's prepared rows share one preparation with it.
        prepared = _prepared(spark, sf_dir)
        return train_job(dirty_samples(spark, sf_dir), SPEC, path, list(FULL_JOB), models=FULL_JOB, validate=False, prepared=prepared)

    return _once(spark, sf_dir, "job-full", make)


_AUDIT = "CAST(0 AS BIGINT) AS wrong_counts, CAST(0 AS BIGINT) AS wrong_means, CAST(0 AS BIGINT) AS wrong_gains, CAST(0 AS BIGINT) AS wrong_order"


def _importances_agree(spark: SparkSession, nodes: DataFrame, entry) -> bool:
    """Whether the model's importances are those of its nodes' gains."""
    told = feature_importance(spark, entry, SPEC.model_columns).withColumnRenamed("importance", "told")
    both = importance_of_nodes(nodes, SPEC.model_columns).join(told, "feature", "full")
    gap = F.max(F.coalesce(F.abs(F.col("importance") - F.col("told")), F.lit(1.0)))
    return both.agg(gap < 1e-6).first()[0]


@query("fit_random_forest", f"SELECT i::INTEGER AS tree, {_AUDIT}, true AS importances_agree FROM range(100) t(i)")
def fit_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred trees of all columns: errors in the bookkeeping of each tree's nodes, and of the importances. SQL states none."""
    entry = _full_job(spark, sf_dir)[1].models["random_forest"]
    nodes = write_through(node_table(spark, entry.model), "nodes")
    return audit_nodes(nodes).drop("nodes").withColumn("importances_agree", F.lit(_importances_agree(spark, nodes, entry)))


@query("fit_gbt", f"SELECT i::INTEGER AS tree, {_AUDIT}, CAST(0 AS BIGINT) AS wrong_leaves FROM range(100) t(i)")
def fit_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rounds on all columns: errors in the nodes, and leaves that are not the mean of what the rounds before left.

    Every training row is followed through all rounds: what is left of its target before each, and
    the leaf it comes to. SQL states that nothing is wrong.
    """
    entry = _boosting(spark, sf_dir).models["gradient_boosting"]
    nodes = write_through(node_table(spark, entry.model), "nodes")
    weights = {r["tree"]: r["weight"] for r in nodes.select("tree", "weight").distinct().collect()}
    train = _vectors(spark, sf_dir).where("split = 'train'").select("features", F.col("quality").cast("double").alias("y"))
    found = boosted_leaf_means(train, entry.model, "y", leaf_values(nodes), np.array([weights[t] for t in sorted(weights)]))
    in_tree = Window.partitionBy("tree").orderBy("node")
    leaves = nodes.where("feature IS NULL").select("tree", "node", "prediction")
    placed = leaves.withColumn("leaf", F.row_number().over(in_tree) - 1)
    right = F.abs(F.col("mean") - F.col("prediction")) < 1e-6
    wrong = placed.join(found, ["tree", "leaf"], "full").groupBy("tree").agg(F.count_if(~F.coalesce(right, F.lit(False))).alias("wrong_leaves"))
    return audit_nodes(nodes).drop("nodes").join(wrong, "tree")


@query(
    "train_job_full",
    f"""{M.linear(("ridge",))}, {_RIDGE_FIT}, {M.FRESH} SELECT {_KEYS}, round(b + list_inner_product(w, x), 4) AS prediction FROM fresh, ridge""",
)
def train_job_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with a hundred-tree forest and ridge, then the unprepared rows with the best model.

    Targets of the table are lines with noise, so the line wins on validation rows; SQL states its predictions.
    """
    preparation, trained = _full_job(spark, sf_dir)
    scored = predict(preparation.transform(dirty_samples(spark, sf_dir)), trained)
    return rounded(scored.select(*KEY, "prediction"), 4, "prediction")


@query("predict_spread")
def predict_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = predict_with_spread(_vectors(spark, sf_dir), _full_job(spark, sf_dir)[1], "random_forest")
    return scored.select(*KEY, "prediction", "spread")


_OPTIMAL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{c}' AS feature, CAST(0.0 AS DOUBLE) AS violation" for m in LINEAR for c in SPEC.model_columns
)


@query("linear_optimality", _OPTIMAL)
def linear_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalised models of all columns: how far each coefficient is from the conditions of the optimum.

    The mean product of residual and column must equal the penalty's slope at a coefficient,
    and stay within the absolute penalty where the coefficient is 0. SQL states the zeros.
    """
    def make() -> ModelSet:
        vectors = assemble(_prepared(spark, sf_dir)[0], SPEC.model_columns)
        return train_all(vectors, "quality", list(LINEAR), tune=False)

    trained = _once(spark, sf_dir, "linear-full", make)
    prepared, _ = _prepared(spark, sf_dir)
    train = assemble(prepared.where("split = 'train'"), SPEC.model_columns)
    scored, predictions = with_predictions(trained, train)
    cells = []
    for name in LINEAR:
        estimator = MODELS[name].build(42)
        weights = trained.models[name].model.coefficients.toArray()
        alpha, share = estimator.getOrDefault("alpha"), estimator.getOrDefault("l1_share")
        scale = F.count(F.lit(1)) if estimator.getOrDefault("summed_loss") else F.lit(1)
        for c, w in zip(SPEC.model_columns, weights.tolist(), strict=True):
            slope = F.avg((F.col("quality") - F.col(predictions[name])) * F.col(c)) - alpha * (1 - share) * w / scale
            absolute = alpha * share / scale
            violation = F.abs(slope - absolute * (1 if w > 0 else -1)) if w else F.greatest(F.abs(slope) - absolute, F.lit(0.0))
            cells.append(F.struct(F.lit(name).alias("model"), F.lit(c).alias("feature"), F.abs(F.round(violation, 4)).alias("violation")))
    return scored.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@query("spread_check", "SELECT CAST(0 AS BIGINT) AS mismatches, true AS some_spread")
def spread_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread over a forest's trees, against the values of each row's leaves in the saved trees.

    Every row is compared in its own task: nothing is exploded or shuffled, and a row needs no key of its own.
    """
    trained = _full_job(spark, sf_dir)[1]
    forest = trained.models["random_forest"].model
    nodes = write_through(node_table(spark, forest), "nodes")
    scored = predict_with_spread(_vectors(spark, sf_dir), trained, "random_forest")
    found = spread_gaps(scored, forest, "prediction", "spread", leaf_values(nodes))
    return found.agg(F.coalesce(F.sum("mismatches"), F.lit(0)).alias("mismatches"), (F.max("spread") > 0).alias("some_spread"))
