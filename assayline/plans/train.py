"""Training job: prepare, train, save; does nothing where artefacts already exist."""

from __future__ import annotations

import inspect
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.models.persistence import load_models, save_models
from assayline.models.training import ModelSet, evaluate_models, train_all, train_one
from assayline.operators.evaluate import model_comparison
from assayline.operators.outliers import POLICIES
from assayline.operators.profile import table_info
from assayline.operators.wide import quoted
from assayline.plans.prepare import Preparation, assemble, fit_preparation
from assayline.session import write_through
from assayline.spec import TableSpec


JOURNAL_SCHEMA = "run string, ordinal int, phase string, started timestamp, seconds double, rows long"


def artefacts_exist(spark: SparkSession, path: str) -> bool:
    """Whether a finished training job left its outcome under ``path``."""
    try:
        spark.read.parquet(f"{path}/training")
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


class Journal:
    """Phases of a job, appended to a table under its path as they end: an unfinished job shows how far it came."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ordinal = spark, f"{path}/journal", 0
        self.run = uuid.uuid4().hex

    @contextmanager
    def phase(self, name: str) -> Iterator[dict]:
        """Time what is done inside; set ``rows`` of what is given to the number of rows the phase worked on.

        A phase that fails is written down too, without rows."""
        found: dict = {"rows": None}
        started, clock = datetime.now(UTC), time.monotonic()
        try:
            yield found
        finally:
            row = (self.run, self.ordinal, name, started, time.monotonic() - clock, found["rows"])
            self.spark.createDataFrame([row], JOURNAL_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.ordinal += 1


def training_journal(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(ordinal, phase, started, seconds, rows)`` of the run that finished the job."""
    journal = spark.read.schema(JOURNAL_SCHEMA).parquet(f"{path}/journal")
    # A few rows per run; the run that saved its models is the last one that did anything.
    finished = journal.where("phase = 'save'").agg(F.max_by("run", "started").alias("run"))
    return journal.join(F.broadcast(finished), "run").drop("run").orderBy("ordinal")


def train_job(
    df: DataFrame,
    spec: TableSpec,
    path: str,
    names: Sequence[str] = ("random_forest", "ridge"),
    tune: bool = False,
    folds: int = 3,
    outliers: str | None = None,
    seed: int = 42,
    prepared: tuple[DataFrame, Preparation] | None = None,
    **options,
) -> tuple[Preparation, ModelSet]:
    """Load the artefacts under ``path``, or train and save them first if there are none.

    ``folds`` and ``outliers`` (a policy of ``treat_outliers``) go to the preparation;
    ``options`` go to ``train_all``. Unknown options raise before any work. ``prepared`` is what
    ``fit_preparation`` gave for these rows and arguments, where a caller has that already; give written rows. Prepared rows
    are written and read again by each pass, not kept in memory beside what the models keep, so a table may be larger than that.
    """
    spark = df.sparkSession
    known = set(inspect.signature(train_all).parameters) | set(inspect.signature(train_one).parameters)
    if unknown := set(options) - known:
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    if folds < 2:
        raise ValueError("at least two folds are needed")
    if outliers is not None and outliers not in POLICIES:
        raise ValueError(f"unknown policy {outliers!r}, expected one of {POLICIES}")
    if not artefacts_exist(spark, path):
        journal = Journal(spark, path)
        with journal.phase("read") as done:
            info = write_through(table_info(df), "table-info")
            info.write.mode("overwrite").parquet(f"{path}/table")
            done["rows"] = info.agg(F.max("rows")).first()[0]
        with journal.phase("prepare") as done:
            rows, preparation = prepared or fit_preparation(df, spec, seed=seed, folds=folds, outliers=outliers)
            if prepared is None:
                names_kept = dict.fromkeys([*spec.model_columns, spec.target, "split", "fold"])
                rows = write_through(rows.select(*[quoted(c) for c in names_kept]), "prepared")
            vectors = assemble(rows, spec.model_columns).select("features", spec.target, "split", "fold")
            sizes = {r["split"]: r["count"] for r in vectors.groupBy("split").count().collect()}
            done["rows"] = sum(sizes.values())

        @contextmanager
        def training(name: str) -> Iterator[None]:
            with journal.phase(f"train {name}") as done:
                yield
                done["rows"] = sizes.get("train", 0)

        trained = train_all(vectors, spec.target, names, tune, folds=folds, seed=seed, phase=training, **options)
        with journal.phase("evaluate") as done:
            metrics = evaluate_models(trained, vectors, spec.target)
            metrics.coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")
            done["rows"] = sum(sizes.values())
        with journal.phase("save") as done:
            preparation.save(spark, f"{path}/preparation")
            save_models(trained, spark, path)
            done["rows"] = sum(sizes.values())
    return Preparation.load(spark, f"{path}/preparation"), load_models(spark, path)


def training_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per model of a finished job: comparison, parameters, times, best flag, rows read and prepared.

    ``training_journal`` has the times of all phases, the table ``table`` under ``path`` what was read.
    """
    training = spark.read.parquet(f"{path}/training").where(F.col("error").isNull())
    metrics = spark.read.parquet(f"{path}/metrics")
    columns = spark.read.parquet(f"{path}/preparation/columns").orderBy("position").collect()
    features = ",".join(r["feature"] for r in columns)
    compared = model_comparison(
        metrics, training.select("model", "best_params", "cv_mean", "cv_std", "training_time", "is_best")
    )
    total = F.sum("training_time").over(Window.partitionBy())  # one row per model
    rows = {r["phase"]: r["rows"] for r in training_journal(spark, path).collect()}
    counts = {"rows_read": F.lit(rows["read"]), "rows_prepared": F.lit(rows["prepare"])}
    return compared.withColumns({"features": F.lit(features), "total_time": total, **counts})
