"""Fitting a preparation on a table and applying it to others."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.numeric import missing_as_null
from assayline.operators.cleaning import drop_duplicates, fill_missing, fit_medians
from assayline.operators.features import Labels, align_schema, fit_labels, fit_scaler, scale
from assayline.operators.outliers import treat_outliers
from assayline.operators.split import draw_of, fold_of, stratified_split
from assayline.operators.wide import identifier, number, present, quoted
from assayline.session import write_through
from assayline.spec import TableSpec

# Version of the saved state.
VERSION = 1
# Columns of the written cleaned table beside its own.
DRAW, FOLD = "__split_draw", "__split_fold"


@dataclass(frozen=True)
class Preparation:
    """Everything learned from the fitted table: a few numbers per column and the labels."""

    spec: TableSpec
    medians: dict[str, float]
    labels: Labels
    scaler: dict[str, tuple[float, float]]
    seed: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Append the model columns as vector ``features``; rows and columns stay as they are.

        Missing values take the fitted medians, an unseen or missing category code 0, an
        absent column 0. The result is a projection of the input, with one lookup of the category's
        code in the labels' table, which the planner broadcasts where it is small.
        """
        if self.spec.category and self.spec.category in df.columns:
            original = quoted(self.spec.category)
            df = df.withColumn("__code", original)
            df = self.labels.encode(df, "__code")
        cells = []
        for name in self.spec.model_columns:
            if name not in df.columns:
                value = "0D"
            elif name == self.spec.category:
                value = "CAST(__code AS DOUBLE)"
            elif name in self.medians:
                value = f"coalesce({present(name)}, {number(self.medians[name])})"
            else:
                value = present(name)
            mean, deviation = self.scaler[name]
            cells.append(f"({value} - {number(mean)}) / {number(deviation)}")
        vector = array_to_vector(F.expr(f"array({', '.join(cells)})"))
        return df.withColumn("features", vector).drop("__code")

    def transform_columns(self, df: DataFrame) -> DataFrame:
        """The model columns alone, filled, encoded, aligned and scaled."""
        df = fill_missing(df, {c: m for c, m in self.medians.items() if c in df.columns})
        if self.spec.category and self.spec.category in df.columns:
            df = self.labels.encode(df, self.spec.category)
        return scale(align_schema(df, self.spec.model_columns), self.scaler)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the state as two small tables."""
        rows = [
            (c, i, self.medians.get(c), *self.scaler[c]) for i, c in enumerate(self.spec.model_columns)
        ]
        schema = "feature string, position int, median double, mean double, deviation double"
        meta = json.dumps(
            {
                "version": VERSION,
                "digest": self.digest(),
                "features": self.spec.features,
                "category": self.spec.category,
                "target": self.spec.target,
                "key": self.spec.key,
                "seed": self.seed,
            }
        )
        if self.labels.table is not None:
            self.labels.table.write.mode("overwrite").parquet(f"{path}/labels")
        state = spark.createDataFrame(rows, schema).withColumn("meta", F.lit(meta))
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    def digest(self) -> str:
        """Digest of the columns, their order and all fitted numbers: two states with one digest prepare alike."""
        numbers = [[c, self.medians.get(c), *self.scaler[c]] for c in self.spec.model_columns]
        state = [list(self.spec.features), self.spec.category, self.spec.target, list(self.spec.key), self.seed, numbers]
        return hashlib.sha256(json.dumps(state).encode()).hexdigest()

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        """Read a saved state; one of another version, or whose numbers are not those that were saved, is refused."""
        rows = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
        meta = json.loads(rows[0]["meta"])
        labels = Labels(spark.read.parquet(f"{path}/labels")) if meta["category"] else Labels()
        if meta.get("version") != VERSION:
            raise ValueError(f"{path} holds a preparation of version {meta.get('version')}, not {VERSION}")
        found = Preparation(
            spec=TableSpec(
                tuple(meta["features"]), meta["category"], meta["target"], tuple(meta["key"])
            ),
            medians={r["feature"]: r["median"] for r in rows if r["median"] is not None},
            labels=labels,
            scaler={r["feature"]: (r["mean"], r["deviation"]) for r in rows},
            seed=meta["seed"],
        )
        if found.digest() != meta["digest"]:
            raise ValueError(f"{path} is not as it was saved")
        return found


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Append already prepared columns as vector ``features``."""
    cells = ", ".join(f"CAST({identifier(c)} AS DOUBLE)" for c in columns)
    return df.withColumn("features", array_to_vector(F.expr(f"array({cells})")))


def clean(
    df: DataFrame, spec: TableSpec, outliers: str | None = None, derived: Mapping[str, Column] | None = None
) -> tuple[DataFrame, dict[str, float]]:
    """Median-filled, duplicate-free rows that have a target, with ``derived`` columns of them, and the medians.

    The result is a written table, or a filter or projection of it under an outlier policy:
    the following fits read a few of its columns each, and the shuffle that removes
    duplicates runs once.
    """
    labelled = missing_as_null(df)
    if spec.target:
        labelled = labelled.where(quoted(spec.target).isNotNull())
    medians = fit_medians(labelled, spec.features)
    cleaned = write_through(drop_duplicates(fill_missing(labelled, medians)).withColumns(derived or {}), "cleaned")
    if outliers:
        cleaned = treat_outliers(cleaned, spec.features, outliers)
    return cleaned, medians


def fit_preparation(
    df: DataFrame,
    spec: TableSpec,
    seed: int = 42,
    folds: int = 3,
    outliers: str | None = None,
) -> tuple[DataFrame, Preparation]:
    """Clean, encode, split and standardise a table.

    Returns the prepared rows (key, target, model columns, ``split``, ``fold``) and the
    fitted state. Labels come from all cleaned rows, means and deviations from train rows.
    """
    # Digests of a key cost more than reading a row, so they are taken once and written with it; those of
    # whole rows, or of cells that an outlier policy may clip, belong to the rows as they are after it.
    early = bool(spec.key) and not (outliers and set(spec.key) & set(spec.features))
    derived = {DRAW: draw_of(spec.key, seed), FOLD: fold_of(spec.key, folds, seed)} if early else {}
    cleaned, medians = clean(df, spec, outliers, derived)
    key = list(spec.key) or cleaned.columns
    if spec.category:
        labels = fit_labels(cleaned, spec.category)
    else:
        labels = Labels()
    split = stratified_split(cleaned, spec.target, key, seed, drawn=DRAW if early else None)
    split = split.withColumn("fold", F.col(FOLD) if early else fold_of(key, folds, seed)).drop(FOLD)
    if spec.category:
        split = labels.encode(split, spec.category)
    scaler = fit_scaler(split.where(F.col("split") == "train"), spec.model_columns)
    kept = [*spec.key, spec.target, *spec.model_columns, "split", "fold"]
    prepared = scale(split, scaler).select(*[quoted(c) for c in kept])
    return prepared, Preparation(spec, medians, labels, scaler, seed)
