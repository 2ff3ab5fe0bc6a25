"""Predictions with one trained model, optionally with their spread over the ensemble."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.models.training import ModelSet
from assayline.models.trees import Spread


def predict(df: DataFrame, trained: ModelSet, name: str | None = None, column: str = "prediction") -> DataFrame:
    """Add the prediction of the named model (the best one by default)."""
    model = trained.get(name).model
    return model.transform(df, {model.predictionCol: column})


def predict_with_spread(
    df: DataFrame,
    trained: ModelSet,
    name: str | None = None,
    column: str = "prediction",
    spread: str = "spread",
) -> DataFrame:
    """Add the prediction and the population deviation over the trees of a forest.

    Three predictions tell both, however many trees there are (see ``Spread``); the two further forests that
    this takes are written once per model. Nothing is exploded, joined or shuffled, and the plan
    also runs on a stream. Linear models have spread 0;
    boosted trees are stages of one sum, not votes, so their spread is unknown (NULL).
    """
    entry = trained.get(name)
    model = entry.model
    if isinstance(model, RandomForestRegressionModel):
        if "spread" not in entry.derived:
            entry.derived["spread"] = Spread(df.sparkSession, model)
        return entry.derived["spread"].transform(df, column, spread)
    df = predict(df, trained, name, column)
    unknown = isinstance(model, GBTRegressionModel)
    return df.withColumn(spread, F.lit(None if unknown else 0.0).cast("double"))
