"""Ridge, lasso and elastic net with absolute penalties."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.models.gram import Sums, fold_sums, shifts, solve


class PenalisedRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter):
    """Least squares with penalty ``alpha * (l1_share*|w| + (1-l1_share)/2 * w²)`` per row.

    ``summed_loss`` states the loss as a sum over rows instead of their mean, the usual
    form of ridge, so the penalty is divided by the row count.

    ``solver`` "sums" reads the rows twice, for the means and for the products of what is left of each column
    (see ``gram``), whatever the number of penalties; they make a matrix as wide as the features. "iterative" hands
    centred columns to MLlib for tables of very many columns. MLlib scales the squared
    penalty by the deviation of the label; the mapping below undoes that.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty weight", TypeConverters.toFloat)
    l1_share = Param(Params._dummy(), "l1_share", "share of the absolute penalty", TypeConverters.toFloat)
    summed_loss = Param(Params._dummy(), "summed_loss", "loss is a sum over rows", TypeConverters.toBoolean)
    solver = Param(Params._dummy(), "solver", "sums or iterative", TypeConverters.toString)

    @keyword_only
    def __init__(
        self,
        *,
        alpha: float = 1.0,
        l1_share: float = 0.0,
        summed_loss: bool = False,
        maxIter: int = 1000,
        solver: str = "sums",
        featuresCol: str = "features",
        labelCol: str = "label",
        predictionCol: str = "prediction",
    ):
        super().__init__()
        self._setDefault(alpha=1.0, l1_share=0.0, summed_loss=False, maxIter=1000, solver="sums")
        self._set(**self._input_kwargs)

    def penalty(self) -> tuple[float, float, bool]:
        return self.getOrDefault("alpha"), self.getOrDefault("l1_share"), self.getOrDefault("summed_loss")

    def fitMultiple(
        self, dataset: DataFrame, paramMaps: Sequence[dict]
    ) -> Iterator[tuple[int, LinearRegressionModel]]:
        """Fit several penalties on one table, whose sums (or means) are taken once for all of them."""
        variants = [self.copy(p) for p in paramMaps]
        facts = {}
        for v in variants:
            if v._table() not in facts:
                facts[v._table()] = v._facts(dataset)
        return _FitMultipleIterator(lambda i: variants[i]._fitted(dataset, facts[variants[i]._table()]), len(variants))

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        return self._fitted(dataset, self._facts(dataset))

    def _table(self) -> tuple[str, str, str]:
        return self.getLabelCol(), self.getFeaturesCol(), self.getOrDefault("solver")

    def _facts(self, dataset: DataFrame):
        label, features, solver = self._table()
        if solver not in ("sums", "iterative"):
            raise ValueError(f"unknown solver {solver!r}")
        found = fold_sums(dataset, label, None, 1, features) if solver == "sums" else self._label_facts(dataset, label, features)
        if not found:
            raise ValueError("no labelled rows")
        return found

    def fit_sums(self, dataset: DataFrame, sums: Sums) -> LinearRegressionModel:
        """The model of rows whose sums are known; reads none of them."""
        return self._fitted(dataset, [sums])

    def _fitted(self, dataset: DataFrame, facts) -> LinearRegressionModel:
        if self.getOrDefault("solver") == "sums":
            weights, intercept = solve(facts[0], *self.penalty())
            return self._model(dataset, weights, facts[0].unshifted(weights, intercept))
        n, deviation, shift_x, shift_y = facts
        label, features, _ = self._table()
        centred = dataset.where(F.col(label).isNotNull()).select(F.col(features), (F.col(label).cast("double") - shift_y).alias("__label"))
        centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="__features").fit(centred).transform(centred)
        found = self._solver(n, deviation).fit(centred)
        weights = found.coefficients.toArray()
        return self._model(dataset, weights, shift_y + found.intercept - float(weights @ shift_x))

    def _model(self, dataset: DataFrame, weights: np.ndarray, intercept: float) -> LinearRegressionModel:
        """A model of MLlib with given numbers; the class has no constructor for them in Python."""
        context = dataset.sparkSession.sparkContext
        java = context._jvm.org.apache.spark.ml.regression.LinearRegressionModel
        model = LinearRegressionModel(java(LinearRegression._randomUID(), _py2java(context, Vectors.dense(weights)), float(intercept)))
        model.setFeaturesCol(self.getFeaturesCol()).setPredictionCol(self.getPredictionCol())
        return model._set(labelCol=self.getLabelCol())

    @staticmethod
    def _label_facts(dataset: DataFrame, label: str, features: str) -> tuple[int, float, np.ndarray, float] | None:
        found = shifts(dataset, label, features)
        if found is None:
            return None
        shift_x, shift_y, n = found
        deviation = dataset.agg(F.stddev_pop(F.col(label).cast("double"))).first()[0]
        return n, deviation or 0.0, shift_x, shift_y

    def _solver(self, n: int, deviation: float) -> LinearRegression:
        weight, share, summed = self.penalty()
        if summed:
            weight = weight / max(n, 1)
        absolute = weight * share
        squared = weight * (1.0 - share) * deviation
        total = absolute + squared
        return LinearRegression(
            featuresCol="__features",
            labelCol="__label",
            maxIter=self.getMaxIter(),
            tol=1e-9,
            regParam=total,
            elasticNetParam=absolute / total if total else 0.0,
            standardization=False,
            solver="normal",
        )
