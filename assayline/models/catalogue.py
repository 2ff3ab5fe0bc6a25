"""The models that can be trained by name, with their search grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from assayline.models.regression import PenalisedRegression

# MLlib's greatest tree depth stands for "unlimited".
UNLIMITED_DEPTH = 30
# Candidate thresholds per feature; finer than MLlib's 32, still a fixed statistics size.
MAX_BINS = 128


@dataclass(frozen=True)
class ModelConfig:
    """How to build an estimator from a seed, and the parameter grid of its search."""

    build: Callable[[int], Estimator]
    grid: Mapping[str, Sequence] = field(default_factory=dict)


def _forest(seed: int) -> Estimator:
    return RandomForestRegressor(
        numTrees=100,
        maxDepth=UNLIMITED_DEPTH,
        minInstancesPerNode=1,
        featureSubsetStrategy="all",
        maxBins=MAX_BINS,
        seed=seed,
    )


def step_size(learning_rate: float) -> float:
    """MLlib step for a learning rate stated against plain residuals.

    For squared loss MLlib fits its trees to the negative gradient, which is twice the
    residual, so an equal shrinkage needs half the step.
    """
    return learning_rate / 2.0


def _boosting(seed: int) -> Estimator:
    return GBTRegressor(
        maxIter=100, stepSize=step_size(0.1), maxDepth=3, lossType="squared", maxBins=MAX_BINS, seed=seed
    )


# Names, defaults and search grids.
MODELS: dict[str, ModelConfig] = {
    "random_forest": ModelConfig(
        _forest,
        {
            "numTrees": [100, 200],
            "maxDepth": [10, 20, UNLIMITED_DEPTH],
            "minInstancesPerNode": [1, 2],
        },
    ),
    "gradient_boosting": ModelConfig(
        _boosting,
        {"maxIter": [100, 200], "stepSize": [step_size(0.1), step_size(0.2)], "maxDepth": [3, 5]},
    ),
    "ridge": ModelConfig(
        lambda seed: PenalisedRegression(alpha=1.0, l1_share=0.0, summed_loss=True),
        {"alpha": [0.1, 1.0, 10.0, 100.0]},
    ),
    "lasso": ModelConfig(
        lambda seed: PenalisedRegression(alpha=1.0, l1_share=1.0, maxIter=2000),
        {"alpha": [0.01, 0.1, 1.0, 10.0]},
    ),
    "elastic_net": ModelConfig(
        lambda seed: PenalisedRegression(alpha=1.0, l1_share=0.5, maxIter=2000),
        {"alpha": [0.01, 0.1, 1.0, 10.0], "l1_share": [0.5]},
    ),
}

# Trained when no names are given.
DEFAULT_MODELS = ("random_forest", "gradient_boosting", "ridge", "lasso")
