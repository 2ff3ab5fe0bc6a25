"""Penalised linear models and their cross-validation from sums of products.

Everything such a model needs of a table are counts, sums and products of its columns. A first scan
takes the mean of every column; a second one adds up products of the columns less these means, once
per fold, so that columns far from 0 lose no digits. The sums of a training part are the total less its
fold's, each solution is a small system, and each held-out error follows from the fold's sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators.comoments import product_sums
from assayline.operators.wide import number


@dataclass
class Sums:
    """Of some rows: number, sums of x and y less ``shift_x`` and ``shift_y``, and of their products."""

    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    shift_x: np.ndarray
    shift_y: float
    # Labelled rows of the whole table, in a fold or in none.
    labelled: int = 0

    def __sub__(self, other: Sums) -> Sums:
        return self._with(other, -1.0)

    def __add__(self, other: Sums) -> Sums:
        return self._with(other, 1.0)

    def _with(self, other: Sums, sign: float) -> Sums:
        """Sums about the same shifts can be added and taken away."""
        names = ("n", "x", "y", "xx", "xy", "yy")
        return replace(self, **{f: getattr(self, f) + sign * getattr(other, f) for f in names})

    def error(self, weights: np.ndarray, intercept: float) -> float:
        """Mean squared error on these rows of a model of the shifted columns."""
        total = (
            self.yy - 2 * weights @ self.xy - 2 * intercept * self.y + weights @ self.xx @ weights + 2 * intercept * (weights @ self.x) + self.n * intercept**2
        )
        return max(float(total) / float(self.n), 0.0)

    def unshifted(self, weights: np.ndarray, intercept: float) -> float:
        """The intercept of the same model for columns as they are."""
        return float(self.shift_y + intercept - weights @ self.shift_x)


def shifts(df: DataFrame, label: str, features: str) -> tuple[np.ndarray, float, int] | None:
    """Mean of every feature and of the label over labelled rows, and their number; None without such rows."""
    # Grouped, as the summary of no rows is an error.
    labelled = df.where(F.col(label).isNotNull()).groupBy(F.lit(1))
    found = labelled.agg(Summarizer.mean(F.col(features)).alias("x"), F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n")).first()
    return (found["x"].toArray(), found["y"], found["n"]) if found else None


def fold_sums(df: DataFrame, label: str, fold: str | None, folds: int, features: str = "features") -> list[Sums]:
    """Sums of the labelled rows of each fold 0.., and of the rows of any other fold (not of none).

    Without ``fold`` all rows count as fold 0.
    """
    found = shifts(df, label, features)
    if found is None:
        return []
    shift_x, shift_y, labelled = found
    place = F.lit(0)
    if fold is not None:
        place = F.when(F.col(fold).between(0, folds - 1), F.col(fold)).when(F.col(fold).isNotNull(), folds)
    rows = df.select(place.alias("fold"), vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.where("y IS NOT NULL AND fold IS NOT NULL")
    own = [*(f"x[{i}] - {number(c)}" for i, c in enumerate(shift_x)), f"y - {number(shift_y)}", "1D"]
    # One block of columns per fold, 0 in the rows of others: the blocks of the matrix are the folds' sums.
    blocks = folds if fold is None else folds + 1
    matrix = product_sums(rows, [f"CASE WHEN fold = {f} THEN {c} ELSE 0D END" for f in range(blocks) for c in own])
    d, sums = len(shift_x), []
    for f in range(blocks):
        m = matrix[f * (d + 2) : (f + 1) * (d + 2), f * (d + 2) : (f + 1) * (d + 2)]
        sums.append(Sums(m[-1, -1], m[:d, -1], m[d, -1], m[:d, :d], m[:d, d], m[d, d], shift_x, shift_y, labelled))
    return sums


def solve(sums: Sums, alpha: float, l1_share: float, summed_loss: bool, passes: int = 10_000, tol: float = 1e-13) -> tuple[np.ndarray, float]:
    """Weights, and intercept for the shifted columns; see ``PenalisedRegression`` for the penalty."""
    weight = alpha / sums.n if summed_loss else alpha
    absolute, squared = weight * l1_share, weight * (1.0 - l1_share)
    mean_x, mean_y = sums.x / sums.n, sums.y / sums.n
    gram = sums.xx / sums.n - np.outer(mean_x, mean_x) + squared * np.eye(len(mean_x))
    target = sums.xy / sums.n - mean_x * mean_y
    if absolute == 0.0:
        found = np.linalg.lstsq(gram, target, rcond=None)[0]
    else:
        found = np.zeros(len(mean_x))
        for _ in range(passes):
            largest = 0.0
            for i in range(len(found)):
                if gram[i, i] <= 0.0:
                    continue
                rest = target[i] - gram[i] @ found + gram[i, i] * found[i]
                new = np.sign(rest) * max(abs(rest) - absolute, 0.0) / gram[i, i]
                largest = max(largest, abs(new - found[i]))
                found[i] = new
            if largest < tol:
                break
    return found, float(mean_y - mean_x @ found)


def cross_validate_linear(parts: Sequence[Sums], estimator, points: Sequence[dict], folds: int) -> list[list[float]]:
    """Mean squared error per grid point and fold, from the sums of the folds."""
    if not parts:
        raise ValueError("fold 0 holds no labelled rows")
    if empty := [f for f in range(folds) if not parts[f].n]:
        raise ValueError(f"fold {empty[0]} holds no labelled rows")
    whole = sum(parts[1:], parts[0])
    errors = []
    for point in points:
        model = estimator.copy({estimator.getParam(k): v for k, v in point.items()})
        errors.append([parts[f].error(*solve(whole - parts[f], *model.penalty())) for f in range(folds)])
    return errors
