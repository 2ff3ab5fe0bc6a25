"""Canonical column names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

# Alternative spelling -> canonical name.
ALIASES = {
    "fixed_acidity": "fixed acidity",
    "volatile_acidity": "volatile acidity",
    "citric_acid": "citric acid",
    "residual_sugar": "residual sugar",
    "free_sulfur_dioxide": "free sulfur dioxide",
    "total_sulfur_dioxide": "total sulfur dioxide",
    "ph": "pH",
}


def canonical_names(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Rename the columns spelled as in ``aliases``; the others keep their name.

    Names are compared exactly, although Spark resolves them without regard to case.
    """
    return df.toDF(*[aliases.get(c, c) for c in df.columns])
