"""Declaration of the tables the operators work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Roles of a table's columns.

    ``key`` identifies a row (Spark rows have no position). Leave it empty to use
    every column of the row, which is unique once duplicates are dropped.
    """

    features: tuple[str, ...]
    category: str | None = None
    target: str | None = None
    key: tuple[str, ...] = ()

    @property
    def model_columns(self) -> list[str]:
        """Feature order a model is fitted on: measurements, then the category code."""
        return [*self.features, *([self.category] if self.category else [])]

    def schema(self, key_type: T.DataType | None = None) -> T.StructType:
        """Explicit read schema, so that no scan has to infer one."""
        fields = [T.StructField(k, key_type or T.LongType()) for k in self.key]
        fields += [T.StructField(f, T.DoubleType()) for f in self.features]
        if self.category:
            fields.append(T.StructField(self.category, T.StringType()))
        if self.target:
            fields.append(T.StructField(self.target, T.IntegerType()))
        return T.StructType(fields)


# The column names of the reference table.
SAMPLE_FEATURES = (
    "fixed acidity",
    "volatile acidity",
    "citric acid",
    "residual sugar",
    "chlorides",
    "free sulfur dioxide",
    "total sulfur dioxide",
    "density",
    "pH",
    "sulphates",
    "alcohol",
)

# Accepted input range per measurement (closed on both ends).
SAMPLE_RANGES = {
    "fixed acidity": (0.0, 20.0),
    "volatile acidity": (0.0, 2.0),
    "citric acid": (0.0, 2.0),
    "residual sugar": (0.0, 50.0),
    "chlorides": (0.0, 1.0),
    "free sulfur dioxide": (0.0, 100.0),
    "total sulfur dioxide": (0.0, 300.0),
    "density": (0.9, 1.1),
    "pH": (2.0, 5.0),
    "sulphates": (0.0, 3.0),
    "alcohol": (5.0, 20.0),
}

# Accepted categories.
SAMPLE_CATEGORIES = {"wine_type": ("red", "white")}

SAMPLE_SPEC = TableSpec(features=SAMPLE_FEATURES, category="wine_type", target="quality")
