"""Text forms of identifiers and category input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(col: Column) -> Column:
    """``random_forest`` becomes ``Random Forest``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def normalise_category(col: Column) -> Column:
    return F.lower(F.trim(col))
