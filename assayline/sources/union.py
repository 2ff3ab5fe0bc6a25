"""Union of tagged sources."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(sources: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Concatenate sources by column name, each marked with its name in column ``tag``.

    A column that a source lacks is NULL there.
    """
    if not sources:
        raise ValueError("at least one source is needed")
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
