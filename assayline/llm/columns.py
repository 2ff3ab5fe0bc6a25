"""One rule for column names: operators work on columns c0, c1, ... and give the names back at the end.

So no name of a table can clash with one that an operator uses inside. Where a column that an operator adds has the
name of a column of the table, it takes that column's place; names are compared as Spark does, without regard to case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, *extra: Column) -> DataFrame:
    """The columns as c0, c1, ..., and after them ``extra`` as e0, e1, ..."""
    names = [f"c{i}" for i in range(len(df.columns))] + [f"e{i}" for i in range(len(extra))]
    return df.select("*", *extra).toDF(*names)


def number_of(df: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives a column."""
    return f"c{df.columns.index(name)}"


def given_back(rows: DataFrame, names: Sequence[str], added: Sequence[str] | Mapping[str, str] = (), without: Sequence[str] = ()) -> DataFrame:
    """Columns c0, c1, ... under ``names`` again, but for those that go, and after them the added ones.

    ``added`` names the latter, or maps their names to those that they have in ``rows``.
    """
    inside = added if isinstance(added, Mapping) else {a: a for a in added}
    gone = {a.lower() for a in [*inside, *without]}
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in gone]
    return rows.select(*kept, *[F.col(own).alias(a) for a, own in inside.items()])
