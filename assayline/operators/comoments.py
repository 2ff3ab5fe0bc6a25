"""Sums of products of many columns from one scan.

An aggregate with one expression per pair of columns grows with the square of their number and soon
loses its generated code. Here each row is one vector, every task adds up one triangle of its
products, and the triangles are merged in a tree; only the final matrix, whose size depends on
the columns alone, reaches the driver. Subtract something near each column's mean first: sums of
squares of large numbers lose what is to be measured.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_sums(df: DataFrame, cells: Sequence[str]) -> np.ndarray:
    """The matrix of sums over rows of ``cells[i] * cells[j]``.

    Cells are SQL text without NULLs: put 0 where a value does not count. No rows give zeros.
    """
    vectors = df.select(array_to_vector(F.expr(f"array({', '.join(f'CAST({c} AS DOUBLE)' for c in cells)})")).alias("cells"))
    # MLlib has no matrix of no rows; a row of zeros changes no sum.
    zeros = df.sparkSession.range(1).select(array_to_vector(F.array_repeat(F.lit(0.0), len(cells))).alias("cells"))
    vectors = vectors.union(zeros)
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "cells"), 0, len(cells)).computeGramianMatrix().toArray()
