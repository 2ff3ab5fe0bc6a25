"""Memory of the Python workers that Spark uses again from task to task and stage to stage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Rows of one Arrow batch where rows are whole texts.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_HELD: dict = {}


def held(key: object, make: Callable[[], object]):
    """What ``make`` gave when a task of this worker asked for ``key`` last, or now.

    A worker holds one such thing, a tokenizer with its memo or a memo of word hashes: what an
    earlier stage needed goes when a later one asks for something else, and its memory is given back.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # only the GNU C library has it, and only its heap needs it
        _HELD[key] = make()
    return _HELD[key]


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Actions inside hand texts to Python in batches of few rows: a batch is in memory several times over."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)
