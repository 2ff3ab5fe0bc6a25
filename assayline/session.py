"""Session helpers: shared folder, written intermediate tables, null-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
# Lists that take down the paths of written tables, one per open ``intermediates``.
_noted: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="assayline-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier call returned."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with ``options`` of the writer, and return a scan of it.

    Cuts the lineage; the copy survives lost executors, later passes prune its
    columns, and its size is known to the planner.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    for paths in _noted:
        paths.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that ``write_through`` writes inside, once the block has ended without a failure.

    Gives the list of their paths as they are written; take out of it those that are needed later, as is the result of a step: it has to be
    written, since a plan that still reads the others fails afterwards.
    """
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted[:] = [p for p in _noted if p is not paths]
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` in which NULL keys match NULL keys; keeps ``df``'s columns first."""
    renamed = table.withColumnsRenamed({k: f"__lookup_{i}" for i, k in enumerate(keys)})
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & df[f"`{k}`"].eqNullSafe(renamed[f"__lookup_{i}"])
    return df.join(renamed, condition, "left").drop(*[f"__lookup_{i}" for i in range(len(keys))])
