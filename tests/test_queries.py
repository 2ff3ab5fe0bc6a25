from __future__ import annotations

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as registry
from tools.check_oracle import multiset

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not here")

# One query per kind; tools/check_oracle.py runs all of them.
CHOSEN = [
    "scan_csv", "union_tagged", "median_impute", "describe_numeric", "outlier_report", "box_stats",
    "stratified_split_events", "synth_samples", "score_stream", "evaluate_test", "forest_stump",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    frame = registry.queries()[name](spark, str(SF_DIR))
    result = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert multiset(frame.columns, [tuple(r) for r in frame.collect()]) == multiset(names, result.fetchall())


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
