"""Digest-first duplicates, saved preparations, and headers of batches."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assayline.models import MODELS
from assayline.operators.cleaning import drop_duplicates
from assayline.plans import score_batch, train, train_job
from assayline.plans.prepare import Preparation
from assayline.sources import delimited
from assayline.spec import SAMPLE_SPEC


def test_duplicates_by_digest_equal_whole_rows(spark):
    nan = float("nan")
    rows = [("a", 1.0, [1, 2]), ("a", 1.0, [1, 2]), ("b", 0.0, None), ("b", -0.0, None), (None, nan, []), (None, nan, []), (None, None, []), ("c" * 5000, 2.0, [3])]
    df = spark.createDataFrame(rows, "text string, digest double, c0 array<int>").repartition(4)
    one, other = drop_duplicates(df, by_digest=True), drop_duplicates(df)
    assert one.columns == df.columns and sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
    assert drop_duplicates(df.limit(0), by_digest=True).collect() == []


def test_rows_that_occur_once_are_not_shuffled(spark):
    df = spark.range(2000).select((F.col("id") % 1990).cast("string").alias("text"))
    frame = drop_duplicates(df, by_digest=True)
    assert frame.count() == 1990
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # The repeated digests are broadcast, and only the rows that have one travel.
    assert plan.count("Exchange hashpartitioning") <= 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.fixture(scope="module")
def artefacts(spark, synthetic, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("artefacts") / "job")
    return path, *train_job(synthetic, SAMPLE_SPEC, path, ["ridge"], models={"ridge": MODELS["ridge"]})


def test_preparation_is_refused_when_it_is_not_what_was_saved(spark, artefacts, tmp_path):
    path, preparation, _ = artefacts
    assert Preparation.load(spark, f"{path}/preparation").digest() == preparation.digest()
    for change, told in (({"median": F.col("median") + 1}, "not as it was saved"), ({"meta": F.regexp_replace("meta", '"version": 1', '"version": 7')}, "version 7")):
        target = str(tmp_path / told.replace(" ", "-"))
        spark.read.parquet(f"{path}/preparation/columns").withColumns(change).coalesce(1).write.parquet(f"{target}/columns")
        spark.read.parquet(f"{path}/preparation/labels").write.parquet(f"{target}/labels")
        with pytest.raises(ValueError, match=told):
            Preparation.load(spark, target)


def batch(folder, header):
    folder.mkdir()
    names = header.split(",")
    (folder / "a.csv").write_text("\n".join([header, ",".join("red" if n == "wine_type" else "1.5" for n in names), "x" + "," * (len(names) - 1)]) + "\n")
    return str(folder)


def test_headers_of_batches(spark, artefacts, tmp_path):
    _, preparation, trained = artefacts
    whole = ",".join([*SAMPLE_SPEC.features, "wine_type"])
    sound, renamed = batch(tmp_path / "sound", whole), batch(tmp_path / "renamed", whole.replace("alcohol", "strength"))
    aliased = batch(tmp_path / "aliased", whole.replace("fixed acidity", "fixed_acidity").replace("pH", "ph"))
    for i, source in enumerate((sound, aliased)):
        rows = score_batch(spark, source, str(tmp_path / f"out{i}"), preparation, trained, absent="fail").collect()
        assert len(rows) == 2 and sum(r["predicted_quality"] is not None for r in rows) == 1
    with pytest.raises(ValueError, match="lacks alcohol; unknown in it: strength"):
        score_batch(spark, renamed, str(tmp_path / "out-fail"), preparation, trained, absent="fail")
    flagged = score_batch(spark, renamed, str(tmp_path / "out-flag"), preparation, trained, absent="flag").collect()
    assert {r["absent_columns"] for r in flagged} == {"alcohol"}
    scored = score_batch(spark, renamed, str(tmp_path / "out-default"), preparation, trained)
    assert "absent_columns" not in scored.columns and scored.count() == 2
    with pytest.raises(ValueError, match="unknown choice"):
        score_batch(spark, sound, str(tmp_path / "out-no"), preparation, trained, absent="hide")


def test_equal_rows_meet_before_they_are_compared(spark):
    rows = [(1.0, 0.0, "a"), (1.0, -0.0, "a"), (float("nan"), None, None), (float("nan"), None, None), (None, 0.0, "a"), (2.0, 0.0, "a"), (2.0, 0.0, "a")]
    found = drop_duplicates(spark.createDataFrame(rows, "x double, `y.z` double, X2 string").repartition(3))
    assert found.columns == ["x", "y.z", "X2"]
    assert sorted(str(tuple(r)).replace("-0.0", "0.0") for r in found.collect()) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5]]))
    scanned = drop_duplicates(spark.range(100).selectExpr("id % 7 AS a", "CAST(id % 3 AS DOUBLE) AS b"))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    # One shuffle, below both steps of the comparison: no task compares the rows that it read.
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("HashAggregate")


def test_prepared_rows_are_not_kept_in_memory(spark, synthetic, tmp_path, monkeypatch):
    seen = []
    real = train.train_all
    monkeypatch.setattr(train, "train_all", lambda df, *a, **o: seen.append(df.storageLevel.useMemory) or real(df, *a, **o))
    train_job(synthetic, SAMPLE_SPEC, str(tmp_path / "job"), ["ridge"], models={"ridge": MODELS["ridge"]})
    assert seen == [False]


def test_batches_in_compressed_files(spark, artefacts, tmp_path, monkeypatch):
    _, preparation, trained = artefacts
    monkeypatch.setattr(delimited, "FILE_ROWS", 40)
    cells = [F.expr(f"CAST(id % 13 AS DOUBLE) / {i + 2} AS `{c}`") for i, c in enumerate(SAMPLE_SPEC.features)]
    rows = spark.range(90).coalesce(1).select(*cells, F.lit("red").alias("wine_type"))
    told = []
    for compression in (None, "gzip"):
        source, sink = (str(tmp_path / f"{name}-{compression}") for name in ("in", "out"))
        delimited.write_delimited(rows, source, compression=compression)
        found = score_batch(spark, source, sink, preparation, trained, compression=compression)
        told.append(sorted(map(str, found.collect())))
        files = [f.name for folder in (source, sink) for f in Path(folder).glob("part-*")]
        assert all(f.endswith(".csv.gz") == bool(compression) for f in files)
        assert len(list(Path(source).glob("part-*"))) == (3 if compression else 1)
    assert told[0] == told[1] and len(told[0]) == 90
