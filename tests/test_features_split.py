from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import features
from assayline.operators.split import cut_draws, draw_of, fold_of, split_report, stratified_split


def test_labels_are_sorted_and_unseen_becomes_zero_per_row(spark):
    train = spark.createDataFrame([("white",), ("red",), ("white",), (None,)], "c string")
    labels = features.fit_labels(train, "c")
    assert [(r.label, r.code) for r in labels.table.orderBy("code").collect()] == [("red", 0), ("white", 1)]
    new = spark.createDataFrame([(1, "white"), (2, "rose"), (3, None), (4, "red")], "i int, c string")
    assert [r.c for r in labels.encode(new, "c").orderBy("i").collect()] == [1, 0, 0, 0]


@pytest.mark.parametrize("size", [3, 300, 12_000])
def test_vocabularies_of_any_size_are_sorted_and_looked_up(spark, size):
    df = spark.range(3 * size).select(F.concat(F.lit("k"), F.col("id") % size).alias("c"))
    labels = features.fit_labels(df, "c")
    want = {c: i for i, c in enumerate(sorted({f"k{i}" for i in range(size)}))}
    assert {r.label: r.code for r in labels.table.collect()} == want
    encoded = labels.encode(df.withColumn("raw", F.col("c")), "c")
    assert encoded.count() == 3 * size
    assert all(want[r.raw] == r.c for r in encoded.collect())


def test_alignment(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, extra double")
    assert features.schema_differences(df, ["a", "b"]) == {"missing": ["a"], "extra": ["extra"]}
    assert features.align_schema(df, ["a", "b"]).first().asDict() == {"a": 0.0, "b": 1.0}


def test_scaling_uses_population_deviation_and_survives_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    scaled = features.scale(df, features.fit_scaler(df, ["a", "b"])).toPandas()
    assert scaled["a"].mean() == pytest.approx(0.0) and np.std(scaled["a"]) == pytest.approx(1.0)
    assert scaled["b"].tolist() == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("tuning", [{}, {"k": 16, "margin": 0.01, "fan_in": 2}])
def test_split_sizes_are_exact_in_every_stratum(spark, tuning):
    sizes = {"hot": 6000, "mid": 997, "ten": 10, "two": 2, "one": 1, None: 33}
    rows = [(f"{s}-{i}", s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, s string").repartition(5)
    got = Counter((r.s, r.split) for r in stratified_split(df, "s", ["k"], **tuning).collect())
    for s, n in sizes.items():
        train, upto_val = -(-6 * n // 10), -(-8 * n // 10)
        assert (got[s, "train"], got[s, "val"], got[s, "test"]) == (train, upto_val - train, n - upto_val)


@pytest.mark.parametrize("bits", [1, 3, 12, 26])
def test_cuts_of_draws_equal_sorting(spark, bits):
    random = np.random.default_rng(bits)
    rows = [("wide", int(d)) for d in random.integers(0, 2**52, 3000)]
    rows += [("one draw", 5)] * 700 + [("mixed", 2**51)] * 400 + [("mixed", int(d)) for d in random.integers(0, 2**52, 601)]
    rows += [(None, int(d)) for d in random.integers(2**51, 2**51 + 40, 500)] + [("single", 2**52 - 1)]
    df = spark.createDataFrame(rows, "s string, d long").repartition(6)
    found = {r["s"]: (r["q0"], r["q1"]) for r in cut_draws(df, (6, 8), bits).collect()}
    for s in {s for s, _ in rows}:
        ordered = sorted(d for t, d in rows if t == s)
        assert found[s] == tuple(ordered[(len(ordered) * t + 9) // 10 - 1] for t in (6, 8))
    assert cut_draws(df.limit(0), (6, 8)).collect() == []


def test_split_ignores_partitioning_and_depends_on_the_seed(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("s"))
    first = sorted(map(tuple, stratified_split(df, "s", ["id"]).collect()))
    assert first == sorted(map(tuple, stratified_split(df.repartition(9), "s", ["id"]).collect()))
    assert first != sorted(map(tuple, stratified_split(df, "s", ["id"], seed=1).collect()))


def test_split_does_not_rank_rows(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("s"))
    plan = stratified_split(df, "s", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_folds_are_near_equal(spark):
    counts = spark.range(6000).groupBy(fold_of(["id"]).alias("f")).count().collect()
    assert sorted(r.f for r in counts) == [0, 1, 2]
    assert all(abs(r["count"] - 2000) < 200 for r in counts)


def test_split_report_shares(spark):
    df = spark.createDataFrame([("train", 3), ("train", 4), ("test", 3), ("val", 3)], "split string, q int")
    got = {(r.split, r.q): (r["count"], r.split_percentage) for r in split_report(df, "q").collect()}
    assert got["train", 4] == (1, 50.0) and got["val", 3] == (1, 25.0)


def test_draws_of_a_written_table_split_it_alike(spark):
    df = spark.range(900).selectExpr("id", "id % 4 AS s")
    drawn = df.withColumn("d", draw_of(["id"], 42))
    got = stratified_split(drawn, "s", ["id"], drawn="d")
    assert got.columns == ["id", "s", "split"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stratified_split(df, "s", ["id"]).collect()))
