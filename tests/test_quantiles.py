from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators.quantiles import Search, exact_quantiles, linear_rank

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
# Small sketches, so that brackets are wide of the mark and the widening is used.
COARSE = {"k": 8, "margin": 0.001, "fan_in": 2}


def expected(values):
    return np.quantile(np.array(values, dtype=float), PROBABILITIES).tolist()


@pytest.mark.parametrize("tuning", [{}, COARSE])
def test_equals_numpy_with_gaps_ties_and_infinities(spark, tuning):
    rng = random.Random(4)
    a = [rng.choice([None, float("nan"), rng.gauss(0, 1), 1.0, 1.0, -1e300, 1e-300]) for _ in range(3000)]
    b = [float(i % 7) for i in range(3000)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(7)
    rows = {r["feature"]: r for r in exact_quantiles(df, ["a", "b"], PROBABILITIES, **tuning).collect()}
    for name, values in (("a", [v for v in a if v is not None and v == v]), ("b", b)):
        assert rows[name]["n"] == len(values)
        assert [rows[name][f"q{i}"] for i in range(7)] == pytest.approx(expected(values), rel=1e-12)


@pytest.mark.parametrize("tuning", [{}, COARSE])
def test_groups_of_all_sizes_and_a_null_group(spark, tuning):
    rng = random.Random(5)
    sizes = {"hot": 5000, "mid": 300, "two": 2, "one": 1, None: 40}
    rows = [(g, rng.expovariate(1)) for g, n in sizes.items() for _ in range(n)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    found = {r["g"]: r for r in exact_quantiles(df, ["v"], PROBABILITIES, by=["g"], **tuning).collect()}
    assert set(found) == set(sizes)
    for g in sizes:
        values = [v for key, v in rows if key == g]
        assert [found[g][f"q{i}"] for i in range(7)] == pytest.approx(expected(values), rel=1e-12)


LAYOUTS = {
    "sorted": lambda id: id.cast("double"),
    "sorted with a heavy tail": lambda id: F.exp(id / 10_000.0),
    "few values": lambda id: (id % 5).cast("double"),
    "mostly one value": lambda id: F.when(id % 10 < 9, 1.0).otherwise(id.cast("double")),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_cost_does_not_depend_on_the_layout(spark, layout):
    n = 200_000
    df = spark.range(0, n, 1, 50).select(LAYOUTS[layout](F.col("id")).alias("v"))
    search = Search(df, ["v"], [], [linear_rank(p) for p in (0.25, 0.5, 0.75)], fan_in=4)
    inside = search.inside()
    # Values that are counted singly, over three ranks, and those in the largest bin.
    assert inside.count() <= 0.04 * n
    assert inside.groupBy("k", "bin").count().agg(F.max("count")).first()[0] <= 0.004 * n
    row = search.result().first()
    values = np.sort(np.array([r[0] for r in df.collect()]))
    assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist(), rel=1e-12)


def test_equal_infinite_neighbours_and_empty_tables(spark):
    df = spark.createDataFrame([(float("inf"),), (float("inf"),), (1.0,)], "v double")
    row = exact_quantiles(df, ["v"], [0.0, 0.5, 1.0]).first()
    assert [row["q0"], row["q1"], row["q2"]] == [1.0, float("inf"), float("inf")]
    assert exact_quantiles(df.limit(0), ["v"], [0.5]).collect() == []
    assert exact_quantiles(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"], [0.5]).count() == 1


def test_probabilities_must_ascend(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.range(3), ["id"], [0.5, 0.1])
