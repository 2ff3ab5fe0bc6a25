"""The joins against brute force."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import jaccard, topk
from assayline.llm.components import connected_components
from assayline.session import shared_dir


def sets(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(rows, width, numerator, denominator):
    found = {i: sets(t, width) for i, t in rows}
    label = {i: i for i in found}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(found, 2):
        x, y = found[a], found[b]
        if x and y and denominator * len(x & y) >= numerator * len(x | y):
            p, q = sorted((root(a), root(b)))
            label[q] = p
    return {i: (len(found[i]), root(i)) for i in found}


def corpus(rng, n):
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.choice([1, 2, 5, 12, 30, 80, 200]))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "Two words"), (6, "x" * 500)]
    for i in range(7, n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice("qrstuv")
        if rng.random() < 0.2:
            words += [rng.choice("wxyz") for _ in range(rng.randint(1, 4))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("width", "numerator"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, width, numerator):
    rows = corpus(random.Random(width), 260)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class string, n int").repartition(5)
    found = jaccard.jaccard_components(frame, width, numerator, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(rows, width, numerator, 100)


def test_one_of_each_group_stays(spark):
    rows = corpus(random.Random(9), 120)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class string")
    doubled = frame.union(frame.where("doc_id in (3, 20)")).union(spark.createDataFrame([(None, "One", "y")], frame.schema))
    kept = jaccard.keep_one(doubled)
    expected = {i for i, (_, c) in components(rows, 5, 80, 100).items() if c == i}
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(expected)
    assert kept.where("doc_id is null").count() == 1


def test_the_join_leaves_only_its_result_in_the_shared_folder(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    frame = spark.createDataFrame(corpus(random.Random(4), 80), "doc_id long, text string")
    before = set(folder.iterdir())
    kept = jaccard.keep_one(frame)
    left = set(folder.iterdir()) - before
    assert [p.name.rpartition("-")[0] for p in left] == ["groups"]
    # The result does not read what went.
    assert kept.count() == kept.select("doc_id").distinct().count() > 0


def test_rows_without_id_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (3, "a  b\nc d")], "doc_id long, text string")
    found = jaccard.jaccard_components(frame).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (3, 3), (4, 3), (4, 3)]
    assert jaccard.jaccard_components(frame.limit(0)).collect() == []


def test_pigeonhole_holds_for_every_linked_pair():
    rng = np.random.default_rng(1)
    for numerator in (80, 90):
        for _ in range(400):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = int(rng.integers(0, len(a) // 5 + 1))
            extra = rng.integers(0, 2**64, int(rng.integers(0, len(a) // 5 + 1)), dtype=np.uint64)
            b = np.unique(np.concatenate([a[drop:], extra]))
            both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if len(b) and 100 * both >= numerator * union:
                x, y = jaccard.sketch_keys(a, numerator, 100), jaccard.sketch_keys(b, numerator, 100)
                assert len(np.intersect1d(x, y)), (len(a), len(b), both)
            folds = jaccard.fold(a) ^ jaccard.fold(b)
            assert sum(int(f).bit_count() if f >= 0 else (int(f) + 2**64).bit_count() for f in folds) <= union - both


def test_connected_components_of_a_path_a_star_and_nulls(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(8, 60)]
    frame = spark.createDataFrame([*path, *star, (5, 5), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}}


def exact(vectors, queries, k):
    out = []
    for q in queries:
        scores = sorted(((-sum(a * b for a, b in zip(v, vectors[q], strict=True)), i) for i, v in vectors.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], 1.0) for i in range(400)]
    rows += [(400 + i, [0.5, -0.5, 0.0, 0.25, 1.0, -1.0], 2.0) for i in range(60)]
    bad = [(1000, None, 1.0), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1.0), (1002, [float("nan")] * 6, 1.0), (1003, [float("inf")] * 6, 1.0), (None, [1.0] * 6, 1.0), (1020, [], 1.0)]
    frame = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, score double").repartition(4)
    vectors = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows}
    for block_rows, query_rows in ((64, 8), (8192, 2048)):
        found = topk.top_k(frame, F.col("vec_id") % 20 == 0, 20, block_rows=block_rows, query_rows=query_rows).collect()
        assert sorted(tuple(r) for r in found) == exact(vectors, [i for i in vectors if i % 20 == 0], 20)


def test_top_k_of_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.1, 9.0])], "vec_id long, embedding array<float>")
    found = topk.top_k(frame, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") == 0).collect() == []


def test_threshold_stops_before_reading_all_lists():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, size=(4000, 3))
    vectors[17] = (60, 60, 60)
    lists = topk.Lists(np.arange(4000), vectors.astype(np.int64))
    seen = []
    scores = lists.scores
    lists.scores = lambda rows, query: (seen.append(len(rows)), scores(rows, query))[1]
    ids, found = lists.top(-1, np.array([1, 1, 1]), 1)
    assert ids.tolist() == [17] and found.tolist() == [180]
    assert sum(seen) < 400


def test_large_components_are_exact():
    vectors = np.array([[2**40, 1], [2**40, 2], [-(2**40), 5]], dtype=np.int64)
    lists = topk.Lists(np.arange(3), vectors)
    ids, found = lists.top(9, np.array([2**20, 3]), 2)
    assert ids.tolist() == [1, 0] and found.tolist() == [2**60 + 6, 2**60 + 3]
