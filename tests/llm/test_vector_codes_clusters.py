"""Vector codes and centroid clusters against brute force over integers."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from assayline.llm import plane_clusters, vector_codes

BAD = [(9000, None, 1), (9001, [float("nan")] * 64, 1), (9002, [float("inf")] + [0.0] * 63, 1), (9003, [None] + [0.0] * 63, 2), (9004, [0.5] * 63, 2), (9005, [], None)]
SCHEMA = "vec_id long, embedding array<double>, label int"


def rows_with_ties(n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=64), 1)], int(rng.integers(0, 5))) for i in rng.permutation(n)]
    same = [float(x) for x in np.round(rng.normal(size=64), 1)]
    # Copies of one vector, equal ids, an id and labels that are NULL.
    rows += [(5000 + i, same, None) for i in range(120)] + [(7, same, 1), (7, same, 1), (None, same, None), (None, [0.25] * 64, 3)]
    return rows


def integers(rows, scale):
    return [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def refined(points, centres, rounds):
    """Centres after the rounds, and (nearest, squared distance) of each point."""
    def place():
        return [min((squared(p, c), i) for i, c in enumerate(centres)) for p in points]

    for _ in range(rounds):
        members = {}
        for p, (_, i) in zip(points, place(), strict=True):
            members.setdefault(i, []).append(p)
        centres = [[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else c for i, c in enumerate(centres)]
    return centres, [(i, d) for d, i in place()]


def last_null(value):
    return (value is None, value or 0)


def expected_codes(rows, entries, rounds):
    kept = sorted(integers(rows, 1024), key=lambda r: (last_null(r[0]), r[1]))
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        points = [v[p * 16 : p * 16 + 16] for _, v, _ in kept]
        centres, found = refined(points, points[:entries], rounds)
        books.append(centres)
        for r, (i, d) in enumerate(found):
            codes[r] += f"{i:02x}"
            errors[r] += d
    totals = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str)


def test_codes_equal_brute_force(spark):
    rows = rows_with_ties()
    frame = spark.createDataFrame([r for r in rows + BAD if r[0] not in (9004, 9005)], SCHEMA).repartition(5)
    found = vector_codes.compress(frame, entries=40, rounds=2).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected_codes(rows, 40, 2)


def test_codes_of_other_lengths_few_rows_and_clashing_names(spark):
    rows = rows_with_ties(20)[:20]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + BAD], SCHEMA + ", code string, error int")
    found = {r["vec_id"]: r for r in vector_codes.compress(frame, rounds=1).collect()}
    assert sorted(found) == sorted([r[0] for r in rows] + [9004, 9005])
    assert found[9004]["code"] is None and found[9005]["error"] is None
    # Every vector is an entry, so every code is exact.
    assert {found[r[0]]["error"] for r in rows} == {0}
    assert vector_codes.compress(frame.limit(0)).collect() == []
    assert vector_codes.compress(frame.where("vec_id = 9005"))[["vec_id", "code"]].collect() == [(9005, None)]


@pytest.mark.parametrize("spread", [3, 500, 2**27])
def test_tree_finds_the_first_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, size=(30, 5))
    entries = np.concatenate([centres, centres[:4], centres[rng.integers(0, 30, 200)] + rng.integers(-2, 3, size=(200, 5))])
    points = entries[rng.integers(0, len(entries), 3000)] + rng.integers(-2, 3, size=(3000, 5))
    tree = vector_codes.Gnat(entries)
    index, best = tree.nearest(points)
    all_pairs = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == all_pairs.argmin(axis=1)).all() and (best == all_pairs.min(axis=1)).all()
    if spread > 3:
        # Whole subtrees go: far fewer distances than pairs.
        assert tree.compared < all_pairs.size / 3


def test_tree_of_equal_entries_and_too_large_components():
    entries = np.ones((50, 4), dtype=np.int64)
    index, best = vector_codes.Gnat(entries).nearest(np.array([[1, 1, 1, 1], [0, 0, 0, 0]]))
    assert index.tolist() == [0, 0] and best.tolist() == [0, 4]
    with pytest.raises(OverflowError):
        vector_codes.squares(np.array([[2**31]]), np.array([[-(2**31)]]))


def expected_clusters(rows, k, rounds):
    def digest(i):
        return hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else None

    kept = sorted(integers(rows, 64), key=lambda r: (r[0] is None, digest(r[0]) or "", r[1]))
    points = [v for _, v, _ in kept]
    centres, found = refined(points, points[:k], rounds)
    inertia = [sum(d for i, d in found if i == c) for c in range(len(centres))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((r[0], i, d, inertia[i], sum(inertia), shas[i]) for r, (i, d) in zip(kept, found, strict=True)), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (2, 0), (500, 1)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = rows_with_ties(150, k)
    frame = spark.createDataFrame([(*r, 3) for r in rows + BAD], SCHEMA + ", cluster int").repartition(5)
    found = plane_clusters.cluster(frame, k, rounds).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected_clusters(rows, k, rounds)


def test_clusters_of_no_rows_and_of_one_value(spark):
    frame = spark.createDataFrame([(1, [0.5] * 64, 1)], SCHEMA)
    assert plane_clusters.cluster(frame.limit(0)).collect() == []
    assert [tuple(r)[:5] for r in plane_clusters.cluster(frame.union(frame)).collect()] == [(1, 0, 0, 0, 0)] * 2
    wide = spark.createDataFrame([(1, [0.0] * 64, 1), (2, [1e9] * 64, 1)], SCHEMA)
    with pytest.raises(OverflowError):
        plane_clusters.cluster(wide)


@pytest.mark.parametrize("bits", [1, 7, 28])
def test_plane_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 2**bits, size=(200, 64))
    values[0], values[1] = 2**bits - 1, 0
    words = plane_clusters.pack(values, bits)
    assert words.shape == (bits, 200)
    for c in (0, 1, 2):
        assert plane_clusters.dots(words, words[:, c]).tolist() == [int(x) for x in values.astype(object) @ values[c].astype(object)]
    assert [int(plane_clusters.set_bits(w).sum()) for w in words] == [int((values >> i & 1).sum()) for i in range(bits)]
