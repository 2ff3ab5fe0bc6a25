"""Centroid clustering of integer vectors by bit planes.

Components become integers, shifted so that the smallest is 0. Bit i of all 64 components of a
vector is packed into one word, so a vector is as many words as its largest component has bits.
The inner product of two vectors is the sum over pairs of planes of 2 ** (i + j) times the number of
bits set in both words; with the inner products of each vector with itself it gives every squared
distance exactly. Centroids are packed in the same way. A round reads the written words once:
each task adds up the set bits of its vectors per cluster and position, Spark adds up the tasks'
sums, and ``k`` rows come back to the driver.

Defined results: vectors that are NULL, of another length than 64, or hold NULL or non-finite components
take no part. Repeated rows and rows with a NULL id are vectors each; a NULL id comes last among the
first centroids, equal ids are ordered by their vectors. With fewer than ``k`` vectors there are
fewer centroids; an empty table gives an empty result. Ties go to the smaller centroid, and a
centroid without vectors stays where it is. Other columns, whatever their names, are not carried along.
Components further apart than 28 bits raise: their squared distances do not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.topk import scaled
from assayline.session import write_through

COMPONENTS = 64
# 64 squares of numbers of this many bits fit a signed 64-bit sum.
MOST_BITS = 28


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, n) words of n vectors of 64 non-negative integers: bit j of word i is bit i of component j."""
    words = np.empty((bits, len(values)), dtype="<u8")
    for i in range(bits):
        on = (values >> i & 1).astype(np.uint8)
        words[i] = np.packbits(on, axis=1, bitorder="little").view("<u8")[:, 0]
    return words


def set_bits(words: np.ndarray) -> np.ndarray:
    """How many of the n words have each of their 64 bits set."""
    return np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def dots(words: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Inner products of n packed vectors with one packed vector (or n of them, pair by pair)."""
    bits, n = words.shape
    # Pairs of planes of one weight are counted together before they are weighted.
    counts = np.zeros((2 * bits - 1, n), dtype=np.uint16)
    for i in range(bits):
        for j in range(bits):
            counts[i + j] += np.bitwise_count(words[i] & centre[j])
    total = np.zeros(n, dtype=np.int64)
    for weight, count in enumerate(counts):
        total += count.astype(np.int64) << weight
    return total


def nearest(words: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, per vector."""
    packed = pack(centres, len(words))
    own = (centres * centres).sum(axis=1)
    distances = np.stack([norms + own[c] - 2 * dots(words, packed[:, c]) for c in range(len(centres))])
    best = distances.argmin(axis=0)
    return best.astype(np.int32), np.take_along_axis(distances, best[None], axis=0)[0]


def _packing(lowest: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS) - lowest
            words = pack(values, bits)
            columns = [batch.column(0), pa.array(dots(words, words)), *(pa.array(w.view(np.int64)) for w in words)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "norm", *_planes(bits)])

    return run


def _planes(bits: int) -> list[str]:
    return [f"plane{i}" for i in range(bits)]


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
    return np.stack(columns[1:]).view("<u8"), columns[0]


def _summing(centres: np.ndarray) -> Callable:
    """One row per cluster and task: number of vectors and sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(len(centres), dtype=np.int64)
        sums = np.zeros((len(centres), COMPONENTS), dtype=np.int64)
        for batch in batches:
            words, norms = _unpacked(batch)
            cluster, _ = nearest(words, norms, centres)
            number += np.bincount(cluster, minlength=len(centres))
            for c in np.unique(cluster):
                members = words[:, cluster == c]
                for i, plane in enumerate(members):
                    sums[c] += set_bits(np.ascontiguousarray(plane)) << i
        used = np.flatnonzero(number)
        if len(used):
            arrays = [pa.array(used.astype(np.int32)), pa.array(number[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "n", "sums"])

    return run


def _assigning(centres: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(*_unpacked(batch), centres)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, id: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """(``id``, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Components are floor(``scale`` * x). Centroids start as the ``k`` vectors with the smallest digest of
    ``seed``:id, in that order, and are moved ``rounds`` times to the floor of the mean of their vectors.
    """
    kept = table.select(F.col(f"`{id}`").cast("long").alias("id"), scaled(F.col(f"`{vector}`"), scale).alias("v")).where(F.size("v") == COMPONENTS)
    lowest, highest = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if lowest is None:
        lowest = highest = 0
    bits = max((highest - lowest).bit_length(), 1)
    if bits > MOST_BITS:
        raise OverflowError(f"components span {bits} bits, squared distances fit 64 bits up to {MOST_BITS}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    centres = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, COMPONENTS) - lowest
    planes = ", ".join(f"{p} long" for p in _planes(bits))
    words = write_through(kept.mapInArrow(_packing(lowest, bits), f"id long, norm long, {planes}"), "planes")
    sums = [F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(COMPONENTS)]
    for _ in range(rounds if len(centres) else 0):
        parts = words.mapInArrow(_summing(centres), "cluster int, n long, sums array<long>")
        # A row per cluster.
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect():
            centres[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    if not len(centres):
        assigned = words.selectExpr("id", "CAST(NULL AS INT) AS cluster", "CAST(NULL AS LONG) AS distance")
    else:
        assigned = write_through(words.mapInArrow(_assigning(centres), "id long, cluster int, distance long"), "clusters")
    inertia = [0] * max(len(centres), 1)
    for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect():
        inertia[row["cluster"]] = int(row["d"])
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in (centres + lowest).tolist()] or [""]
    return assigned.select(
        F.col("id").alias(id), "cluster", "distance",
        F.array(*(F.lit(i).cast("long") for i in inertia))[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        F.array(*map(F.lit, digests))[F.col("cluster")].alias("centroid_sha256"),
    )
