"""Compressing vectors to codes of codebook entries found through trees of distances.

Components become integers and vectors are cut into equal parts; each part position has a codebook
that is refined in rounds. The nearest entry of a part is found in a GNAT, a tree over the entries of
the codebook: each node holds a few split points far from one another, every other entry goes to
the child of its nearest split point, and for every split point and child the node keeps the least and
greatest distance from the point to the child's entries. A query measures its distances to the split
points; a child whose range is out of reach of the best distance so far, seen from any split
point, is left out whole. Ranges and query distances are rounded outwards, so that rounding never
drops an entry, and a child goes only if it is strictly farther than the best; entries that are
met are compared by their exact integer distances and, where these are equal, by their index.

Defined results: vectors that are NULL or hold NULL or non-finite components go. Repeated rows and rows with
a NULL id count each; NULL ids come last among the first entries, equal ids are ordered by their
vectors. The length that most vectors have (of those that divide into the parts; ties to the
longer) is the table's: vectors of other lengths, empty ones too, keep their row with NULL code and error and take no part
in the codebooks. With fewer vectors than entries codebooks are shorter; an empty table gives
an empty result. Equal labels, NULL ones together, share ``label_error``. Other columns, whatever their
names, are not carried along. Components whose squared distances do not fit 62 bits raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.topk import scaled
from assayline.session import lookup_join, write_through

# Split points of a node, and entries that are compared one by one.
DEGREE, LEAF = 8, 12
# Far above the rounding of a square root and a difference, far below any real gap that is worth pruning.
SLACK = 1e-12


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances between every point and every entry."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    width = points.shape[1]
    if 4 * width * largest**2 < 2**53:
        # Floating point holds these integers exactly.
        p, e = points.astype(np.float64), entries.astype(np.float64)
        found = (p * p).sum(axis=1)[:, None] + (e * e).sum(axis=1)[None] - 2 * (p @ e.T)
        return found.astype(np.int64)
    if 4 * width * largest**2 >= 2**62:
        raise OverflowError("squared distances of these components do not fit 62 bits")
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


class Node:
    """A subtree over some entries of a codebook."""

    def __init__(self, entries: np.ndarray, members: np.ndarray):
        self.members, self.children = members, []
        if len(members) <= LEAF:
            return
        # Farthest from those chosen before, ties to the smaller index.
        chosen = [0]
        gaps = squares(entries[members], entries[members[:1]])
        while len(chosen) < DEGREE:
            far = int(gaps.min(axis=1).argmax())
            if gaps[far].min() == 0:
                break
            chosen.append(far)
            gaps = np.hstack([gaps, squares(entries[members], entries[members[far]][None])])
        if len(chosen) < 2:
            return
        owner, distances = gaps.argmin(axis=1), np.sqrt(gaps.astype(np.float64))
        others = np.ones(len(members), dtype=bool)
        others[chosen] = False
        for c in range(len(chosen)):
            mine = owner == c
            if not (rest := mine & others).any():
                continue
            # From every split point to the entries of the child (its split point is compared by itself).
            low, high = distances[rest].min(axis=0) * (1 - SLACK), distances[rest].max(axis=0) * (1 + SLACK)
            self.children.append((low, high, Node(entries, members[rest])))
        self.members = members[chosen]


class Gnat:
    """Nearest entries of a codebook; ``compared`` counts the distances taken."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = Node(entries, np.arange(len(entries)))
        self.compared = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, per point."""
        index = np.full(len(points), len(self.entries), dtype=np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        self._visit(self.root, points, np.arange(len(points)), index, best)
        return index, best

    def _visit(self, node: Node, points: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        found = squares(points[rows], self.entries[node.members])
        self.compared += found.size
        for i, entry in enumerate(node.members):
            here = found[:, i]
            better = (here < best[rows]) | ((here == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = here[better], entry
        if not node.children:
            return
        distances = np.sqrt(found.astype(np.float64))
        near, far = distances * (1 - SLACK), distances * (1 + SLACK)
        for low, high, child in node.children:
            reach = (np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK))[:, None]
            # Strictly out of reach of one split point is enough.
            alive = ~((near - high > reach) | (low - far > reach)).any(axis=1)
            if alive.any():
                self._visit(child, points, rows[alive], index, best)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summing(books: Sequence[np.ndarray]) -> Callable:
    """One row per used entry and task: number of its parts and their sums by position."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        number = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in batches:
            values = _vectors(batch.column(0), width * len(books))
            for p, tree in enumerate(trees):
                part = values[:, p * width : (p + 1) * width]
                index, _ = tree.nearest(part)
                number[p] += np.bincount(index, minlength=len(number[p]))
                np.add.at(sums[p], index, part)
        for p in range(len(books)):
            if len(used := np.flatnonzero(number[p])):
                arrays = [
                    pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(number[p][used]),
                    pa.array(sums[p][used].tolist(), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", "sums"])

    return run


def _coding(books: Sequence[np.ndarray]) -> Callable:
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            values = _vectors(batch.column(2), width * len(books))
            codes, error = np.empty((len(values), len(books)), dtype=np.uint8), np.zeros(len(values), dtype=np.int64)
            for p, tree in enumerate(trees):
                index, distance = tree.nearest(values[:, p * width : (p + 1) * width])
                codes[:, p] = index
                error += distance
            columns = [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    return run


def compress(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(``id``, code, error, label_error, codebooks_sha256) of each kept vector.

    Components are floor(``scale`` * x). Codebooks start as the parts of the ``entries`` (256 at most) vectors with
    the smallest ids and are moved ``rounds`` times to the floor of the mean of their parts. A code has
    two hexadecimal digits per part; ``error`` is the sum of the parts' squared distances.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    named = table.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("raw"))
    numbers = F.when(F.size("raw") == 0, F.array().cast("array<long>")).otherwise(scaled(F.col("raw"), scale))
    kept = write_through(named.select("id", "label", numbers.alias("v")).where(F.col("v").isNotNull()), "numbers")
    sizes = kept.groupBy(F.size("v").alias("d")).count().where((F.col("d") > 0) & (F.col("d") % parts == 0))
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        coded = kept.selectExpr("id", "label", "CAST(NULL AS STRING) AS code", "CAST(NULL AS LONG) AS error")
        books = []
    else:
        width = common["d"] // parts
        fitting = kept.where(F.size("v") == common["d"])
        first = np.array([r["v"] for r in fitting.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()], dtype=np.int64)
        books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
        sums = [F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(width)]
        for _ in range(rounds):
            found = fitting.select("v").mapInArrow(_summing(books), "part int, entry int, n long, sums array<long>")
            # A row per entry of each codebook.
            for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*sums).alias("sums")).collect():
                books[row["part"]][row["entry"]] = [int(s) // row["n"] for s in row["sums"]]
        kind = kept.schema["label"].dataType.simpleString()
        coded = fitting.mapInArrow(_coding(books), f"id long, label {kind}, code string, error long")
        others = kept.where(F.size("v") != common["d"]).selectExpr("id", "label", "CAST(NULL AS STRING) AS code", "CAST(NULL AS LONG) AS error")
        coded = write_through(coded.unionByName(others), "codes")
    errors = write_through(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return lookup_join(coded, errors, ["label"]).select(F.col("id").alias(id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
