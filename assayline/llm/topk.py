"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks, and queries into blocks of their own; every pair of blocks is
one group of work of a bounded size. Within a block each dimension has a list of the
vectors in order of that component. For a query the lists are read in step, from the end
that its sign favours; every vector met for the first time gets its exact score. The sum of
the best components still unread bounds the scores of all vectors not met, and reading
stops when that bound cannot beat the k-th score found. The k best of each block are then
merged per query.

Defined results: vectors that are NULL, or hold NULL or non-finite components, or whose id is
NULL take no part, nor do vectors of another length than the query's; equal scores go to the
smaller id; repeated rows are candidates each; fewer than k candidates are all returned, and an empty table gives no
rows. Other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8_192
QUERY_ROWS = 2_048
# Entries of each list that a query reads at first, and by what that grows while the bound allows
# better ones.
DEPTH, GROWTH = 32, 4


class Lists:
    """A block of integer vectors with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = int(np.abs(self.vectors.astype(np.float64)).max(initial=0))
        # Floating point holds products and sums of small numbers exactly, and is faster.
        self.exact = self.vectors.astype(np.float32 if self.largest**2 * vectors.shape[1] < 2**24 else np.float64)
        ranked = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.rising = np.ascontiguousarray(ranked.T)
        self.falling = np.ascontiguousarray(ranked[::-1].T)
        self.sorted = np.take_along_axis(self.vectors, ranked, axis=0)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products, in floating point where it is exact, else in integers."""
        largest = int(np.abs(query).max(initial=0))
        worst = max(self.largest, largest) ** 2 * len(query)
        if worst < (2**24 if self.exact.dtype == np.float32 else 2**53):
            query = query.astype(self.exact.dtype)
            found = (self.exact @ query)[rows] if 2 * len(rows) > len(self.ids) else self.exact[rows] @ query
            return found.astype(np.int64)
        if worst < 2**63:
            return self.vectors[rows] @ query
        exact = self.vectors[rows].astype(object) @ query.astype(object)
        if any(not -(2**63) <= s < 2**63 for s in exact):
            raise OverflowError("a score does not fit a 64-bit integer")
        return exact.astype(np.int64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, without the query's own row."""
        n = len(self.ids)
        up = np.flatnonzero(query > 0)
        down = np.flatnonzero(query < 0)
        met = np.zeros(n, dtype=bool)
        best_rows, best_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        read, depth = 0, min(DEPTH, n)
        bounded = self.largest * int(np.abs(query).max(initial=0)) * len(query) < 2**63
        while True:
            if depth < n:
                seen = met.copy()
                seen[self.falling[up, read:depth]] = True
                seen[self.rising[down, read:depth]] = True
                new = np.flatnonzero(seen & ~met)
                met = seen
            else:
                new = np.flatnonzero(~met)
                met[:] = True
            if len(new):
                found = self.scores(new, query)
                keep = self.ids[new] != query_id
                rows = np.concatenate([best_rows, new[keep]])
                scores = np.concatenate([best_scores, found[keep]])
                if len(rows) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[scores >= least], scores[scores >= least]
                # Rows are in order of their ids.
                order = np.lexsort((rows, -scores))[:k]
                best_rows, best_scores = rows[order], scores[order]
            if depth >= n or met.all():
                break
            if len(best_rows) == k and bounded:
                unread = int(self.sorted[n - depth - 1, up] @ query[up]) + int(self.sorted[depth, down] @ query[down])
                if unread < best_scores[-1]:
                    break
            read, depth = depth, min(n, depth * GROWTH)
        return self.ids[best_rows], best_scores


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _block(k: int) -> Callable:
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            lists = Lists(candidates["id"].to_numpy(), _vectors(candidates["v"]))
            for query_id, query in zip(queries["id"].to_pylist(), _vectors(queries["v"]), strict=True):
                ids, scores = lists.top(query_id, query, k)
                out[0].append(np.full(len(ids), query_id, dtype=np.int64))
                out[1].append(ids)
                out[2].append(scores)
        flat = [pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64), pa.int64()) for c in out]
        return pa.table(flat, names=["query_id", "vec_id", "score"])

    return run


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; NULL unless all are finite numbers."""
    def bad(x: Column) -> Column:
        value = x.cast("double")
        return x.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    whole = vector.isNotNull() & ~F.exists(vector, bad) & (F.size(vector) > 0)
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id: str = "vec_id", vector: str = "embedding",
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of each query row.

    ``is_query`` is a condition over ``table``. The numbers of blocks follow the numbers of rows.
    """
    whole = table.withColumn("__v", scaled(F.col(f"`{vector}`"), scale)).where(F.col("__v").isNotNull() & F.col(f"`{id}`").isNotNull())
    rows = whole.select(F.col(f"`{id}`").cast("long").alias("id"), F.col("__v").alias("v"), F.size("__v").alias("d"), is_query.alias("q"))
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks, parts = -(-n // block_rows) or 1, -(-asked // query_rows) or 1
    candidates = rows.select("id", "v", "d", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    queries = rows.where("q").select("id", "v", "d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ("block", "part", "d")
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_block(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
