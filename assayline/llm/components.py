"""Connected components by alternating star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.session import write_through

# Links per partition: the tables of a round are dealt out by their number, not by the
# session's setting, which suits tables of documents.
LINKS_PER_PARTITION = 100_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node with a link.

    Each round points all neighbours of a node at the smallest one, first the smaller ones,
    then the larger ones; the number of rounds grows with the logarithm of the longest path.
    Minima are taken before rows move, so a node with very many links does no harm. Every
    round is written to the shared folder. Rows with a NULL end are no links.
    """
    def directed(x: str, y: str) -> DataFrame:
        return links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))

    edges = write_through(directed(a, b).where("u > v").distinct(), "links")
    state = _state(edges)
    edges = edges.coalesce(_partitions(state))
    while state[0]:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("x"), "m").where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        small = write_through(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links").coalesce(_partitions(state))
        both = small.union(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_through(large.distinct(), "links")
        before, state = state, _state(edges)
        edges = edges.coalesce(_partitions(state))
        if state == before:
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.union(roots)


def _partitions(state: tuple) -> int:
    return -(-state[0] // LINKS_PER_PARTITION) or 1


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
