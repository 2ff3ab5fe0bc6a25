"""Mixing sources to target weights by temperature.

Shares of tokens per source are raised to an exponent between 0 (equal weights) and 1 (the
shares as they are) and normalised. Entropy and repetition fall as the exponent rises, so the
exponent is found by bisection: the smallest that keeps every source within the repetition
limit or, where an entropy is asked for, the one that meets it, if that is larger. The weights are then realised exactly: each source gives a whole number of passes
over all its documents, and one part of a pass. Its documents lie in an order of seeded
hashes, cut into blocks; the part takes whole blocks as long as the tokens allow, and then
documents of one more block.

DataFrame functions only. Defined results: a NULL source is a source; a NULL text has no
tokens; a source without tokens is used once; documents with equal ids and source share
their place in the order, so they are used equally often; texts of any length count whole; an empty table gives an
empty one. Extra columns pass through, whatever their names; ``copies`` takes the place of a column of that name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.columns import given_back, number_of, numbered
from assayline.session import write_through

# Exponents that one pass over the sources evaluates, and passes: an accuracy of 16 ** -8.
SECTIONS, PASSES = 16, 8
BLOCK_DOCS = 1_000
SEED = 42


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet.

    ``repetition``: most passes over a source, where the budget gives the source with the
    fewest passes exactly one (``budget`` None) or is a number of tokens. ``entropy``: in nats.
    """

    repetition: float = 2.0
    entropy: float | None = None
    budget: int | None = None


def words(text: Column) -> Column:
    """Tokens of a text as words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def totals(docs: DataFrame, source: str, tokens: Column) -> DataFrame:
    """Tokens and documents per source; pre-aggregated, one row per source is written."""
    rows = docs.select(F.col(f"`{source}`").alias("source"), tokens.alias("tokens"))
    return write_through(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")


def fit_exponent(sources: DataFrame, target: Target) -> tuple[float, float, int]:
    """(exponent, normaliser, budget in tokens) for the given totals per source."""
    used = sources.where("tokens > 0")
    whole, least, most = used.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not whole:
        return 1.0, 1.0, 0
    share = F.col("tokens") / F.lit(float(whole))

    def measured(exponents: list[float]) -> list[tuple[float, float]]:
        """Normaliser and entropy at each exponent, in one pass over the sources."""
        powers = [F.pow(share, F.lit(a)) for a in exponents]
        row = used.agg(*[x for p in powers for x in (F.sum(p), F.sum(p * F.log(share)))]).first()
        return [(row[2 * i], math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i]) for i, a in enumerate(exponents)]

    def repetition(a: float, z: float) -> float:
        """Passes over the source with the fewest tokens, which has the most of them."""
        if target.budget is None:
            return (most / least) ** (1 - a)
        return target.budget / whole * (least / whole) ** (a - 1) / z

    def search(holds) -> float:
        """Smallest exponent from which on ``holds`` is true; 1 if it never is."""
        low, high = 0.0, 1.0
        if holds(0.0, *measured([0.0])[0]):
            return 0.0
        for _ in range(PASSES):
            grid = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
            first = next((i for i, (a, m) in enumerate(zip(grid, measured(grid), strict=True)) if holds(a, *m)), len(grid))
            low, high = (grid[first - 1] if first else low), (grid[first] if first < len(grid) else high)
        return high

    exponent = search(lambda a, z, h: repetition(a, z) <= target.repetition)
    if target.entropy is not None:
        exponent = max(exponent, search(lambda a, z, h: h <= target.entropy))
    normaliser = measured([exponent])[0][0]
    budget = target.budget
    if budget is None:
        budget = math.ceil(whole * normaliser * (most / whole) ** (1 - exponent))
    return exponent, normaliser, budget


def plan(docs: DataFrame, target: Target, id: str = "doc_id", source: str = "source", tokens: Column | None = None, seed: int = SEED) -> DataFrame:
    """(source, weight, tokens, docs, wanted, passes, last): how each source is used.

    ``wanted`` tokens are ``passes`` whole passes and the documents whose place in the order
    is at most ``last`` (NULL: none).
    """
    tokens = words(F.col("text")) if tokens is None else tokens
    sources = totals(docs, source, tokens)
    exponent, normaliser, budget = fit_exponent(sources, target)
    whole = sources.agg(F.sum("tokens")).first()[0] or 1
    weight = F.pow(F.col("tokens") / F.lit(float(whole)), F.lit(exponent)) / normaliser
    # A rounding error must not cost a source its last document.
    wanted = F.round(weight * budget).cast("long")
    wanted = F.when(F.abs(wanted - F.col("tokens")) <= F.col("tokens") * 1e-9 + 1, F.col("tokens")).otherwise(wanted)
    used = sources.where("tokens > 0").withColumns({"weight": F.round(weight, 9), "wanted": wanted})
    idle = sources.where("tokens = 0").withColumns({"weight": F.lit(0.0), "wanted": F.lit(0).cast("long")})
    used = used.unionByName(idle).withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.try_divide("wanted", "tokens"))).otherwise(1))
    used = used.withColumn("rest", F.when(F.col("tokens") > 0, F.col("wanted") - F.col("passes") * F.col("tokens")).otherwise(0))
    used = used.withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS))
    used = write_through(used, "weights")
    placed = docs.select(F.col(f"`{source}`").alias("source"), place(F.col(f"`{id}`"), F.col(f"`{source}`"), seed).alias("place"), tokens.alias("t"))
    named = used.select(F.col("source").alias("s"), "rest", "blocks")
    placed = placed.join(named.where("rest > 0"), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("block", F.floor(F.col("place") / (2.0**62) * F.col("blocks")))
    by_block = placed.groupBy("source", "block", "rest").agg(F.sum("t").alias("t"), F.max("place").alias("end"))
    so_far = Window.partitionBy("source").orderBy("block")
    by_block = by_block.withColumns({"before": F.sum("t").over(so_far) - F.col("t"), "end": F.lag("end").over(so_far)})
    # The block in which the tokens run out; all blocks before it are used whole.
    last_block = write_through(
        by_block.where("before <= rest").groupBy("source").agg(F.max_by(F.struct("block", "before", "end"), "block").alias("x")).select(F.col("source").alias("s_"), "x.*"), "blocks"
    )
    inside = placed.join(last_block.withColumnsRenamed({"block": "block_"}), F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("block_")))
    inside = inside.groupBy("source", "place", "rest", "before", "end").agg(F.sum("t").alias("t"))
    in_order = Window.partitionBy("source").orderBy("place")
    inside = inside.withColumn("upto", F.col("before") + F.sum("t").over(in_order))
    ends = inside.groupBy("source", "end").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("last"))
    # Without a document of the block that fits, the part ends with the block before.
    ends = ends.select(F.col("source").alias("s3"), F.coalesce("last", "end").alias("last"))
    out = used.join(ends, F.col("source").eqNullSafe(F.col("s3")), "left")
    return write_through(out.select("source", "weight", "tokens", "docs", "wanted", "passes", "last"), "mix")


def place(id: Column, source: Column, seed: int) -> Column:
    """Place of a document in its source's order: a number from 0 up to 2 ** 62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), source, id), 2)


def mix(docs: DataFrame, target: Target, id: str = "doc_id", source: str = "source", tokens: Column | None = None, seed: int = SEED) -> DataFrame:
    """Add column ``copies``: how often each document is used; one row per row of ``docs``."""
    rows = numbered(docs, words(F.col("text")) if tokens is None else tokens)
    own, origin = number_of(docs, id), number_of(docs, source)
    used = plan(rows, target, own, origin, F.col("e0"), seed).select("source", "passes", "last")
    found = rows.join(used, F.col(origin).eqNullSafe(F.col("source")))
    part = F.coalesce((place(F.col(own), F.col(origin), seed) <= F.col("last")).cast("long"), F.lit(0))
    return given_back(found.withColumn("copies", F.col("passes") + part), docs.columns, ["copies"])


def repeat(mixed: DataFrame) -> DataFrame:
    """One row per use; columns as before ``mix``."""
    used = numbered(mixed).withColumn("use", F.explode(F.array_repeat(F.lit(1), F.col(number_of(mixed, "copies")).cast("int"))))
    return given_back(used, mixed.columns, without=["copies"])
