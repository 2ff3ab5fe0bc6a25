"""Stratified splits and folds that depend only on a row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.randomness import hash_number, key_digest
from assayline.operators.quantiles import Rank, order_statistics
from assayline.operators.wide import quoted
from assayline.session import lookup_join, write_through

SPLITS = ("train", "val", "test")
# Upper ends of train and validation in tenths of a stratum: 60/20/20.
CUTS = (6, 8)
TENTHS = 10
# Bits of a draw, and those that make the cells of one level of counting.
DRAW_BITS, CELL_BITS = 52, 12


def _last_of(tenths: int) -> Rank:
    """Place, counted from 0, of the last row below a cut."""
    return Rank(tenths / TENTHS, lambda n: F.floor((n * F.lit(tenths) + F.lit(TENTHS - 1)) / F.lit(float(TENTHS))) - 1)


def _sums_upto(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Add ``upto``, the number of rows up to and with this one in its group."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("rows").over(window))


def _holding(cells: DataFrame) -> Column:
    """Whether the wanted place, counted from 0, lies in a cell that ends at ``upto``."""
    return (F.col("upto") - F.col("rows") <= F.col("place")) & (F.col("place") < F.col("upto"))


def cut_draws(draws: DataFrame, cuts: Sequence[int], cell_bits: int = CELL_BITS) -> DataFrame:
    """Rows ``(s, q0, q1, ...)``: per stratum the draw of the last row below each cut, from rows ``(s, d)``.

    ``draws`` is read twice.

    Row rn (from 1) of n in order of its draw is below a cut while 10 * (rn - 1) < tenths * n. Draws are digests, so
    cells of equal width hold about equally many: their leading bits are counted once for all rows, then the draws
    of the few cells that hold a cut are looked at again, by the bits that follow and at last one by one. Rows of one draw
    are counted before they travel.
    """
    first, second = DRAW_BITS - cell_bits, DRAW_BITS - 2 * cell_bits
    count = F.count(F.lit(1)).alias("rows")
    cells = write_through(draws.groupBy("s", F.shiftright("d", first).alias("cell")).agg(count), "split-cells")
    places = ", ".join(f"named_struct('k', {k}, 'place', (whole * {t} + {TENTHS - 1}) DIV {TENTHS} - 1)" for k, t in enumerate(cuts))
    running = _sums_upto(cells, ["s"], "cell").withColumn("whole", F.sum("rows").over(Window.partitionBy("s")))
    held = running.selectExpr("s", "cell", "rows", "upto", f"inline(array({places}))").where(_holding(running))
    held = write_through(held.selectExpr("s", "cell", "k", "place - (upto - rows) AS place"), "split-held")
    chosen = held.groupBy("s").agg(F.collect_set("cell").alias("cells"))
    near = lookup_join(draws, chosen, ["s"]).where(F.array_contains("cells", F.shiftright("d", first)))
    near = write_through(near.groupBy("s", "d").agg(count), "split-near").withColumn("cell", F.shiftright("d", first))
    # From here on only a few cells' draws remain.
    near = lookup_join(near, held, ["s", "cell"]).withColumn("sub", F.shiftright("d", second))
    subs = near.groupBy("s", "k", "sub", "place").agg(F.sum("rows").alias("rows"))
    subs = _sums_upto(subs, ["s", "k"], "sub").where(_holding(subs))
    inner = lookup_join(near.drop("place", "cell"), subs.selectExpr("s", "k", "sub", "place - (upto - rows) AS place"), ["s", "k", "sub"])
    last = _sums_upto(inner.where("place IS NOT NULL"), ["s", "k"], "d").where("upto > place")
    return last.groupBy("s").agg(*[F.min(F.when(F.col("k") == k, F.col("d"))).alias(f"q{k}") for k in range(len(cuts))])


def stratified_split(
    df: DataFrame,
    stratum: str,
    key: Sequence[str] = (),
    seed: int = 42,
    cuts: tuple[int, int] = CUTS,
    drawn: str | None = None,
    **tuning: int,
) -> DataFrame:
    """Add ``split``: exactly the first six tenths of every stratum by key digest are train,
    the next two validation, the rest test.

    No row is ranked: two exact thresholds per stratum are found from digests alone (see
    ``cut_draws``), and rows are then labelled by a projection. A stratum of any size is
    spread over all tasks. Rows with equal keys share a side, so ``key`` should be unique;
    empty means the whole row. ``drawn`` names a column that holds ``draw_of`` these keys already, as a written table
    may: no digest is taken then, and the column is dropped. With ``tuning`` the limits are searched by ``order_statistics`` and these
    options of its, which assumes nothing about how draws are spread.
    """
    key = list(key) or df.columns
    draw = quoted(drawn) if drawn else draw_of(key, seed)
    draws = df.select(quoted(stratum).alias("s"), draw.alias("d"))
    if tuning:
        limits = order_statistics(draws, ["s"], [_last_of(c) for c in cuts], "d", **tuning)
    else:
        # Strata and draws alone, so that the table is hashed once for them and once for the labels.
        limits = cut_draws(draws if drawn else write_through(draws, "split-draws"), cuts)
    limits = write_through(limits.select(F.col("s").alias(stratum), "q0", "q1"), "split-limits")
    located = lookup_join(df.withColumn("__draw", draw), limits, [stratum])
    split = (
        F.when(F.col("__draw") <= F.col("q0"), SPLITS[0])
        .when(F.col("__draw") <= F.col("q1"), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return located.withColumn("split", split).drop("__draw", "q0", "q1", *([drawn] if drawn else []))


def draw_of(key: Sequence[str], seed: int = 42) -> Column:
    """The number that decides a row's side of the split."""
    return hash_number(key_digest(seed, *[quoted(k) for k in key]))


def fold_of(key: Sequence[str], folds: int = 3, seed: int = 42) -> Column:
    """Fold number 0..folds-1 of a row."""
    digest = key_digest(f"fold:{seed}", *[quoted(k) for k in key])
    return (hash_number(digest, 1, 8) % F.lit(folds)).cast("int")


def split_report(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows ``(split, target, count, split_rows, split_percentage)``."""
    counts = df.groupBy(split, quoted(target)).count()
    # From here on there is one row per split and class.
    sizes = counts.groupBy(split).agg(F.sum("count").alias("split_rows"))
    total = F.sum("split_rows").over(Window.partitionBy())
    shares = sizes.withColumn("split_percentage", F.lit(100.0) * F.col("split_rows") / total)
    return counts.join(shares, split)
