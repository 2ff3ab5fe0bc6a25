"""Exact order statistics without sorting the table or gathering it in one task.

``percentile`` merges a map of all distinct values of a group in one task, which does
not hold for billions of distinct measurements. Here

1. one pass fills a KLL sketch per group and column, and the sketches are merged in a tree,
   so that no task merges those of all partitions. A sketch's error is relative to the
   rank in the whole group, however values are laid out,
2. one pass counts the values below and inside a narrow bracket around each wanted rank,
   and brackets that miss their rank are widened,
3. one pass counts the values inside the brackets one by one, in bins of equal depth; a bracket that is
   one value, as usual where a column has few values, needs no such look.

Sketches only decide where to look; all counts are exact. Only the values inside brackets leave
their row's task, counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.operators.wide import identifier, number, per_column, present, quoted, text
from assayline.session import lookup_join, write_through

# Size of a sketch (about 14 KB) and a bracket's reach in shares of the group, three times the
# error that the sketch exceeds once in a hundred times.
SKETCH_K = 1_000
MARGIN = 0.004
# Parts of a bracket that hold about equally many values.
BINS = 32
# Sketches that one task merges at a time; two levels of it stand before the last one.
FAN_IN = 64


@dataclass(frozen=True)
class Rank:
    """A wanted order statistic: zero-based ``position(n)`` (may be fractional) near ``share``."""

    share: float
    position: Callable[[Column], Column]


def linear_rank(probability: float) -> Rank:
    """Rank of a quantile under linear interpolation."""
    return Rank(probability, lambda n: (n - 1) * F.lit(probability))


def order_statistics(long: DataFrame, keys: Sequence[str], ranks: Sequence[Rank], value: str = "value", **tuning) -> DataFrame:
    """Rows ``(keys..., n, q0, q1, ...)`` with the exact ranked values of column ``value``.

    Missing values are ignored. Fractional positions are interpolated linearly between their
    neighbours.
    """
    ranks = sorted(ranks, key=lambda r: r.share)
    return Search(long, [value], list(keys), ranks, **tuning).result().drop("feature")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), **tuning
) -> DataFrame:
    """Rows ``(by..., feature, n, q0, q1, ...)``; missing values are ignored.

    ``q0, q1, ...`` follow ``probabilities``, which must be ascending.
    """
    if list(probabilities) != sorted(probabilities):
        raise ValueError("probabilities must be ascending")
    return Search(df, list(columns), list(by), [linear_rank(p) for p in probabilities], **tuning).result()


class Search:
    """One search over some columns; ``k``, ``margin`` and ``fan_in`` are there for tests."""

    def __init__(
        self, df: DataFrame, columns: list[str], by: list[str], ranks: Sequence[Rank],
        k: int = SKETCH_K, margin: float = MARGIN, fan_in: int = FAN_IN,
    ):
        self.columns, self.by, self.ranks = columns, by, list(ranks)
        self.keys = [quoted(b) for b in by]
        self.values = df.select(*self.keys, *[F.expr(present(c)).alias(f"__v{i}") for i, c in enumerate(columns)])
        self.sketches = write_through(self._sketches(k, fan_in), "sketches")
        while True:
            self.brackets = write_through(self._brackets(margin), "brackets")
            self.located = self._located()
            self.counts = write_through(self._counts(), "bracket-counts")
            if margin >= 1.0 or self._missed().isEmpty():
                break
            margin = min(1.0, margin * 8)

    def _sketches(self, k: int, fan_in: int) -> DataFrame:
        """Rows ``(by..., feature, n, sketch, least, greatest, total)`` of the columns that hold values."""
        names = range(len(self.columns))
        first, later = [], []
        for i in names:
            v = f"__v{i}"
            first += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"g{i}"), F.sum(v).alias(f"t{i}"), F.expr(f"kll_sketch_agg_double({v}, {k})").alias(f"s{i}")]
            later += [F.sum(f"n{i}").alias(f"n{i}"), F.min(f"l{i}").alias(f"l{i}"), F.max(f"g{i}").alias(f"g{i}"), F.sum(f"t{i}").alias(f"t{i}"), F.expr(f"kll_merge_agg_double(s{i}, {k})").alias(f"s{i}")]
        level = self.values.withColumn("__part", F.floor(F.spark_partition_id() / fan_in)).groupBy(*self.keys, "__part").agg(*first)
        level = level.withColumn("__part", F.floor(F.col("__part") / fan_in)).groupBy(*self.keys, "__part").agg(*later)
        whole = level.groupBy(*self.keys).agg(*later)
        cells = ", ".join(f"named_struct('feature', {text(c)}, 'n', n{i}, 'sketch', s{i}, 'least', l{i}, 'greatest', g{i}, 'total', t{i})" for i, c in enumerate(self.columns))
        return whole.selectExpr(*[identifier(b) for b in self.by], f"inline(array({cells}))").where("n > 0")

    def _brackets(self, margin: float) -> DataFrame:
        """Rows ``(by..., feature, n, b)``: per rank its ends and the inner edges of its bins.

        A group so small that the margin is less than two ranks is a bracket as a whole.
        """
        cells = []
        for rank in self.ranks:
            low, high = max(rank.share - margin, 0.0), min(rank.share + margin, 1.0)
            wanted = ", ".join(number(min(low + (high - low) * j / BINS, 1.0)) for j in range(BINS + 1))
            cuts = f"kll_sketch_get_quantile_double(sketch, array({wanted}))"
            whole = f"n * {number(margin)} < 2"
            cells.append(
                f"named_struct('low', if({low <= 0.0} OR {whole}, least, {cuts}[0]), 'high', if({high >= 1.0} OR {whole}, greatest, {cuts}[{BINS}]), "
                f"'edges', slice({cuts}, 2, {BINS - 1}), 'mean', total / n)"
            )
        return self.sketches.selectExpr(*[identifier(b) for b in self.by], "feature", "n", f"array({', '.join(cells)}) AS b")

    def _located(self) -> DataFrame:
        """The values beside their group's brackets, one column ``__b`` per value column."""
        wide = self.brackets.groupBy(*self.keys).agg(*[F.first(F.when(F.col("feature") == c, F.col("b")), True).alias(f"__b{i}") for i, c in enumerate(self.columns)])
        if self.by:
            return lookup_join(self.values, write_through(wide, "wide-brackets"), self.by)
        # Without groups the brackets are a few numbers per column: constants of the plan.
        row = self.known = wide.first()
        return self.values.withColumns({f"__b{i}": _constant(row[f"__b{i}"]) for i in range(len(self.columns))})

    def _counts(self) -> DataFrame:
        """Rows ``(by..., feature, below, inside, squares)``: counts per rank, and squares of distances from the mean."""
        def measures(c: str) -> dict[str, str]:
            i = self.columns.index(c)
            below = ", ".join(f"count_if(__v{i} < __b{i}[{k}].low)" for k in range(len(self.ranks)))
            inside = ", ".join(f"count_if(__v{i} BETWEEN __b{i}[{k}].low AND __b{i}[{k}].high)" for k in range(len(self.ranks)))
            squares = f"sum((__v{i} - __b{i}[0].mean) * (__v{i} - __b{i}[0].mean))"
            return {"below": f"array({below})", "inside": f"array({inside})", "squares": squares}

        return per_column(self.located, self.columns, measures, self.by)

    def _positions(self) -> DataFrame:
        """Rows ``(by..., feature, n, k, position, below, inside, low, high)``, one per wanted rank."""
        counts = lookup_join(self.brackets, self.counts, [*self.by, "feature"])
        cells = F.array(*[
            F.struct(
                F.lit(k).alias("k"), rank.position(F.col("n")).cast("double").alias("position"), F.col("below")[k].alias("below"), F.col("inside")[k].alias("inside"),
                F.col("b")[k]["low"].alias("low"), F.col("b")[k]["high"].alias("high"),
            )
            for k, rank in enumerate(self.ranks)
        ])
        return counts.select(*self.keys, "feature", "n", F.inline(cells))

    def _missed(self) -> DataFrame:
        found = (F.col("below") <= F.floor("position")) & (F.ceil("position") < F.col("below") + F.col("inside"))
        return self._positions().where(~found)

    def inside(self, every: bool = True) -> DataFrame:
        """Rows ``(by..., feature, k, bin, value, rows)``: the values inside brackets, counted; all, or those of several values."""
        cells = []
        several = "true" if every else "{b}.low < {b}.high"
        for i, c in enumerate(self.columns):
            for k in range(len(self.ranks)):
                if not every and not self.by and not self._open(i, k):
                    continue
                b = f"__b{i}[{k}]"
                inside = f"coalesce({several.format(b=b)} AND __v{i} BETWEEN {b}.low AND {b}.high, false)"
                cells.append(f"if({inside}, named_struct('feature', {text(c)}, 'k', {k}, 'value', __v{i}), NULL)")
        place = [*self.by, "feature", "k"]
        if cells:
            emitted = self.located.selectExpr(*[identifier(b) for b in self.by], f"inline(array({', '.join(cells)}))").where("feature IS NOT NULL")
            counted = emitted.groupBy(*self.keys, "feature", "k", "value").agg(F.count(F.lit(1)).alias("rows"))
        else:
            counted = self.values.sparkSession.createDataFrame([], "feature string, k int, value double, rows long")
        # Bins of the values that are left, of which there are few where a column has few.
        edges = self.brackets.select(*self.keys, "feature", F.posexplode("b").alias("k", "bracket")).select(*[quoted(p) for p in place], F.col("bracket.edges").alias("edges"))
        binned = lookup_join(counted, edges, place).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
        return binned.select(*[quoted(p) for p in place], "bin", "value", "rows")

    def _open(self, i: int, k: int) -> bool:
        """Whether a bracket of a search without groups holds more than one value."""
        brackets = self.known[f"__b{i}"]
        return brackets is not None and brackets[k]["low"] < brackets[k]["high"]

    def moments(self) -> DataFrame:
        """Rows ``(by..., feature, n, mean, std, least, greatest)`` from the same passes; ``std`` is that of a sample."""
        whole = lookup_join(self.sketches.drop("sketch"), self.counts.select(*self.keys, "feature", "squares"), [*self.by, "feature"])
        deviation = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1)))
        return whole.select(*self.keys, "feature", "n", (F.col("total") / F.col("n")).alias("mean"), deviation.alias("std"), "least", "greatest")

    def result(self) -> DataFrame:
        """Rows ``(by..., feature, n, q0, q1, ...)``.

        The running count has two levels: over the bins of a bracket, then inside a bin.
        """
        counted = self.inside(every=False)
        bracket = [*self.by, "feature", "k"]
        over_bins = Window.partitionBy(*[quoted(b) for b in bracket]).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        in_bin = Window.partitionBy(*[quoted(b) for b in bracket], "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = counted.groupBy(*[quoted(b) for b in bracket], "bin").agg(F.sum("rows").alias("bin_rows"))
        bins = bins.withColumn("before", F.coalesce(F.sum("bin_rows").over(over_bins), F.lit(0))).drop("bin_rows")
        running = lookup_join(counted, bins, [*bracket, "bin"]).withColumn("upto", F.col("before") + F.sum("rows").over(in_bin))
        positions = self._positions()
        wanted = positions.where("low < high").drop("low", "high")
        running = lookup_join(running, wanted, bracket).withColumn("upto", F.col("upto") + F.col("below"))
        picked = running.groupBy(*[quoted(b) for b in bracket], "n", "position").agg(
            F.min(F.when(F.col("upto") > F.floor("position"), F.col("value"))).alias("low"),
            F.min(F.when(F.col("upto") > F.ceil("position"), F.col("value"))).alias("high"),
        )
        step = (F.col("high") - F.col("low")) * (F.col("position") - F.floor("position"))
        picked = picked.withColumn("q", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + step))
        closed = positions.where("low = high").select(*self.keys, "feature", "k", "n", F.col("low").alias("q"))
        picked = picked.select(*closed.columns).unionByName(closed)
        return picked.groupBy(*self.keys, "feature", "n").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(self.ranks))])


def _constant(brackets) -> Column:
    if brackets is None:
        return F.expr("CAST(NULL AS array<struct<low:double,high:double,edges:array<double>,mean:double>>)")
    cells = [f"named_struct('low', {number(b['low'])}, 'high', {number(b['high'])}, 'edges', array({', '.join(map(number, b['edges']))}), 'mean', {number(b['mean'])})" for b in brackets]
    return F.expr(f"array({', '.join(cells)})")
