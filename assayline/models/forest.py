"""Forests of many trees, grown level by level from sums per node and bin that NumPy takes over compact binned rows.

MLlib keeps its rows as objects with a number per tree, updates sums of up to ``maxMemoryInMB`` in no order for each row, tree and
feature, and reads all rows again for each such group of nodes. Here a row is a byte per feature and tree in a written table, and
a task takes few trees at a time. Thresholds, bins, draws and the choice of a split are MLlib's own, so the trees are too.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from assayline.session import fresh_path, write_through

# Rows of a chunk of the written table, and trees whose draws share one of its columns.
CHUNK_ROWS, DRAWN = 65_536, 4
# Bytes of sums that a task holds, and of one part of them as it travels.
HELD, SENT = 64 << 20, 8 << 20
# Rows that a task goes through at least, where there are so many, and groups of trees of one job.
TASK_ROWS, BRANCHES = 4_000_000, 64
# Cells of a tree that features share at most where they are counted together.
JOINT_CELLS = 65_536
# What counts stay below, and totals, where both share the 53 bits of a number.
SHIFT, MOST_TOTAL = 2.0**24, 2.0**28
# Row groups are closed by size alone, as few rows hold many bytes.
WRITTEN = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
# MLlib's: a variance below this is none, and the gain of a split that is not allowed.
EPSILON, INVALID = float(np.finfo(float).eps), -float(np.finfo(float).max)
SPLITS = "tree int, node int, feature int, cut int, gain double, impurity double, n double, total double, squares double, left_n double, left_total double, left_squares double"


@dataclass(frozen=True)
class Binned:
    """Training rows as bins, with how often each tree drew them, in a written table of chunks."""

    chunks: DataFrame
    rows: int
    thresholds: list[list[float]]
    least_weight: float

    @property
    def widths(self) -> list[int]:
        return [len(t) + 1 for t in self.thresholds]


@dataclass
class Tree:
    """Nodes in the order of their making: a row each of counts, sums and sums of squares, and what is known of its split.

    The right child of a node is the one after its left child.
    """

    stats: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    impurity: np.ndarray
    gain: np.ndarray
    # Nodes of the last level whose split is still to be found.
    open: np.ndarray

    @staticmethod
    def root() -> Tree:
        whole = [np.full(1, -1, dtype=np.int32) for _ in range(3)]
        return Tree(np.zeros((1, 3)), *whole, np.zeros(1), np.full(1, INVALID), np.zeros(1, dtype=np.int64))

    def paths(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a row needs to find its way: feature, cut and left child, by which a leaf leads to itself; place among the open nodes."""
        inner = self.left >= 0
        at = np.full(len(self.left), -1, dtype=np.intp)
        at[self.open] = np.arange(len(self.open))
        own = np.arange(len(self.left), dtype=np.intp)
        # No bin is beyond the last number of its kind.
        return np.where(inner, self.feature, 0).astype(np.intp), np.where(inner, self.cut, 65_535).astype(np.uint16), np.where(inner, self.left, own), at

    def split(self, found: dict[str, np.ndarray], level: int, depth: int) -> None:
        """Take the best splits of the open nodes, in their order, and make the children."""
        nodes, gain = self.open, found["gain"]
        self.stats[nodes] = np.column_stack([found[c] for c in ("n", "total", "squares")])
        self.impurity[nodes], self.gain[nodes] = found["impurity"], gain
        chosen = np.flatnonzero(gain > 0) if level < depth else np.zeros(0, dtype=np.int64)
        first = len(self.left) + 2 * np.arange(len(chosen))
        self.feature[nodes[chosen]], self.cut[nodes[chosen]], self.left[nodes[chosen]] = found["feature"][chosen], found["cut"][chosen], first
        left = np.column_stack([found[f"left_{c}"][chosen] for c in ("n", "total", "squares")])
        children = np.stack([left, self.stats[nodes[chosen]] - left], axis=1).reshape(-1, 3)
        impurity, made = variance(*children.T), len(children)
        self.open = len(self.left) + np.flatnonzero(impurity >= EPSILON) if level + 1 < depth else np.zeros(0, dtype=np.int64)
        self.stats, self.impurity = np.concatenate([self.stats, children]), np.concatenate([self.impurity, impurity])
        none = np.full(made, -1, dtype=np.int32)
        self.feature, self.cut, self.left = (np.concatenate([a, none]) for a in (self.feature, self.cut, self.left))
        self.gain = np.concatenate([self.gain, np.full(made, np.nan)])


def variance(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (squares - total * total / n) / n)


def grows(estimator: object) -> bool:
    """Whether ``fit_forest`` knows all that an estimator asks for; a single tree gains nothing by it."""
    return (
        isinstance(estimator, RandomForestRegressor)
        and estimator.getNumTrees() > 1
        and estimator.getFeatureSubsetStrategy() == "all"
        and estimator.getImpurity() == "variance"
        and not (estimator.isDefined("weightCol") and estimator.getWeightCol())
    )


def fit_forest(df: DataFrame, estimator: RandomForestRegressor) -> RandomForestRegressionModel:
    """The forest that ``estimator.fit(df)`` gives: same trees, and same numbers where sums of targets are exact.

    Bins, thresholds and draws are read from MLlib; categorical features, if the column's metadata has any, are left to it.
    """
    binned = binned_rows(df, estimator)
    if binned is None:
        return estimator.fit(df)
    trees = grow(binned, estimator)
    return _model(df.sparkSession, estimator, binned, trees)


def _scala(package: object, name: str) -> JavaObject:
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def binned_rows(df: DataFrame, estimator: RandomForestRegressor) -> Binned | None:
    """Training rows as MLlib bins and draws them; None where a feature is categorical."""
    spark = df.sparkSession
    jvm, ml = spark._jvm, spark._jvm.org.apache.spark.ml
    estimator._transfer_params_to_java()
    java = estimator._java_obj
    datasets, impl = _scala(ml.util, "DatasetUtils"), ml.tree.impl
    instances = datasets.extractInstances(java, df._jdf, getattr(datasets, "extractInstances$default$3")())
    categories = _scala(ml.util, "MetadataUtils").getCategoricalFeatures(df._jdf.schema().apply(estimator.getFeaturesCol()))
    if not categories.isEmpty():
        return None
    regression = jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()
    strategy = java.getOldStrategy(categories, 0, regression, java.getOldImpurity())
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    metadata = _scala(impl, "DecisionTreeMetadata").buildMetadata(instances, strategy, trees, estimator.getFeatureSubsetStrategy())
    splits = _scala(impl, "RandomForest").findSplits(instances, metadata, seed)
    thresholds = [[s.threshold() for s in feature] for feature in splits]
    points = _scala(impl, "TreePoint").convertToTreeRDD(instances, splits, metadata)
    bagging = _scala(impl, "BaggedPoint")
    # Rows weigh 1 each, as there is no column of weights.
    weigh = getattr(bagging, "convertToBaggedRDD$default$5")()
    bagged = bagging.convertToBaggedRDD(points, estimator.getSubsamplingRate(), trees, estimator.getBootstrap(), weigh, seed)
    # Only by their serialised form can these points leave the JVM.
    kind = spark._sc._gateway.jvm.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint", True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    written = DataFrame(spark._jsparkSession.createDataset(bagged, jvm.org.apache.spark.sql.Encoders.javaSerialization(kind)).toDF(), spark)
    layout = _layout(spark, len(thresholds), trees)
    blocks = [f"draws{i}" for i in range(math.ceil(trees / DRAWN))]
    schema = ", ".join(["n int", "y binary", "bins binary", *(f"{b} binary" for b in blocks)])
    wide = max(map(len, thresholds), default=0) > 255
    chunks = written.mapInArrow(_packed(layout, len(thresholds), trees, blocks, np.uint16 if wide else np.uint8), schema)
    return Binned(write_through(chunks, "binned", **WRITTEN), metadata.numExamples(), thresholds, metadata.minWeightPerNode())


def _layout(spark: SparkSession, features: int, trees: int) -> tuple[int, int, int, int]:
    """Length of a serialised point, and where its label, bins and counts begin, found by marks."""
    jvm, gateway = spark._jvm, spark._sc._gateway
    marks = [0x5A11 + i for i in range(features)], [0x7B220000 + i for i in range(trees)]
    bins, counts = (gateway.new_array(jvm.int, len(m)) for m in marks)
    for array, numbers in zip((bins, counts), marks, strict=True):
        for i, v in enumerate(numbers):
            array[i] = v
    label = 12345.678
    impl, out = jvm.org.apache.spark.ml.tree.impl, jvm.java.io.ByteArrayOutputStream()
    stream = jvm.java.io.ObjectOutputStream(out)
    stream.writeObject(impl.BaggedPoint(impl.TreePoint(label, bins, 1.0), counts, 1.0))
    stream.close()
    found = bytes(out.toByteArray())
    wanted = np.array([label], ">f8").tobytes(), *(np.array(m, ">i4").tobytes() for m in marks)
    if any(found.count(w) != 1 for w in wanted):
        raise RuntimeError("serialised points have another form than expected")
    return len(found), *(found.index(w) for w in wanted)


def _packed(layout: tuple[int, int, int, int], features: int, trees: int, blocks: Sequence[str], of_bins: type) -> Callable:
    """From serialised points to chunks of rows: their number, targets, and bins and draws one feature or tree after the other."""
    length, label, bins, counts = layout
    chunk_rows, together = CHUNK_ROWS, DRAWN

    def numbers(points: np.ndarray, at: int, many: int, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(points[:, at : at + many * size]).view(kind).reshape(len(points), many)

    def chunk(parts: list) -> pa.RecordBatch:
        y, binned, drawn = (np.concatenate(p) for p in zip(*parts))
        columns = {"n": pa.array([len(y)], pa.int32()), "y": pa.array([y.tobytes()], pa.binary()), "bins": pa.array([binned.T.tobytes()], pa.binary())}
        for i, name in enumerate(blocks):
            columns[name] = pa.array([drawn[:, i * together : (i + 1) * together].T.tobytes()], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
            # Points are padded to the size of the buffer that they were written to.
            padded = int(ends[1] - ends[0])
            if padded < length or (np.diff(ends) != padded).any():
                raise ValueError("serialised points differ in length")
            points = np.frombuffer(column.buffers()[2], np.uint8, len(column) * padded, int(ends[0])).reshape(-1, padded)
            drawn = numbers(points, counts, trees, ">i4")
            if drawn.max() > 255:
                raise ValueError("a tree drew a row more than 255 times")
            for at in range(0, len(points), chunk_rows):
                cut = slice(at, at + chunk_rows)
                parts.append((numbers(points[cut], label, 1, ">f8").ravel().astype(float), numbers(points[cut], bins, features, ">i4").astype(of_bins), drawn[cut].astype(np.uint8)))
                held += len(parts[-1][0])
                if held >= chunk_rows:
                    yield chunk(parts)
                    parts, held = [], 0
        if parts:
            yield chunk(parts)

    return run


def grow(binned: Binned, estimator: RandomForestRegressor) -> list[Tree]:
    """All trees, a level at a time."""
    trees = [Tree.root() for _ in range(estimator.getNumTrees())]
    depth = estimator.getMaxDepth()
    best = _best(binned.widths, estimator.getMinInstancesPerNode(), binned.least_weight, estimator.getMinInfoGain())
    for level in range(depth + 1):
        groups = _groups(binned, trees)
        found = []
        for i in range(0, len(groups), BRANCHES):
            sums = functools.reduce(DataFrame.unionAll, [_sums(binned, trees, group, level) for group in groups[i : i + BRANCHES]])
            found.append(sums.repartition("tree", "first").sortWithinPartitions("tree", "first").mapInArrow(best, SPLITS).toArrow())
        if not found:
            break
        table = pa.concat_tables(found).sort_by([("tree", "ascending"), ("node", "ascending")])
        columns = {c: table[c].to_numpy() for c in table.column_names}
        ends = np.searchsorted(columns["tree"], np.arange(len(trees) + 1))
        for tree, start, end in zip(trees, ends, ends[1:]):
            if len(tree.open):
                tree.split({c: v[start:end] for c, v in columns.items()}, level, depth)
    return trees


def _parts(binned: Binned) -> int:
    # With one, Spark would take a union of such scans for one partition too.
    return max(2, math.ceil(binned.rows / TASK_ROWS))


def _groups(binned: Binned, trees: Sequence[Tree]) -> list[list[tuple[int, int, int]]]:
    """Trees, with the stretches of their open nodes, that a task takes at once: so many that their sums fit, so few that all cores have work."""
    most = max(1, HELD // (24 * sum(binned.widths)))
    # A tree is cut only where it alone is too much, as its rows are followed down anew for each stretch.
    stretches = [(i, first, min(first + most, len(t.open))) for i, t in enumerate(trees) for first in range(0, len(t.open), most)]
    total = sum(last - first for _, first, last in stretches)
    cores = binned.chunks.sparkSession.sparkContext.defaultParallelism
    wanted = max(math.ceil(total / most), min(len(stretches), math.ceil(cores / _parts(binned))))
    groups: dict[int, list[tuple[int, int, int]]] = {}
    seen = 0
    for stretch in stretches:
        groups.setdefault(seen * wanted // total, []).append(stretch)
        seen += stretch[2] - stretch[1]
    return list(groups.values())


def _joined(widths: Sequence[int], most: int) -> list[list[int]]:
    """Features that are counted together, by cells of all their bins: fewer additions per row, and no more than ``most`` cells."""
    joined: list[list[int]] = []
    cells: list[int] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        for j, count in enumerate(cells):
            if count * widths[f] <= most:
                joined[j].append(f)
                cells[j] *= widths[f]
                break
        else:
            joined.append([f])
            cells.append(widths[f])
    return joined


def _sums(binned: Binned, trees: Sequence[Tree], group: Sequence[tuple[int, int, int]], level: int) -> DataFrame:
    """Rows ``(tree, first, sums)``: of the open nodes from ``first`` on, sums of weights, targets and squares by bin, from one task's rows."""
    plan = [(i, first, last, *trees[i].paths()) for i, first, last in group]
    blocks = sorted({i // DRAWN for i, _, _ in group})
    widths, drawn_together, shift, most_total = binned.widths, DRAWN, SHIFT, MOST_TOTAL
    of_bins = np.uint16 if max(widths) > 256 else np.uint8
    sent = max(1, SENT // (24 * sum(widths)))
    joined = _joined(widths, JOINT_CELLS // max(last - first for _, first, last in group))
    cells_of = [math.prod(widths[f] for f in together) for together in joined]

    def places(bins: np.ndarray) -> list[np.ndarray]:
        """The place of each row among the cells of features that are counted together."""
        found = []
        for together in joined:
            at = bins[together[0]].astype(np.intp)
            for f in together[1:]:
                at = at * widths[f] + bins[f]
            found.append(at)
        return found

    class Sums:
        """Of a tree's open nodes, by cell. Counts and totals share a number as long as both are whole and fit into it."""

        def __init__(self, first: int, last: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, place: np.ndarray):
            self.first, self.nodes = first, last - first
            self.feature, self.cut, self.left, self.place = feature, cut, left, place
            self.both, self.squares = ([np.zeros(self.nodes * c) for c in cells_of] for _ in range(2))
            self.apart, self.n, self.total = None, 0.0, 0.0

        def add(self, drawn: np.ndarray, y: np.ndarray, bins: np.ndarray, cells: list[np.ndarray], most: float) -> None:
            """Follow a chunk's rows down to their open nodes; ``most`` is the greatest size of its targets, or infinite if one is not whole."""
            n = len(drawn)
            rows = np.flatnonzero(drawn != 0)
            at, start = np.zeros(len(rows), dtype=np.intp), self.feature * n
            for _ in range(level):
                right = bins.take(start.take(at) + rows) > self.cut.take(at)
                at = self.left.take(at) + right
            at = self.place.take(at) - self.first
            out = (at < 0) | (at >= self.nodes)
            if out.any():
                rows, at = rows[~out], at[~out]
            weight, target = drawn.take(rows).astype(float), y.take(rows)
            total = weight * target
            drawn_rows = float(weight.sum())
            alone = drawn_rows >= shift or drawn_rows * most >= most_total
            if alone or self.n + drawn_rows >= shift or self.total + drawn_rows * most >= most_total:
                self.part()
            if not alone:
                self.n, self.total = self.n + drawn_rows, self.total + drawn_rows * most
            both = weight if alone else weight + total * shift
            squares = total * target
            for j, count in enumerate(cells_of):
                cell = at * count + cells[j].take(rows)
                self.squares[j] += np.bincount(cell, squares, minlength=self.nodes * count)
                if alone:
                    self.apart[j][0] += np.bincount(cell, weight, minlength=self.nodes * count)
                    self.apart[j][1] += np.bincount(cell, total, minlength=self.nodes * count)
                else:
                    self.both[j] += np.bincount(cell, both, minlength=self.nodes * count)

        def part(self) -> None:
            """Take counts and totals apart."""
            if self.apart is None:
                self.apart = [np.zeros((2, len(b))) for b in self.both]
            for both, (n, total) in zip(self.both, self.apart):
                above = np.floor(both / shift)
                n += both - above * shift
                total += above
                both[:] = 0.0
            self.n = self.total = 0.0

        def by_bin(self) -> np.ndarray:
            self.part()
            found: list = [None] * len(widths)
            for j, together in enumerate(joined):
                cells = np.concatenate([self.apart[j], self.squares[j][None]]).reshape(3, self.nodes, *(widths[f] for f in together))
                for k, f in enumerate(together):
                    found[f] = cells.sum(axis=tuple(2 + i for i in range(len(together)) if i != k))
            return np.concatenate(found, axis=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Sums(*of) for _, *of in plan]
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column(0)[row].as_py()
                y = np.frombuffer(batch.column(1)[row].as_buffer(), float)
                bins = np.frombuffer(batch.column(2)[row].as_buffer(), of_bins)
                cells, most = places(bins.reshape(-1, n)), float(np.abs(y).max()) if (y == np.rint(y)).all() else np.inf
                drawn = {b: np.frombuffer(batch.column(3 + k)[row].as_buffer(), np.uint8).reshape(-1, n) for k, b in enumerate(blocks)}
                for of_tree, (i, *_) in zip(sums, plan):
                    of_tree.add(drawn[i // drawn_together][i % drawn_together], y, bins, cells, most)
        for of_tree, (i, first, last, *_) in zip(sums, plan):
            whole = of_tree.by_bin()
            for at in range(0, last - first, sent):
                part = np.ascontiguousarray(whole[:, at : at + sent])
                yield pa.RecordBatch.from_pydict({"tree": pa.array([i], pa.int32()), "first": pa.array([first + at], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})

    needed = ["n", "y", "bins", *(f"draws{b}" for b in blocks)]
    return binned.chunks.select(*needed).coalesce(_parts(binned)).mapInArrow(run, "tree int, first int, sums binary")


def _best(widths: Sequence[int], least: int, least_weight: float, least_gain: float) -> Callable:
    """Add up the sums of each stretch of nodes, which come one after the other, and find the best split of every node."""
    width, invalid, fields = sum(widths), INVALID, [c.split()[0] for c in SPLITS.split(", ")]

    def variance(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n == 0, 0.0, (squares - total * total / n) / n)

    def splits(tree: int, first: int, sums: np.ndarray) -> pa.RecordBatch:
        nodes, at = sums.shape[1], 0
        columns = {"gain": np.full(nodes, invalid), "feature": np.zeros(nodes, dtype=np.int32), "cut": np.zeros(nodes, dtype=np.int32)}
        children, whole = np.zeros((3, nodes)), sums[:, :, : widths[0]].cumsum(axis=2)[:, :, -1]
        impurity = variance(*whole)
        for f, wide in enumerate(widths):
            along = sums[:, :, at : at + wide].cumsum(axis=2)
            at += wide
            if wide < 2:
                continue
            left = along[:, :, :-1]
            right = along[:, :, -1:] - left
            count = left[0] + right[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = impurity[:, None] - left[0] / count * variance(*left) - right[0] / count * variance(*right)
            fewest = np.minimum(left[0], right[0])
            gain = np.where((fewest < least) | (fewest < least_weight) | ~(gain >= least_gain), invalid, gain)
            # The first of equal ones, as in MLlib, of thresholds as of features.
            cut = gain.argmax(axis=1)
            of_cut = gain[np.arange(nodes), cut]
            better = np.flatnonzero(of_cut > columns["gain"])
            columns["gain"][better], columns["feature"][better], columns["cut"][better] = of_cut[better], f, cut[better]
            children[:, better] = left[:, better, cut[better]]
        columns |= {"tree": np.full(nodes, tree, dtype=np.int32), "node": np.arange(first, first + nodes, dtype=np.int32), "impurity": impurity}
        columns |= dict(zip(("n", "total", "squares"), whole)) | dict(zip(("left_n", "left_total", "left_squares"), children))
        return pa.RecordBatch.from_pydict({c: pa.array(columns[c]) for c in fields})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                part = np.frombuffer(batch.column(2)[row].as_buffer(), float).reshape(3, -1, width)
                if key == known:
                    sums += part
                    continue
                if known:
                    yield splits(*known, sums)
                known, sums = key, part.copy()
        if known:
            yield splits(*known, sums)

    return run


def _node_table(number: int, tree: Tree, thresholds: Sequence[Sequence[float]]) -> pa.Table:
    """A tree's nodes as MLlib saves them: numbered from the root to the left, inner nodes of two leaves that predict alike made leaves."""
    with np.errstate(divide="ignore", invalid="ignore"):
        prediction = np.where(tree.stats[:, 0] == 0, 0.0, tree.stats[:, 1] / tree.stats[:, 0])
    left, told = tree.left.tolist(), prediction.tolist()
    size = [1] * len(left)
    for i in range(len(left) - 1, -1, -1):
        if (a := left[i]) >= 0:
            if left[a] < 0 and left[a + 1] < 0 and told[a] == told[a + 1]:
                left[i] = -2
            else:
                size[i] = 1 + size[a] + size[a + 1]
    order, first, second, waiting = [], [], [], [(0, 0)]
    while waiting:
        i, place = waiting.pop()
        order.append(i)
        inner = (a := left[i]) >= 0
        first.append(place + 1 if inner else -1)
        second.append(place + 1 + size[a] if inner else -1)
        if inner:
            waiting += [(a + 1, second[-1]), (a, first[-1])]
    at, inner = np.array(order), np.array(first) >= 0
    # A leaf for which no split was allowed has no impurity, as in MLlib.
    unsplit = (np.array(left)[at] == -1) & (tree.gain[at] == INVALID)
    threshold = [thresholds[f][c] for f, c in zip(tree.feature[at[inner]].tolist(), tree.cut[at[inner]].tolist())]

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.float64()))

    split = {
        "featureIndex": pa.array(np.where(inner, tree.feature[at], -1), pa.int32()),
        "leftCategoriesOrThreshold": lists(threshold, inner.astype(int)),
        "numCategories": pa.array(np.full(len(at), -1), pa.int32()),
    }
    columns = {
        "id": pa.array(np.arange(len(at)), pa.int32()),
        "prediction": pa.array(prediction[at]),
        "impurity": pa.array(np.where(unsplit, -1.0, tree.impurity[at])),
        "impurityStats": lists(tree.stats[at].ravel(), np.full(len(at), 3)),
        "rawCount": pa.array(tree.stats[at, 0].astype(np.int64)),
        "gain": pa.array(np.where(inner, tree.gain[at], -1.0)),
        "leftChild": pa.array(first, pa.int32()),
        "rightChild": pa.array(second, pa.int32()),
        "split": pa.StructArray.from_arrays(split.values(), list(split)),
    }
    return pa.table({"treeID": pa.array(np.full(len(at), number), pa.int32()), "nodeData": pa.StructArray.from_arrays(columns.values(), list(columns))})


def _model(spark: SparkSession, estimator: RandomForestRegressor, binned: Binned, trees: Sequence[Tree]) -> RandomForestRegressionModel:
    """A model of these trees, by way of files: what MLlib saves of a forest over one row, with other nodes."""
    row = spark.sql(f"SELECT array_repeat(0D, {len(binned.thresholds)}) AS x, 0D AS y")
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    source, target = fresh_path(spark, "forest-frame"), fresh_path(spark, "forest")
    estimator.fit(row.select(array_to_vector("x").alias(features), row["y"].alias(label))).write().save(source)
    schema = spark.read.parquet(f"{source}/data").schema
    nodes = spark.createDataFrame(pa.concat_tables([_node_table(i, tree, binned.thresholds) for i, tree in enumerate(trees)]))
    if nodes.dtypes != spark.createDataFrame([], schema).dtypes:
        raise RuntimeError("MLlib saves nodes in another form than expected")
    nodes.write.parquet(f"{target}/data")
    spark.read.parquet(f"{source}/treesMetadata").write.parquet(f"{target}/treesMetadata")
    spark.read.text(f"{source}/metadata").coalesce(1).write.text(f"{target}/metadata")
    return RandomForestRegressionModel.load(target)
