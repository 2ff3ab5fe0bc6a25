"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles, as 64-bit hashes. Two documents link when
``denominator * intersection >= numerator * union``.

* Copies: documents with equal sets form one class, known by a 64-bit digest of the set. A
  task sketches a class once, however many copies it reads.
* Sketches: shingle hashes are dealt into the words of a sketch, and each word is the XOR of
  those dealt to it. Sizes are cut into bands; within a band at most ``d`` shingles of a linked
  pair can differ, and each changes one word. A set that fills more than ``d`` words therefore
  shares a filled word with each of its partners (pigeonhole), and filled words are the join
  keys. A set that fills fewer uses its empty words as well.
* Bound: a second sketch of fixed width has one bit for the parity of the shingles dealt to it.
  Its Hamming distance never exceeds the symmetric difference, which a link bounds from
  above, so pairs beyond that bound go before any set is compared.
* Groups: the members of a key's group stream past in order, each paired with the first and with
  the one before. Links
  found so far are put together into components, and only pairs that lie in different
  components are compared after that. No link between different texts is lost
  that could change a component, and a group of very many near copies costs rows in
  proportion to its size.
* Verification compares the exact sets.

Defined results: NULL or empty texts and texts without words have an empty set and link with
nothing; a row without id links with nothing and has no component; rows that repeat an id
are taken as they are, one result each; texts of any length are compared whole; an empty table gives an
empty one. Extra columns are ignored by the join and kept as they are by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.columns import given_back, number_of, numbered
from assayline.llm.components import connected_components
from assayline.llm.shingles import mixed, shingles
from assayline.session import intermediates, write_through

FOLD_WORDS, WIDE_WORDS = 8, 64
_FOLDS = [f"f{i}" for i in range(FOLD_WORDS)]
# Ratio of neighbouring size bands: wider ones have more words, narrower ones more overlap.
BAND_RATIO = 1.5
# Words of a sketch beyond the necessary ones, in per cent, so that enough of them are filled.
SPARE = 14
CHUNK = 256
# Classes that a task remembers as sketched; forgetting one repeats rows, no more.
SEEN = 500_000


def bands(largest: int) -> list[int]:
    """Lower ends of the size bands up to and beyond ``largest``."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND_RATIO)))
    return ends


def sketch_keys(hashes: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """Join keys of one set: for its own size band and those below that hold possible partners."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ends = bands(n)
    keys = []
    high = hashes >> np.uint64(32)
    band = len(ends) - 2
    while band >= 0 and (ends[band + 1] - 1) * denominator >= n * numerator:
        most = (denominator - numerator) * (ends[band + 1] - 1) // numerator
        size = most + most * SPARE // 100 + 2
        place = (high * np.uint64(size)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        filled = place[starts]
        salt = mixed(np.uint64([band * 2 + 1]) * np.uint64(0x9E3779B97F4A7C15))
        keys.append(mixed(np.bitwise_xor.reduceat(hashes, starts) ^ mixed(filled + salt)))
        if len(filled) <= min(most, (denominator - numerator) * n // numerator):
            empty = np.setdiff1d(np.arange(size, dtype=np.uint64), filled, assume_unique=True)
            keys.append(mixed(mixed(empty + salt) ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        band -= 1
    return np.unique(np.concatenate(keys))


def fold(hashes: np.ndarray, words: int = FOLD_WORDS) -> np.ndarray:
    """Parity of the shingles at each bit of a sketch of fixed width."""
    bits = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Slices of (id, text) batches with the sets of their texts and the sets' digests."""
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            part = batch.slice(start, CHUNK)
            sets = [shingles(t, width) for t in part.column(1).to_pylist()]
            yield part, sets, np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)


def _source(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))


def features(docs: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """Per row: id, class, size of its set and the fixed sketch."""
    names = ["id", "class", "n", *_FOLDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, classes in _batches(batches, width):
            folds = np.stack([fold(s) for s in sets])
            columns = [part.column(0), pa.array(classes), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(folds[:, i]) for i in range(FOLD_WORDS)]], names=names)

    return _source(docs, id, text).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def sketch_words(docs: DataFrame, width: int, numerator: int, denominator: int, id: str, text: str) -> DataFrame:
    """(key, class) of every class, once per task that reads it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets, classes in _batches(batches, width):
            if len(seen) > SEEN:
                seen.clear()
            keys, owners = [], []
            for s, c in zip(sets, classes.tolist(), strict=True):
                if c not in seen and len(s):
                    seen.add(c)
                    keys.append(sketch_keys(s, numerator, denominator))
                    owners.append(np.full(len(keys[-1]), c, dtype=np.int64))
            if keys:
                columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "class"])

    return _source(docs, id, text).where("id is not null").mapInArrow(run, "key long, class long")


def set_table(docs: DataFrame, wanted: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """(class, hashes, wide) of the documents whose ids are wanted; ``wide`` is a fixed sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, classes in _batches(batches, width):
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64)
            wide = np.concatenate([fold(s, WIDE_WORDS) for s in sets])
            ends = np.arange(len(sets) + 1, dtype=np.int32) * WIDE_WORDS
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.ListArray.from_arrays(pa.array(ends), pa.array(wide))],
                names=["class", "hashes", "wide"],
            )

    return _source(docs, id, text).join(wanted, "id", "left_semi").mapInArrow(run, "class long, hashes array<long>, wide array<long>")


def _possible(numerator: int, denominator: int) -> Column:
    """Sizes and fixed sketches of sides x and y allow a link."""
    smaller, larger = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    distance = sum((F.bit_count(F.col(f"x.{f}").bitwiseXOR(F.col(f"y.{f}"))).cast("long") for f in _FOLDS), F.lit(0))
    most = (F.col("x.n") + F.col("y.n")) * (denominator - numerator)
    return (smaller * denominator >= larger * numerator) & (distance * (denominator + numerator) <= most)


class Join:
    """The join over one table of documents; each table it needs again is written once."""

    def __init__(self, docs: DataFrame, width: int, numerator: int, denominator: int, id: str, text: str):
        self.docs, self.width, self.id, self.text = docs, width, id, text
        self.numerator, self.denominator = numerator, denominator
        self.rows = write_through(features(docs, width, id, text), "sketches")
        counted = self.rows.where("n > 0 and id is not null")
        same = [F.min(c).alias(c) for c in ("id", "n", *_FOLDS)]
        self.classes = write_through(counted.groupBy("class").agg(*same), "classes")
        in_order = Window.partitionBy("key").orderBy("class")
        words = sketch_words(docs, width, numerator, denominator, id, text)
        # Copies read by several tasks stand next to each other.
        once = words.withColumn("previous", F.lag("class").over(in_order)).where("previous is null or previous <> class")
        groups = once.withColumn("least", F.first("class").over(in_order)).where("class <> least")
        self.groups = write_through(groups, "groups")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes whose sets link; ``pairs`` is a written table.

        A sketch eight times as wide as that of the rows is held against the bound first, so
        that few sets travel with a pair that cannot link.
        """
        members = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        wanted = self.classes.join(members, "class", "left_semi").select("id").distinct()
        sets = write_through(set_table(self.docs, wanted, self.width, self.id, self.text), "sets")
        wide = sets.select("class", F.size("hashes").alias("n"), "wide")
        sketched = pairs.select("a", "b").join(wide.toDF("a", "n_a", "wide_a"), "a").join(wide.toDF("b", "n_b", "wide_b"), "b")
        apart = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda t, d: t + d)
        most = (F.col("n_a") + F.col("n_b")) * (self.denominator - self.numerator)
        near = write_through(sketched.where(apart * (self.denominator + self.numerator) <= most).select("a", "b").distinct(), "near")
        both = near.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("x")), "a")
        both = both.join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        union = F.size("x") + F.size("y") - shared
        return both.where(shared * self.denominator >= union * self.numerator).select("a", "b").distinct()

    def against_least(self) -> DataFrame:
        """(a, b, shared): each member with its group's first and with the one before, where a link is possible."""
        pairs = self.groups.select(F.explode(F.array_distinct(F.array("least", "previous"))).alias("a"), F.col("class").alias("b"))
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
        x, y = self.classes.alias("x"), self.classes.alias("y")
        near = pairs.join(x, pairs["a"] == F.col("x.class")).join(y, pairs["b"] == F.col("y.class"))
        return near.where(_possible(self.numerator, self.denominator)).select("a", "b", "shared")

    def across(self, components: DataFrame) -> DataFrame:
        """Pairs of one group in different components, as far as a link is possible."""
        label = components.select(F.col("node").alias("class"), "component")
        members = self.groups.select("key", "class").union(self.groups.select("key", F.col("least").alias("class")).distinct())
        members = members.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
        several = members.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("key")
        table = write_through(members.join(several, "key", "left_semi").join(self.classes, "class"), "members")
        x, y = table.alias("x"), table.alias("y")
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component"))
        return x.join(y, met & _possible(self.numerator, self.denominator)).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(node, component) of the classes that links reach, from three steps of comparing.

        First each class is compared with the first member it shares most keys with; then with
        the others, where these are still in another component; then across components.
        """
        pairs = write_through(self.against_least(), "pairs")
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
        best = write_through(best, "best")
        found = self._joined(lambda: self.verified(best))
        of_a = found.select(F.col("node").alias("a"), F.col("component").alias("p"))
        of_b = found.select(F.col("node").alias("b"), F.col("component").alias("q"))
        apart = pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")
        found = self._grown(found, apart.join(best, ["a", "b"], "left_anti"))
        return self._grown(found, self.across(found))

    def _grown(self, found: DataFrame, pairs: DataFrame) -> DataFrame:
        """Components with the links among some more pairs."""
        pairs = write_through(pairs, "pairs")
        if pairs.isEmpty():
            return found
        # A component is one link from each node to its smallest: earlier links are done with.
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return self._joined(lambda: links.union(self.verified(pairs)))

    def _joined(self, links: Callable[[], DataFrame]) -> DataFrame:
        """Components of some links; the sets that these were verified by go when they are written."""
        with intermediates(self.docs.sparkSession) as written:
            found = write_through(connected_components(links()), "components")
            written.pop()
        return found


def jaccard_components(docs: DataFrame, width: int = 3, numerator: int = 90, denominator: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, class_id): one row per row of ``docs``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id that
    links reach. Copies are not expanded into pairs.
    """
    join = Join(docs, width, numerator, denominator, id, text)
    components = join.components()
    named = join.classes.select("class", F.col("id").alias("class_id")).join(components, F.col("class") == F.col("node"), "left")
    named = write_through(named.select("class", "class_id", F.coalesce("component", "class").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    rows = join.rows.select("id", "n", "class").join(named.join(least, "component"), "class", "left")
    alone = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id"))
    return rows.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"),
        alone.otherwise(F.col("component_id")).alias("component_id"), alone.otherwise(F.col("class_id")).alias("class_id"),
    )


def keep_one(docs: DataFrame, width: int = 5, numerator: int = 80, denominator: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of linked ones: that with the smallest id; columns as given.

    Rows without id stay. Of rows that repeat an id one stays. What the join writes goes when its result is written.
    """
    names, id, text, docs = docs.columns, number_of(docs, id), number_of(docs, text), numbered(docs)
    with intermediates(docs.sparkSession) as written:
        rows = write_through(jaccard_components(docs, width, numerator, denominator, id, text), "groups")
        written.pop()
    kept = rows.where(F.col(id).isNotNull()).groupBy(id).agg(F.min("component_id").alias("__least"), F.count("*").alias("__rows"))
    kept = kept.where(F.col(id) == F.col("__least")).select(F.col(id).alias("__kept"), "__rows")
    found = docs.join(kept, F.col(id) == F.col("__kept"))
    once = found.where("__rows = 1").drop("__kept", "__rows")
    several = found.where("__rows > 1").drop("__kept", "__rows").dropDuplicates([id])
    return given_back(once.unionByName(several).unionByName(docs.where(F.col(id).isNull())), names)
