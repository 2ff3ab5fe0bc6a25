"""Quality rules: counts of a text, and perplexity under a corpus model of its own language.

The model is a modified Kneser-Ney model of the characters of words, counted with Spark over
all documents that are long enough and hold few symbols (of a language without any such, over
all its documents), and smoothed with the discounts that its own counts give. Its entries
are known by a 64-bit hash. As many as a bound allows lie in sorted arrays that every task has; of a model with
more, these are the grams used most, and a text's other grams are joined to the written table of all
entries, so that no entry is left out of any text's score. The mean logarithm of a text's character probabilities is held against its
language's band, which lies around the median of all documents that pass the basic rules;
both too surprising and too predictable texts are rejected.

Defined results: a NULL text has no words and fails; a NULL language is a language of its
own, and the band of one with few documents leans smoothly towards that of all; equal rows get
equal results, once per row; texts of any length are counted whole; without documents there is no model
and no row. Extra columns pass through, whatever their names; an added column takes the place of one of its name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.columns import given_back
from assayline.llm.shingles import windows, word_hashes
from assayline.session import write_through

ORDER = 4
MAX_ENTRIES = 2_000_000  # that a task holds, of all languages together; 16 bytes each
# Perplexity of a kept text, as a part and a multiple of its language's median.
LOWEST, HIGHEST = 1 / 1.5, 2.5
LEAN = 2  # documents that the median of all languages counts as beside a language's own
LEAST_WORDS, MOST_SYMBOLS = 50, 0.01  # of a document that the model learns from; symbols per character
STEP = 0.002  # resolution of the histogram of mean log-probabilities
CHUNK = 256
MEMO_WORDS = 300_000
MEMO_VALUES = 600_000  # words of all languages together whose values a task remembers

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


# -- the model ---------------------------------------------------------------------------


def spelled(word: bytes) -> str:
    """Characters that the model predicts, after a word start."""
    return f" {word.decode('utf-8', 'replace').lower()} "


def pieces(s: str) -> list[str]:
    """Each character after the first with up to three before it."""
    return [*[s[:i] for i in range(2, min(ORDER, len(s) + 1))], *[s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]]


def grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, clean, gram, n): each character of each word with up to three before it, counted.

    Documents that read like running text, with enough words and few symbols, are clean. Words are counted within a task first, so few rows leave it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str | None, bool], dict[str, int]] = {}
        for batch in batches:
            words: dict[tuple[str | None, bool], Counter] = {}
            for t, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (t or "").encode().split()
                clean = len(found) >= LEAST_WORDS and sum(map(t.count, SYMBOLS)) <= MOST_SYMBOLS * len(t)
                if found:
                    words.setdefault((code, clean), Counter()).update(found)
            for kind, found in words.items():
                into = counts.setdefault(kind, {})
                get = into.get
                for word, n in found.items():
                    for gram in pieces(spelled(word)):
                        into[gram] = get(gram, 0) + n
            if sum(map(len, counts.values())) > MEMO_WORDS:
                yield from _counted(counts)
                counts = {}
        yield from _counted(counts)

    return docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).mapInArrow(run, "lang string, clean boolean, gram string, n long").groupBy("lang", "clean", "gram").agg(F.sum("n").alias("n"))


def _counted(counts: dict[tuple[str | None, bool], dict[str, int]]) -> Iterator[pa.RecordBatch]:
    for (code, clean), found in counts.items():
        columns = [pa.array([code] * len(found), pa.string()), pa.array([clean] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "clean", "gram", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count, smooth and store the model of all languages."""
    found = write_through(grams(docs, text, lang), "grams").withColumn("lang", F.coalesce("lang", F.lit("")))
    rest = found.where("not clean").join(found.where("clean").select("lang").distinct(), "lang", "left_anti")
    counted = found.where("clean").unionByName(rest).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = write_through(counted, "counted")
    orders = {ORDER: counted.where(F.length("gram") == ORDER)}
    for n in range(ORDER - 1, 0, -1):
        # Below the highest order a gram counts the characters seen before it; at a word's
        # start, where none can be, its own number.
        inner = orders[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
        starts = counted.where(F.length("gram") == n)
        orders[n] = write_through(inner.unionByName(starts).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"order{n}")
    characters = orders[1].groupBy("lang").agg(F.count("*").alias("size"))
    lower = None
    parts = []
    for n in range(1, ORDER + 1):
        table = orders[n].withColumn("context", F.substring("gram", 1, n - 1))
        table = table.join(_discounts(table), "lang").withColumn("held", F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        totals = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("held").alias("kept"))
        totals = totals.withColumn("back", 1 - F.col("kept") / F.col("total"))
        table = table.join(totals, ["lang", "context"])
        if lower is None:
            table = table.join(characters, "lang").withColumn("p", F.col("held") / F.col("total") + F.col("back") / (F.col("size") + 1))
        else:
            below = lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("q"))
            table = table.withColumn("rest", F.substring("gram", 2, n - 1)).join(below, ["lang", "rest"])
            table = table.withColumn("p", F.col("held") / F.col("total") + F.col("back") * F.col("q"))
        lower = write_through(table.select("lang", "gram", "n", "p"), f"p{n}")
        # A text asks first for grams of the highest order and for those at a word's start; others are met on the way back.
        uses = F.col("n") if n == ORDER else F.when(F.col("gram").startswith(" "), F.col("n")).otherwise(0)
        parts.append(lower.select(F.xxhash64("lang", "gram").alias("key"), F.log("p").cast("float").alias("value"), F.lit(True).alias("is_p"), uses.alias("uses")))
        back = F.log(F.greatest("back", F.lit(1e-9))).cast("float")
        parts.append(totals.select(F.xxhash64("lang", "context").alias("key"), back.alias("value"), F.lit(False).alias("is_p"), F.lit(0).alias("uses")))
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    entries = write_through(entries, "entries")
    if entries.count() <= MAX_ENTRIES:
        # No more languages than entries.
        return Model.of(entries.drop("uses").toArrow(), {row["lang"]: row["size"] for row in characters.collect()})
    model = Model.of(entries.where(F.col("uses") > _least_uses(entries)).drop("uses").toArrow(), {}, complete=False)
    model.tables = (entries.drop("uses"), write_through(characters, "characters"))
    return model


def _discounts(table: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language from the counts of counts."""
    counts = table.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        # Without a usable value, as in a small language, one half of the count.
        value = i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}")
        return F.when((value > 0) & (value < i), value).otherwise(0.5 * i)

    return counts.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])


def _least_uses(entries: DataFrame) -> int:
    """Number of uses up to which entries are left to the join, so that the others fit the bound."""
    cell = F.floor(F.log2("uses") * 8).alias("cell")
    rows = entries.where("uses > 0").groupBy(cell).agg(F.count("*").alias("entries"), F.max("uses").alias("most")).orderBy(F.desc("cell")).collect()
    kept = 0
    for row in rows:
        kept += row["entries"]
        if kept > MAX_ENTRIES:
            return row["most"]
    return 0


def rest_values(wanted: DataFrame, entries: DataFrame, characters: DataFrame) -> DataFrame:
    """(lang, gram, value): log-probability of the last character of some distinct grams, from the table of all entries.

    A gram asks for itself and what follows its first characters, and for the weight of each context on the way."""
    steps = []
    for k in range(ORDER):
        rest = f"substring(gram, {k + 1})"
        steps += [f"named_struct('k', {k}, 'asks_p', true, 'own', xxhash64(lang, {rest}))",
                  f"named_struct('k', {k}, 'asks_p', false, 'own', xxhash64(lang, substring({rest}, 1, length({rest}) - 1)))"]
    asked = wanted.selectExpr("lang", "gram", f"inline(array({', '.join(steps)}))").where("k < length(gram)")
    met = asked.join(entries, (F.col("own") == F.col("key")) & (F.col("asks_p") == F.col("is_p")))
    cells = [F.max(F.when((F.col("k") == k) & (F.col("asks_p") == p), F.col("value").cast("double"))).alias(f"{name}{k}") for k in range(ORDER) for name, p in (("p", True), ("b", False))]
    known = wanted.join(met.groupBy("lang", "gram").agg(*cells), ["lang", "gram"], "left").join(characters, "lang", "left")
    value = -F.log(F.coalesce("size", F.lit(1)) + F.lit(1.0))
    for k in reversed(range(ORDER)):
        value = F.coalesce(f"p{k}", F.coalesce(f"b{k}", F.lit(0.0)) + value)
    return known.select("lang", "gram", value.alias("value"))


class Model:
    """Arrays of log-probabilities and back-off weights, sorted by hash.

    Of a model that is not ``complete`` they hold the probabilities used most, and no way back: ``tables`` has all entries, and
    what a task cannot tell is NaN.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, back_keys: np.ndarray, back_values: np.ndarray, sizes: dict[str, int], complete: bool = True):
        self.keys, self.values, self.back_keys, self.back_values, self.sizes, self.complete = keys, values, back_keys, back_values, sizes, complete
        self.tables: tuple[DataFrame, DataFrame] | None = None
        self.characters: dict[str, dict[str, float]] = {}
        self.words: dict[str, dict[bytes, float]] = {}

    @classmethod
    def of(cls, entries: pa.Table, sizes: dict[str, int], complete: bool = True) -> Model:
        keys, values = entries["key"].to_numpy(), entries["value"].to_numpy()
        is_p = entries["is_p"].to_numpy()

        def part(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(keys[chosen], kind="stable")
            return keys[chosen][order], values[chosen][order].astype(np.float32)

        return cls(*part(is_p), *part(~is_p), sizes, complete)

    def __getstate__(self) -> tuple:
        return self.keys, self.values, self.back_keys, self.back_values, self.sizes, self.complete

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, seed: int, gram: str) -> float | None:
        key = np.uint64(xxhash.xxh64_intdigest(gram.encode(), seed)).view(np.int64)
        i = int(np.searchsorted(keys, key))
        return float(values[i]) if i < len(keys) and keys[i] == key else None

    def character(self, lang: str, gram: str) -> float:
        """Log-probability of a gram's last character after the others; NaN where it takes the table of all entries."""
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        weight = 0.0
        while gram:
            found = self._find(self.keys, self.values, seed, gram)
            if found is not None:
                return weight + found
            if not self.complete:
                return math.nan
            weight += self._find(self.back_keys, self.back_values, seed, gram[:-1]) or 0.0
            gram = gram[1:]
        return weight - math.log(self.sizes.get(lang, 1) + 1)

    def word(self, lang: str, word: bytes) -> float:
        known = self.characters.setdefault(lang, {})
        if len(known) > MEMO_WORDS:
            known.clear()
        found = pieces(spelled(word))
        try:
            return sum(map(known.__getitem__, found))
        except KeyError:
            for gram in found:
                if gram not in known:
                    known[gram] = self.character(lang, gram)
            return sum(map(known.__getitem__, found))

    def total(self, lang: str, words: list[bytes]) -> float:
        """Log-probability of all characters of some words; NaN where ``open`` has to part them."""
        known = self.words.setdefault(lang, {})
        if sum(map(len, self.words.values())) > MEMO_VALUES:
            # All languages start anew: one that is met seldom would else be forgotten at each of its texts.
            for memo in self.words.values():
                memo.clear()
        # Long words are not remembered, so a text has values of its own; the memo, as large as it may be, is not copied for them.
        own = {}
        for w in set(words).difference(known):
            (known if len(w) <= 64 else own)[w] = self.word(lang, w)
        if own:
            return math.fsum([own[w] if w in own else known[w] for w in words])
        return math.fsum(map(known.__getitem__, words))

    def open(self, lang: str, words: list[bytes]) -> tuple[float, dict[str, int]]:
        """Log-probability of the characters that a task can tell, and the other grams with their number."""
        known, sums, rest = self.characters.setdefault(lang, {}), [], Counter()
        for word, times in Counter(words).items():
            for gram in pieces(spelled(word)):
                value = known.get(gram)
                if value is None:
                    value = self.character(lang, gram)
                if value == value:
                    sums.append(times * value)
                else:
                    rest[gram] += times
        return math.fsum(sums), rest


# -- rules ---------------------------------------------------------------------------------


def counts_of(text: str) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    repeated = 0
    if len(words) > 3:
        found = windows(word_hashes(words), 3)
        ranked = np.sort(found)
        again = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(again):
            twice = again[np.minimum(np.searchsorted(again, found), len(again) - 1)] == found
            inside = np.zeros(len(words), dtype=bool)
            for i in range(3):
                inside[i : len(words) - 2 + i] |= twice
            repeated = int(inside.sum())
    chars = len(text) - sum(map(text.count, SPACE))
    return words, (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", lowest: float = LOWEST, highest: float = HIGHEST) -> DataFrame:
    """Add the five counts, base_failed, log_perplexity (NULL without words) and kept."""
    names = docs.columns
    source = docs.toDF(*[f"c{i}" for i in range(len(names))])
    position, code = names.index(text), names.index(lang)
    fitted = fit(docs, text, lang)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    added = [*[T.StructField(n, T.LongType()) for n in _NAMES], T.StructField("log_perplexity", T.DoubleType())]
    if not fitted.complete:
        added.append(T.StructField("rest", T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("times", T.LongType())]))))
    kept_fields = [f for i, f in enumerate(source.schema.fields) if i != position]
    schema = T.StructType([*kept_fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                rows, scores, rests = [], [], []
                for t, c in zip(part.column(position).to_pylist(), part.column(code).to_pylist(), strict=True):
                    words, counts = counts_of(t or "")
                    rows.append(counts)
                    total, rest = lm.total(c or "", words), {}
                    if total != total:
                        total, rest = lm.open(c or "", words)
                    # One more for each word's end.
                    scores.append(-total / (counts[1] + len(words)) if words else None)
                    rests.append([{"gram": g, "times": n} for g, n in rest.items()])
                columns = [c for i, c in enumerate(part.columns) if i != position]
                columns += [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.array(scores, pa.float64())]
                if not lm.complete:
                    columns.append(pa.array(rests, pa.list_(pa.struct([("gram", pa.string()), ("times", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    counted = source.mapInArrow(run, schema)
    if fitted.complete:
        counted = write_through(counted, "judged")
    else:
        # Numbers of rows are fixed as they are written.
        counted = write_through(counted.withColumn("row", F.monotonically_increasing_id()), "judged")
        counted = write_through(_completed(counted, F.coalesce(f"c{code}", F.lit("")), fitted.tables), "completed")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed).withColumn("__lang", F.coalesce(f"c{code}", F.lit("")))
    limits = bands(rows.where("not base_failed"), lowest, highest)
    rows = rows.join(limits.withColumnRenamed("lang", "__l"), F.col("__lang") == F.col("__l"), "left")
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    out = rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return given_back(out, names, [*_NAMES, "base_failed", "log_perplexity", "kept"], [text])


def _completed(counted: DataFrame, lang: Column, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows with the share of the grams in ``rest`` in their ``log_perplexity``; only these grams are shuffled."""
    asked = counted.select("row", lang.alias("lang"), F.inline("rest"))
    values = write_through(rest_values(write_through(asked.select("lang", "gram").distinct(), "rest-grams"), *tables), "rest-values")
    more = asked.join(values, ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
    whole = F.col("log_perplexity") - F.coalesce("more", F.lit(0.0)) / (F.col("word_chars") + F.col("n_words"))
    return counted.drop("rest").join(more, "row", "left").withColumn("log_perplexity", whole).drop("row", "more")


def bands(rows: DataFrame, lowest: float, highest: float) -> DataFrame:
    """(lang, low, high) of every language, around its median shrunk towards that of all.

    Medians come from a histogram of fixed step, so no language is sorted in one task.
    """
    cells = rows.groupBy(F.col("__lang").alias("lang"), F.floor(F.col("log_perplexity") / STEP).alias("cell")).agg(F.count("*").alias("n"))
    cells = write_through(cells, "cells")

    def medians(table: DataFrame) -> DataFrame:
        up = Window.partitionBy("lang").orderBy("cell")
        whole = table.groupBy("lang").agg(F.sum("n").alias("docs"))
        upto = table.withColumn("upto", F.sum("n").over(up)).join(whole, "lang").where(F.col("upto") * 2 >= F.col("docs"))
        return upto.groupBy("lang").agg(F.max("docs").alias("docs"), (F.min("cell") * STEP).alias("median"))

    whole = medians(cells.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(""))).first()
    overall = whole["median"] if whole else 0.0
    shrunk = (F.col("docs") * F.col("median") + LEAN * overall) / (F.col("docs") + LEAN)
    return medians(cells).select("lang", (shrunk + math.log(lowest)).alias("low"), (shrunk + math.log(highest)).alias("high"))
