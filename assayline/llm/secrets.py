"""Secret scans: fixed patterns, and a battery of randomness tests over other long tokens.

Fixed patterns give the base spans. Other candidates are long runs of letters, digits and the
signs of encoded data. Each is tested for randomness within its inferred encoding: uniform
use of the alphabet (chi-squared), runs of its lower and upper half, and serial correlation
of neighbours. The three statistics give one p-value. In each class of encoding and length
the candidates that are not random are told from those that are by the Benjamini-Hochberg
step at a fixed false-discovery rate; those that remain are spans as well.

DataFrame functions only. Positions are code points, ends exclusive. Defined results: NULL
text is an empty text without spans; equal rows give equal results, once per row; texts of any length are
scanned whole; an empty table gives an empty one; the p-values of a whole table are counted in a grid of fixed size.
Extra columns pass through, whatever their names; the spans take the place of a column of their name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.columns import given_back, number_of, numbered

# Fixed values of the contract. A keyword may be in either case; a hexadecimal or access run
# is maximal, so that its least length can stand in the pattern. A short assigned value cannot:
# such a match takes its characters, and is dropped afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "letters": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
RATE = 0.05  # false discoveries among the candidates that are called not random
GRID = 10_000  # steps of the p-values that are counted
LENGTH_CLASSES = 32  # by powers of two

Span = "struct<start:int,end:int,text:string>"


def spans(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, with start, end and text.

    The texts between matches come from ``split``, which finds the same matches, so the
    places follow from lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    gaps = F.slice(between, 1, F.size(found))
    moves = F.zip_with(gaps, found, lambda gap, match: F.coalesce(gap, F.lit(0)) + F.length(match))

    def place(before: Column, gap: Column, match: Column) -> Column:
        start = before + F.coalesce(gap, F.lit(0))
        return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("text"))

    known = F.zip_with(gaps, found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    placed = F.zip_with(running(moves, lambda a, b: a + b), known, lambda before, piece: place(before, piece["gap"], piece["match"]))
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast(f"array<{Span}>"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def blocks(values: Column) -> Column:
    """An array cut into about as many blocks as each has elements."""
    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / width).cast("int") - 1, F.lit(0)))
        return F.transform(places, lambda i: F.slice(v, i * width + 1, width))

    return once(values, cut)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of some integers what ``join`` makes of those before it, from 0 on.

    Within blocks first and then over the blocks, as an array that grows by one is copied each time.
    """
    def grown(items: Column, amount: Callable[[Column], Column]) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda s, x: F.struct(join(s["at"], amount(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def over(parts: Column) -> Column:
        starts = grown(parts, lambda p: p["at"])["out"]
        return F.flatten(F.zip_with(parts, starts, lambda p, start: F.transform(p["out"], lambda x: join(start, x))))

    return once(F.transform(blocks(values), lambda block: grown(block, lambda x: x)), over)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind."""
    assigned = F.filter(spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= LEAST_VALUE)
    return {"assign": assigned, "access": spans(text, ACCESS), "hex": spans(text, HEX)}


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9]+$"), "digits").when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32").when(token.rlike("^[A-Za-z0-9]+$"), "letters").otherwise("base64")
    )


def battery(token: Column, kind: Column) -> Column:
    """p-value of a token under a uniform choice of its alphabet's characters."""
    alphabet = F.lit(None).cast("string")
    for name, letters in ALPHABETS.items():
        alphabet = F.when(kind == name, letters).otherwise(alphabet)
    plain = F.regexp_replace(F.when(kind == "hex", F.lower(token)).otherwise(token), "=+", "")
    values = F.struct(plain.alias("s"), F.length(plain).cast("double").alias("n"), alphabet.alias("a"), F.length(alphabet).cast("double").alias("k"))

    def test(x: Column) -> Column:
        # Without enough characters no statistic counts, but each must have a value.
        s, n, a, k = x["s"], F.greatest(x["n"], F.lit(2.0)), x["a"], x["k"]
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t + F.pow(n - F.length(F.replace(s, c, F.lit(""))), 2))
        uniform = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        places = F.transform(chars, lambda c: F.instr(a, c) - (k + 1) / 2)
        pairs = F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.size(places)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        changes = F.aggregate(pairs, F.lit(0.0), lambda t, y: t + F.when((y["p"] > 0) != (y["q"] > 0), 1.0).otherwise(0.0))
        product = F.aggregate(pairs, F.lit(0.0), lambda t, y: t + y["p"] * y["q"])
        runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = product / ((k * k - 1) / 12 * F.sqrt(n - 1))
        return F.when(n < 8, 0.0).otherwise(_beyond(F.pow(uniform, 2) + F.pow(runs, 2) + F.pow(serial, 2)))

    return F.transform(F.array(values), test)[0]


def _beyond(q: Column) -> Column:
    """Probability that a chi-squared value with three degrees of freedom is above ``q``.

    The complementary error function is a rational approximation (Abramowitz and Stegun 7.1.26).
    """
    x = F.sqrt(q / 2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.exp(-q / 2) * (tail + F.sqrt(q * (2 / math.pi)))


def candidates(text: Column) -> Column:
    """Candidate spans with their class and p-value."""
    def judged(s: Column) -> Column:
        return F.transform(
            F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), encoding(s["text"]).alias("kind"))),
            lambda c: F.struct(
                c["start"].alias("start"), c["end"].alias("end"),
                F.concat_ws(":", c["kind"], F.least(F.floor(F.log2(F.length(c["text"]))), F.lit(LENGTH_CLASSES)).cast("string")).alias("class"),
                battery(c["text"], c["kind"]).alias("p"),
            ),
        )[0]

    return F.transform(spans(text, CANDIDATE), judged)


def thresholds(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Per class the p-value up to which candidates are called not random.

    Counts go into a grid whose size does not depend on the table: classes of encoding and
    length times steps. The largest step below which false discoveries stay under the rate
    is the threshold. At most ``len(ALPHABETS) * LENGTH_CLASSES`` numbers reach the driver.
    """
    found = docs.select(F.explode(candidates(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("c")).select("c.class", F.ceil(F.col("c.p") * GRID).alias("step"))
    counted = found.groupBy("class", "step").agg(F.count("*").alias("n"))
    totals = counted.groupBy("class").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("step", "n"))).alias("steps"))
    zero = F.struct(F.lit(0).cast("long").alias("below"), F.lit(-1).cast("long").alias("best"))

    def step(state: Column, cell: Column) -> Column:
        below = state["below"] + cell["n"]
        holds = cell["step"] * F.col("all") <= RATE * GRID * below
        return F.struct(below.alias("below"), F.when(holds, cell["step"]).otherwise(state["best"]).alias("best"))

    best = totals.select("class", F.aggregate("steps", zero, step, lambda state: state["best"]).alias("best"))
    return {row["class"]: row["best"] / GRID for row in best.collect()}


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add column ``out``: array of (kind, start, end) in order of start, then of kind as listed.

    Two passes: one counts p-values, one finds all spans with the thresholds as constants.
    Nothing is shuffled but the grid.
    """
    own, docs, text = docs.columns, numbered(docs), number_of(docs, text)
    limits = thresholds(docs, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair]) if limits else None
    base = base_spans(whole)
    fixed = docs.withColumns({f"__{k}": v for k, v in base.items()})

    def ranked(kind: str, column: Column) -> Column:
        rank = KINDS.index(kind)
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    given = F.concat(*[ranked(k, F.col(f"__{k}")) for k in base])
    fixed = fixed.withColumn("__given", given).drop(*[f"__{k}" for k in base])
    if table is None:
        added = F.slice(F.col("__given"), 1, 0)
    else:
        likely = F.filter(candidates(whole), lambda c: c["p"] > F.coalesce(table[c["class"]], F.lit(1.0)))
        added = ranked("random", clear_of(likely, F.col("__given")))
    every = F.array_sort(F.concat(F.col("__given"), added))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.transform(every, lambda s: F.struct(F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return given_back(fixed.withColumn("found", listed), own, {out: "found"})


def clear_of(found: Column, given: Column) -> Column:
    """The spans of one array that overlap none of another, in order.

    All lie in one order, spans of the first at their ends and those of the second at their starts: where a
    span ends, the farthest end of those that started before it must not lie beyond its start.
    """
    ends = F.transform(found, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("given"), c["start"].alias("start"), F.lit(0).alias("reach")))
    starts = F.transform(given, lambda g: F.struct(g["start"].alias("at"), F.lit(1).alias("given"), g["start"].alias("start"), g["end"].alias("reach")))

    def cleared(events: Column) -> Column:
        farthest = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        marked = F.zip_with(events, farthest, lambda e, far: F.struct(e["start"].alias("start"), e["at"].alias("end"), ((e["given"] == 0) & (far <= e["start"])).alias("clear")))
        return F.filter(marked, lambda m: m["clear"])

    return once(F.array_sort(F.concat(ends, starts)), cleared)


def digest_text(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, in their order, joined by commas."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover put as ``mark``.

    The text is cut block by block of spans, as finding a place in a text takes as long as the text before it.
    """
    def cut(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return F.zip_with(spans, reach, lambda s, before: F.struct(s["start"].alias("start"), s["end"].alias("end"), before.alias("before")))

    def block_text(block: Column) -> Column:
        base, end = block[0]["before"], F.array_max(F.transform(block, lambda s: s["end"]))
        def pieces(chunk: Column) -> Column:
            def piece(s: Column) -> Column:
                hidden = (s["start"] < s["before"]) & (s["before"] > 0)
                return F.when(hidden, "").otherwise(F.concat(F.substring(chunk, s["before"] - base + 1, s["start"] - s["before"]), F.lit(mark)))

            return F.array_join(F.transform(block, piece), "")

        return once(F.substring(text, base + 1, end - base), pieces)

    parts = F.transform(blocks(cut(found)), block_text)
    rest = F.substring(text, F.array_max(F.transform(found, lambda s: s["end"])) + 1, F.length(text))
    return F.when(F.size(found) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with their secrets redacted; ``length`` follows the text where it is a column."""
    own = number_of(docs, text)
    found = scan(numbered(docs), own, "found")
    clean = found.withColumn("clean", redact(F.col(own), F.col("found")))
    if length in docs.columns:
        clean = clean.withColumn(number_of(docs, length), F.length("clean").cast(docs.schema[length].dataType))
    return given_back(clean.withColumn(own, F.col("clean")), docs.columns)
