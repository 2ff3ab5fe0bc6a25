"""Score post-processing and the rule score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.functions.numeric import round_half_even
from assayline.functions.randomness import hash_normal, key_digest

# Score limits, category cuts, labels and texts.
SCORE_RANGE = (1.0, 10.0)
CATEGORY_CUTS = ((4.0, "Poor"), (6.0, "Average"))
TOP_CATEGORY = "Good"
INTERPRETATIONS = {
    "Poor": "This wine may have noticeable flaws or defects.",
    "Average": "This wine is acceptable but not outstanding.",
    "Good": "This wine should have good to excellent characteristics.",
}

# Weights, per-category base and defaults of the rule score.
RULE_WEIGHTS = {"alcohol": 0.35, "pH": 1.2, "fixed acidity": 0.08, "sulphates": 1.5}
RULE_BASE = {"red": 4.0}
RULE_OTHER_BASE = 4.8
RULE_DEFAULTS = {"alcohol": 10.0, "pH": 3.5, "fixed acidity": 7.0, "sulphates": 0.6}
RULE_DEFAULT_CATEGORY = "red"
RULE_NOISE_DEVIATION = 0.3

# 95 % factor and the half-widths used where no spread exists.
NORMAL_95 = 1.96
UNKNOWN_HALF_WIDTH = 0.5
RULE_HALF_WIDTH = 0.8


def _clamp(col: Column, low: float, high: float) -> Column:
    # greatest/least skip NULLs, so a missing value has to be kept missing explicitly.
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def clamp_round(
    col: Column,
    digits: int = 1,
    limits: tuple[float, float] | None = SCORE_RANGE,
) -> Column:
    """Round half to even at ``digits`` decimals, then clamp (``limits=None``: no clamp)."""
    rounded = round_half_even(col, digits)
    return _clamp(rounded, *limits) if limits else rounded


def quality_category(
    score: Column,
    cuts: Sequence[tuple[float, str]] = CATEGORY_CUTS,
    top: str = TOP_CATEGORY,
) -> Column:
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for upper, label in cuts:
        chain = chain.when(score <= upper, F.lit(label))
    return chain.otherwise(F.lit(top))


def interpretation(category: Column, texts: Mapping[str, str] = INTERPRETATIONS) -> Column:
    chain = None
    for label, text in texts.items():
        chain = (F if chain is None else chain).when(category == label, F.lit(text))
    return chain


def half_width(deviation: Column, factor: float = NORMAL_95) -> Column:
    """Half-width of the 95 % interval; the fixed fallback where the spread is unknown."""
    return F.coalesce(F.lit(factor) * deviation, F.lit(UNKNOWN_HALF_WIDTH))


def interval_bounds(
    score: Column, half: Column, limits: tuple[float, float] = SCORE_RANGE
) -> tuple[Column, Column]:
    known = score.isNotNull() & half.isNotNull()
    low = F.when(known, F.greatest(score - half, F.lit(limits[0])))
    high = F.when(known, F.least(score + half, F.lit(limits[1])))
    return round_half_even(low, 1), round_half_even(high, 1)


def interval_text(score: Column, half: Column) -> Column:
    low, high = interval_bounds(score, half)
    return F.when(low.isNotNull(), F.format_string("%.1f - %.1f", low, high))


def rule_score(
    available: Sequence[str],
    names: Mapping[str, str] | None = None,
    category: str = "wine_type",
    offset: float = 0.0,
    noise_seed: int | None = None,
    noise_key: Sequence[str] = (),
) -> Column:
    """Unclamped rule score.

    A weight's default applies when its *column* is absent; a missing value in a
    present column makes the score missing. ``names`` maps the rule's measurement
    names to the table's. With ``noise_seed`` a normal draw per key is added.
    """
    names = names or {}
    total = F.lit(offset)
    for measure, weight in RULE_WEIGHTS.items():
        column = names.get(measure, measure)
        value = F.col(f"`{column}`") if column in available else F.lit(RULE_DEFAULTS[measure])
        total = total + value * F.lit(weight)
    kind = F.col(f"`{category}`") if category in available else F.lit(RULE_DEFAULT_CATEGORY)
    base = None
    for label, amount in RULE_BASE.items():
        base = (F if base is None else base).when(kind == label, F.lit(amount))
    total = total + base.otherwise(F.lit(RULE_OTHER_BASE))
    if noise_seed is not None:
        key = [F.col(f"`{k}`") for k in (noise_key or available)]
        total = total + hash_normal(key_digest(noise_seed, *key), 0.0, RULE_NOISE_DEVIATION)
    return total
