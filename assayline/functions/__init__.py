"""Column functions: pure Catalyst expressions without state."""

from assayline.functions.numeric import cut, guarded_ratio, missing_as_null, round_half_even
from assayline.functions.randomness import key_digest, hash_uniform, hash_normal, hash_exponential
from assayline.functions.scores import (
    clamp_round,
    half_width,
    interpretation,
    interval_bounds,
    interval_text,
    quality_category,
    rule_score,
)
from assayline.functions.text import normalise_category, title

__all__ = [
    "clamp_round",
    "cut",
    "guarded_ratio",
    "half_width",
    "hash_exponential",
    "hash_normal",
    "hash_uniform",
    "interpretation",
    "interval_bounds",
    "interval_text",
    "key_digest",
    "missing_as_null",
    "normalise_category",
    "quality_category",
    "round_half_even",
    "rule_score",
    "title",
]
