"""Reproducible draws that depend only on a row's key and a seed.

``rand``/``randn`` depend on partitioning and change when a lost task is rerun on
differently arranged input. A digest of the key does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # 52 bits, exact in a double
_SPAN = float(16**_DIGITS)


def key_digest(seed: int | str, *key: Column) -> Column:
    """md5 of ``seed:part|part|...`` as 32 hexadecimal digits.

    A part is its length, a colon and its text, or ``N`` for NULL, so different keys never
    have the same text.
    """
    parts = []
    for k in key:
        value = k.cast("string")
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("N")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *parts)))


def hash_number(digest: Column, first: int = 1, digits: int = _DIGITS) -> Column:
    """Whole number made of ``digits`` hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")


def hash_uniform(digest: Column, first: int = 1) -> Column:
    """Uniform draw strictly between 0 and 1."""
    return (hash_number(digest, first).cast("double") + 0.5) / _SPAN


def hash_normal(digest: Column, mean: float, deviation: float) -> Column:
    """Normal draw (Box-Muller on the two halves of the digest)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(hash_uniform(digest, 1)))
    angle = F.lit(2.0 * math.pi) * hash_uniform(digest, 1 + _DIGITS)
    return F.lit(mean) + F.lit(deviation) * radius * F.cos(angle)


def hash_exponential(digest: Column, scale: float) -> Column:
    """Exponential draw by inversion."""
    return F.lit(-scale) * F.ln(hash_uniform(digest, 1))
