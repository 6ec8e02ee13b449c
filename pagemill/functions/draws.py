"""Keyed random draws.

A draw is a function of (salt, key) alone, so that it does not depend on
partitioning, retries or the order of rows, unlike ``rand()``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 32


def draw_u32(salt: str, key: Column) -> Column:
    """Uniform BIGINT in [0, 2^32)."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw(salt: str, key: Column) -> Column:
    """Uniform DOUBLE in [0, 1)."""
    return draw_u32(salt, key) / F.lit(float(1 << DRAW_BITS))


def choice(values: Sequence[object], salt: str, key: Column) -> Column:
    """Uniform draw from a short list."""
    position = F.floor(draw(salt, key) * len(values)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), position + 1)


def coin(salt: str, key: Column) -> Column:
    """True with probability one half."""
    return draw(salt, key) > 0.5


def normal(salt: str, key: Column) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    radius = F.sqrt(-2.0 * F.log(1.0 - draw(f"{salt}_radius", key)))
    return radius * F.cos(2.0 * F.pi() * draw(f"{salt}_angle", key))
