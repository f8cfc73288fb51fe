"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _halves(x):
    """Split a double into two 26-bit halves whose sum is exactly ``x``."""
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    return high, x - high


def round_half_even(x: Column, digits: int) -> Column:
    """Round the *binary* value half to even, as Python's ``round`` does.

    ``F.round`` and ``F.bround`` decide ties on the shortest decimal text of the double, so
    they differ on values such as 0.12345 that are not exactly representable.  Here the scaled
    product is followed by its exact rounding error, which settles every tie.
    """
    scale = float(10 ** digits)
    s_high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    s_low = scale - s_high
    x = x.cast("double")
    product = x * F.lit(scale)
    high, low = _halves(x)
    error = ((high * s_high - product) + high * s_low + low * s_high) + low * s_low
    floor = F.floor(product).cast("double")
    rest = product - floor
    up = (
        F.when(rest > 0.5, True)
        .when(rest < 0.5, False)
        .when(error > 0, True)
        .when(error < 0, False)
        .otherwise(F.pmod(floor, F.lit(2.0)) == 1.0)
    )
    rounded = (floor + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    # beyond 2^52 there is nothing to round; NaN and infinity stay what they are
    return F.when(x.isNull() | (F.abs(product) < 4503599627370496.0), rounded).otherwise(x)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score_bucket(score: Column, buckets: int = 5) -> Column:
    """Equal-width bucket of a score in [0, 1]; the upper edge falls in the last one."""
    return F.least((score * F.lit(float(buckets))).cast("int"), F.lit(buckets - 1))


def minmax(x: Column, low: Column, high: Column, digits: int | None = 6) -> Column:
    """Position of ``x`` in [low, high]; a constant range gives 0.5."""
    scaled = (x - low) / F.nullif(high - low, F.lit(0.0))
    if digits is not None:
        scaled = round_half_even(scaled, digits)
    return F.when(high == low, F.lit(0.5)).otherwise(scaled)
