"""Value cleaning and the log-space prediction transforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weekcast.constants import CLIP_HIGH, CLIP_LOW, DIRECTION_BAND


NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_number(value: Column) -> Column:
    """DOUBLE value of a plain decimal number, else NULL; a cast alone would also take ``1d`` or ``7F``."""
    return F.when(F.regexp_like(value.cast("string"), F.lit(NUMBER)), value.try_cast("double"))


def finite(value: Column) -> Column:
    """DOUBLE value, or NULL when it is not a finite number (text that does not parse included)."""
    number = as_number(value)
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def non_negative(value: Column) -> Column:
    number = finite(value)
    return F.when(number >= 0, number)


def positive(value: Column) -> Column:
    number = finite(value)
    return F.when(number > 0, number)


def within_percent(value: Column) -> Column:
    number = finite(value)
    return F.when(number.between(0, 100), number)


def from_log_shift(level: Column, shift: Column) -> Column:
    """``max(0, expm1(clip(log1p(level) + shift)))``; NULL in, NULL out."""
    moved = F.log1p(level) + shift
    clipped = F.least(F.greatest(moved, F.lit(CLIP_LOW)), F.lit(CLIP_HIGH))
    return F.when(moved.isNotNull(), F.greatest(F.lit(0.0), F.expm1(clipped)))


def direction(value: Column, baseline: Column) -> Column:
    """+1 / -1 outside the neutral band around the baseline, else 0."""
    up, down = 1 + DIRECTION_BAND, 1 - DIRECTION_BAND
    return F.when(value > up * baseline, 1).when(value < down * baseline, -1).otherwise(0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is NULL on a zero denominator (ANSI safe)."""
    return F.when(denominator != 0, numerator / denominator)
