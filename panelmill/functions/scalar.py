"""Numeric and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sign of each directional word.
DIRECTION_SIGN = {"bullish": 1.0, "neutral": 0.0, "bearish": -1.0}


def fixed(value: Column, digits: int) -> Column:
    """Text with *digits* decimals and no grouping, half-even on the exact binary value."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def round_exact(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even; built-in round works on the decimal text."""
    return fixed(value, digits).cast("double")


def safe_float(value: Column, default: float = 0.0) -> Column:
    """Parsed double, or the default for null, unparsable, NaN and infinite input."""
    number = F.trim(value.cast("string")).try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(usable, number).otherwise(F.lit(default))


def clamp(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def squash(value: Column, scale: float = 5.0) -> Column:
    """Unbounded value into (-1, 1)."""
    return F.tanh(value * scale)


def fold_conviction(word: Column, confidence: Column) -> Column:
    """Signed conviction from a direction word and a 0..100 confidence."""
    sign = F.lit(None).cast("double")
    for name, s in DIRECTION_SIGN.items():
        sign = F.when(word == name, s).otherwise(sign)
    return sign * confidence / 100


def verdict_label(value: Column, stored: Column, abstained: Column) -> Column:
    """Abstention first, then a stored word, then the sign of the value."""
    word = (
        F.when(F.coalesce(abstained, F.lit(False)), "abstain")
        .when(stored.isin(*DIRECTION_SIGN), stored)
        .when(value > 0, "bullish")
        .when(value < 0, "bearish")
        .otherwise("neutral")
    )
    return F.upper(word)


def day_of(stamp: Column) -> Column:
    """Date of an ISO text timestamp."""
    return F.to_date(F.substring(stamp, 1, 10))


def previous_day(day: Column) -> Column:
    return F.date_sub(day, 1)
