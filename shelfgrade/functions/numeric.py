"""Tolerant parsing and small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def number(c, is_text: bool = True) -> Column:
    """Parse to double; whatever is no number, NaN included, becomes null."""
    text = col(c)
    value = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    if not is_text:
        return value
    # The JVM parser also takes Java's type suffixes ("1d", "2.5f"), which are no numbers here.
    # The last character is looked at first, so that the pattern is rarely tried.
    last = F.right(F.rtrim(text), F.lit(1))
    suffixed = F.contains(F.lit("dDfF"), last) & text.rlike(r"[0-9.][dDfF]\s*$")
    return F.when(~suffixed, value)


def count_or_zero(c, is_text: bool = True) -> Column:
    """Parse to an integer count, dropping decimals; missing counts as zero."""
    return F.coalesce(number(c, is_text).try_cast("int"), F.lit(0))


def zero_if_missing(c) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def clip(c, low, high) -> Column:
    """Limit to [low, high], the lower limit last; nulls stay null and an absent limit does nothing."""
    value = col(c)
    if high is None and low is None:
        return value
    # The lower limit is tested on the original value too, so that each value is read once.
    limited = F.when(value < low, F.lit(low).cast("double")) if low is not None else F
    if high is not None:
        top = max(high, low) if low is not None else high
        limited = limited.when(value > high, F.lit(top).cast("double"))
    return limited.otherwise(value)


def relative_change(original, new, least_percent: float = 2.0) -> Column:
    """Absolute change in percent; null when the original is 0 or the change is too small."""
    original, new = col(original), col(new)
    percent = F.abs((new - original) / F.nullif(original, F.lit(0.0)) * 100)
    return F.when(percent >= least_percent, percent)
