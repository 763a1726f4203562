"""Rounding and rendering that give the same digits on every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(x: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def stored_mean(x: Column, digits: int) -> Column:
    """Mean of values kept with ``digits`` decimals, summed as integers: the same whatever the order of rows."""
    scale = float(10**digits)
    return F.try_divide(F.sum(F.floor(x * F.lit(scale) + F.lit(0.5))), F.count(x)) / F.lit(scale)


def fixed(x: Column, digits: int) -> Column:
    """Number as text with ``digits`` decimals, half up."""
    if digits == 0:
        return F.floor(x + F.lit(0.5)).cast("string")
    return half_up(x, digits).cast(f"decimal(18,{digits})").cast("string")


def number_or_null(x: Column) -> Column:
    """Text to double; anything unreadable becomes null."""
    return F.trim(x).try_cast("double")


def day_first_date(x: Column) -> Column:
    """Date text with the day first, or ISO order; anything unreadable becomes null."""
    text = F.trim(x)
    forms = ("d/M/yyyy", "d-M-yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d", "yyyy/M/d")
    parsed = [F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in forms]
    return F.coalesce(*parsed, text.try_cast("date"))
