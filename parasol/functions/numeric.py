"""Numeric column helpers with explicit null and rounding rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def round_to(c, digits: int = 0) -> Column:
    """Round half up by scaling and flooring, the same IEEE steps on any engine."""
    scale = float(10**digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round_even(c) -> Column:
    """Whole number, half to even (rupee payouts)."""
    return F.bround(as_col(c), 0)


def clip(c, low, high) -> Column:
    """Clamp to [low, high]. least/greatest skip nulls, so null is guarded."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def truthy_or(c, default) -> Column:
    """``c`` unless it is null or zero, else ``default``."""
    return F.coalesce(F.nullif(as_col(c), F.lit(0).cast("double")), F.lit(default))


def ratio(num, den) -> Column:
    """num / den, null on a zero denominator (ANSI mode raises otherwise)."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def percent_of(num, den, digits: int = 1) -> Column:
    return round_to(ratio(num, den) * 100.0, digits)


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def sum_if(cond: Column, value) -> Column:
    return F.sum(F.when(cond, as_col(value)).otherwise(F.lit(0.0)))


def kmh(metres_per_second) -> Column:
    return as_col(metres_per_second) * F.lit(3.6)


def paise(rupees) -> Column:
    """Whole paise, truncated."""
    return (as_col(rupees) * F.lit(100.0)).cast("bigint")
