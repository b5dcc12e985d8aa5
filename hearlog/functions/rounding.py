"""Rounded ratios. The marts round half up, the model tables round half to even."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_HOUR = 3_600_000
MS_PER_MINUTE = 60_000


def ratio(part: Column, whole: Column | int) -> Column:
    """Null instead of an error when there is nothing to divide by."""
    return F.try_divide(part, whole if isinstance(whole, Column) else F.lit(whole))


def hours(ms: Column) -> Column:
    return F.round(ratio(ms, MS_PER_HOUR), 2)


def minutes(ms: Column) -> Column:
    return F.round(ratio(ms, MS_PER_MINUTE), 1)


def percent(part: Column, whole: Column) -> Column:
    return F.round(ratio(part, whole) * 100, 2)


def half_even(value: Column, digits: int) -> Column:
    """Binary rounding of the scaled value, as array libraries do it."""
    if digits == 0:
        return F.rint(value)
    return F.rint(value * 10**digits) / 10**digits
