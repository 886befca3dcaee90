"""Numeric column helpers shared by every summary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums of scores are taken over whole millionths, so they do not depend on the order in which
# partitions arrive and a retried task cannot move a rounded result.
_MICRO = 1_000_000.0


def half_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even (what NumPy does); -0.0 becomes 0.0."""
    factor = float(10**digits)
    return F.rint(value * factor) / factor + F.lit(0.0)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, NULL when ``whole`` is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0


def micro_sum(value: Column) -> Column:
    """Aggregate: order-independent sum of a double, in millionths (a LONG)."""
    return F.sum(F.rint(value * _MICRO).cast("long"))


def from_micro(total: Column) -> Column:
    return total / _MICRO


def exact_mean(value: Column) -> Column:
    """Aggregate: mean over the non-null values, independent of the order of summation."""
    return F.try_divide(from_micro(micro_sum(value)), F.count(value).cast("double"))


def whole_mean(value: Column) -> Column:
    """Aggregate: mean of a whole-number column from its exact sum (no scaling, so no overflow)."""
    return F.try_divide(F.sum(value.cast("long")).cast("double"), F.count(value).cast("double"))


def share_of(condition: Column) -> Column:
    """Aggregate: percentage of all rows (NULL conditions count as false) that satisfy it."""
    return percent(F.count(F.when(condition, 1)), F.count(F.lit(1)))
