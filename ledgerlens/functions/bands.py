"""Derived columns: hour of day, amount segment, four-hour period, value band.

Each returns a JVM-side CASE expression (first match wins); the numeric
``*_rank`` variants are the sort keys the reports order by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    PERIOD_FOLDED_DAYS,
    PERIOD_LABELS,
    PERIOD_SECONDS,
    SECONDS_PER_DAY,
    SECONDS_PER_HOUR,
    SEGMENT_LABELS,
    SEGMENT_LIMITS,
    SEGMENT_SHORT_LABELS,
    VALUE_BAND_LIMITS,
)


def day_seconds(t: Column) -> Column:
    """Seconds into the day: the second day is folded by one subtraction
    (times from the third day on are not wrapped, as in the source data)."""
    return F.when(t < SECONDS_PER_DAY, t).otherwise(t - SECONDS_PER_DAY)


def hour_of_day(t: Column) -> Column:
    """Whole hours of the folded day offset, as INT.

    ``EXTRACT(HOUR FROM n * INTERVAL '1 second')`` does not wrap at 24 h, so a
    time of 172800 s or more gives 24 and above; integral division keeps that.
    Data of more than two days therefore has as many hours as it spans.
    """
    return F.call_function("div", day_seconds(t), F.lit(SECONDS_PER_HOUR)).cast("int")


def _banded(value: Column, limits, labels) -> Column:
    expr = None
    for limit, label in zip(limits, labels):
        expr = F.when(value <= F.lit(limit), label) if expr is None else expr.when(value <= F.lit(limit), label)
    return expr.otherwise(labels[len(limits)])


def _band_rank(value: Column, limits) -> Column:
    expr = None
    for i, limit in enumerate(limits, start=1):
        expr = F.when(value <= F.lit(limit), i) if expr is None else expr.when(value <= F.lit(limit), i)
    return expr.otherwise(len(limits) + 1)


def amount_segment(amount: Column, short: bool = False) -> Column:
    return _banded(amount, SEGMENT_LIMITS, SEGMENT_SHORT_LABELS if short else SEGMENT_LABELS)


def amount_segment_rank(amount: Column) -> Column:
    return _band_rank(amount, SEGMENT_LIMITS)


def value_band_rank(amount: Column) -> Column:
    return _band_rank(amount, VALUE_BAND_LIMITS)


def time_period_rank(t: Column) -> Column:
    """1..6 for the four-hour blocks of day 1 and day 2 (inclusive ranges);
    anything else (later days, negatives, NULL) falls to the last block."""
    n = len(PERIOD_LABELS)
    expr = None
    for day in range(PERIOD_FOLDED_DAYS):
        for i in range(n):
            lo = day * SECONDS_PER_DAY + i * PERIOD_SECONDS
            hi = lo + PERIOD_SECONDS - 1
            if day == PERIOD_FOLDED_DAYS - 1 and i == n - 1:
                continue  # the last block of the last day is the ELSE branch
            cond = t.between(lo, hi)
            expr = F.when(cond, i + 1) if expr is None else expr.when(cond, i + 1)
    return expr.otherwise(n)


def label_of_rank(rank: Column, labels) -> Column:
    expr = None
    for i, label in enumerate(labels, start=1):
        expr = F.when(rank == i, label) if expr is None else expr.when(rank == i, label)
    return expr
