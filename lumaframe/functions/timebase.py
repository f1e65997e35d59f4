"""Exact integer conversions between nanoseconds, samples and presentation units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def _whole(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative bigints."""
    return F.call_function("div", a, b)


def samples_to_ns(samples: Column, rate: int) -> Column:
    """Nearest nanosecond."""
    r = F.lit(rate).cast("long")
    return _whole(samples, r) * NS + _whole(samples % r * NS + rate // 2, r)


def ns_to_samples(ns: Column, rate: int, nearest: bool = False) -> Column:
    """Samples that have ended by ns, or the nearest number."""
    n = F.lit(NS).cast("long")
    return _whole(ns, n) * rate + _whole(ns % n * rate + (NS // 2 if nearest else 0), n)


def ns_to_pts(ns: Column) -> Column:
    """Nearest unit of 1/90000 s from the origin; a time before the origin raises."""
    units = _whole(ns * 9 + 50_000, F.lit(100_000).cast("long"))
    return F.when(ns < 0, F.raise_error(F.lit("a timestamp lies before the origin")).cast("long")).otherwise(units)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
