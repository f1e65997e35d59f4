"""Checks and cuts of arrays, checked numbers, packed words."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.errors import InvalidArgument


def _or_raise(ok: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def vector3(values: Column) -> Column:
    """Three finite positive values; null stays null, anything else raises."""
    ok = (F.size(values) == 3) & F.forall(values, lambda x: _finite(x) & (x > 0))
    return F.when(values.isNotNull(), _or_raise(ok, values, "invalid_metadata: not three finite positive values", "array<double>"))


def matrix9(values: Column) -> Column:
    """Nine finite values; null stays null, anything else raises."""
    ok = (F.size(values) == 9) & F.forall(values, _finite)
    return F.when(values.isNotNull(), _or_raise(ok, values, "invalid_metadata: not nine finite values", "array<double>"))


def samples_per_channel(size: Column, channels: Column) -> Column:
    """Interleaved samples by channels; an empty or uneven chunk raises."""
    ok = (channels > 0) & (size > 0) & (F.when(channels > 0, size % channels) == 0)
    return _or_raise(ok, (size / F.greatest(channels, F.lit(1))).cast("long"), "invalid_metadata: a chunk must hold whole frames of samples", "long")


def cropped(samples: Column, n: Column) -> Column:
    """The first n samples, or all if there are fewer."""
    return F.slice(samples, F.lit(1), F.least(F.greatest(n, F.lit(0)), F.size(samples)).cast("int"))


def checked_number(text: Column) -> Column:
    """An unsigned number that is the whole text; anything else raises."""
    return _or_raise(text.rlike(r"^[0-9]{1,18}$"), text.try_cast("long"), "invalid_argument: not an unsigned number", "long")


def unpack16(words: Column) -> Column:
    """Two 16-bit values from each 32-bit word, the low half first."""
    return F.flatten(F.transform(words, lambda w: F.array(w.cast("long").bitwiseAND(0xFFFF), F.shiftrightunsigned(w.cast("long"), 16).bitwiseAND(0xFFFF))))


def wrapping_sum(values: Column) -> Column:
    """Sum modulo 2 ** 64, as a decimal."""
    return F.pmod(F.sum(values.cast("decimal(20,0)")), F.lit(Decimal(2**64))).cast("decimal(20,0)")


def whole_number(text: str) -> int:
    """checked_number() of a word on the driver."""
    if not re.fullmatch("[0-9]{1,18}", text):
        raise InvalidArgument(f"not an unsigned number: {text}")
    return int(text)
