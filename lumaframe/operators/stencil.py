"""Neighbourhood operators on whole planes.

A plane is one array, row after row. Its neighbours are array elements, so no stencil needs a shuffle or a sort: the number of
frames is what grows with the data, and each is read where it lies. A plane is bound once (let) before its elements are read,
for the optimizer may put a plane's own expression into the reading function, where it would be computed for each element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.functions.pixel import let, luma


def _at(plane: Column, x: Column, y: Column, width: int, height: int) -> Column:
    """The value at (x, y), edges repeated."""
    cx, cy = F.least(F.greatest(x, F.lit(0)), F.lit(width - 1)), F.least(F.greatest(y, F.lit(0)), F.lit(height - 1))
    return F.element_at(plane, (cy * width + cx + 1).cast("int"))


def _indices(n: int) -> Column:
    return F.array(*(F.lit(i) for i in range(n))) if n <= 256 else F.sequence(F.lit(0), F.lit(n - 1))


def luma_plane(r: Column, g: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda s: luma(s["r"], s["g"], s["b"]).cast("float").cast("double"))


def sharpen_delta(y: Column, width: int, height: int, amount: float, threshold: float) -> Column:
    """What sharpening adds to each channel: the detail against the four neighbours' mean, less the threshold, times the amount."""

    def whole(p: Column) -> Column:
        def one(i: Column) -> Column:
            cx, cy = i % width, F.floor(i / width).cast("int")
            around = _at(p, cx - 1, cy, width, height) + _at(p, cx + 1, cy, width, height) + _at(p, cx, cy - 1, width, height) + _at(p, cx, cy + 1, width, height)
            return let(F.element_at(p, i + 1) - around * 0.25, lambda d: F.when(F.abs(d) > threshold, (F.signum(d) * (F.abs(d) - threshold) * amount).cast("float").cast("double")).otherwise(F.lit(0.0)))

        return F.transform(_indices(width * height), one)

    return let(y, whole)


def chroma_taps(plane: Column, width: int, height: int, quality: bool) -> Column:
    """Samples at even x, point-sampled or filtered by [-1, 4, 10, 4, -1] / 16."""

    def whole(p: Column) -> Column:
        def one(i: Column) -> Column:
            x, y = i % (width // 2) * 2, F.floor(i / (width // 2)).cast("int")
            if not quality:
                return _at(p, x, y, width, height)
            tap = lambda d: _at(p, x + d, y, width, height)
            return (tap(0) * 10 + (tap(-1) + tap(1)) * 4 - tap(-2) - tap(2)) / 16

        return F.transform(_indices(width // 2 * height), one)

    return let(plane, whole)
