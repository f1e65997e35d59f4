"""Ratio-corrected demosaicing of strips.

A frame is cut into strips of rows with HALO rows of their neighbours on either side and an even first row, so each strip is a
row of a table and needs no other. Planes are numpy arrays; every step is a whole-array stencil. Other demosaicers are
external libraries and not offered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.pixel import CFA

HALO, BORDER = 12, 9
# The internal scale and the two guards against division by zero.
SCALE, EPS, EPS_SQUARED = 65536.0, 1e-5, 1e-10


def shift(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a[y + dy, x + dx]; past the edge the last value counts (such places are within the border and replaced)."""
    h, w = a.shape
    return a[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]


def high_pass(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    at = lambda k: shift(a, k * dy, k * dx)
    return (at(-3) - at(-1) - at(1) + at(3) - 3 * (at(-2) + at(2)) + 6 * a) ** 2


def rcd(raw: np.ndarray, cfa: str, y0: int = 0, height: int | None = None) -> np.ndarray:
    """3 x h x w of a calibrated mosaic in 0..65535; y0 and height place a strip in its frame."""
    raw = raw.astype(np.float32)
    h, w = raw.shape
    height = h if height is None else height
    if w % 2 or y0 % 2:
        raise ValueError("width and first row must be even")
    y, x = np.mgrid[y0 : y0 + h, 0:w]
    color = np.array(CFA[cfa])[(y & 1) * 2 + (x & 1)]
    v = np.clip(raw / np.float32(SCALE), 0, 1)
    is_green = color == 1

    vertical, horizontal = high_pass(v, 1, 0), high_pass(v, 0, 1)
    vs = np.maximum(shift(vertical, -1, 0) + vertical + shift(vertical, 1, 0), EPS_SQUARED)
    hs = np.maximum(shift(horizontal, 0, -1) + horizontal + shift(horizontal, 0, 1), EPS_SQUARED)
    vh = vs / (vs + hs)
    cross = shift(v, -1, 0) + shift(v, 1, 0) + shift(v, 0, -1) + shift(v, 0, 1)
    corners = shift(v, -1, -1) + shift(v, -1, 1) + shift(v, 1, -1) + shift(v, 1, 1)
    low = v + 0.5 * cross + 0.25 * corners

    def disc(a: np.ndarray, around: np.ndarray) -> np.ndarray:
        return np.where(np.abs(0.5 - a) < np.abs(0.5 - around), around, a)

    vh_around = 0.25 * (shift(vh, -1, -1) + shift(vh, -1, 1) + shift(vh, 1, -1) + shift(vh, 1, 1))
    vh_disc = disc(vh, vh_around)

    def gradient(dy: int, dx: int) -> np.ndarray:
        at = lambda k: shift(v, k * dy, k * dx)
        return EPS + np.abs(at(1) - at(-1)) + np.abs(v - at(2)) + np.abs(at(1) - at(3)) + np.abs(at(2) - at(4))

    north, south, west, east = gradient(-1, 0), gradient(1, 0), gradient(0, -1), gradient(0, 1)

    def by_ratio(dy: int, dx: int) -> np.ndarray:
        return shift(v, dy, dx) * (low + low) / (EPS + low + shift(low, 2 * dy, 2 * dx))

    v_est = (south * by_ratio(-1, 0) + north * by_ratio(1, 0)) / (north + south)
    h_est = (west * by_ratio(0, 1) + east * by_ratio(0, -1)) / (east + west)
    green = np.where(is_green, v, v_est + vh_disc * (h_est - v_est))

    p_high, q_high = high_pass(v, 1, 1), high_pass(v, 1, -1)
    # Diagonal high-pass values exist at odd columns only: a column stands for its pair.
    columns = np.arange(w)
    own, left = 2 * (columns // 2) + 1, np.clip(2 * ((columns - 1) // 2) + 1, 0, w - 1)
    right = np.clip(left + 2, 0, w - 1)
    ps = np.maximum(shift(p_high, -1, 0)[:, left] + p_high[:, own] + shift(p_high, 1, 0)[:, right], EPS_SQUARED)
    qs = np.maximum(shift(q_high, -1, 0)[:, right] + q_high[:, own] + shift(q_high, 1, 0)[:, left], EPS_SQUARED)
    pq = ps / (ps + qs)
    pq_around = 0.25 * (shift(pq, -1, -1) + shift(pq, -1, 1) + shift(pq, 1, -1) + shift(pq, 1, 1))
    pq_disc = disc(pq, pq_around)

    planes = {0: np.where(color == 0, v, 0), 2: np.where(color == 2, v, 0)}
    for own, other in ((0, 2), (2, 0)):  # `own` at the sites of `other`
        c = planes[own]

        def slope(dy: int, dx: int, c: np.ndarray = c) -> np.ndarray:
            return EPS + np.abs(shift(c, dy, dx) - shift(c, -dy, -dx)) + np.abs(shift(c, dy, dx) - shift(c, 3 * dy, 3 * dx)) + np.abs(green - shift(green, 2 * dy, 2 * dx))

        nw, ne, sw, se = slope(-1, -1), slope(-1, 1), slope(1, -1), slope(1, 1)
        apart = lambda dy, dx, c=c: shift(c, dy, dx) - shift(green, dy, dx)
        p_est = (nw * apart(1, 1) + se * apart(-1, -1)) / (nw + se)
        q_est = (ne * apart(1, -1) + sw * apart(-1, 1)) / (ne + sw)
        planes[own] = np.where(color == other, green + p_est + pq_disc * (q_est - p_est), c)
    for own in (0, 2):
        c = planes[own]

        def slope4(dy: int, dx: int, c: np.ndarray = c) -> np.ndarray:
            across = np.abs(shift(c, dy, dx) - shift(c, -dy, -dx))
            return EPS + np.abs(green - shift(green, 2 * dy, 2 * dx)) + across + np.abs(shift(c, dy, dx) - shift(c, 3 * dy, 3 * dx))

        n, s, ww, e = slope4(-1, 0), slope4(1, 0), slope4(0, -1), slope4(0, 1)
        apart = lambda dy, dx, c=c: shift(c, dy, dx) - shift(green, dy, dx)
        v_est = (n * apart(1, 0) + s * apart(-1, 0)) / (n + s)
        h_est = (e * apart(0, -1) + ww * apart(0, 1)) / (e + ww)
        planes[own] = np.where(is_green, green + v_est + vh_disc * (h_est - v_est), c)

    out = np.stack([planes[0], green, planes[2]]) * np.float32(SCALE)
    out = np.maximum(out, 0)
    inside = (y >= BORDER) & (y < height - BORDER) & (x >= BORDER) & (x < w - BORDER)
    for k in range(3):
        same = color == k
        total, count = np.zeros_like(raw), np.zeros_like(raw)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                yy, xx = np.arange(h) + dy, np.arange(w) + dx
                ok = ((yy >= 0) & (yy < h))[:, None] & ((xx >= 0) & (xx < w))[None, :]
                there = shift(same.astype(np.float32), dy, dx) * ok
                total += shift(raw, dy, dx) * there
                count += there
        edge = np.where(same, raw, total / np.maximum(count, 1))
        out[k] = np.where(inside, out[k], edge)
    return out


def strips(frames: DataFrame, rows: int = 64) -> DataFrame:
    """frame, width, height, cfa, mosaic (array, row after row) into strips with y0, take (rows of its own) and skip (halo above)."""
    cut = frames.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(rows))).alias("own0"))
    cut = cut.withColumn("y0", F.greatest(F.col("own0") - HALO, F.lit(0))).withColumn("y1", F.least(F.col("own0") + rows + HALO, F.col("height")))
    return cut.select("frame", "width", "height", "cfa", "own0", "y0", F.least(F.lit(rows), F.col("height") - F.col("own0")).alias("take"), F.slice("mosaic", F.col("y0") * F.col("width") + 1, (F.col("y1") - F.col("y0")) * F.col("width")).alias("mosaic"))


def demosaic(frames: DataFrame, rows: int = 64, method: str = "rcd") -> DataFrame:
    """frame, own0, r, g, b (arrays) of each strip, in the mosaic's scale. Frames under 32 x 32 raise."""
    if method != "rcd":
        raise NotImplementedError(f"{method} is an external library's method")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf.itertuples():
                if s.width < 32 or s.height < 32:
                    raise ValueError("frames must have 32 x 32 values at least")
                whole = rcd(np.asarray(s.mosaic, np.float32).reshape(-1, s.width), s.cfa, s.y0, s.height)
                own = whole[:, s.own0 - s.y0 : s.own0 - s.y0 + s.take]
                out.append((s.frame, s.own0, *(p.ravel() for p in own)))
            yield pd.DataFrame(out, columns=["frame", "own0", "r", "g", "b"])

    return strips(frames, rows).mapInPandas(run, "frame long, own0 int, r array<float>, g array<float>, b array<float>")
