"""Column expressions for sensor and picture arithmetic. All of them stay inside generated code; none shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour codes (0 red, 1 green, 2 blue) by [y & 1][x & 1] of each filter arrangement.
CFA = {"rggb": (0, 1, 1, 2), "bggr": (2, 1, 1, 0), "grbg": (1, 0, 2, 1), "gbrg": (1, 2, 0, 1)}
# The log curve's constants.
LOG_A, LOG_B, LOG_C, LOG_M, LOG_CUT, LOG_CODE_CUT = 0.0075, 7.0, 0.07329248, 10.44426855, 0.00262409, 0.02740668
# Luma weights of the wide-gamut space, non-constant luminance.
KR, KG, KB = 0.2627, 0.6780, 0.0593
# Multipliers of the counter hash (sample, frame, plane) and of its two mixing steps.
HASH_SAMPLE, HASH_FRAME, HASH_PLANE = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
HASH_MIX_1, HASH_MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def site(x: Column, y: Column) -> Column:
    """Position in the 2 x 2 filter cell, row by row."""
    return (y.cast("int").bitwiseAND(1) * 2 + x.cast("int").bitwiseAND(1)).cast("int")


def cfa_color(cfa: Column, x: Column, y: Column) -> Column:
    """Colour code at (x, y); an unknown arrangement raises."""
    at = site(x, y) + 1
    found = F.raise_error(F.concat(F.lit("unknown arrangement "), F.coalesce(cfa, F.lit("null")))).cast("int")
    for name, codes in CFA.items():
        found = F.when(F.lower(cfa) == name, F.element_at(F.array(*map(F.lit, codes)), at)).otherwise(found)
    return found


def shifted_cfa(cfa: Column, x: Column, y: Column) -> Column:
    """Arrangement after a crop at (x, y)."""
    by_codes = {codes: name for name, codes in CFA.items()}
    found = F.lit(None).cast("string")
    for name, c in CFA.items():
        moved = [by_codes[tuple(c[((yy + dy) & 1) * 2 + ((xx + dx) & 1)] for yy in (0, 1) for xx in (0, 1))] for dy in (0, 1) for dx in (0, 1)]
        found = F.when(F.lower(cfa) == name, F.element_at(F.array(*map(F.lit, moved)), site(x, y) + 1)).otherwise(found)
    return found


def calibrate(value: Column, black: Column, white: Column, scale: float = 1.0) -> Column:
    """(value - black) / (white - black) in double, as float, times a float scale; neither end is clamped."""
    return ((value.cast("double") - black) / (white - black)).cast("float") * F.lit(scale).cast("float")


def calibrate_single(value: Column, black: Column, white: Column, scale: float = 1.0) -> Column:
    """calibrate() with every step in single precision."""
    a, b, c = (x.cast("float") for x in (value, black, white))
    return ((a - b) / (c - b)).cast("float") * F.lit(scale).cast("float")


def status(x: Column) -> Column:
    """Bits of what is wrong with a value: 1 if it is negative, 2 if it is not finite. bit_or() puts many together."""
    wild = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(wild, 2).when(x < 0, 1).otherwise(0)


def matrix3(matrix: Sequence[float], rgb: Sequence[Column], stops: float = 0.0, scale: float = 1.0) -> list[Column]:
    """float((M rgb) * 2 ** stops * scale) for each of three rows."""
    if not 0 < scale < float("inf"):
        raise ValueError("the input scale must be finite and positive")
    gain = 2.0**stops * scale
    return [((rgb[0] * matrix[3 * i] + rgb[1] * matrix[3 * i + 1] + rgb[2] * matrix[3 * i + 2]) * gain).cast("float") for i in range(3)]


def finite(x: Column) -> Column:
    """x, or an error if it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(x)


def log_encode(x: Column) -> Column:
    return F.when(x <= LOG_CUT, x * LOG_M).otherwise((F.log2(F.greatest(x, F.lit(LOG_CUT)) + LOG_A) + LOG_B) * LOG_C)


def log_decode(v: Column) -> Column:
    return F.when(v <= LOG_CODE_CUT, v / LOG_M).otherwise(F.pow(F.lit(2.0), v / LOG_C - LOG_B) - LOG_A)


def log_lut(x: Column, entries: int = 65536) -> Column:
    """The curve by linear interpolation between `entries` points on each side of 1, as a table of them gives it.

    Up to the cut it is linear, from 100 on analytic, and NaN for what is not finite. A table's entries are the curve at its
    points, in single precision, so the two around x are computed, not looked up.
    """
    n = entries - 1

    def between(low: float, high: float) -> Column:
        at = (x - low) * (n / (high - low))
        i = F.least(at.cast("long"), F.lit(n - 1).cast("long"))
        point = lambda k: log_encode(F.lit(low) + k / float(n) * (high - low)).cast("float").cast("double")
        return let(F.struct(at.alias("at"), i.alias("i")), lambda p: let(point(p["i"]), lambda base: base + (p["at"] - p["i"]) * (point(p["i"] + 1) - base)))

    inside = F.when(x <= LOG_CUT, x * LOG_M).when(x <= 1, between(LOG_CUT, 1.0)).when(x <= 100, between(1.0, 100.0)).otherwise(log_encode(x))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float("nan"))).otherwise(inside)


def negative_policy(x: Column, policy: str) -> Column:
    """preserve_by_curve, clamp_to_zero or error."""
    if policy == "preserve_by_curve":
        return x
    if policy == "clamp_to_zero":
        return F.greatest(x, F.lit(0.0))
    if policy == "error":
        return F.when(x < 0, F.raise_error(F.lit("negative value before the log curve")).cast("double")).otherwise(x)
    raise ValueError(f"unknown negative policy {policy}")


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * KR + g * KG + b * KB


def blue_difference(y: Column, b: Column) -> Column:
    return (b - y) / (2 * (1 - KB))


def red_difference(y: Column, r: Column) -> Column:
    return (r - y) / (2 * (1 - KR))


def luma_value(y: Column) -> Column:
    return y * 876 + 64


def chroma_value(c: Column) -> Column:
    return c * 896 + 512


def quantize(value: Column, low: int, high: int, noise: Column | None = None) -> Column:
    """Clamped to [low, high], plus noise and a half, truncated."""
    clamped = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return (clamped + (noise if noise is not None else F.lit(0.0)) + 0.5).cast("int")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: a plain expression would repeat it wherever f uses it, and grow with each step."""
    return F.element_at(F.transform(F.array(value), f), 1)


def multiply64(x: Column, factor: int) -> Column:
    """x * factor modulo 2 ** 64 as a bigint's bits. Under ANSI arithmetic a plain product would raise, so it is built from 16-bit limbs."""
    c = [(factor >> 16 * i) & 0xFFFF for i in range(4)]

    def limbs(v: Column) -> Column:
        low, high = v.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(v, 32)
        t1, t3, u1 = low * c[1], low * c[3], high * c[1]
        down = low * c[0] + F.shiftleft(t1.bitwiseAND(0xFFFF), 16)
        up = F.shiftrightunsigned(down, 32) + F.shiftrightunsigned(t1, 16) + (low * c[2]).bitwiseAND(0xFFFFFFFF) + F.shiftleft(t3.bitwiseAND(0xFFFF), 16) + (high * c[0]).bitwiseAND(0xFFFFFFFF) + F.shiftleft(u1.bitwiseAND(0xFFFF), 16)
        return F.shiftleft(up.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(down.bitwiseAND(0xFFFFFFFF))

    return let(x, limbs)


def _fold(h: Column, bits: int, factor: int | None = None) -> Column:
    def step(v: Column) -> Column:
        x = v.bitwiseXOR(F.shiftrightunsigned(v, bits))
        return x if factor is None else multiply64(x, factor)

    return let(h, step)


def counter_hash(frame: Column, plane: Column, sample: Column) -> Column:
    h = multiply64(sample.cast("long"), HASH_SAMPLE).bitwiseXOR(multiply64(frame.cast("long"), HASH_FRAME)).bitwiseXOR(multiply64(plane.cast("long"), HASH_PLANE))
    return _fold(_fold(_fold(h, 30, HASH_MIX_1), 27, HASH_MIX_2), 31)


def dither(frame: Column, plane: Column, sample: Column, bits: int = 53) -> Column:
    """Noise in [-0.5, 0.5) that depends on the place alone; 24 bits give the coarser variant."""
    return F.shiftrightunsigned(counter_hash(frame, plane, sample), 64 - bits).cast("double") / float(2**bits) - 0.5


def half(x: Column) -> Column:
    """x rounded to a half float's 11 significant bits (range 2 ** -14 to 65504), to nearest, ties to even."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs(x), F.lit(2.0**-14)))) - 10)
    return F.when(x == 0, x).otherwise(F.rint(x / power) * power)


def planckian_x(t: Column) -> Column:
    # The cubic approximation of the locus.
    k = F.least(F.greatest(t, F.lit(1667.0)), F.lit(25000.0))
    low = -0.2661239e9 / (k * k * k) - 0.2343580e6 / (k * k) + 0.8776956e3 / k + 0.179910
    high = -3.0258469e9 / (k * k * k) + 2.1070379e6 / (k * k) + 0.2226347e3 / k + 0.240390
    return F.when(k <= 4000, low).otherwise(high)


def planckian_y(t: Column) -> Column:
    k, x = F.least(F.greatest(t, F.lit(1667.0)), F.lit(25000.0)), planckian_x(t)
    first = -1.1063814 * x * x * x - 1.34811020 * x * x + 2.18555832 * x - 0.20219683
    second = -0.9549476 * x * x * x - 1.37418593 * x * x + 2.09137015 * x - 0.16748867
    third = 3.0817580 * x * x * x - 5.87338670 * x * x + 3.75112997 * x - 0.37001483
    return F.when(k <= 2222, first).when(k <= 4000, second).otherwise(third)


def xy_to_uv(x: Column, y: Column) -> tuple[Column, Column]:
    below = -2 * x + 12 * y + 3
    return 4 * x / below, 6 * y / below


def reciprocal_weight(t: Column, t1: Column, t2: Column) -> Column:
    """clamp((1/t - 1/t1) / (1/t2 - 1/t1), 0, 1)."""
    return F.least(F.greatest((1 / t - 1 / t1) / (1 / t2 - 1 / t1), F.lit(0.0)), F.lit(1.0))


def determinant(m: Sequence[Column]) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Sequence[Column]) -> list[Column]:
    """Adjugate over determinant, as nine columns."""
    d = determinant(m)
    minors = ((4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3))
    return [(m[a] * m[b] - m[c] * m[e]) / d for a, b, c, e in minors]


def row_norm(m: Sequence[Column]) -> Column:
    """Largest absolute row sum."""
    return F.greatest(*(F.abs(m[3 * i]) + F.abs(m[3 * i + 1]) + F.abs(m[3 * i + 2]) for i in range(3)))
