"""The picture chain: calibrated values -> exposure and matrix -> sharpening -> log curve -> luma and chroma codes.

Each step is a function from DataFrame to DataFrame over planes (one row a frame), so a plan is their composition and a query
for an earlier stage simply stops there; unused columns are never computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.config import Config
from lumaframe.errors import ProcessingFailed
from lumaframe.functions import pixel as P
from lumaframe.operators.stencil import chroma_taps, luma_plane, sharpen_delta
from lumaframe.session import ship_code

# The matrix of the queries and tests.
MATRIX = (1.1, -0.1, 0.02, -0.03, 1.04, -0.01, 0.01, -0.08, 1.07)
STAGES = ("camera", "linear", "sharpened", "log", "codes")


def linear(planes: DataFrame, config: Config, matrix=MATRIX) -> DataFrame:
    """r, g, b -> the target space, exposed."""
    x = planes.withColumn("_rgb", F.arrays_zip("r", "g", "b"))
    out = {c: F.transform("_rgb", _matrix_row(matrix, k, config.exposure_offset_stops)) for k, c in enumerate("rgb")}
    return x.withColumns(out).drop("_rgb")


def _matrix_row(matrix, k: int, stops: float):
    def row(s: Column) -> Column:
        return P.matrix3(matrix, (s["r"], s["g"], s["b"]), stops)[k].cast("double")

    return row


def sharpened(planes: DataFrame, config: Config, width: int, height: int) -> DataFrame:
    if config.capture_sharpening <= 0:
        return planes
    x = planes.withColumn("_y", luma_plane(F.col("r"), F.col("g"), F.col("b")))
    x = x.withColumn("_d", sharpen_delta(F.col("_y"), width, height, config.capture_sharpening, config.capture_sharpening_threshold))
    return x.withColumns({c: F.zip_with(c, "_d", lambda a, d: (a + d).cast("float").cast("double")) for c in "rgb"}).drop("_y", "_d")


def logged(planes: DataFrame, config: Config) -> DataFrame:
    """Rounded to nine digits, so that a code doesn't hang on the last bit of a logarithm."""
    return planes.withColumns({c: F.transform(c, lambda v: F.round(P.log_encode(P.negative_policy(P.finite(v), config.negative_policy)), 9)) for c in "rgb"})


def coded(planes: DataFrame, config: Config, width: int, height: int) -> DataFrame:
    """frame, y, cb, cr codes and the numbers of clipped values."""
    x = planes.withColumn("_y", luma_plane_exact(F.col("r"), F.col("g"), F.col("b")))
    x = x.withColumns({"_cb": F.zip_with("_y", "b", P.blue_difference), "_cr": F.zip_with("_y", "r", P.red_difference)})
    good = config.chroma_filter == "quality"
    x = x.withColumns({"_cb": chroma_taps(F.col("_cb"), width, height, good), "_cr": chroma_taps(F.col("_cr"), width, height, good)})
    values = {"y": ("_y", P.luma_value, 940, 0), "cb": ("_cb", P.chroma_value, 960, 1), "cr": ("_cr", P.chroma_value, 960, 2)}
    low, high, out = F.lit(0), F.lit(0), {}
    for name, (source, to_value, top, plane) in values.items():
        exact = F.transform(source, _rounded(to_value))
        low = low + F.size(F.filter(exact, lambda v: v < 64))
        high = high + F.size(F.filter(exact, _over(top)))
        out[name] = F.transform(exact, _code(top, plane, config.deterministic_dither))
    return x.withColumns(out | {"clipped_low": low, "clipped_high": high}).select("frame", "y", "cb", "cr", "clipped_low", "clipped_high")


def luma_plane_exact(r: Column, g: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda s: P.luma(s["r"], s["g"], s["b"]))


def _rounded(to_value):
    return lambda v: F.round(to_value(v), 6)


def _over(top: int):
    return lambda v: v > top


def _code(top: int, plane: int, dithered: bool):
    def code(v: Column, i: Column) -> Column:
        return P.quantize(v, 64, top, P.dither(F.col("frame"), F.lit(plane), i) if dithered else None)

    return code


def pack(planes: DataFrame, config: Config, width: int, height: int, until: str = "codes", matrix=MATRIX) -> DataFrame:
    """The chain up to a stage."""
    steps = (lambda d: d, lambda d: linear(d, config, matrix), lambda d: sharpened(d, config, width, height), lambda d: logged(d, config), lambda d: coded(d, config, width, height))
    for step in steps[: STAGES.index(until) + 1]:
        planes = step(planes)
    return planes


def samples(codes: DataFrame) -> DataFrame:
    """frame, plane, i, code of the planes of packed frames."""
    kinds = [codes.select("frame", F.lit(k).alias("plane"), F.posexplode(c).alias("i", "code")) for k, c in enumerate(("y", "cb", "cr"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def _noise(frame: int, plane: int, n: int) -> np.ndarray:
    """P.dither of samples 0 to n - 1."""
    h = np.arange(n, dtype=np.uint64) * np.uint64(P.HASH_SAMPLE) ^ np.uint64((frame * P.HASH_FRAME ^ plane * P.HASH_PLANE) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(P.HASH_MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(P.HASH_MIX_2)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(2**24) - np.float32(0.5)


def fused_codes(rgb: np.ndarray, frame: int, config: Config, matrix=MATRIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """y, cb, cr codes and clipped values of one frame (3 x h x w), all steps in single precision, by whole planes."""
    f32 = np.float32
    x = np.tensordot(np.array(matrix, f32).reshape(3, 3) * f32(2.0**config.exposure_offset_stops), rgb.astype(f32), 1)
    if config.capture_sharpening > 0:
        weights = np.array((P.KR, P.KG, P.KB), f32)[:, None, None]
        y = (x * weights).sum(axis=0)
        e = np.pad(y, 1, "edge")
        d = y - (e[1:-1, :-2] + e[1:-1, 2:] + e[:-2, 1:-1] + e[2:, 1:-1]) * f32(0.25)
        x = x + np.where(np.abs(d) > f32(config.capture_sharpening_threshold), np.copysign((np.abs(d) - f32(config.capture_sharpening_threshold)) * f32(config.capture_sharpening), d), f32(0))
    if not np.isfinite(x).all():
        raise ProcessingFailed("a value is not finite")
    if config.negative_policy == "error" and (x < 0).any():
        raise ProcessingFailed("negative value before the log curve")
    if config.negative_policy == "clamp_to_zero":
        x = np.maximum(x, f32(0))
    x = np.where(x <= f32(P.LOG_CUT), x * f32(P.LOG_M), (np.log2(np.maximum(x, f32(P.LOG_CUT)) + f32(P.LOG_A)) + f32(P.LOG_B)) * f32(P.LOG_C))
    y = x[0] * f32(P.KR) + x[1] * f32(P.KG) + x[2] * f32(P.KB)

    def chroma(c: np.ndarray) -> np.ndarray:
        if config.chroma_filter != "quality":
            return c[:, : c.shape[1] // 2 * 2 : 2]
        e = np.pad(c, ((0, 0), (2, 2)), "edge")
        w = c.shape[1]
        taps = (e[:, 2 : 2 + w] * f32(10) + (e[:, 1 : 1 + w] + e[:, 3 : 3 + w]) * f32(4) - e[:, :w] - e[:, 4 : 4 + w]) / f32(16)
        return taps[:, : w // 2 * 2 : 2]

    cb, cr = chroma((x[2] - y) / f32(2 * (1 - P.KB))), chroma((x[0] - y) / f32(2 * (1 - P.KR)))
    out, low, high = [], 0, 0
    for plane, (value, top) in enumerate(((y * f32(876) + f32(64), 940), (cb * f32(896) + f32(512), 960), (cr * f32(896) + f32(512), 960))):
        value = value.ravel()
        low, high = low + int((value < 64).sum()), high + int((value > top).sum())
        noise = _noise(frame, plane, len(value)) if config.deterministic_dither else f32(0)
        out.append((np.clip(value, f32(64), f32(top)) + noise + f32(0.5)).astype(np.int32))
    return *out, low, high


def pack_fused(planes: DataFrame, config: Config, width: int, height: int, matrix=MATRIX) -> DataFrame:
    """The whole chain in one pass over each frame, in single precision: within one code of pack()."""
    ship_code(planes.sparkSession)
    frame = planes.schema["frame"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rgb = np.stack([batch.column(k)[i].values.to_numpy(zero_copy_only=False).reshape(height, width) for k in (1, 2, 3)])
                y, cb, cr, low, high = fused_codes(rgb, batch.column(0)[i].as_py(), config, matrix)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], pa.list_(pa.int32())) for x in (y, cb, cr)), pa.array([low], pa.int32()), pa.array([high], pa.int32())], names=["frame", "y", "cb", "cr", "clipped_low", "clipped_high"])

    return planes.select("frame", "r", "g", "b").mapInArrow(run, f"frame {frame}, y array<int>, cb array<int>, cr array<int>, clipped_low int, clipped_high int")


def to_pixels(planes: DataFrame, names: list[str], width: int) -> DataFrame:
    """frame, y, x and one column a plane."""
    rows = planes.select("frame", F.posexplode(F.arrays_zip(*names)).alias("i", "s"))
    return rows.select("frame", F.floor(F.col("i") / width).cast("int").alias("py"), (F.col("i") % width).alias("px"), *(F.col(f"s.{n}").alias(n) for n in names))
