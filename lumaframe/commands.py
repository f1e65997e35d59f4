"""What a user calls: inspect, convert, extract, validate, benchmark, configuration and capabilities, as DataFrames."""

from __future__ import annotations

import dataclasses
import json
import time

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lumaframe.config import PROFILES, Config
from lumaframe.errors import InvalidArgument, ProcessingFailed
from lumaframe.operators import timing
from lumaframe.plans import picture
from lumaframe.session import ship_code
from lumaframe.sources import files
from lumaframe.sources.files import publish


def inspect(frames: DataFrame) -> DataFrame:
    """frames, first_ns, last_ns, min and max step of frames (timestamp_ns) of one source, keys by path if there is one."""
    keys = ["path"] if "path" in frames.columns else []
    step = F.col("timestamp_ns") - F.lag("timestamp_ns").over(Window.partitionBy(*keys).orderBy("timestamp_ns"))
    found = frames.select(*keys, "timestamp_ns", step.alias("step"))
    return found.groupBy(*keys).agg(F.count("*").alias("frames"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.min("step").alias("min_step_ns"), F.max("step").alias("max_step_ns"))


def frame(frames: DataFrame, index: int) -> DataFrame:
    """The frame of an index; one that isn't there raises."""
    found = frames.where(F.col("frame_index") == index)
    if found.isEmpty():
        raise InvalidArgument(f"there is no frame {index}")
    return found


def extract(planes: DataFrame, config: Config, width: int, height: int, stage: str) -> DataFrame:
    """The planes at a stage of the picture chain."""
    if stage not in picture.STAGES:
        raise InvalidArgument(f"no stage {stage}; there are {', '.join(picture.STAGES)}")
    return picture.pack(planes, config, width, height, stage)


def convert(planes: DataFrame, config: Config, width: int, height: int, path: str, overwrite: bool = False) -> int:
    """Codes of all frames (of the first max_frames, if that is set), published at a path; the number of frames."""
    chosen = planes.orderBy("frame").limit(config.max_frames) if config.max_frames else planes
    return publish(picture.pack(chosen, config, width, height), path, overwrite, ["frame"])


def validate(planes: DataFrame, config: Config, width: int, height: int) -> DataFrame:
    """compared, missing, differing, max_abs_diff, differing_fraction between the chain and the single-precision pass."""
    a = picture.samples(picture.pack(planes, config, width, height))
    b = picture.samples(picture.pack_fused(planes, config, width, height))
    return timing.difference(a, b, ["frame", "plane", "i"], "code")


def packet_faults(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, packets, faults: packets (pts, duration) without a time, out of order or without a duration, by stream in the order written (seq)."""
    order = Window.partitionBy(*keys).orderBy("seq")
    bad = F.col("pts").isNull() | F.coalesce(F.col("pts") <= F.lag("pts").over(order), F.lit(False)) | ~F.coalesce(F.col("duration") > 0, F.lit(False))
    return packets.withColumn("bad", bad).groupBy(*keys).agg(F.count("*").alias("packets"), F.count_if("bad").alias("faults"))


def benchmark(run, repeats: int = 3) -> dict[str, float]:
    """Seconds of a callable that returns a DataFrame, each time computed whole: least, median, most."""
    took = []
    for _ in range(repeats):
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    took.sort()
    return {"least": took[0], "median": took[len(took) // 2], "most": took[-1]}


def dump(frames: DataFrame, width: int, height: int, folder: str) -> DataFrame:
    """A file for each frame in a shared folder; returns name, size. Planes r, g, b become PFM, codes y, cb, cr planar 16-bit numbers."""
    ship_code(frames.sparkSession)
    floats = {"r", "g", "b"} <= set(frames.columns)
    names = ("r", "g", "b") if floats else ("y", "cb", "cr")

    @F.pandas_udf(BinaryType())
    def content(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        if floats:
            return pd.Series([files.pfm_bytes(np.stack([np.asarray(p, np.float32).reshape(height, width) for p in planes], axis=2)) for planes in zip(a, b, c, strict=True)])
        return pd.Series([files.planar_bytes(*map(np.asarray, planes)) for planes in zip(a, b, c, strict=True)])

    name = F.concat(F.lit("frame-"), F.lpad(F.col("frame").cast("string"), 8, "0"), F.lit(".pfm" if floats else ".yuv"))
    return files.write_files(frames.select(name.alias("name"), content(*names).alias("content")), folder)


def sidecar(frames: DataFrame, config: Config, diagnostics: DataFrame | None = None, transfers: dict[str, int] | None = None) -> DataFrame:
    """One row with a JSON report: configuration, summary of frames (timestamp_ns), sound diagnostics, transfers to and from a device.

    Frames that stay on a device (resident: 1) can't have uploads or readbacks: that raises.
    """
    moved = transfers or {}
    if moved.get("resident") and (moved.get("uploads") or moved.get("readbacks")):
        raise ProcessingFailed("resident frames with uploads or readbacks")
    video = inspect(frames.select("timestamp_ns"))
    parts = {"configuration": F.parse_json(F.lit(json.dumps(dataclasses.asdict(config)))), "video": F.struct(*video.columns), "transfers": F.parse_json(F.lit(json.dumps(moved)))}
    x = video
    if diagnostics is not None:
        streams = diagnostics.agg(F.sort_array(F.collect_list(F.struct(*diagnostics.columns))).alias("_audio"))  # one row a stream of one file
        x = x.join(F.broadcast(streams))
        parts["audio"] = F.col("_audio")
    return x.select(files.report(**parts).alias("report"))


def benchmark_rows(spark: SparkSession, name: str, runs: dict[str, float], frames: int, pixels: int) -> DataFrame:
    """name, run, seconds, frames_per_second, mpixels_per_second, to be written as CSV."""
    rows = [(name, run, s, frames / s if s > 0 else 0.0, frames * pixels / s / 1e6 if s > 0 else 0.0) for run, s in runs.items()]
    return spark.createDataFrame(rows, "name string, run string, seconds double, frames_per_second double, mpixels_per_second double")


def config_df(spark: SparkSession, config: Config) -> DataFrame:
    """key, value (JSON) of the effective configuration."""
    rows = [(k, json.dumps(v)) for k, v in dataclasses.asdict(config).items()]
    return spark.createDataFrame(rows, "key string, value string")


def capabilities(spark: SparkSession) -> DataFrame:
    """kind, name, available: what this package has itself and what it leaves to external programs."""
    own = [("demosaic", "rcd"), *(("stage", s) for s in picture.STAGES), ("chroma_filter", "fast"), ("chroma_filter", "quality"), ("backend", "cpu")]
    outside = [*(("demosaic", x) for x in ("amaze", "igv", "dcb", "lmmse")), ("backend", "vulkan"), *(("encoder_profile", p) for p in PROFILES)]
    return spark.createDataFrame([(*x, True) for x in own] + [(*x, False) for x in outside], "kind string, name string, available boolean")
