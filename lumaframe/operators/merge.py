"""Merging ordered streams by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def due_frame(chunks: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """chunks (ts, chunk_index, keys) with due: the frame_index of the stream's first frame in time that is not before the chunk; null after the last.

    One union, one sort inside each stream, one running first value: no range join.
    """
    both = chunks.select(*keys, "ts", "chunk_index", F.lit(None).cast("long").alias("frame_index")).unionByName(frames.select(*keys, "ts", F.lit(None).cast("long").alias("chunk_index"), "frame_index"))
    ahead = Window.partitionBy(*keys).orderBy("ts", F.col("frame_index").isNotNull(), "frame_index").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("due", F.first("frame_index", ignorenulls=True).over(ahead)).where("chunk_index is not null").select(*keys, "ts", "chunk_index", "due")


def interleave(audio: DataFrame, video: DataFrame, keys: list[str]) -> DataFrame:
    """All packets with seq, their place by (ts, audio before video, index)."""
    both = audio.select(*keys, "ts", F.lit(0).alias("kind"), F.col("chunk_index").alias("i")).unionByName(video.select(*keys, "ts", F.lit(1).alias("kind"), F.col("frame_index").alias("i")))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "kind", "i")) - 1)


def claim(packets: DataFrame, waiting: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """packets with what waits under their key (null if nothing does), and what is left waiting because no packet took it."""
    return packets.join(waiting, key, "left"), waiting.join(packets.select(key), key, "left_anti")
