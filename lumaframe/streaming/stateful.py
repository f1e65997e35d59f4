"""Stateful streams: re-sequencing and the sample clock. Both fail on a violation of order; nothing is dropped as late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.errors import InvalidMetadata
from lumaframe.functions.timebase import ns_to_samples


def resequence(packets: DataFrame) -> DataFrame:
    """packets (container, seq from 0, payload) of a stream -> the same in order, each as soon as all before it are there.

    The state is what waits and the next number. A number that comes twice raises. What still waits when the stream ends
    stays in the state, for its predecessor never came.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, seqs, payloads = state.get if state.exists else (0, [], [])
        waiting = dict(zip(seqs, payloads, strict=True))
        for pdf in batches:
            for seq, payload in zip(pdf["seq"].tolist(), pdf["payload"].tolist(), strict=True):
                if seq < following or seq in waiting:
                    raise ValueError(f"sequence number {seq} of {key[0]} came twice")
                waiting[seq] = payload
        out = []
        while following in waiting:
            out.append((key[0], following, waiting.pop(following)))
            following += 1
        state.update((following, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["container", "seq", "payload"])

    return packets.groupBy("container").applyInPandasWithState(step, "container long, seq long, payload string", "following long, seqs array<long>, payloads array<string>", "append", "NoTimeout")


def resequenced_prefix(packets: DataFrame) -> DataFrame:
    """The batch form: the rows of the gapless prefix from 0 of each container."""
    order = Window.partitionBy("container").orderBy("seq")
    return packets.withColumn("at", F.row_number().over(order) - 1).where("seq = at").drop("at")


def sample_clock(chunks: DataFrame, rate: int, origin_ns: int = 0) -> DataFrame:
    """chunks (stream, chunk_index, ts_ns, n) of a stream -> pts: the first timestamp after the origin in samples, then plus the samples before.

    Chunks come in order of chunk_index, within a trigger in any; a gap, an overlap or a first timestamp before the origin raises.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        following, pts = state.get if state.exists else (None, None)
        out = []
        for c in pd.concat(list(batches)).sort_values("chunk_index").itertuples():
            if following is None:
                ns = c.ts_ns - origin_ns
                if ns < 0:
                    raise InvalidMetadata(f"stream {key[0]} begins before the origin")
                following, pts = c.chunk_index, ns // 1_000_000_000 * rate + (ns % 1_000_000_000 * rate + 500_000_000) // 1_000_000_000
            if c.chunk_index != following:
                raise InvalidMetadata(f"chunk {c.chunk_index} of {key[0]} came instead of {following}")
            out.append((key[0], c.chunk_index, pts))
            following, pts = following + 1, pts + c.n
        if following is not None:
            state.update((following, pts))
        yield pd.DataFrame(out, columns=["stream", "chunk_index", "pts"])

    return chunks.groupBy("stream").applyInPandasWithState(step, "stream long, chunk_index long, pts long", "following long, pts long", "append", "NoTimeout")


def sample_clock_batch(chunks: DataFrame, rate: int, origin_ns: int = 0) -> DataFrame:
    """The batch form: one window in each stream."""
    w = Window.partitionBy("stream").orderBy("chunk_index")
    ahead = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    first = F.first("ts_ns").over(w.rowsBetween(Window.unboundedPreceding, 0)) - origin_ns
    wrong = lambda message: F.raise_error(F.lit(f"invalid_metadata: {message}")).cast("long")
    broken = (F.col("chunk_index") - F.lag("chunk_index").over(w)) != 1
    x = chunks.select("stream", "chunk_index", ahead.alias("ahead"), first.alias("first"), broken.alias("broken"))
    pts = F.when(F.col("first") < 0, wrong("a stream begins before the origin")).when(F.col("broken"), wrong("a gap or an overlap of chunks")).otherwise(ns_to_samples(F.col("first"), rate, nearest=True) + F.col("ahead"))
    return x.select("stream", "chunk_index", pts.alias("pts"))


def still_waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """container, following, waiting of a finished resequence(): where a packet never came, and how many wait for it.

    Reads the state in the query's checkpoint. With no row everything was put out.
    """
    state = spark.read.format("statestore").load(checkpoint)
    value = F.col("value.groupState") if "groupState" in state.schema["value"].dataType.names else F.col("value")
    return state.select(F.col("key.container").alias("container"), value["following"].alias("following"), F.size(value["seqs"]).alias("waiting")).where("waiting > 0")


def progress(query) -> list[dict]:
    """What a query's triggers did: trigger, rows, rows a second, rows of state, ms. Their number is bounded by Spark."""
    return [
        {"trigger": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"], "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"]), "ms": p["durationMs"].get("triggerExecution", 0)}
        for p in query.recentProgress
    ]
