"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Only the number of pieces of each length matters to best fit decreasing, and there are at most `capacity` lengths. So the
plan is made once from the length histogram: a segment tree over the remaining capacities finds the tightest open bin for
a length in logarithmic time, and all bins with the same content are moved as one group. The plan is a list of slots: the
pieces of a length whose ranks lie in an interval go to a run of bins at an offset. Its size depends on the capacity, not on
the documents. The rows then find their slot by their rank among the pieces of their length.

Null and empty texts have the end id only. Repeated rows are packed each on its own. An empty table gives an empty result. Texts
of any length are encoded whole. Pieces of one length are interchangeable: their ranks follow a hash of doc_id and piece, so ties
change neither the number of sequences nor how full they are. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.tokens import encoder
from lumaframe.llm.words import texts_of, tidy
from lumaframe.session import ship_code, stage

#: Ranks are counted in so many rows at most (on average) for each length and bucket.
RANK_ROWS = 200_000


class CapacityTree:
    """Which remaining capacities have open bins; tightest(length) is the smallest that holds the length."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def put(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            state = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == state:
                break
            self.open[i] = state

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1 and (i & 1 or not self.open[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, first bin, pieces a bin, offset) in order of length and rank, and the number of bins."""
    tree = CapacityTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}
    slots: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(capacity_left: int, first: int, count: int) -> None:
        if count and capacity_left:
            if not groups.get(capacity_left):
                groups[capacity_left] = []
                tree.put(capacity_left, True)
            groups[capacity_left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, count = bins, -(-left // each)
                bins += count
            else:
                first, count = groups[room].pop()
                if not groups[room]:
                    tree.put(room, False)
                each = room // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                slots.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, count - full)
    return np.array(sorted(slots), np.int64).reshape(-1, 5), bins


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's ids, cut only where they exceed the capacity."""
    ship_code(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            row, out = [], ([], [], [], [], [])
            for i, text in enumerate(texts_of(batch.column(1))):
                ids = np.concatenate([enc.encode(text), end]).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    row.append(i)
                    for column, value in zip(out, (k, a, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None), strict=True):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:4])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(out[4], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        enc.end()

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(cut), f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(cut: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (any table with doc_id, piece and length up to the capacity)."""
    cut = stage(cut, "pieces")
    # At most `capacity` rows come to the driver, however many pieces there are.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    buckets = max(1, -(-sum(histogram.values()) // RANK_ROWS)) * 4
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counted = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ties = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(ties) - 1).join(counted, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")
    shift = 44
    starts = (slots[:, 0] << shift) + slots[:, 1]
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at_length, at_rank))
            slot = slots[np.searchsorted(starts, (length << shift) + rank, "right") - 1] if len(length) else slots[:0]
            nth = rank - slot[:, 1]
            sequence, offset = slot[:, 2] + nth // slot[:, 3], slot[:, 4] + nth % slot[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").select(*cut.columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Tokenize and pack docs (doc_id, text)."""
    return pack(pieces(docs, tokenizer, capacity, end_id, keep_ids), capacity)
