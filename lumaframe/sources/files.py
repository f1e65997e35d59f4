"""Binary picture and container files as tables, and back."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumaframe.errors import InvalidArgument, InvalidContainer, InvalidMetadata, IoFailed
from lumaframe.session import ship_code

# This package's own open container, a stand-in for camera containers whose layout is an external library's.
MAGIC, VERSION = b"LFC1", 1
_FOOTER, _RECORD, _ITEM = struct.Struct("<qq"), struct.Struct("<qqi"), struct.Struct("<BI")
AUDIO_FORMAT, AUDIO_DATA, AUDIO_TIME = 1, 2, 3
_SOUND = struct.Struct("<ii")


def write_container(path: str, frames: list[tuple[int, bytes]], sound: tuple[int, int, list[tuple[int, np.ndarray]]] | None = None) -> None:
    """Payloads; items (tag, size, content) of the sound (rate, channels, chunks of a time and interleaved samples); then
    (timestamp, offset, size) of each payload; then count and index offset."""
    with open(path, "wb") as out:
        out.write(MAGIC + bytes([VERSION]))
        index = []
        for ts, payload in frames:
            index.append((ts, out.tell(), len(payload)))
            out.write(payload)
        if sound:
            rate, channels, chunks = sound
            items = [(AUDIO_FORMAT, _SOUND.pack(rate, channels))]
            for ts, samples in chunks:
                items += [(AUDIO_DATA, samples.astype("<i2").tobytes()), (AUDIO_TIME, struct.pack("<q", ts))]
            out.write(b"".join(_ITEM.pack(tag, len(content)) + content for tag, content in items))
        at = out.tell()
        out.write(b"".join(_RECORD.pack(*x) for x in index) + _FOOTER.pack(len(index), at))


def read_index(f: BinaryIO, length: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(frame_index, timestamp_ns, file_offset, size) in order of time, and where the index is. Only head and index are read.

    A damaged file or a time that doesn't grow raises.
    """
    if length < 5 + _FOOTER.size or f.read(5) != MAGIC + bytes([VERSION]):
        raise InvalidContainer("not a container of this version")
    f.seek(length - _FOOTER.size)
    count, at = _FOOTER.unpack(f.read(_FOOTER.size))
    if count < 0 or at < 5 or at + count * _RECORD.size + _FOOTER.size != length:
        raise InvalidContainer("the index lies outside the file")
    f.seek(at)
    found = sorted(_RECORD.iter_unpack(f.read(count * _RECORD.size)))
    if any(a[0] >= b[0] for a, b in zip(found, found[1:], strict=False)):
        raise InvalidContainer("timestamps don't increase strictly")
    for _, offset, size in found:
        if not (0 < size and 5 <= offset and offset + size <= at):
            raise InvalidContainer("a payload lies outside the file")
    return [(i, *x) for i, x in enumerate(found)], at


def parse_index(raw: bytes) -> list[tuple[int, int, int, int]]:
    """read_index() of a container's bytes."""
    return read_index(io.BytesIO(raw), len(raw))[0]


def read_sound(f: BinaryIO, length: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(chunk_index, ts_ns, rate, channels, samples) of the items between the last payload and the index, in the order written.

    Times are signed and stay as they are. A file without a sound format has none; a chunk without a time, of no or uneven samples,
    or an unknown item raises.
    """
    found, end = read_index(f, length)
    at = max((offset + size for _, _, offset, size in found), default=5)
    sound = samples = None
    chunk = 0
    while at < end:
        f.seek(at)
        head = f.read(_ITEM.size) if at + _ITEM.size <= end else b""
        tag, size = _ITEM.unpack(head) if head else (0, 0)
        at += _ITEM.size + size
        if not head or at > end:
            raise InvalidContainer("an item lies outside the file")
        content = f.read(size)
        if tag == AUDIO_FORMAT and sound is None and size == _SOUND.size:
            sound = _SOUND.unpack(content)
            if min(sound) <= 0:
                raise InvalidMetadata("sound needs a rate and channels")
        elif tag == AUDIO_DATA and sound and samples is None and size and size % (2 * sound[1]) == 0:
            samples = np.frombuffer(content, "<i2")
        elif tag == AUDIO_TIME and samples is not None and size == 8:
            yield chunk, struct.unpack("<q", content)[0], *sound, samples
            chunk, samples = chunk + 1, None
        else:
            raise InvalidContainer(f"item {tag} of {size} bytes can't stand there")
    if samples is not None:
        raise InvalidContainer("a chunk has no time")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, any that Spark and Arrow both know, and the place in it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def _opened(path: str) -> BinaryIO:
    """A file for reading anywhere in it."""
    system, inside = _located(path)
    return system.open_input_file(inside)


def index(spark: SparkSession, path: str) -> DataFrame:
    """path, frame_index, timestamp_ns, file_offset, size of the frames of all containers under path. No payload is read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length in zip(pdf["path"], pdf["length"], strict=True):
                with _opened(name) as f:
                    rows = [(name, *x) for x in read_index(f, length)[0]]
                yield pd.DataFrame(rows, columns=["path", "frame_index", "timestamp_ns", "file_offset", "size"])

    return _files(spark, path).mapInPandas(read, "path string, frame_index long, timestamp_ns long, file_offset long, size int")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files under path; their content isn't read."""
    ship_code(spark)
    return spark.read.format("binaryFile").load(path).select("path", "length")


def fetch(chosen: DataFrame) -> DataFrame:
    """The rows of index() with payload. Filter them first: what isn't chosen isn't read. Files may be of any size, a frame is held alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, rows in pdf.groupby("path", sort=False):
                with _opened(name) as f:
                    for i in range(len(rows)):
                        row = rows.iloc[i : i + 1]
                        f.seek(int(row["file_offset"].iloc[0]))
                        payload = f.read(int(row["size"].iloc[0]))
                        if len(payload) != row["size"].iloc[0]:
                            raise IoFailed(f"{name} ends within a frame")
                        yield row[["path", "frame_index", "timestamp_ns", "file_offset"]].assign(payload=[payload])

    spread = chosen.select("path", "frame_index", "timestamp_ns", "file_offset", "size").repartition("path", F.floor(F.col("frame_index") / 16))
    return spread.mapInPandas(read, "path string, frame_index long, timestamp_ns long, file_offset long, payload binary")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """path, frame_index, timestamp_ns, file_offset, payload of all containers under path, 16 frames of a file at a time."""
    return fetch(index(spark, path))


def frame_at(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The frame of an index in each container; a container without it raises."""
    known = index(spark, path)
    short = known.groupBy("path").agg(F.max("frame_index").alias("last")).where((F.col("last") < number) | F.lit(number < 0)).select("path").head()
    if short is not None:
        raise InvalidArgument(f"{short['path']} has no frame {number}")
    return fetch(known.where(F.col("frame_index") == number))


def sound(spark: SparkSession, path: str) -> DataFrame:
    """path, chunk_index, ts_ns, rate, channels, n (samples of a channel), samples (interleaved) of all containers under path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, length in zip(pdf["path"], pdf["length"], strict=True):
                with _opened(name) as f:
                    for chunk, ts, rate, channels, samples in read_sound(f, length):
                        yield pd.DataFrame({"path": [name], "chunk_index": [chunk], "ts_ns": [ts], "rate": [rate], "channels": [channels], "n": [len(samples) // channels], "samples": [samples]})

    return _files(spark, path).mapInPandas(read, "path string, chunk_index long, ts_ns long, rate int, channels int, n long, samples array<short>")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256, frames of each file in a corpus manifest (JSON with a list `files`); a row without them raises."""
    entry = "name string, bytes long, sha256 string, frames long"
    x = spark.read.json(path, schema=f"files array<struct<{entry}>>", multiLine=True, mode="FAILFAST").select(F.inline("files"))
    ok = F.col("name").isNotNull() & (F.col("bytes") >= 0) & F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.col("frames") >= 0)
    return x.withColumn("name", F.when(F.coalesce(ok, F.lit(False)), F.col("name")).otherwise(F.raise_error(F.lit("invalid_metadata: a file of the manifest lacks name, bytes, sha256 or frames"))))


def differing_files(spark: SparkSession, listed: DataFrame, folder: str) -> DataFrame:
    """name, fault (missing, size, sha256) of the files of a manifest that aren't in a folder as listed; content is hashed in blocks."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for name in pdf["path"]:
                total = hashlib.sha256()
                with _opened(name) as f:
                    while block := f.read(1 << 22):
                        total.update(block)
                sums.append(total.hexdigest())
            yield pdf.assign(found=sums)

    files = _files(spark, folder).mapInPandas(check, "path string, length long, found string").withColumn("name", F.substring_index("path", "/", -1))
    fault = F.when(F.col("path").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("found") != F.col("sha256"), "sha256")
    return listed.join(files, "name", "left").select("name", fault.alias("fault")).where("fault is not null")


class _Pixels(DataSourceReader):
    def __init__(self, path: str, width: int, height: int) -> None:
        self.path, self.width, self.height = path, width, height

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(y) for y in range(0, self.height, 64)]

    def read(self, partition: InputPartition):
        rows = min(64, self.height - partition.value)
        with _opened(self.path) as f:
            if f.size() != 2 * self.width * self.height:
                raise InvalidArgument("the file's size isn't width x height x 2")
            f.seek(2 * self.width * partition.value)
            values = np.frombuffer(f.read(2 * self.width * rows), "<u2").reshape(rows, self.width)
        for y in range(rows):
            yield partition.value + y, values[y].astype(int).tolist()


class RawMosaic(DataSource):
    """spark.read.format("raw_u16le").options(width=, height=).load(path): y, values of each row of a 16-bit mosaic."""

    @classmethod
    def name(cls) -> str:
        return "raw_u16le"

    def schema(self) -> str:
        return "y int, values array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Pixels(self.options["path"], int(self.options["width"]), int(self.options["height"]))


def pfm_bytes(rgb: np.ndarray) -> bytes:
    """h x w x 3 floats as PFM: rows from the bottom up, interleaved, little-endian."""
    h, w, _ = rgb.shape
    return f"PF\n{w} {h}\n-1.0\n".encode() + rgb[::-1].astype("<f4").tobytes()


def planar_bytes(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> bytes:
    return b"".join(p.astype("<u2").tobytes() for p in (y, cb, cr))


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """name, content -> a file each (written under a name of its own, then renamed); returns name, size as written.

    folder is one that all executors share. A task that is repeated writes the same files again.
    """
    ship_code(df.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inside = _located(folder)
        system.create_dir(inside, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                part = f"{inside}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{inside}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "size": pdf["content"].map(len)})

    return df.select("name", "content").mapInPandas(write, "name string, size long")


def publish(df: DataFrame, path: str, overwrite: bool = False, order: list[str] | None = None) -> int:
    """Write as Parquet, all or nothing; an existing path is an error unless told. Returns the number of rows.

    The rows are counted while they are written beside the path; only what reads back whole takes its place, so a failure leaves an
    older table as it was.
    """
    spark, part = df.sparkSession, f"{path.rstrip('/')}.partial-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(hadoop(path)) and not overwrite:
        raise IoFailed(f"{path} exists")
    seen = Observation()
    arranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    try:
        arranged.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(part)
        before, after = seen.get["n"], spark.read.schema(df.schema).parquet(part).count()
        if before != after:
            raise IoFailed(f"{after} of {before} rows were written")
        if overwrite:
            store.delete(hadoop(path), True)
        if not store.rename(hadoop(part), hadoop(path)):
            raise IoFailed(f"{part} can't be renamed")
    finally:
        store.delete(hadoop(part), True)
    return after


def report(**parts: Column) -> Column:
    """One JSON column of nested values."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))
