"""Content-addressed store of token ids.

Each document is encoded whole and closed with an end id. A rolling hash over the last ids cuts its id stream into chunks
wherever the ids themselves say so, so equal passages give equal chunks wherever they stand. A chunk is stored once, under
the SHA-256 of its ids; a document keeps a recipe, the addresses of its chunks in order, and the Merkle root over them;
a manifest keeps one Merkle root for each part of the recipes. Reading recomputes the address of each chunk that it reads, the
roots of the documents and, before all else, the whole manifest.

Folders under the store's path (Parquet): chunks (address, refs, payload), recipes (doc_id, part, n_tokens, recipe, root; parts
follow ascending doc_id), manifest (part, n_docs, n_tokens, root). While it is written, encoded has all chunks as they come.
A payload is one width byte (2 or 4) and the ids as little-endian unsigned integers of that width.

Null and empty texts are documents with the end id only. Repeated rows are documents of their own (ties in doc_id follow
the recipe). A null doc_id sorts first. An empty table gives an empty store. Texts of any length are encoded whole. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.llm.tokens import encoder
from lumaframe.llm.words import mix, texts_of, tidy
from lumaframe.session import discard, new_path, ship_code

WINDOW, MEAN, LEAST, MOST = 16, 1024, 256, 4096
#: Words whose ids a process keeps, some 150 bytes each.
CACHE_WORDS = 600_000


#: A random value for each of the lowest 65,536 ids, made by rule.
_VALUES = mix(np.arange(1 << 16, dtype=np.uint64), 3)
_ODD, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - MEAN.bit_length() + 1)


def cut_points(ids: np.ndarray) -> list[int]:
    """Chunk ends: where the hash of the last WINDOW ids has its top bits zero (once in MEAN ids), no chunk under LEAST or over MOST ids."""
    n, marks = len(ids), []
    if n > LEAST:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[ids & 0xFFFF], out=sums[1:])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * _ODD
        marks = (np.flatnonzero(rolled >> _TOP == 0) + WINDOW).tolist()
    ends, last = [], 0
    for mark in [*marks, n]:
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST or mark == n and mark > last:
            last = mark
            ends.append(last)
    return ends


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd last node moves up unchanged."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@cache
def _over_zeros(power: int) -> list[list[int]]:
    """What 2 ** power zero bytes after it make of a CRC-32, for each value of each of its four bytes; the results are to be xored."""

    def tables(columns: list[int]) -> list[list[int]]:
        found = [[0] for _ in range(4)]
        for i, column in enumerate(columns):
            found[i // 8] += [column ^ x for x in found[i // 8]]
        return found

    if power:
        half = _over_zeros(power - 1)
        return tables([_carry(half, _carry(half, 1 << i)) for i in range(32)])
    # One zero byte is eight zero bits.
    columns = [1 << i for i in range(32)]
    for _ in range(8):
        columns = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in columns]
    return tables(columns)


def _carry(tables: list[list[int]], crc: int) -> int:
    a, b, c, d = tables
    return a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]


def crc_join(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings together, from theirs and the second one's length."""
    power = 0
    while n_bytes and first:
        if n_bytes & 1:
            first = _carry(_over_zeros(power), first)
        n_bytes >>= 1
        power += 1
    return first ^ second


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode docs (doc_id, text) into a new store at path."""
    spark = docs.sparkSession
    ship_code(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, CACHE_WORDS)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys, lengths, recipes, payloads, roots = batch.column(0), [], [], [], []
            for text in texts_of(batch.column(1)):
                ids = np.concatenate([enc.encode(text), end])
                cuts = cut_points(ids)
                parts = [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
                recipe = [hashlib.sha256(x.astype("<u4").tobytes()).digest() for x in parts]
                lengths.append(len(ids))
                recipes.append(recipe)
                payloads.append([pack_ids(x) for x in parts])
                roots.append(merkle(recipe))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(lengths, pa.int64()), pa.array(recipes, pa.list_(pa.binary())), pa.array(payloads, pa.list_(pa.binary())), pa.array(roots, pa.binary())],
                names=["doc_id", "n_tokens", "recipe", "payloads", "root"],
            )
        enc.end()

    key = docs.schema["doc_id"].dataType.simpleString()
    encoded = docs.select("doc_id", "text").mapInArrow(tidy(encode), f"doc_id {key}, n_tokens long, recipe array<binary>, payloads array<binary>, root binary")
    encoded.write.option("compression", "zstd").parquet(f"{path}/encoded")
    encoded = spark.read.parquet(f"{path}/encoded")
    (
        encoded.select(F.explode(F.arrays_zip("recipe", "payloads")).alias("c"))
        .groupBy(F.col("c.recipe").alias("address"))
        .agg(F.count("*").alias("refs"), F.first("c.payloads").alias("payload"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/chunks")
    )
    order = ["doc_id", "root"]
    (
        encoded.select("doc_id", "n_tokens", "recipe", "root")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )

    _sealed(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    discard(spark, f"{path}/encoded")


def _sealed(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root of the parts of recipes, as they are in the manifest."""

    def seal(pdf):
        pdf = pdf.sort_values(["doc_id", "root"], na_position="first")
        import pandas as pd

        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n_docs": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())], "root": [merkle([bytes(x) for x in pdf["root"]])]})

    return recipes.select("part", "doc_id", "n_tokens", "root").groupBy("part").applyInPandas(seal, "part int, n_docs long, n_tokens long, root binary")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises if the recipes don't give the manifest: if documents or parts are missing, added or changed in either."""
    found = _sealed(spark.read.parquet(f"{path}/recipes")).withColumn("w", F.lit(1))
    kept = spark.read.parquet(f"{path}/manifest").withColumn("w", F.lit(-1))
    wrong = found.unionByName(kept).groupBy("part", "n_docs", "n_tokens", "root").agg(F.sum("w").alias("w")).where("w <> 0").select(F.min("part")).head()
    if wrong[0] is not None:
        raise ValueError(f"part {wrong[0]} of the recipes and the manifest differ")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Every stored chunk as address, n, crc (of its uint32 ids); a chunk whose ids don't give its address raises."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = [], []
            for address, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unpack_ids(payload).tobytes()
                if hashlib.sha256(raw).digest() != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                sizes.append(len(raw) // 4)
                sums.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["address", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("address", "payload").mapInArrow(verify, "address binary, n long, crc long")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of each document, put together from the stored chunks by its recipe.

    Raises if a chunk is missing or damaged, if a recipe's chunks don't give its length or its Merkle root, or if the recipes don't
    give the manifest.
    """
    ship_code(spark)
    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    key = recipes.schema["doc_id"].dataType.simpleString()
    # One row for each part, and one part holds a bounded range of documents.
    offsets = spark.read.parquet(f"{path}/manifest").select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("doc_id", "root")
    placed = (
        recipes.withColumn("row", F.row_number().over(within))
        .withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(offsets, "part")
        .select("doc_id", "part", "row", "n_tokens", "root", (F.col("before") + F.col("ahead")).alias("start"), "recipe")
    )
    links = placed.select("doc_id", "part", "row", "start", "n_tokens", "root", F.posexplode("recipe").alias("pos", "address"))
    joined = (
        links.join(read_chunks(spark, path), "address", "left")
        .groupBy("part", "row")
        .agg(*(F.first(c).alias(c) for c in ("doc_id", "start", "n_tokens", "root")), F.sort_array(F.collect_list(F.struct("pos", "address", "n", "crc"))).alias("chunks"))
        .select("doc_id", "start", "n_tokens", "root", "chunks.address", "chunks.n", "chunks.crc")
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = [], []
            lengths, roots, addresses, sizes, crcs = (batch.column(i).to_pylist() for i in range(2, 7))
            for length, root, address, size, crc in zip(lengths, roots, addresses, sizes, crcs, strict=True):
                if None in size or sum(size) != length or merkle(address) != root:
                    raise ValueError("a document can't be rebuilt from its recipe")
                total = 0
                for n, c in zip(size, crc, strict=True):
                    total = crc_join(total, c, 4 * n)
                sums.append(total)
                counts.append(len(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])

    return joined.mapInArrow(combine, f"doc_id {key}, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_ids(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, ids (array of ints) of the documents in wanted (doc_id), or of all. Raises as read_digests() does."""
    ship_code(spark)
    check_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "n_tokens", "root", "recipe")
    recipes = recipes.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi") if wanted is not None else recipes
    rows = recipes.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "n_tokens", "root", F.posexplode("recipe").alias("pos", "address"))
    chunks = spark.read.parquet(f"{path}/chunks").select("address", "payload")
    key = recipes.schema["doc_id"].dataType.simpleString()
    joined = (
        rows.join(chunks, "address", "left").groupBy("row")
        .agg(*(F.first(c).alias(c) for c in ("doc_id", "n_tokens", "root")), F.sort_array(F.collect_list(F.struct("pos", "address", "payload"))).alias("c"))
        .select("doc_id", "n_tokens", "root", "c.address", "c.payload")
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            lengths, roots, addresses, payloads = (batch.column(i).to_pylist() for i in range(1, 5))
            for length, root, address, payload in zip(lengths, roots, addresses, payloads, strict=True):
                parts = [None if p is None else unpack_ids(p) for p in payload]
                for a, x in zip(address, parts, strict=True):
                    if x is None or hashlib.sha256(x.tobytes()).digest() != a:
                        raise ValueError(f"chunk {a.hex()} is {'missing' if x is None else 'damaged'}")
                if sum(map(len, parts)) != length or merkle(address) != root:
                    raise ValueError("a document can't be rebuilt from its recipe")
                whole.append(np.concatenate(parts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return joined.mapInArrow(rebuild, f"doc_id {key}, ids array<int>")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the store (to the shared folder unless a path is given), read it back, return read_digests()."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    write_store(docs, path, tokenizer, end_id)
    return read_digests(spark, path)
