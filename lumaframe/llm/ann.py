"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is taken relative to the mean, padded with zeros, rotated by one random orthogonal matrix and kept as one sign bit
for each dimension of the rotated space, with two correction scalars: its length and how well its code represents its direction.
A query is rotated likewise, quantised to a few bits a dimension and kept as bit planes; counting the bits that a plane and a
code have in common, word by word, gives an estimate of their inner product without unpacking either. The scalars make it
unbiased and bound its error; only vectors whose upper bound reaches the 20th best exact value so far are reranked with their
original values in double precision. The best by estimate go first, so that this bar is high.

The queries are taken in blocks of a fixed number: each block is sent to the tasks, which keep the best of their own rows, and
the tasks' best are merged. Work grows with queries times rows, at a few word operations a pair; every row is indexed and no list
is left out, so what is missed is missed by the error bounds alone.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, neither as
queries nor as candidates. Values are scaled by a power of two for the estimates, so vectors of any length are found; scores are
those of the originals, and infinite beyond the range of doubles. Rows with one vec_id are candidates each; as a query the one
with the smallest vector counts. A query never finds a row of its own vec_id. Ties go to the smaller vec_id. A null vec_id takes
no part. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.session import new_path, ship_code, stage

#: Queries in a block, and standard deviations of the error bound.
BLOCK, EPSILON = 2_048, 3.0
#: Code bits for each dimension: vectors are padded with zeros before they are rotated, the error falls with the root of the bits.
BITS = 4
#: Bits that a query's rotated components are quantised to.
PLANES = 4
#: Queries and candidates that are compared at once.
TILE_QUERIES, TILE_ROWS = 64, 4_096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (array of double) of the rows that take part."""
    e = F.col("embedding")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(e, lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fine.where(F.size("embedding") == (sizes["d"] if sizes else -1))


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """The first d columns of a random rotation of BITS * d dimensions, which is all that vectors padded with zeros meet."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((BITS * d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits packed in 64-bit words, length and representation factor of each row."""
    y = (x - centre) @ turn.T
    size = np.sqrt((y * y).sum(axis=1))
    fit = np.abs(y).sum(axis=1) / np.maximum(size, 1e-300) / np.sqrt(y.shape[1])
    return words(y > 0), size, np.where(size > 0, np.clip(fit, 1e-6, 1.0), 1.0)


def words(bits: np.ndarray) -> np.ndarray:
    """The last axis packed into 64-bit words, the last one filled up with zeros."""
    return np.packbits(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, -bits.shape[-1] % 64)]), axis=-1).view(np.uint64)


class Queries:
    """Rotated and quantised queries: bit planes, and what turns counts of common bits into inner products."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        turned = q @ turn.T
        self.offset = q @ centre
        self.length = np.sqrt((turned * turned).sum(axis=1))
        self.least = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.least, 1e-300) / (2**PLANES - 1)
        level = np.rint((turned - self.least[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([words(level >> j & 1 == 1) for j in range(PLANES)])
        self.total = turned.sum(axis=1)

    def products(self, code: np.ndarray, rows: slice) -> np.ndarray:
        """Inner products of queries with the sign vectors of codes, by counting common bits."""
        total = np.zeros((len(self.total[rows]), len(code)), np.uint32)
        for plane in self.planes[::-1]:
            total <<= 1
            for w in range(code.shape[1]):
                total += np.bitwise_count(plane[rows, w, None] & code[None, :, w])
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        return 2 * (self.step[rows, None] * total + self.least[rows, None] * ones) - self.total[rows, None]


def build_index(vectors: DataFrame, seed: int = 11) -> tuple[DataFrame, np.ndarray, np.ndarray, float] | None:
    """The staged table of codes (vec_id, code, size, fit, embedding), the centre, the rotation and the scale; None without usable vectors."""
    good = usable(vectors)
    first = good.select(F.size("embedding").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    largest = good.select(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0]
    scale = 1.0 if 1e-100 < largest < 1e100 else 2.0 ** -min(max(np.frexp(largest)[1], -1000), 1000)
    centre = np.array(good.select(*(F.avg(F.col("embedding")[i] * scale) for i in range(d))).first(), np.float64)
    turn = rotation(d, seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            bits, size, fit = encode(x * scale, centre, turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(size), pa.array(fit), batch.column(1)], names=["vec_id", "code", "size", "fit", "embedding"])

    table = good.mapInArrow(code, "vec_id long, code binary, size double, fit double, embedding array<double>")
    return stage(table, "codes"), centre, turn, scale


class Best:
    """The k best candidates of each query so far: greatest score first, then smallest id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query = self.ids = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        score = np.where(np.isnan(score), -np.inf, score)  # inf - inf, beyond the range of doubles
        fair = score >= self.least[query]  # what is below k others can't be among the best
        query, ids, score = query[fair], ids[fair], score[fair]
        if not len(query):
            return
        query, ids, score = np.concatenate([self.query, query]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < self.k
        self.query, self.ids, self.score = query[keep], ids[order][keep], score[order][keep]
        full = nth[keep] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def search_rows(best: Best, ids: np.ndarray, q: np.ndarray, queries: Queries, scale: float, vec: np.ndarray, code: np.ndarray, size: np.ndarray, fit: np.ndarray, x: np.ndarray) -> int:
    """Compare queries with a tile of candidates; returns how many pairs were reranked."""
    reranked = 0
    bits = BITS * x.shape[1]
    long = size / fit / np.sqrt(bits)
    loose = EPSILON * size * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(max(bits - 1, 1))

    def exact(rows: np.ndarray, columns: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            best.add(a + rows, vec[columns], np.einsum("ij,ij->i", part[rows], x[columns]))

    for a in range(0, len(q), TILE_QUERIES):
        rows = slice(a, a + TILE_QUERIES)
        part = q[rows]
        estimate = queries.offset[rows, None] + queries.products(code, rows) * long
        # The error of the code, of the query's quantisation (rounding is even over a step) and of the arithmetic.
        bound = queries.length[rows, None] * loose + (EPSILON / np.sqrt(12)) * queries.step[rows, None] * np.sqrt(bits) * long + 1e-9 * (np.abs(estimate) + queries.length[rows, None] * size)
        own = ids[rows, None] == vec
        here = np.arange(len(part))[:, None]
        if len(vec) > best.k:
            estimate[own] = -np.inf
            lead = np.argpartition(estimate, len(vec) - best.k, axis=1)[:, len(vec) - best.k :]
            r, c = np.broadcast_to(here, lead.shape)[~own[here, lead]], lead[~own[here, lead]]
            exact(r, c)
            reranked += len(r)
            own[here, lead] = True
        # What isn't certainly below is reranked, estimates that are no numbers too.
        row, column = np.nonzero(~(estimate + bound < (best.least[rows, None] * scale) * scale) & ~own)
        reranked += len(row)
        for s in range(0, len(row), 1 << 16):
            exact(row[s : s + (1 << 16)], column[s : s + (1 << 16)])
    return reranked


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    ship_code(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    index = build_index(vectors)
    if index is None:
        return spark.createDataFrame([], schema)
    codes, centre, turn, scale = index
    d, path = len(centre), new_path(spark, "neighbours")
    queries = codes.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toLocalIterator()
    wrote = False
    while block := list(islice(queries, BLOCK)):
        wrote = True
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in block], np.int64), np.array([r["embedding"] for r in block], np.float64)))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best, turned = Best(len(ids), k), Queries(q * scale, centre, turn)
            for batch in batches:
                for s in range(0, batch.num_rows, TILE_ROWS):
                    t = batch.slice(s, TILE_ROWS)
                    vec, size, fit = (t.column(i).to_numpy() for i in (0, 2, 3))
                    code = np.frombuffer(b"".join(t.column(1).to_pylist()), np.uint64).reshape(len(vec), -1)
                    x = t.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    search_rows(best, ids, q, turned, scale, vec, code, size, fit, x)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.ids), pa.array(best.score)], names=["query_id", "vec_id", "score"])

        local = codes.mapInArrow(search, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)
