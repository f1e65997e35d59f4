"""How the driver's tables stand for frames, pixels, chunks and metadata: the same formulas in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe.functions.timebase import micros, samples_to_ns

WIDTH = HEIGHT = 8
RATE = 48_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, py, px, v (and label) of every embedding as an 8 x 8 plane."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("frame", "label", F.floor(F.col("i") / WIDTH).cast("int").alias("py"), (F.col("i") % WIDTH).alias("px"), F.col("v").cast("double").alias("v"))


SQL_PIXELS = "SELECT vec_id AS frame, label, (i // 8)::INT AS py, (i % 8)::INT AS px, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i)"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, r, g, b: embeddings 3k, 3k + 1, 3k + 2 as the planes of frame k; a plane that isn't there is all zeros."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("frame"), (F.col("vec_id") % 3).alias("k"), F.col("embedding").cast("array<double>").alias("e"))
    found = e.groupBy("frame").agg(*(F.first(F.when(F.col("k") == k, F.col("e")), ignorenulls=True).alias(c) for k, c in enumerate("rgb")))
    return found.select("frame", *(F.coalesce(c, F.array_repeat(F.lit(0.0), WIDTH * HEIGHT)).alias(c) for c in "rgb"))


SQL_PLANES = """pl AS (SELECT vec_id // 3 AS frame, vec_id % 3 AS k, embedding AS e FROM embeddings),
rgb AS (SELECT a.frame, (i // 8)::INT AS py, (i % 8)::INT AS px, i, coalesce(x.e[i + 1]::DOUBLE, 0) AS r, coalesce(y.e[i + 1]::DOUBLE, 0) AS g, coalesce(z.e[i + 1]::DOUBLE, 0) AS b
  FROM (SELECT DISTINCT frame FROM pl) a LEFT JOIN pl x ON x.frame = a.frame AND x.k = 0 LEFT JOIN pl y ON y.frame = a.frame AND y.k = 1 LEFT JOIN pl z ON z.frame = a.frame AND z.k = 2, range(64) t(i))"""


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, chunk_index, n, ts_ns: one chunk an event, with a clock that jitters but for every fifth user."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = F.lit(1) + F.floor(F.col("value") * 10).cast("long")
    x = e.select("user_id", "event_id", n.alias("n"), (micros(F.col("ts")) * 1000).alias("ns"), (F.row_number().over(w) - 1).cast("long").alias("chunk_index"))
    ahead = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    first = F.first("ns").over(w.rowsBetween(Window.unboundedPreceding, 0))
    jitter = F.when(F.col("user_id") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("event_id") * 7919 % 20_000_001 - 10_000_000)
    return x.select("user_id", "chunk_index", "n", (first + samples_to_ns(ahead, RATE) + jitter).alias("ts_ns"))


SQL_NS = "(({0}) // 48000 * 1000000000 + (({0}) % 48000 * 1000000000 + 24000) // 48000)"
SQL_AUDIO = f"""ev AS (SELECT user_id, event_id, 1 + floor(value * 10)::BIGINT AS n, epoch_us(ts) * 1000 AS ns,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS chunk_index,
  coalesce(sum(1 + floor(value * 10)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
  first_value(epoch_us(ts) * 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS anchor FROM events),
aud AS (SELECT user_id, chunk_index, n, ahead, anchor + {SQL_NS.format("ahead")} + CASE WHEN user_id % 5 = 0 THEN 0 ELSE event_id * 7919 % 20000001 - 10000000 END AS ts_ns FROM ev),
nor AS (SELECT *, first_value(ts_ns) OVER (PARTITION BY user_id ORDER BY chunk_index) + {SQL_NS.format("ahead")} AS expected_ns FROM aud)"""
