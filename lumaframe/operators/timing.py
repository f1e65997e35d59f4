"""Summaries, differences and gates over measurements: aggregations with partial sums, ranks by ranks.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.operators import ranks


def stage_summary(samples: DataFrame, stage: str, ms: str) -> DataFrame:
    """stage, samples, total, mean, p50, p95, p99 (interpolated, exact); a stage without values has 0 as percentiles."""
    sums = samples.groupBy(F.col(stage).alias("_stage")).agg(F.count(ms).alias("samples"), F.sum(ms).alias("total"), F.avg(ms).alias("mean"))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = ranks.percentiles(samples, [stage], ms, points)
    return found.join(sums, F.col(stage).eqNullSafe(F.col("_stage"))).select(stage, "samples", "total", "mean", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in points))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """compared, missing, differing, differing_fraction, max_abs_diff of two tables joined by position."""
    x, y = a.select(*keys, F.col(value).alias("va")), b.select(*keys, F.col(value).alias("vb"))
    d = F.abs(F.col("va") - F.col("vb"))
    return (
        x.join(y, keys, "full_outer")
        .agg(F.count(d).alias("compared"), F.count_if(d.isNull()).alias("missing"), F.count_if(d > 0).alias("differing"), F.coalesce(F.max(d), F.lit(0)).alias("max_abs_diff"))
        .withColumn("differing_fraction", F.when(F.col("compared") > 0, F.col("differing") / F.col("compared")).otherwise(F.lit(0.0)))
    )


def error_metrics(a: Column, b: Column, limit: float) -> list[Column]:
    d = F.abs(a - b)
    return [F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d).alias("max_abs"), F.count_if(d > limit).alias("over_limit")]


def video_end(frames: DataFrame, keys: list[str], kept: int | None = None) -> DataFrame:
    """keys, last_ns, end_ns of frames (timestamp_ns): of the first `kept` if that is set. They end with the next frame, or after one more of the last gap."""
    order = Window.partitionBy(*keys).orderBy("timestamp_ns")
    t = F.col("timestamp_ns")
    x = frames.select(*keys, t, F.row_number().over(order).alias("nth"), F.lead(t).over(order).alias("next"), (t - F.lag(t).over(order)).alias("gap"))
    x = x.where(F.col("nth") <= kept) if kept is not None else x.withColumn("next", F.lit(None).cast("long"))
    last = F.max(F.struct("timestamp_ns", "next", "gap"))
    return x.groupBy(*keys).agg(last.alias("x")).select(*keys, F.col("x.timestamp_ns").alias("last_ns"), F.coalesce("x.next", F.col("x.timestamp_ns") + F.coalesce("x.gap", F.lit(0))).alias("end_ns"))


def worst(table: DataFrame, keys: list[str], error: Column, place: Column) -> DataFrame:
    """keys, p99 (of the errors' sizes, by truncated index), worst_at (the place of the largest; the first, if several)."""
    x = table.select(*keys, F.abs(error).alias("_d"), place.alias("_place"))
    last = x.groupBy(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(keys))).agg(F.min_by("_place", F.struct(-F.col("_d"), F.col("_place"))).alias("worst_at"))
    found = ranks.values_at(x, keys, "_d", {"p99": (0.99, lambda n: F.floor((n - 1) * 0.99))})
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return found.join(last, same).select(*keys, "p99", "worst_at")


def high_water(events: DataFrame, keys: list[str], order: str, change: str, limit: int) -> DataFrame:
    """keys, most (the largest running sum of the changes, 0 at least), waits (how often it is over the limit)."""
    depth = F.sum(change).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    x = events.select(*keys, depth.alias("_depth"))
    return x.groupBy(*keys).agg(F.greatest(F.max("_depth"), F.lit(0)).cast("long").alias("most"), F.count_if(F.col("_depth") > limit).alias("waits"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str, same: str) -> DataFrame:
    """keys, <value>_a, <value>_b of two reports; where their hashes `same` differ or one is missing, they can't be compared: an error."""
    x = a.select(*keys, F.col(value).alias("_a"), F.col(same).alias("_x")).join(b.select(*keys, F.col(value).alias("_b"), F.col(same).alias("_y")), keys, "full_outer")
    wrong = F.raise_error(F.lit("invalid_argument: reports of different inputs or configurations")).cast("double")
    checked = lambda c: F.when(F.col("_x") == F.col("_y"), F.col(c).cast("double")).otherwise(wrong)
    return x.select(*keys, checked("_a").alias(f"{value}_a"), checked("_b").alias(f"{value}_b"))


def improvement(new: Column, old: Column, least: float) -> tuple[Column, Column]:
    """100 (new / old - 1) and whether it reaches the threshold."""
    gain = 100 * (new / old - 1)
    return gain, gain >= least
