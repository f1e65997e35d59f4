"""Audio clock analysis, repair and cropping. All windows run inside one stream, ordered by chunk_index, never by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.timebase import ns_to_samples, samples_to_ns


def _streams(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("chunk_index")


def normalized(chunks: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """Adds expected_ns: the first timestamp plus the exact duration of all samples before the chunk; a negative timestamp raises."""
    w = _streams(keys)
    ahead = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ts = F.when(F.col("ts_ns") < 0, F.raise_error(F.lit("negative audio timestamp")).cast("long")).otherwise(F.col("ts_ns"))
    anchor = F.first("ts_ns").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("ts_ns", ts).withColumn("expected_ns", anchor + samples_to_ns(ahead, rate))


def diagnostics(chunks: DataFrame, keys: list[str], rate: int) -> DataFrame:
    """One row a stream: backward steps, largest step back, largest and last residual, nominal interval (of the upper median chunk), reasons."""
    w = _streams(keys)
    x = normalized(chunks, keys, rate).withColumn("delta", F.col("ts_ns") - F.lag("ts_ns").over(w)).withColumn("residual", F.col("ts_ns") - F.col("expected_ns"))
    found = x.groupBy(*keys).agg(
        F.count("*").alias("chunks"),
        F.sum(F.when(F.col("delta") <= 0, 1).otherwise(0)).alias("non_monotonic_steps"),
        F.max(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0)).alias("max_backward_ns"),
        F.max(F.abs("residual")).alias("max_abs_residual_ns"),
        F.max_by("residual", "chunk_index").alias("end_residual_ns"),
        upper_median("n").alias("median_samples"),
    )
    found = found.withColumn("nominal_ns", samples_to_ns(F.col("median_samples"), rate)).drop("median_samples")
    reasons = F.array_compact(F.array(F.when(F.col("non_monotonic_steps") > 0, F.lit("source_non_monotonic")), F.when(F.col("max_abs_residual_ns") > 2 * F.col("nominal_ns"), F.lit("residual_exceeds_two_chunk_intervals"))))
    return found.withColumn("reasons", F.array_join(reasons, ","))


def upper_median(value: str | Column) -> Column:
    """The element at n div 2 of the sorted values: of an even number the upper middle one."""
    ordered = F.sort_array(F.collect_list(value))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def crop(chunks: DataFrame, end_ns: Column, rate: int) -> DataFrame:
    """Chunks that begin before end_ns, the last one cut to the samples that end by it; empty ones go. Needs expected_ns."""
    kept = F.least(F.col("n"), ns_to_samples(F.greatest(end_ns - F.col("expected_ns"), F.lit(0).cast("long")), rate))
    return chunks.where(F.col("expected_ns") < end_ns).withColumn("kept", kept).where("kept > 0")
