"""Ranks and neighbours in groups of any size: no group's rows have to fit, or be sorted, in one task.

Values at ranks are exact. A sketch of bounded size (percentile_approx) gives an interval of values around each rank; what lies
below it is only counted, and only the distinct values within it, some hundredth of the rows, are put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error of the sketch, as a fraction of a group's rows, and half the width of an interval.
ACCURACY, HALF_WIDTH = 10_000, 0.005
#: Groups of fewer rows are ordered whole: there a place more or less could pass the interval.
WHOLE = 1_000


def values_at(table: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """keys, n and a column for each rank: the value at a 0-based rank in the group's ascending order, without nulls.

    A rank is the fraction of the rows before it, to within two rows, and a function of n that gives it exactly. A rank outside
    0 to n - 1 gives null, and so does a group of nulls. Null keys are a group.
    """
    # A NaN comes after all other values.
    names, low, high = list(ranks), float("-inf"), float("nan")
    edges = [min(max(p + side * HALF_WIDTH, 0.0), 1.0) for p, _ in ranks.values() for side in (-1, 1)]
    x = table.select(*keys, F.col(value).cast("double").alias("_v"))
    found = x.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile_approx("_v", edges, ACCURACY).alias("_e"))
    spans = [
        F.struct(
            F.lit(k).alias("k"),
            F.when((F.col("n") < WHOLE) | F.lit(edges[2 * k] == 0.0), F.lit(low)).otherwise(F.col("_e")[2 * k]).alias("lo"),
            F.when((F.col("n") < WHOLE) | F.lit(edges[2 * k + 1] == 1.0), F.lit(high)).otherwise(F.col("_e")[2 * k + 1]).alias("hi"),
            rank(F.col("n")).cast("long").alias("rank"),
        )
        for k, (_, rank) in enumerate(ranks.values())
    ]
    groups = found.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)), "n", F.array(*spans).alias("_s"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = x.join(groups, same).select(*keys, "n", "_v", "_s")
    below = joined.groupBy(*keys, "n").agg(*(F.count_if(F.col("_v") < F.col("_s")[k]["lo"]).alias(f"_b{k}") for k in range(len(names))))
    near = (
        joined.select(*keys, "_v", F.explode(F.filter("_s", lambda s: F.col("_v").between(s["lo"], s["hi"]))).alias("_s"))
        .groupBy(*keys, F.col("_s.k").alias("_k"), F.col("_s.rank").alias("_r"), "_v")
        .agg(F.count("*").alias("_c"))
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_to", upto)
    tagged = near.select(*keys, "_k", "_r", "_v", "_c", "_to", F.lit(None).cast("long").alias("n"), *(F.lit(None).cast("long").alias(f"_b{k}") for k in range(len(names))))
    counts = below.select(*keys, F.lit(None).cast("int").alias("_k"), F.lit(None).cast("long").alias("_r"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("long").alias("_c"), F.lit(None).cast("long").alias("_to"), "n", *(F.col(f"_b{k}").cast("long").alias(f"_b{k}") for k in range(len(names))))
    # The counts meet the few ordered values in one window a group.
    every = Window.partitionBy(*keys)
    both = tagged.unionByName(counts).withColumns({"n": F.max("n").over(every)} | {f"_b{k}": F.max(f"_b{k}").over(every) for k in range(len(names))})
    picked = []
    for k, name in enumerate(names):
        at = F.col("_r") - F.col(f"_b{k}")
        picked.append(F.max(F.when((F.col("_k") == k) & (at >= F.col("_to") - F.col("_c")) & (at < F.col("_to")), F.col("_v"))).alias(name))
    return both.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


def percentiles(table: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """keys, n and a column for each point: exact percentiles, interpolated at p * (n - 1)."""
    ranks: dict[str, tuple[float, Callable[[Column], Column]]] = {}
    for name, p in points.items():
        ranks[f"_lo_{name}"] = (p, lambda n, p=p: F.floor((n - 1) * p))
        ranks[f"_hi_{name}"] = (p, lambda n, p=p: F.ceil((n - 1) * p))
    found = values_at(table, keys, value, ranks)
    part = {name: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p) for name, p in points.items()}
    return found.select(*keys, "n", *((F.col(f"_lo_{c}") + part[c] * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).alias(c) for c in points))


def numbered(table: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the 0-based place in each group's order. bucket never falls along the order and cuts a group into parts that fit a task."""
    x = table.withColumn("_bucket", bucket)
    counts = x.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate([*keys, "_bucket"])), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, c in enumerate([*keys, "_bucket"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return x.withColumn("_within", within).join(offsets, same).select(*table.columns, (F.col("_within") + F.col("_before")).alias(name))


def lagged(table: DataFrame, keys: list[str], order: str, value: str, bucket: Column, name: str) -> DataFrame:
    """Adds the value before in each group's order (order has no ties); bucket as in numbered()."""
    x = table.withColumn("_bucket", bucket)
    lasts = x.groupBy(*keys, "_bucket").agg(F.max_by(value, order).alias("_last"))
    ahead = lasts.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate([*keys, "_bucket"])), F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_prior"))
    same = F.lit(True)
    for i, c in enumerate([*keys, "_bucket"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    inside = x.withColumn("_inside", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return inside.join(ahead, same).select(*table.columns, F.when(F.col("_first"), F.col("_prior")).otherwise(F.col("_inside")).alias(name))
