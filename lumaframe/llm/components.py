"""Connected components of an edge table by alternating large-star and small-star steps, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.session import stage


def connected_components(edges: DataFrame, put: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """id, component (smallest reachable id) of every node of edges (a, b) that isn't its component's smallest.

    Each round is written by put(). It ends when a round changes nothing; rounds grow with the logarithm of the longest path.
    """
    now = put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new["n"] == 0 or (new["n"], new["h"]) == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = (new["n"], new["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = put(small.where("u > v").distinct(), "edges")
