"""Ranks, percentiles, places and neighbours against plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lumaframe.operators import ranks, timing


def _rows():
    rng = random.Random(4)
    rows = [("skewed", rng.choice((0.0, 0.0, 1.0, rng.lognormvariate(0, 4)))) for _ in range(6000)]
    rows += [("ties", 7.0)] * 3000 + [("ties", 8.0)] * 10 + [("small", float(i * i)) for i in range(9)]
    return rows + [(None, float(i)) for i in range(1500)] + [("nulls", None)] * 3 + [("skewed", None)] * 5


def test_percentiles_equal_numpy(spark):
    rows = _rows()
    points = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["key"]: r for r in ranks.percentiles(spark.createDataFrame(rows, "key string, v double").repartition(7), ["key"], "v", points).collect()}
    assert set(got) == {k for k, _ in rows} and got["nulls"]["n"] == 0 and got["nulls"]["p50"] is None
    for key in set(got) - {"nulls"}:
        values = np.array([v for k, v in rows if k == key and v is not None])
        assert got[key]["n"] == len(values)
        for name, p in points.items():
            assert math.isclose(got[key][name], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-12), (key, name)


def test_values_at_ranks(spark):
    rows = [(float("nan"),)] * 20 + [(float(i),) for i in range(2000)]
    got = ranks.values_at(spark.createDataFrame(rows, "v double"), [], "v", {"first": (0.0, lambda n: n * 0), "middle": (0.5, lambda n: F.floor(n / 2)), "last": (1.0, lambda n: n - 1), "none": (1.0, lambda n: n)}).first()
    assert (got["n"], got["first"], got["middle"], got["none"]) == (2020, 0.0, 1010.0, None) and math.isnan(got["last"])


def test_places_and_neighbours_over_buckets(spark):
    rng = random.Random(5)
    rows = [(key, t, rng.randrange(100)) for key in ("a", "b", None) for t in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "key string, t int, v int").repartition(5)
    x = ranks.numbered(df, ["key"], ["t"], F.floor(F.col("t") / 37), "at")
    x = ranks.lagged(x, ["key"], "t", "v", F.floor(F.col("t") / 37), "before")
    found = {(r["key"], r["t"]): (r["at"], r["before"]) for r in x.collect()}
    assert len(found) == len(rows)
    for key in ("a", "b", None):
        ordered = sorted((t, v) for k, t, v in rows if k == key)
        for i, (t, _) in enumerate(ordered):
            assert found[key, t] == (i, ordered[i - 1][1] if i else None)


def test_summary_and_worst(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "stage string, ms double")
    got = {r["stage"]: tuple(r)[1:] for r in timing.stage_summary(df, "stage", "ms").collect()}
    assert got == {"a": (2, 4.0, 2.0, 2.0, 2.9, 2.98), "b": (0, None, None, 0.0, 0.0, 0.0)}
    errors = spark.range(300).select(F.lit("x").alias("k"), (F.col("id") % 150).cast("double").alias("e"), "id")
    assert tuple(timing.worst(errors, ["k"], -F.col("e"), F.col("id")).first()) == ("x", 148.0, 149)
