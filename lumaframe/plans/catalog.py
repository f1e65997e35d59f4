"""All queries of the engine by name, and the SQL that gives the same rows.

A query runs over its whole tables. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaframe import commands
from lumaframe.config import PROFILES, Config
from lumaframe.functions import arrays
from lumaframe.functions import pixel as P
from lumaframe.functions import text as T
from lumaframe.functions.timebase import micros, ns_to_pts
from lumaframe.operators import audio as A
from lumaframe.operators import color, demosaic, devices, merge, metadata, ranks, timing
from lumaframe.plans import picture
from lumaframe.plans.bindings import HEIGHT, RATE, SQL_AUDIO, SQL_NS, SQL_PIXELS, SQL_PLANES, WIDTH, audio, pixels, planes, table
from lumaframe.session import ship_code
from lumaframe.streaming.stateful import resequenced_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- frames and time


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS frame_index, epoch_us(ts) * 1000 AS timestamp_ns FROM events")
def frame_index_assign(spark, d):
    x = ranks.numbered(table(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], ["ts"], F.date_trunc("hour", "ts"), "frame_index")
    return x.select("event_id", F.col("frame_index").cast("long").alias("frame_index"), (micros(F.col("ts")) * 1000).alias("timestamp_ns"))


@query("""SELECT event_type, count(*) AS n, sum(CASE WHEN gap <= 0 THEN 1 ELSE 0 END)::BIGINT AS not_increasing, min(gap) AS least_gap_us FROM (
SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM events) GROUP BY event_type""")
def strictly_increasing_check(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", micros(F.col("ts")).alias("us"))
    x = ranks.lagged(e, ["event_type"], "event_id", "us", F.floor(F.col("event_id") / 1_000_000), "before").withColumn("gap", F.col("us") - F.col("before"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gap") <= 0, 1).otherwise(0)).alias("not_increasing"), F.min("gap").alias("least_gap_us"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts, event_id LIMIT 240")
def frame_limit_point(spark, d):
    """The first 240 frames: the limit is the operator."""
    return table(spark, d, "events").orderBy("ts", "event_id").limit(240).select("event_id", "user_id", "event_type")


@query("""SELECT event_type, count(*) AS frames, min(us) * 1000 AS first_ns, max(us) * 1000 AS last_ns, round(avg(gap) / 1000.0, 6) AS mean_interval_ms,
round(CASE WHEN avg(gap) > 0 THEN 1000000.0 / avg(gap) ELSE 0 END, 6) AS estimated_fps, round((max(us) - min(us)) / 1000000.0, 6) AS duration_s FROM (
SELECT event_type, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) GROUP BY event_type""")
def inspect_summary(spark, d):
    """The gaps between neighbours add up to the whole span, so their mean needs no order."""
    x = table(spark, d, "events").select("event_type", micros(F.col("ts")).alias("us"))
    gap = F.when(F.count("us") > 1, (F.max("us") - F.min("us")) / F.greatest(F.count("us") - 1, F.lit(1)))
    return x.groupBy("event_type").agg(F.count("*").alias("frames"), (F.min("us") * 1000).alias("first_ns"), (F.max("us") * 1000).alias("last_ns"), r6(gap / 1000).alias("mean_interval_ms"), r6(F.when(gap > 0, 1_000_000 / gap).otherwise(0.0)).alias("estimated_fps"), r6((F.max("us") - F.min("us")) / 1_000_000).alias("duration_s"))


_SUMMARY = "count(value) AS samples, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"


def _summary(x: DataFrame) -> DataFrame:
    return timing.stage_summary(x, "event_type", "value").select("event_type", "samples", *(r6(c).alias(c) for c in ("total", "mean", "p50", "p95", "p99")))


@query(f"SELECT event_type, {_SUMMARY} FROM events GROUP BY event_type")
def stage_timing_summary(spark, d):
    return _summary(table(spark, d, "events"))


@query(f"SELECT event_type, {_SUMMARY} FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1) GROUP BY event_type")
def stage_timing_merge(spark, d):
    e = table(spark, d, "events")
    return _summary(e.where("event_id % 2 = 0").unionAll(e.where("event_id % 2 = 1")))


@query("SELECT event_type, round(max(value), 6) AS largest, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def bench_percentiles(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    x = e.groupBy("event_type").agg(r6(F.max("value")).alias("largest"), r6(F.min("value")).alias("least"), r6(F.avg("value")).alias("mean"))
    return x.join(ranks.percentiles(e, ["event_type"], "value", {"p90": 0.9}).select("event_type", r6("p90").alias("p90")), "event_type")


@query("""SELECT event_id, user_id, count(*) OVER w AS n, (sum(round(value * 100)::BIGINT) OVER w)::DOUBLE / ((count(*) OVER w) * 100.0::DOUBLE) AS mean, max(value) OVER w AS largest FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_mean_max(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.count("*").over(w).alias("n"), (F.sum(F.round(F.col("value") * 100).cast("long")).over(w).cast("double") / (F.count("*").over(w) * 100.0)).alias("mean"), F.max("value").over(w).alias("largest"))


@query("SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_suppkey")
def upper_median(spark, d):
    return ranks.values_at(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", {"upper_median": (0.5, lambda n: F.floor(n / 2))}).select("l_suppkey", "upper_median")


@query("""SELECT l_suppkey, l_extendedprice AS p99 FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i,
count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE i = least(n * 99 // 100, n - 1)""")
def p99_trunc(spark, d):
    return ranks.values_at(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p99": (0.99, lambda n: F.least(F.floor(n * 99 / 100), n - 1))}).select("l_suppkey", "p99")


@query("SELECT l_returnflag, round(median(l_tax), 6) AS median_tax, min(l_tax) AS least, max(l_tax) AS largest, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def median_of_runs(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_tax", "l_suppkey")
    rest = x.groupBy("l_returnflag").agg(F.min("l_tax").alias("least"), F.max("l_tax").alias("largest"), F.count_distinct("l_suppkey").alias("suppliers"))
    return rest.join(ranks.percentiles(x, ["l_returnflag"], "l_tax", {"median_tax": 0.5}).select("l_returnflag", r6("median_tax").alias("median_tax")), "l_returnflag")


@query("""SELECT event_id, user_id, (us * 9 + 50) // 100 AS pts, coalesce((us * 9 + 50) // 100 - lag((us * 9 + 50) // 100) OVER (PARTITION BY user_id ORDER BY us, event_id), 3000) AS duration FROM (
SELECT event_id, user_id, epoch_us(ts) - min(epoch_us(ts)) OVER () AS us FROM events)""")
def pts_duration(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", micros(F.col("ts")).alias("us"))
    origin = e.agg(F.min("us").alias("origin"))  # one row
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    x = e.join(F.broadcast(origin)).withColumn("pts", ns_to_pts((F.col("us") - F.col("origin")) * 1000))
    return x.select("event_id", "user_id", "pts", F.coalesce(F.col("pts") - F.lag("pts").over(w), F.lit(3000).cast("long")).alias("duration"))


@query("""SELECT user_id, max(us) * 1000 AS last_ns, (max(us) + coalesce(arg_max(gap, us), 0)) * 1000 AS end_ns FROM (
SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY user_id""")
def video_end(spark, d):
    e = table(spark, d, "events").select("user_id", micros(F.col("ts")).alias("us"))
    x = e.withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us")))
    return x.groupBy("user_id").agg((F.max("us") * 1000).alias("last_ns"), ((F.max("us") + F.coalesce(F.max_by("gap", "us"), F.lit(0))) * 1000).alias("end_ns"))


# --- pixels

_BLACK, _WHITE = (100.25, 120.5, 90.75, 110.0), (3000.5, 3100.25, 2990.0, 3050.75)
_SITE = "(py & 1) * 2 + (px & 1)"
_CASES = lambda values: "CASE s " + " ".join(f"WHEN {i} THEN {v}::DOUBLE" for i, v in enumerate(values)) + " END"
_CFA_CASE = "CASE label % 4 " + " ".join(f"WHEN {i} THEN [{','.join(map(str, P.CFA[n]))}][s + 1]" for i, n in enumerate(("rggb", "bggr", "grbg", "gbrg"))) + " END"


def _cfa(label: str = "label") -> Column:
    names = ("rggb", "bggr", "grbg", "gbrg")
    return F.element_at(F.array(*map(F.lit, names)), (F.col(label) % 4 + 1).cast("int"))


def _u16(v: str = "v") -> Column:
    return F.floor((F.col(v) + 1) * 2000).cast("int")


@query(f"""SELECT frame, py, px, round((((u - {_CASES(_BLACK)}) / ({_CASES(_WHITE)} - {_CASES(_BLACK)}))::FLOAT * 65535::FLOAT)::DOUBLE, 3) AS calibrated, color FROM (
SELECT *, {_CFA_CASE} AS color FROM (SELECT *, floor((v + 1) * 2000)::INT AS u, {_SITE} AS s FROM ({SQL_PIXELS})))""")
def calibrate_mosaic(spark, d):
    x = pixels(spark, d)
    at = P.site(F.col("px"), F.col("py")) + 1
    black, white = (F.element_at(F.array(*map(F.lit, levels)), at) for levels in (_BLACK, _WHITE))
    return x.select("frame", "py", "px", F.round(P.calibrate(_u16(), black, white, 65535.0).cast("double"), 3).alias("calibrated"), P.cfa_color(_cfa(), F.col("px"), F.col("py")).alias("color"))


@query(f"SELECT label % 4 AS arrangement, color, count(*) AS n, sum(u)::BIGINT AS total FROM (SELECT label, floor((v + 1) * 2000)::INT AS u, {_CFA_CASE} AS color FROM (SELECT *, {_SITE} AS s FROM ({SQL_PIXELS}))) GROUP BY ALL")
def cfa_color_histogram(spark, d):
    x = pixels(spark, d).select((F.col("label") % 4).alias("arrangement"), P.cfa_color(_cfa(), F.col("px"), F.col("py")).alias("color"), _u16().alias("u"))
    return x.groupBy("arrangement", "color").agg(F.count("*").alias("n"), F.sum("u").alias("total"))


_M = picture.MATRIX
_MATRIX_SQL = lambda k, gain: f"(({_M[3 * k]} * r + {_M[3 * k + 1]} * g + {_M[3 * k + 2]} * b) * {gain})::FLOAT::DOUBLE"


@query(f"WITH {SQL_PLANES} SELECT frame, py, px, round({_MATRIX_SQL(0, 1)}, 6) AS r, round({_MATRIX_SQL(1, 1)}, 6) AS g, round({_MATRIX_SQL(2, 1)}, 6) AS b FROM rgb")
def matrix3_transform(spark, d):
    x = picture.to_pixels(picture.linear(planes(spark, d), Config()), ["r", "g", "b"], WIDTH)
    return x.select("frame", "py", "px", *(r6(c).alias(c) for c in "rgb"))


@query(f"SELECT frame, py, px, round((v * pow(2.0, 0.375))::FLOAT::DOUBLE, 6) AS v FROM ({SQL_PIXELS})")
def exposure_stops(spark, d):
    return pixels(spark, d).select("frame", "py", "px", r6((F.col("v") * F.pow(F.lit(2.0), F.lit(0.375))).cast("float").cast("double")).alias("v"))


@query(f"SELECT frame, round(sum(round(greatest(v, 0), 6)), 6) AS total, sum(CASE WHEN v < 0 THEN 1 ELSE 0 END)::BIGINT AS negatives, max(v) > 0.25 AS bright FROM ({SQL_PIXELS}) GROUP BY frame")
def negative_policy_clamp(spark, d):
    v = F.col("v")
    return pixels(spark, d).groupBy("frame").agg(r6(F.sum(r6(P.negative_policy(v, "clamp_to_zero")))).alias("total"), F.sum(F.when(v < 0, 1).otherwise(0)).alias("negatives"), F.bool_or(v > 0.25).alias("bright"))


_LOG_SQL = lambda x: f"(CASE WHEN {x} <= {P.LOG_CUT} THEN {x} * {P.LOG_M} ELSE (log2(greatest({x}, {P.LOG_CUT}) + {P.LOG_A}) + {P.LOG_B}) * {P.LOG_C} END)"
_UNLOG_SQL = lambda x: f"(CASE WHEN {x} <= {P.LOG_CODE_CUT} THEN {x} / {P.LOG_M} ELSE pow(2.0, {x} / {P.LOG_C} - {P.LOG_B}) - {P.LOG_A} END)"


@query(f"SELECT l_orderkey, l_linenumber, round({_LOG_SQL('(l_extendedprice / 1000)')}, 9) AS code FROM lineitem")
def log_oetf(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(P.log_encode(F.col("l_extendedprice") / 1000), 9).alias("code"))


@query(f"SELECT l_orderkey, l_linenumber, round({_UNLOG_SQL('v')}, 6) AS linear FROM (SELECT l_orderkey, l_linenumber, {_LOG_SQL('(l_discount + l_tax - 0.05)')} AS v FROM lineitem)")
def log_roundtrip(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(P.log_decode(P.log_encode(F.col("l_discount") + F.col("l_tax") - 0.05))).alias("linear"))


_LUT_N = 65536
_LUT_SQL = f"lut AS (SELECT i, {_LOG_SQL(f'({P.LOG_CUT} + i * (1 - {P.LOG_CUT}) / {_LUT_N - 1})')}::FLOAT::DOUBLE AS low, {_LOG_SQL(f'(1 + i * 99.0 / {_LUT_N - 1})')}::FLOAT::DOUBLE AS high FROM range({_LUT_N}) t(i))"


def _lut(spark) -> DataFrame:
    """A table of fixed size."""
    i = F.col("id")
    return spark.range(_LUT_N).select(i.alias("i"), P.log_encode(P.LOG_CUT + i * (1 - P.LOG_CUT) / (_LUT_N - 1)).cast("float").cast("double").alias("low"), P.log_encode(1 + i * 99.0 / (_LUT_N - 1)).cast("float").cast("double").alias("high"))


@query(f"""WITH {_LUT_SQL}, x AS (SELECT l_linenumber, l_discount + l_tax + l_quantity / 5.0 AS v FROM lineitem),
p AS (SELECT *, CASE WHEN v <= 1 THEN (v - {P.LOG_CUT}) * {_LUT_N - 1} / (1 - {P.LOG_CUT}) ELSE (v - 1) * {_LUT_N - 1} / 99.0 END AS pos FROM x),
q AS (SELECT *, least(trunc(pos)::BIGINT, {_LUT_N - 2}) AS i FROM p),
f AS (SELECT l_linenumber, v, CASE WHEN v <= 1 THEN a.low + (pos - q.i) * (b.low - a.low) ELSE a.high + (pos - q.i) * (b.high - a.high) END AS code FROM q JOIN lut a ON a.i = q.i JOIN lut b ON b.i = q.i + 1)
SELECT l_linenumber, count(*) AS n, round(max(abs(code - {_LOG_SQL('v')})), 6) AS max_error, round(sum(round(code, 4)), 2) AS total FROM f GROUP BY l_linenumber""")
def lut_vs_analytic(spark, d):
    v, n = F.col("v"), _LUT_N - 1
    x = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_discount") + F.col("l_tax") + F.col("l_quantity") / 5.0).alias("v"))
    at = F.when(v <= 1, (v - P.LOG_CUT) * n / (1 - P.LOG_CUT)).otherwise((v - 1) * n / 99.0)
    x = x.withColumn("at", at).withColumn("i", F.least(F.col("at").cast("long"), F.lit(n - 1).cast("long")))
    lut = _lut(spark)
    pair = lut.select("i", "low", "high").join(lut.select((F.col("i") - 1).alias("i"), F.col("low").alias("low2"), F.col("high").alias("high2")), "i")
    f = x.join(F.broadcast(pair), "i")
    part = F.col("at") - F.col("i")
    code = F.when(v <= 1, F.col("low") + part * (F.col("low2") - F.col("low"))).otherwise(F.col("high") + part * (F.col("high2") - F.col("high")))
    f = f.select("l_linenumber", "v", code.alias("code"))
    return f.groupBy("l_linenumber").agg(F.count("*").alias("n"), r6(F.max(F.abs(F.col("code") - P.log_encode(v)))).alias("max_error"), F.round(F.sum(F.round("code", 4)), 2).alias("total"))


_Y = f"({P.KR} * r + {P.KG} * g + {P.KB} * b)"


@query(f"WITH {SQL_PLANES} SELECT frame, py, px, round({_Y}, 9) AS y, round((b - {_Y}) / (2 * (1 - {P.KB})), 9) AS cb, round((r - {_Y}) / (2 * (1 - {P.KR})), 9) AS cr FROM rgb")
def rgb_to_ycbcr(spark, d):
    x = picture.to_pixels(planes(spark, d), ["r", "g", "b"], WIDTH)
    y = P.luma(F.col("r"), F.col("g"), F.col("b"))
    return x.select("frame", "py", "px", F.round(y, 9).alias("y"), F.round(P.blue_difference(y, F.col("b")), 9).alias("cb"), F.round(P.red_difference(y, F.col("r")), 9).alias("cr"))


def _chroma(spark, d, quality: bool) -> DataFrame:
    from lumaframe.operators.stencil import chroma_taps

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), chroma_taps(F.col("embedding").cast("array<double>"), WIDTH, HEIGHT, quality).alias("c"))
    return picture.to_pixels(e, ["c"], WIDTH // 2).select("frame", "py", F.col("px").alias("cx"), F.round("c", 9).alias("c"))


_TAPS = "SELECT frame, py, px, v, " + ", ".join(f"coalesce({f}(v, {k}) OVER w, {e}(v) OVER w2) AS {n}" for f, k, e, n in (("lag", 1, "first_value", "a1"), ("lag", 2, "first_value", "a2"), ("lead", 1, "last_value", "b1"), ("lead", 2, "last_value", "b2")))
_WINDOWS = "WINDOW w AS (PARTITION BY frame, py ORDER BY px), w2 AS (PARTITION BY frame, py ORDER BY px ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(f"SELECT frame, py, px // 2 AS cx, round((10 * v + (a1 + b1) * 4 - a2 - b2) / 16, 9) AS c FROM ({_TAPS} FROM ({SQL_PIXELS}) {_WINDOWS}) WHERE px % 2 = 0")
def chroma_422_quality(spark, d):
    return _chroma(spark, d, True)


@query(f"SELECT frame, py, px // 2 AS cx, round(v, 9) AS c FROM ({SQL_PIXELS}) WHERE px % 2 = 0")
def chroma_422_fast(spark, d):
    return _chroma(spark, d, False)


def _sharpen_sql(source: str, amount: float, threshold: float) -> str:
    return f"""lum AS (SELECT *, ({P.KR} * r + {P.KG} * g + {P.KB} * b)::FLOAT::DOUBLE AS yy FROM {source}),
nb AS (SELECT *, coalesce(lag(yy) OVER wr, yy) AS l, coalesce(lead(yy) OVER wr, yy) AS rr, coalesce(lag(yy) OVER wc, yy) AS u, coalesce(lead(yy) OVER wc, yy) AS dn FROM lum
  WINDOW wr AS (PARTITION BY frame, py ORDER BY px), wc AS (PARTITION BY frame, px ORDER BY py)),
det AS (SELECT *, yy - (l + rr + u + dn) * 0.25 AS dd FROM nb),
sh AS (SELECT frame, py, px, i, (r + delta)::FLOAT::DOUBLE AS r, (g + delta)::FLOAT::DOUBLE AS g, (b + delta)::FLOAT::DOUBLE AS b FROM (
  SELECT *, CASE WHEN abs(dd) > {threshold} THEN (sign(dd) * (abs(dd) - {threshold}) * {amount})::FLOAT::DOUBLE ELSE 0 END AS delta FROM det))"""


@query(f"WITH {SQL_PLANES}, {_sharpen_sql('rgb', 0.4, 0.002)} SELECT frame, py, px, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM sh")
def sharpen_cross(spark, d):
    x = picture.to_pixels(picture.sharpened(planes(spark, d), Config(), WIDTH, HEIGHT), ["r", "g", "b"], WIDTH)
    return x.select("frame", "py", "px", *(r6(c).alias(c) for c in "rgb"))


_U = "18446744073709551616::UHUGEINT"
_MUL = lambda x, c: f"((({x})::UHUGEINT * {c}::UHUGEINT) % {_U})::UBIGINT"


def _noise_sql(frame: str, plane: str, sample: str, source: str, keep: str) -> str:
    return f"""h0 AS (SELECT {keep}, xor(xor({_MUL(sample, P.HASH_SAMPLE)}, {_MUL(frame, P.HASH_FRAME)}), {_MUL(plane, P.HASH_PLANE)}) AS h FROM {source}),
h1 AS (SELECT {keep}, {_MUL('xor(h, h >> 30)', P.HASH_MIX_1)} AS h FROM h0), h2 AS (SELECT {keep}, {_MUL('xor(h, h >> 27)', P.HASH_MIX_2)} AS h FROM h1),
noise AS (SELECT {keep}, (xor(h, h >> 31) >> 11)::DOUBLE / 9007199254740992.0 - 0.5 AS noise FROM h2)"""


@query(f"WITH {_noise_sql('l_orderkey', 'l_linenumber % 3', 'l_partkey', 'lineitem', 'l_orderkey, l_linenumber, l_partkey')} SELECT l_orderkey, l_linenumber, noise FROM noise")
def dither_noise(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.dither(F.col("l_orderkey"), F.col("l_linenumber") % 3, F.col("l_partkey")).alias("noise"))


@query(f"SELECT frame, sum(CASE WHEN c < 64 THEN 1 ELSE 0 END)::BIGINT AS low, sum(CASE WHEN c > 940 THEN 1 ELSE 0 END)::BIGINT AS high, sum(trunc(least(greatest(c, 64), 940) + 0.5)::INT)::BIGINT AS total FROM (SELECT frame, 64 + 876 * v * 3 AS c FROM ({SQL_PIXELS})) GROUP BY frame")
def quantize_clip_stats(spark, d):
    c = F.lit(64) + F.lit(876) * F.col("v") * 3
    x = pixels(spark, d).select("frame", c.alias("c"))
    return x.groupBy("frame").agg(F.sum(F.when(F.col("c") < 64, 1).otherwise(0)).alias("low"), F.sum(F.when(F.col("c") > 940, 1).otherwise(0)).alias("high"), F.sum(P.quantize(F.col("c"), 64, 940)).alias("total"))


def _numbered(plane: int):
    return lambda v, i: F.struct(F.lit(plane).alias("plane"), i.alias("sample"), v.alias("code"))


_PACK = Config(exposure_offset_stops=0.25, negative_policy="clamp_to_zero")
_PACK_SQL = f"""{SQL_PLANES},
lin AS (SELECT frame, py, px, i, {_MATRIX_SQL(0, 2.0**0.25)} AS r, {_MATRIX_SQL(1, 2.0**0.25)} AS g, {_MATRIX_SQL(2, 2.0**0.25)} AS b FROM rgb),
{_sharpen_sql('lin', 0.4, 0.002)},
lg AS (SELECT frame, py, px, i, round({_LOG_SQL('greatest(r, 0)')}, 9) AS r, round({_LOG_SQL('greatest(g, 0)')}, 9) AS g, round({_LOG_SQL('greatest(b, 0)')}, 9) AS b FROM sh),
yc AS (SELECT frame, py, px, i, yy, (b - yy) / (2 * (1 - {P.KB})) AS cb, (r - yy) / (2 * (1 - {P.KR})) AS cr FROM (SELECT *, {_Y} AS yy FROM lg)),
chroma AS (SELECT frame, py, px, 1 AS plane, cb AS v FROM yc UNION ALL SELECT frame, py, px, 2, cr FROM yc),
tp AS (SELECT frame, py, px, plane, v, {", ".join(f"coalesce({f}(v, {k}) OVER w, {e}(v) OVER w2) AS {n}" for f, k, e, n in (("lag", 1, "first_value", "a1"), ("lag", 2, "first_value", "a2"), ("lead", 1, "last_value", "b1"), ("lead", 2, "last_value", "b2")))} FROM chroma
  WINDOW w AS (PARTITION BY frame, plane, py ORDER BY px), w2 AS (PARTITION BY frame, plane, py ORDER BY px ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
val AS (SELECT frame, 0 AS plane, i AS sample, round(yy * 876 + 64, 6) AS v, 940 AS top FROM yc UNION ALL
  SELECT frame, plane, py * 4 + px // 2, round((10 * v + (a1 + b1) * 4 - a2 - b2) / 16 * 896 + 512, 6), 960 FROM tp WHERE px % 2 = 0),
{_noise_sql('frame', 'plane', 'sample', 'val', 'frame, plane, sample, v, top')}"""


@query(f"WITH {_PACK_SQL} SELECT frame, plane, sample::INT AS sample, trunc(least(greatest(v, 64), top) + noise + 0.5)::INT AS code FROM noise")
def pack_yuv_pipeline(spark, d):
    """The flagship: the whole chain from planes to dithered codes."""
    x = picture.pack(planes(spark, d), _PACK, WIDTH, HEIGHT)
    numbered = F.concat(*(F.transform(c, _numbered(k)) for k, c in enumerate(("y", "cb", "cr"))))
    return x.select("frame", F.inline(numbered))


@query(f"WITH {_PACK_SQL} SELECT frame, sum(CASE WHEN v < 64 THEN 1 ELSE 0 END)::BIGINT AS clipped_low, sum(CASE WHEN v > top THEN 1 ELSE 0 END)::BIGINT AS clipped_high FROM val GROUP BY frame")
def pack_clip_counts(spark, d):
    return picture.pack(planes(spark, d), _PACK, WIDTH, HEIGHT).select("frame", F.col("clipped_low").cast("long").alias("clipped_low"), F.col("clipped_high").cast("long").alias("clipped_high"))


@query(f"""WITH {SQL_PLANES} SELECT (SELECT count(*) * 2 FROM rgb)::BIGINT AS compared, 0::BIGINT AS missing, TRUE AS within_one""")
def fused_vs_reference(spark, d):
    """Both packs of all frames, sample by sample: the chain in double precision and the pass in single precision."""
    return commands.validate(planes(spark, d), _PACK, WIDTH, HEIGHT).select("compared", "missing", (F.col("max_abs_diff") <= 1).alias("within_one"))


def _lut_segment(low: str, high: str) -> str:
    at, n = f"((v - {low}) * ({_LUT_N - 1} / ({high} - {low})))", _LUT_N - 1
    i = f"least(trunc({at})::BIGINT, {n - 1})"
    point = lambda k: _LOG_SQL(f"({low} + {k} / {n}::DOUBLE * ({high} - {low}))") + "::FLOAT::DOUBLE"
    return f"{point(i)} + ({at} - {i}) * ({point(f'({i} + 1)')} - {point(i)})"


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN v <= {P.LOG_CUT} THEN v * {P.LOG_M} WHEN v <= 1 THEN {_lut_segment(f"{P.LOG_CUT}::DOUBLE", "1::DOUBLE")} WHEN v <= 100 THEN {_lut_segment("1::DOUBLE", "100::DOUBLE")} ELSE {_LOG_SQL('v')} END, 6) AS code FROM (
SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE / 500.0::DOUBLE - 5 AS v FROM lineitem)""")
def lut_branches(spark, d):
    """Values below the cut, on both segments and beyond."""
    v = F.col("l_extendedprice").cast("double") / 500.0 - 5
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(P.log_lut(v)).alias("code"))


@query("""WITH e AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS place, abs(l_extendedprice * l_discount - l_extendedprice * l_tax) AS e FROM lineitem)
SELECT l_returnflag, round(list_sort(list(e))[floor((count(*) - 1) * 0.99)::INT + 1], 6) AS p99, arg_min(place, (-round(e, 6), place)) AS worst_at FROM e GROUP BY l_returnflag""")
def worst_errors(spark, d):
    price = F.col("l_extendedprice")
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    x = timing.worst(table(spark, d, "lineitem"), ["l_returnflag"], F.round(price * F.col("l_discount") - price * F.col("l_tax"), 6), place)
    return x.withColumn("p99", r6("p99"))


@query("""WITH x AS (SELECT user_id, epoch_us(ts) * 1000 AS t, row_number() OVER w AS nth, lead(epoch_us(ts) * 1000) OVER w AS nxt, epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, max(t) AS last_ns, coalesce(arg_max(nxt, t), max(t) + coalesce(arg_max(gap, t), 0)) AS end_ns FROM x WHERE nth <= 20 GROUP BY user_id""")
def video_end_cropped(spark, d):
    """After 20 frames: the end is the next frame's time, if there is one."""
    return timing.video_end(table(spark, d, "events").select("user_id", (micros(F.col("ts")) * 1000).alias("timestamp_ns")), ["user_id"], 20)


@query("""SELECT o_orderpriority, (sum(CAST((o_orderkey * 6364136223846793005::HUGEINT + 1442695040888963407) % 18446744073709551616 AS HUGEINT)) % 18446744073709551616)::DECIMAL(20, 0) AS checksum FROM orders GROUP BY o_orderpriority""")
def wrapping_checksum(spark, d):
    word = F.pmod(F.col("o_orderkey").cast("decimal(38,0)") * F.lit(Decimal(6364136223846793005)).cast("decimal(19,0)") + F.lit(Decimal(1442695040888963407)).cast("decimal(19,0)"), F.lit(Decimal(2**64)).cast("decimal(20,0)"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(arrays.wrapping_sum(word).alias("checksum"))


@query("""SELECT p_partkey, (p_partkey * 65537 + p_size) & 65535 AS low, ((p_partkey * 65537 + p_size) >> 16) & 65535 AS high FROM part""")
def unpack_words(spark, d):
    x = table(spark, d, "part").select("p_partkey", arrays.unpack16(F.array(F.col("p_partkey").cast("long") * 65537 + F.col("p_size"))).alias("v"))
    return x.select("p_partkey", F.col("v")[0].alias("low"), F.col("v")[1].alias("high"))


@query("""SELECT vec_id, (len(embedding) // 2)::BIGINT AS per_channel, list_sum(list_transform(embedding[1:(vec_id % 80)::INT], lambda x: round(x::DOUBLE, 4))) AS kept FROM embeddings""")
def channel_samples(spark, d):
    x = table(spark, d, "embeddings")
    kept = F.transform(arrays.cropped(F.col("embedding"), F.col("vec_id") % 80), lambda v: F.round(v.cast("double"), 4))
    total = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v))
    return x.select("vec_id", arrays.samples_per_channel(F.size("embedding"), F.lit(2)).alias("per_channel"), total.alias("kept"))


@query("""WITH dev AS (SELECT s_suppkey AS idx, s_name AS name, ['other', 'virtual', 'integrated', 'discrete', 'cpu'][(s_suppkey % 5 + 1)::INT] AS type, s_suppkey % 3 = 0 AS software, s_suppkey % 4 <> 1 AS compute FROM supplier)
SELECT idx, name, type FROM dev WHERE NOT software AND compute AND type <> 'cpu' ORDER BY list_position(['discrete', 'integrated', 'virtual', 'other'], type), idx LIMIT 1""")
def preferred_device(spark, d):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("other", "virtual", "integrated", "discrete", "cpu"))), (k % 5 + 1).cast("int"))
    x = table(spark, d, "supplier").select(k.alias("index"), F.col("s_name").alias("name"), kind.alias("type"), (k % 3 == 0).alias("software"), (k % 4 != 1).alias("compute"))
    return devices.select_device(x, "auto").select(F.col("index").alias("idx"), "name", "type")


@query("""SELECT user_id, count(*) AS packets, count(*) FILTER (pts IS NULL OR coalesce(pts <= before, FALSE) OR NOT coalesce(duration > 0, FALSE)) AS faults FROM (
SELECT user_id, pts, duration, lag(pts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT user_id, event_id, CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) END AS pts, event_id % 50 AS duration FROM events)) GROUP BY user_id""")
def packet_validation(spark, d):
    e = F.col("event_id")
    x = table(spark, d, "events").select("user_id", e.alias("seq"), F.when(e % 97 != 0, micros(F.col("ts"))).alias("pts"), (e % 50).alias("duration"))
    return commands.packet_faults(x, ["user_id"])


@query("""SELECT event_type AS path, count(*) AS frames, min(us) * 1000 AS first_ns, max(us) * 1000 AS last_ns, min(step) * 1000 AS min_step_ns, max(step) * 1000 AS max_step_ns FROM (
SELECT event_type, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS step FROM events) GROUP BY event_type""")
def inspect_command(spark, d):
    return commands.inspect(table(spark, d, "events").select(F.col("event_type").alias("path"), (micros(F.col("ts")) * 1000).alias("timestamp_ns")))


@query("""SELECT l_returnflag, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(max(e), 6) AS max_abs, count(*) FILTER (e > 2000) AS over_limit FROM (
SELECT l_returnflag, abs(l_extendedprice * l_discount - l_extendedprice * l_tax) AS e FROM lineitem) GROUP BY l_returnflag""")
def error_metrics(spark, d):
    price = F.col("l_extendedprice")
    x = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*timing.error_metrics(price * F.col("l_discount"), price * F.col("l_tax"), 2000.0))
    return x.withColumns({"rmse": r6("rmse"), "max_abs": r6("max_abs")})


@query("""SELECT doc_id, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT AS fnv FROM (
SELECT doc_id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT::UHUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM documents)""")
def fnv1a_hash(spark, d):
    ship_code(spark)
    return table(spark, d, "documents").select("doc_id", T.fnv1a("text").alias("fnv"))


@query(f"""SELECT frame, py, px, round((((u::FLOAT - {_CASES(_BLACK)}::FLOAT) / ({_CASES(_WHITE)}::FLOAT - {_CASES(_BLACK)}::FLOAT)) * 65535::FLOAT)::DOUBLE, 1) AS calibrated FROM (
SELECT *, floor((v + 1) * 2000)::INT AS u, {_SITE} AS s FROM ({SQL_PIXELS}))""")
def calibrate_single(spark, d):
    """Calibration in single precision."""
    at = P.site(F.col("px"), F.col("py")) + 1
    black, white = (F.element_at(F.array(*map(F.lit, levels)), at) for levels in (_BLACK, _WHITE))
    return pixels(spark, d).select("frame", "py", "px", F.round(P.calibrate_single(_u16(), black, white, 65535.0).cast("double"), 1).alias("calibrated"))


@query(f"""SELECT frame, bit_or(CASE WHEN isnan(w) OR isinf(w) THEN 2 WHEN w < 0 THEN 1 ELSE 0 END)::INT AS flags FROM (
SELECT frame, CASE WHEN frame % 7 = 0 AND px = 3 THEN 'nan'::DOUBLE WHEN frame % 11 = 0 AND py = 2 THEN 'inf'::DOUBLE WHEN frame % 2 = 0 THEN abs(v) ELSE v END AS w FROM ({SQL_PIXELS})) GROUP BY frame""")
def status_flags(spark, d):
    """Bits of what is wrong anywhere in a frame."""
    v = F.when((F.col("frame") % 7 == 0) & (F.col("px") == 3), float("nan")).when((F.col("frame") % 11 == 0) & (F.col("py") == 2), float("inf")).when(F.col("frame") % 2 == 0, F.abs("v")).otherwise(F.col("v"))
    return pixels(spark, d).groupBy("frame").agg(F.bit_or(P.status(v)).alias("flags"))


@query("""SELECT vec_id, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT AS hash FROM (
SELECT vec_id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(flatten(list_transform(embedding, lambda x: [floor((x::DOUBLE + 1) * 2000)::INT & 255, floor((x::DOUBLE + 1) * 2000)::INT >> 8])), lambda x: x::UHUGEINT)),
lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM embeddings)""")
def plane_hash(spark, d):
    ship_code(spark)
    codes = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 2000).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", T.plane_hash(codes).alias("hash"))


@query("""SELECT user_id, greatest(max(depth), 0)::BIGINT AS most, count(*) FILTER (depth > 3) AS waits FROM (
SELECT user_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM events) GROUP BY user_id""")
def queue_high_water(spark, d):
    """Views enter a user's queue, purchases leave it."""
    change = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return timing.high_water(table(spark, d, "events").select("user_id", "event_id", change.alias("change")), ["user_id"], "event_id", "change", 3)


@query("""SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderkey % 2 = 0), 6) AS price_a, round(avg(o_totalprice) FILTER (o_orderkey % 2 = 1), 6) AS price_b FROM orders GROUP BY o_orderpriority""")
def paired_reports(spark, d):
    x = table(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 2).alias("side")).agg(F.avg("o_totalprice").alias("price"), F.md5(F.first("o_orderpriority")).alias("hash"))
    return timing.paired(x.where("side = 0"), x.where("side = 1"), ["o_orderpriority"], "price", "hash").select("o_orderpriority", r6("price_a").alias("price_a"), r6("price_b").alias("price_b"))


@query("SELECT event_id, value AS duration FROM events WHERE event_type <> 'view' AND event_id % 3 = 0")
def unclaimed_durations(spark, d):
    """What still waits when all packets have taken theirs."""
    e = table(spark, d, "events")
    return merge.claim(e.where("event_id % 3 <> 0").select("event_id"), e.where("event_type <> 'view'").select("event_id", F.col("value").alias("duration")), "event_id")[1]


# --- audio


@query(f"""WITH {SQL_AUDIO}, st AS (SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY chunk_index) AS delta, ts_ns - expected_ns AS residual FROM nor),
g AS (SELECT user_id, count(*) AS chunks, sum(CASE WHEN delta <= 0 THEN 1 ELSE 0 END)::BIGINT AS non_monotonic_steps, max(CASE WHEN delta < 0 THEN -delta ELSE 0 END)::BIGINT AS max_backward_ns,
  max(abs(residual))::BIGINT AS max_abs_residual_ns, arg_max(residual, chunk_index)::BIGINT AS end_residual_ns, list_sort(list(n))[count(*) // 2 + 1] AS med FROM st GROUP BY user_id)
SELECT user_id, chunks, non_monotonic_steps, max_backward_ns, max_abs_residual_ns, end_residual_ns, {SQL_NS.format("med")} AS nominal_ns,
array_to_string(list_filter([CASE WHEN non_monotonic_steps > 0 THEN 'source_non_monotonic' END, CASE WHEN max_abs_residual_ns > 2 * {SQL_NS.format("med")} THEN 'residual_exceeds_two_chunk_intervals' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g""")
def audio_timing(spark, d):
    return A.diagnostics(audio(spark, d), ["user_id"], RATE)


@query(f"WITH {SQL_AUDIO} SELECT user_id, chunk_index, n, expected_ns::BIGINT AS normalized_ns FROM nor")
def audio_normalized_ts(spark, d):
    return A.normalized(audio(spark, d), ["user_id"], RATE).select("user_id", "chunk_index", "n", F.col("expected_ns").alias("normalized_ns"))


@query(f"""WITH {SQL_AUDIO}, e AS (SELECT *, first_value(expected_ns) OVER (PARTITION BY user_id ORDER BY chunk_index) + 300000000 AS end_ns FROM nor),
k AS (SELECT user_id, chunk_index, n, least(n, (end_ns - expected_ns) // 1000000000 * 48000 + (end_ns - expected_ns) % 1000000000 * 48000 // 1000000000)::BIGINT AS kept FROM e WHERE expected_ns < end_ns)
SELECT * FROM k WHERE kept > 0""")
def audio_crop(spark, d):
    x = A.normalized(audio(spark, d), ["user_id"], RATE)
    first = F.first("expected_ns").over(Window.partitionBy("user_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    return A.crop(x.withColumn("end_ns", first + 300_000_000), F.col("end_ns"), RATE).select("user_id", "chunk_index", "n", "kept")


@query(f"""WITH {SQL_AUDIO}, v AS (SELECT user_id, min(epoch_us(ts)) * 1000 AS v0, max(epoch_us(ts)) * 1000 AS v1 FROM events GROUP BY user_id)
SELECT nor.user_id, round((min(expected_ns) - any_value(v0)) / 1e6, 6) AS start_delta_ms, round((max(expected_ns) - any_value(v1)) / 1e9, 6) AS end_delta_s, least(min(expected_ns), any_value(v0))::BIGINT AS origin_ns FROM nor JOIN v USING (user_id) GROUP BY nor.user_id""")
def av_sync_report(spark, d):
    a = A.normalized(audio(spark, d), ["user_id"], RATE).groupBy("user_id").agg(F.min("expected_ns").alias("a0"), F.max("expected_ns").alias("a1"))
    v = table(spark, d, "events").groupBy("user_id").agg((F.min(micros(F.col("ts"))) * 1000).alias("v0"), (F.max(micros(F.col("ts"))) * 1000).alias("v1"))
    return a.join(v, "user_id").select("user_id", r6((F.col("a0") - F.col("v0")) / 1e6).alias("start_delta_ms"), r6((F.col("a1") - F.col("v1")) / 1e9).alias("end_delta_s"), F.least("a0", "v0").alias("origin_ns"))


@query("""SELECT c.user_id, epoch_us(c.ts) AS ts, c.event_id AS chunk_index, min(f.event_id) AS due FROM events c LEFT JOIN events f ON f.user_id = c.user_id AND f.event_type = 'purchase' AND f.ts >= c.ts
WHERE c.event_type = 'view' GROUP BY ALL""")
def audio_video_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", micros(F.col("ts")).alias("ts"), "event_id")
    chunks = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("chunk_index"))
    frames = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("frame_index"))
    return merge.due_frame(chunks, frames, ["user_id"])


@query("""SELECT user_id, ts, kind, i, row_number() OVER (PARTITION BY user_id ORDER BY ts, kind, i) - 1 AS seq FROM (
SELECT user_id, epoch_us(ts) AS ts, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS kind, event_id AS i FROM events WHERE event_type IN ('view', 'purchase'))""")
def packet_interleave(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", micros(F.col("ts")).alias("ts"), "event_id")
    a = e.where("event_type = 'view'").withColumnRenamed("event_id", "chunk_index")
    v = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "frame_index")
    return merge.interleave(a, v, ["user_id"]).withColumn("seq", F.col("seq").cast("long"))


@query("""SELECT p.event_id, p.user_id, q.value AS duration FROM events p LEFT JOIN events q ON q.event_id = p.event_id AND q.event_type <> 'view'""")
def pts_lookup(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "user_id").join(e.where("event_type <> 'view'").select("event_id", F.col("value").alias("duration")), "event_id", "left")


@query("""WITH n AS (SELECT user_id AS container, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id FROM events),
kept AS (SELECT * FROM n WHERE NOT (container % 3 = 0 AND event_id % 11 = 0)), gap AS (SELECT container, min(seq) AS lost FROM n WHERE container % 3 = 0 AND event_id % 11 = 0 GROUP BY container)
SELECT container, seq, chr((65 + event_id % 26)::INT) AS payload FROM kept LEFT JOIN gap USING (container) WHERE lost IS NULL OR seq < lost""")
def resequencer(spark, d):
    """Packets of every third container get lost now and then: only what comes before the first lost one is put out."""
    e = table(spark, d, "events")
    numbered = e.select(F.col("user_id").alias("container"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("seq"), "event_id", F.chr(65 + F.col("event_id") % 26).alias("payload"))
    lossy = numbered.where("not (container % 3 = 0 and event_id % 11 = 0)").select("container", "seq", "payload")
    return resequenced_prefix(lossy)


# --- metadata and rules


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice ELSE c_acctbal END AS level, CASE WHEN o_totalprice > 200000 THEN 'frame' WHEN c_acctbal IS NOT NULL THEN 'container' ELSE 'absent' END AS source
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def metadata_fallback(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    x = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    value, source = metadata.fallback(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")), F.col("c_acctbal"))
    return x.select("o_orderkey", value.alias("level"), source.alias("source"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS INT), -1) AS missing FROM events")
def json_props(spark, d):
    j = F.from_json("props", "k int, missing int")
    return table(spark, d, "events").select("event_id", j["k"].alias("k"), F.coalesce(j["missing"], F.lit(-1)).alias("missing"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN [p, p, p, p] WHEN 1 THEN [p, q, q, p] ELSE [p, q, p + 1, q + 1] END[3] AS third, CASE o_orderkey % 3 WHEN 0 THEN p WHEN 1 THEN p ELSE q + 1 END AS fourth, p AS first, CASE o_orderkey % 3 WHEN 0 THEN p ELSE q END AS second
FROM (SELECT o_orderkey, o_totalprice AS p, o_totalprice * 2 AS q FROM orders)""")
def level_broadcast(spark, d):
    p, q = F.col("o_totalprice"), F.col("o_totalprice") * 2
    levels = F.when(F.col("o_orderkey") % 3 == 0, F.array(p)).when(F.col("o_orderkey") % 3 == 1, F.array(p, q)).otherwise(F.array(p, q, p + 1, q + 1))
    x = table(spark, d, "orders").select("o_orderkey", T.broadcast_levels(levels).alias("v"))
    return x.select("o_orderkey", *(F.col("v")[i].alias(c) for i, c in enumerate(("first", "second", "third", "fourth"))))


_NAMES = ("Standard A", "D-50", "d55", "D65 ", "standard_light_a", "D 75", "mystery")


@query(f"""SELECT p_partkey, CASE lower(regexp_replace(name, '[\\s_\\-]', '', 'g')) {" ".join(f"WHEN '{k}' THEN {v}" for k, v in T.LIGHT_NAMES.items())} END AS by_name,
CASE WHEN code > 1000 THEN code::DOUBLE {" ".join(f"WHEN code = {k} THEN {v}.0" for k, v in T.LIGHT_CODES.items())} ELSE 0.0 END AS by_code FROM (
SELECT p_partkey, [{", ".join(f"'{n}'" for n in _NAMES)}][p_partkey % 7 + 1] AS name, p_size + CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 0 END AS code FROM part)""")
def illuminant_cct(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    code = F.col("p_size") + F.when(F.col("p_partkey") % 2 == 0, 1000).otherwise(0)
    return table(spark, d, "part").select("p_partkey", T.light_name_to_cct(name).alias("by_name"), T.light_code_to_cct(code).alias("by_code"))


@query("SELECT n_name AS unknown_key FROM nation WHERE n_regionkey > 1 EXCEPT SELECT n_name FROM nation WHERE n_nationkey % 3 = 0")
def config_unknown_keys(spark, d):
    n = table(spark, d, "nation")
    given, allowed = n.where("n_regionkey > 1").select(F.col("n_name").alias("unknown_key")), n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("unknown_key"))
    return given.join(allowed, "unknown_key", "left_anti").distinct()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey IN (1, 3))")
def profile_semijoin(spark, d):
    n = table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT w)), ',') AS warnings FROM (SELECT lang, source AS w FROM documents UNION ALL SELECT lang, CASE WHEN n_chars > 5000 THEN 'long' ELSE 'short' END FROM documents) GROUP BY lang")
def warnings_distinct(spark, d):
    x = table(spark, d, "documents")
    both = x.select("lang", F.col("source").alias("w")).unionAll(x.select("lang", F.when(F.col("n_chars") > 5000, "long").otherwise("short").alias("w")))
    return both.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("warnings"))


_FLAGS = ("gpu", "encoder", "cpu", "rcd", "fallback", "forced")


@query("""SELECT i AS combination, CASE WHEN gpu AND encoder AND rcd THEN 'gpu' WHEN forced OR NOT fallback OR NOT cpu THEN 'error' ELSE 'cpu' END AS chosen, NOT (gpu AND encoder AND rcd) AND NOT (forced OR NOT fallback OR NOT cpu) AS used_fallback FROM (
SELECT i, i & 1 > 0 AS gpu, i & 2 > 0 AS encoder, i & 4 > 0 AS cpu, i & 8 > 0 AS rcd, i & 16 > 0 AS fallback, i & 32 > 0 AS forced FROM range(64) t(i))""")
def backend_decision_table(spark, d):
    """Which device a wish and the capabilities give; every combination of six flags."""
    flags = {n: F.col("id").bitwiseAND(1 << i) > 0 for i, n in enumerate(_FLAGS)}
    usable = flags["gpu"] & flags["encoder"] & flags["rcd"]
    error = flags["forced"] | ~flags["fallback"] | ~flags["cpu"]
    return spark.range(64).select(F.col("id").alias("combination"), F.when(usable, "gpu").when(error, "error").otherwise("cpu").alias("chosen"), (~usable & ~error).alias("used_fallback"))


@query("SELECT l_suppkey, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_order, max(l_orderkey * 10 + l_linenumber) AS last_offset FROM lineitem GROUP BY l_suppkey")
def last_physical_frame(spark, d):
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", at).alias("last_order"), F.max(at).alias("last_offset"))


@query("""WITH g AS (SELECT o_orderpriority, o_orderkey % 2 AS side, avg(o_totalprice) AS fps FROM orders GROUP BY ALL)
SELECT a.o_orderpriority, round(100 * (b.fps / a.fps - 1), 6) AS gain, 100 * (b.fps / a.fps - 1) >= 0.5 AS go FROM g a JOIN g b ON a.o_orderpriority = b.o_orderpriority AND a.side = 0 AND b.side = 1""")
def improvement_gate(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 2).alias("side")).agg(F.avg("o_totalprice").alias("fps"))
    a, b = (g.where(f"side = {s}").select("o_orderpriority", F.col("fps").alias(f"fps{s}")) for s in (0, 1))
    gain, go = timing.improvement(F.col("fps1"), F.col("fps0"), 0.5)
    return a.join(b, "o_orderpriority").select("o_orderpriority", r6(gain).alias("gain"), go.alias("go"))


@query("SELECT o_orderpriority, count(*) AS frames, round(count(*) * 1000.0 / sum(o_totalprice), 6) AS per_second, round(count(*) * 12.582912 / sum(o_totalprice), 6) AS megapixels FROM orders GROUP BY o_orderpriority")
def throughput(spark, d):
    wall = F.sum("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("frames"), r6(F.count("*") * 1000.0 / wall).alias("per_second"), r6(F.count("*") * 12.582912 / wall).alias("megapixels"))


@query("SELECT l_returnflag, bit_xor(l_orderkey * 8 + l_linenumber) AS checksum, bit_or(l_linenumber) AS flags FROM lineitem GROUP BY l_returnflag")
def checksum_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.bit_xor(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("checksum"), F.bit_or("l_linenumber").alias("flags"))


_MATRIX_COLUMNS = ("1 + a / 20000", "0.1", "-0.2", "0.3", "0.8 + a / 10000", "0.1", "-0.1", "0.2", "1.1")
_MINORS = ((4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3))


@query(f"""WITH m AS (SELECT c_custkey, {", ".join(f"({c.replace('a', 'c_acctbal')})::DOUBLE AS m{i}" for i, c in enumerate(_MATRIX_COLUMNS))} FROM customer),
q AS (SELECT *, m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) AS det FROM m),
v AS (SELECT *, {", ".join(f"(m{a} * m{b} - m{c} * m{e}) / det AS v{i}" for i, (a, b, c, e) in enumerate(_MINORS))} FROM q)
SELECT c_custkey, round(det, 6) AS det, round(v0, 6) AS v0, round(v4, 6) AS v4, round(v8, 6) AS v8, abs(det) >= 1e-12 AND
greatest({", ".join(f"abs(m{3 * i}) + abs(m{3 * i + 1}) + abs(m{3 * i + 2})" for i in range(3))}) * greatest({", ".join(f"abs(v{3 * i}) + abs(v{3 * i + 1}) + abs(v{3 * i + 2})" for i in range(3))}) <= 1e3 AS valid FROM v""")
def matrix_inverse_validate(spark, d):
    m = [F.expr(c.replace("a", "c_acctbal")).cast("double") for c in _MATRIX_COLUMNS]
    x = table(spark, d, "customer").select("c_custkey", *(c.alias(f"m{i}") for i, c in enumerate(m)))
    m = [F.col(f"m{i}") for i in range(9)]
    v = P.inverse(m)
    return x.select("c_custkey", r6(P.determinant(m)).alias("det"), *(r6(v[i]).alias(f"v{i}") for i in (0, 4, 8)), metadata.matrix_valid(m, 1e3).alias("valid"))


@query("SELECT s_suppkey, round(least(greatest((1 / (2000 + abs(s_acctbal)) - 1 / 6504.0) / (1 / 2856.0 - 1 / 6504.0), 0), 1), 9) AS weight FROM supplier")
def cct_weight(spark, d):
    t = F.lit(2000) + F.abs("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.round(P.reciprocal_weight(t, F.lit(6504.0), F.lit(2856.0)), 9).alias("weight"))


_K = "least(greatest(p_retailprice * 5, 1667), 25000)"


@query(f"""WITH k AS (SELECT p_partkey, {_K} AS k FROM part), x AS (SELECT p_partkey, k, CASE WHEN k <= 4000 THEN -0.2661239e9 / (k * k * k) - 0.2343580e6 / (k * k) + 0.8776956e3 / k + 0.179910
ELSE -3.0258469e9 / (k * k * k) + 2.1070379e6 / (k * k) + 0.2226347e3 / k + 0.240390 END AS x FROM k),
y AS (SELECT *, CASE WHEN k <= 2222 THEN -1.1063814 * x * x * x - 1.34811020 * x * x + 2.18555832 * x - 0.20219683 WHEN k <= 4000 THEN -0.9549476 * x * x * x - 1.37418593 * x * x + 2.09137015 * x - 0.16748867
ELSE 3.0817580 * x * x * x - 5.87338670 * x * x + 3.75112997 * x - 0.37001483 END AS y FROM x)
SELECT p_partkey, round(x, 9) AS x, round(y, 9) AS y, round(4 * x / (-2 * x + 12 * y + 3), 9) AS u, round(6 * y / (-2 * x + 12 * y + 3), 9) AS v FROM y""")
def planckian_xy(spark, d):
    t = F.col("p_retailprice") * 5
    p = table(spark, d, "part").select("p_partkey", P.planckian_x(t).alias("x"), P.planckian_y(t).alias("y"))
    u, v = P.xy_to_uv(F.col("x"), F.col("y"))
    return p.select("p_partkey", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


@query()
def cct_golden_section(spark, d):
    ship_code(spark)
    t = F.lit(2000) + F.abs("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.round(color.cct_of(P.planckian_x(t), P.planckian_y(t)), 3).alias("cct"))


@query()
def color_solution(spark, d):
    ship_code(spark)
    k = F.col("n_nationkey") / 500.0
    neutral = F.array(0.9504559 - k, F.lit(1.0), 1.0890578 - k)
    eye = F.array(*(F.lit(float(i % 4 == 0)) for i in range(9)))
    x = table(spark, d, "nation").select("n_nationkey", color.solution_of(neutral, eye).alias("s"))
    return x.select("n_nationkey", *(r6(f"s.{c}").alias(c) for c in ("x", "y", "cct")), F.col("s.iterations").alias("iterations"), r6(F.col("s.matrix")[0]).alias("m00"))


@query()
def rcd_demosaic(spark, d):
    """Sixteen embeddings, tiled 4 x 4, are a frame of 32 x 32; a tile that isn't there is black."""
    ship_code(spark)
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("frame"), (F.col("vec_id") % 16).alias("k"), "embedding")
    whole = e.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("k", "embedding"))).alias("t"))
    whole = whole.withColumn("t", F.map_from_entries("t"))
    dark = F.array_repeat(F.lit(-1.0).cast("float"), WIDTH * HEIGHT)
    tile = lambda i: F.coalesce(F.element_at(F.col("t"), (F.floor(i / 256) * 4 + F.floor(i % 32 / 8)).cast("long")), dark)
    mosaic = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: ((F.element_at(tile(i), (F.floor(i % 256 / 32) * 8 + i % 8 + 1).cast("int")) + 1) * 30000).cast("float"))
    frames = whole.select("frame", F.lit(32).alias("width"), F.lit(32).alias("height"), F.element_at(F.array(*map(F.lit, P.CFA)), (F.col("frame") % 4 + 1).cast("int")).alias("cfa"), mosaic.alias("mosaic"))
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c), 2)
    return demosaic.demosaic(frames).select("frame", "own0", *(mean(c).alias(f"mean_{c}") for c in "rgb"))


@query(f"""SELECT o_orderkey, profile, tag FROM (SELECT o_orderkey, [{", ".join(f"'{p}'" for p in PROFILES)}][o_orderkey % 6 + 1] AS profile, ['apco', 'apcs', 'apcn', 'apch', 'ap4h', 'ap4x'][o_orderkey % 6 + 1] AS tag FROM orders)""")
def codec_tags(spark, d):
    p = F.element_at(F.array(*map(F.lit, PROFILES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", p.alias("profile"), T.codec_tag(p).alias("tag"))
