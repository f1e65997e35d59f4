"""Exact small cases of the engine's functions, and whole queries against their SQL on the smallest tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe import config, errors
from lumaframe.functions import pixel as P
from lumaframe.functions import text as T
from lumaframe.functions import timebase as B
from lumaframe.operators import audio, color, demosaic, metadata
from lumaframe.sources import files

SMALL = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_calibration_keeps_both_ends(spark):
    df = spark.createDataFrame([(v,) for v in (50, 100, 150, 250)], "v int").select(P.calibrate(F.col("v"), F.lit(100.0), F.lit(200.0)).alias("c"))
    assert [r.c for r in df.collect()] == [-0.5, 0.0, 0.5, 1.5]


def test_cfa_crop(spark):
    got = one(spark, *(P.shifted_cfa(F.lit("rggb"), F.lit(x), F.lit(y)) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))))
    assert got == ("rggb", "grbg", "gbrg", "bggr")
    with pytest.raises(Exception, match="unknown arrangement"):
        one(spark, P.cfa_color(F.lit("xtrans"), F.lit(0), F.lit(0)))


def test_log_curve(spark):
    got = one(spark, *(P.log_encode(F.lit(x)) for x in (-0.01, 0.00262409, 0.18, 1.0, 100.0, 150.0)))
    assert got == pytest.approx((-0.104442685, 0.02740670066, 0.336043272385, 0.513837441116, 0.999999987017, 1.042870696099), abs=1e-9)
    back = one(spark, *(P.log_decode(P.log_encode(F.lit(x))) for x in (-0.01, 0.001, 0.18, 1.0, 12.5)))
    assert back == pytest.approx((-0.01, 0.001, 0.18, 1.0, 12.5), abs=1e-9)


def test_dither_and_checksums(spark):
    places = [(0, 0, 0), (0, 0, 1), (17, 1, 5), (19, 2, 123456), (239, 0, 12582911)]
    got = one(spark, *(P.dither(*(F.lit(x) for x in p)) for p in places))
    assert got == (-0.5, 0.28219807809729414, -0.3779919653879239, -0.12372464286545781, -0.46229981187500746)
    assert T.fnv1a_numpy([b"", b"a", b"foobar"]).tolist() == [14695981039346656037, 12638187200555641996, 9625390261332436968]
    df = spark.createDataFrame([(x,) for x in (-7, 0, 1, 2**62, -(2**63))], "x long")
    for r in df.select("x", P.multiply64(F.col("x"), 0x9E3779B185EBCA87).alias("m")).collect():
        assert r.m % 2**64 == r.x * 0x9E3779B185EBCA87 % 2**64


def test_neutral_pack(spark):
    y = P.luma(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    assert one(spark, P.quantize(P.luma_value(y), 64, 940), P.quantize(P.chroma_value(P.blue_difference(y, F.lit(0.5))), 64, 960)) == (502, 512)


def test_rescaling(spark):
    big = lambda x: F.lit(x).cast("long")
    assert one(spark, B.samples_to_ns(big(1), 48000), *(B.ns_to_samples(big(x), 48000) for x in (20833, 20834, 20833333, 20833334)), B.ns_to_samples(big(10417), 48000, nearest=True)) == (20833, 0, 1, 999, 1000, 1)
    with pytest.raises(Exception, match="before the origin"):
        one(spark, B.ns_to_pts(big(-1)))


def chunks(spark, times, n=1024):
    return spark.createDataFrame([(0, i, t, n) for i, t in enumerate(times)], "s int, chunk_index long, ts_ns long, n long")


def test_audio_repair(spark):
    times = (1_000_000_000, 1_021_000_000, 1_043_000_000)
    got = audio.normalized(chunks(spark, times), ["s"], 48000).orderBy("chunk_index").collect()
    assert [r.expected_ns for r in got] == [1_000_000_000, 1_021_333_333, 1_042_666_667]
    d = audio.diagnostics(chunks(spark, times), ["s"], 48000).first()
    assert (d.nominal_ns, d.reasons) == (21_333_333, "")
    d = audio.diagnostics(chunks(spark, (1_000_000_000, 999_999_666)), ["s"], 48000).first()
    assert (d.non_monotonic_steps, d.max_backward_ns, d.reasons) == (1, 334, "source_non_monotonic")
    d = audio.diagnostics(chunks(spark, (5, 5)), ["s"], 48000).first()
    assert (d.non_monotonic_steps, d.max_backward_ns) == (1, 0)
    with pytest.raises(Exception, match="negative"):
        audio.normalized(chunks(spark, (-1,)), ["s"], 48000).collect()


def test_color_solution():
    m, white = color.camera_solution([0.9504559, 1, 1.0890578], [np.eye(3)], ccts=(6504.0, 2856.0))
    assert white[:2] == pytest.approx((0.3127, 0.3290), abs=1e-5) and abs(white[2] - 6504) < 150 and m.shape == (3, 3)
    with pytest.raises(ValueError, match="singular"):
        color.checked_inverse(np.zeros((3, 3)))


@pytest.mark.parametrize("cfa", list(P.CFA))
def test_strips_equal_whole_frames(spark, cfa):
    y, x = np.mgrid[0:96, 0:48]
    raw = (1200 + x * 173 + y * 97 + (x * y * 13) % 4000 + 9000 * ((x // 8 + y // 8) & 1)).astype(np.float32)
    whole = demosaic.rcd(raw, cfa)
    frame = spark.createDataFrame([(1, 48, 96, cfa, raw.ravel().tolist())], "frame long, width int, height int, cfa string, mosaic array<float>")
    rows = demosaic.demosaic(frame, 32).orderBy("own0").collect()
    got = np.stack([np.concatenate([np.array(r[c]) for r in rows]).reshape(96, 48) for c in "rgb"])
    assert np.isfinite(got).all() and np.abs(got - whole).max() <= 0.02
    with pytest.raises(NotImplementedError):
        demosaic.demosaic(frame, method="amaze")


def test_metadata(spark):
    eye = "[1,0,0,0,1,0,0,0,1]"
    c = '{"blackLevel":[64,65,66,67],"whiteLevel":1023,"sensorArrangment":"rggb","colorMatrix1":%s,"colorMatrix2":%s}' % (eye, eye)
    f = '{"width":4,"height":2,"compressionType":7,"asShotNeutral":[0.5,1,0.6]}'
    df = metadata.normalize(spark.createDataFrame([(f, c)], "frame_json string, container_json string"))
    r = df.select("meta", metadata.raw_faults().alias("raw"), metadata.color_faults().alias("color")).first()
    assert (r.meta.illuminant1_cct, r.meta.illuminant2_cct, len(r.meta.warnings), r.raw, r.color) == (6504, 2856, 3, [], [])
    assert r.meta.colorMatrix1.source == "container" and r.meta.black_level == [64, 65, 66, 67]


def test_config():
    c = config.load('{"max_frames": 5} // a comment')
    assert c.max_frames == 5 and c.capture_sharpening == 0.4
    for bad in ('{"nope": 1}', '{"async_depth": 0}', '{"prores_profile": "x"}'):
        with pytest.raises(errors.InvalidArgument):
            config.load(bad)


def test_container_round_trip(spark, tmp_path):
    files.write_container(str(tmp_path / "a.lfc"), [(30, b"three"), (10, b"one"), (20, b"two")])
    got = files.frames(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert [(r.frame_index, r.timestamp_ns, bytes(r.payload)) for r in got] == [(0, 10, b"one"), (1, 20, b"two"), (2, 30, b"three")]
    with pytest.raises(ValueError, match="strictly"):
        files.write_container(str(tmp_path / "b.lfc"), [(1, b"x"), (1, b"y")])
        files.parse_index((tmp_path / "b.lfc").read_bytes())
    assert files.pfm_bytes(np.arange(12).reshape(2, 2, 3)).startswith(b"PF\n2 2\n-1.0\n")
    df = spark.range(10)
    assert files.publish(df, str(tmp_path / "out")) == 10
    with pytest.raises(Exception):
        files.publish(df, str(tmp_path / "out"))


def test_streams_equal_batch(spark, tmp_path):
    from lumaframe.streaming.stateful import resequence, resequenced_prefix

    rows = [(1, s, f"p{s}") for s in (2, 0, 1, 4, 3, 7)] + [(2, s, f"q{s}") for s in (1, 0)]
    packets = spark.createDataFrame(rows, "container long, seq long, payload string")
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = resequence(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("reseq").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("reseq").collect())) == sorted(map(tuple, resequenced_prefix(packets).collect()))


def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    norm = lambda v: None if v is None else round(float(v), 9) if isinstance(v, (int, float)) and not (isinstance(v, float) and math.isnan(v)) else str(v)
    for name in ("stage_timing_summary", "audio_timing", "pack_clip_counts", "audio_crop", "metadata_fallback", "dither_noise", "matrix_inverse_validate", "chroma_422_quality"):
        df = entry.queries()[name](spark, SMALL)
        columns = sorted(df.columns)
        a = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=repr)
        b = sorted((tuple(map(norm, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()), key=repr)
        assert a == b, name


def test_result_is_free_of_partitioning(spark):
    from lumaframe.config import Config
    from lumaframe.plans import bindings, picture

    planes = bindings.planes(spark, SMALL)
    codes = lambda n: sorted(map(tuple, picture.pack(planes.repartition(n), Config(), 8, 8).select("frame", "y", "cb", "cr").collect()))
    assert codes(1) == codes(7)


def test_fused_pack_is_within_one_code(spark):
    """Both packs over all policies, filters, dither and sharpening; the single-precision one raises where the chain does."""
    import itertools

    from lumaframe import commands
    from lumaframe.config import Config

    rng = np.random.default_rng(7)
    rows = [(f, *(rng.uniform(0.0, 1.5, 12 * 6).tolist() for _ in range(3))) for f in range(3)]
    planes = spark.createDataFrame(rows, "frame long, r array<double>, g array<double>, b array<double>")
    for policy, chroma, dither, amount in itertools.product(("preserve_by_curve", "clamp_to_zero"), ("fast", "quality"), (True, False), (0.0, 0.8)):
        config = Config(negative_policy=policy, chroma_filter=chroma, deterministic_dither=dither, capture_sharpening=amount, exposure_offset_stops=0.5)
        got = commands.validate(planes, config, 12, 6).first()
        assert got["compared"] == 3 * (72 + 2 * 36) and got["missing"] == 0 and got["max_abs_diff"] <= 1, (policy, chroma, dither, amount)
    bad = spark.createDataFrame([(0, [-1.0] * 72, [-1.0] * 72, [-1.0] * 72)], planes.schema)
    for function in (picture_pack, fused_pack):
        with pytest.raises(Exception, match="negative"):
            function(bad, Config(negative_policy="error"))
        with pytest.raises(Exception, match="finite"):
            function(spark.createDataFrame([(0, [float("nan")] * 72, [1.0] * 72, [1.0] * 72)], planes.schema), Config())


def picture_pack(planes, config):
    from lumaframe.plans import picture

    return picture.pack(planes, config, 12, 6).collect()


def fused_pack(planes, config):
    from lumaframe.plans import picture

    return picture.pack_fused(planes, config, 12, 6).collect()


def test_config_ranges():
    from lumaframe.config import load
    from lumaframe.errors import InvalidArgument

    assert load('{"capture_sharpening": 1.5, "capture_sharpening_threshold": 0.1}').capture_sharpening == 1.5
    for text in ('{"capture_sharpening": 2.1}', '{"capture_sharpening_threshold": 0.2}', '{"capture_sharpening": -0.1}', '{"async_depth": 0}'):
        with pytest.raises(InvalidArgument):
            load(text)


def test_due_frame_is_the_first_in_time(spark):
    from lumaframe.operators.merge import due_frame

    chunks = spark.createDataFrame([(1, 10, 0), (1, 25, 1), (1, 31, 2)], "k long, ts long, chunk_index long")
    frames = spark.createDataFrame([(1, 20, 5), (1, 30, 2)], "k long, ts long, frame_index long")
    assert [r.due for r in due_frame(chunks, frames, ["k"]).orderBy("ts").collect()] == [5, 2, None]


def test_metadata_null_key_stops_the_fallback(spark):
    from lumaframe.operators import metadata

    ones = str([1.0, 0, 0, 0, 1, 0, 0, 0, 1])
    rows = [('{"sensorArrangement": "rggb", "colorMatrix1": null}', f'{{"colorMatrix1": {ones}}}'), ('{"sensorArrangement": "rggb"}', f'{{"colorMatrix1": {ones}}}')]
    got = metadata.normalize(spark.createDataFrame(rows, "frame_json string, container_json string")).withColumn("faults", metadata.raw_faults()).collect()
    assert got[0]["meta"]["colorMatrix1"] is None and got[1]["meta"]["colorMatrix1"]["source"] == "container"
    assert set(got[0]["faults"]) == {"dimensions", "compression"}
    with pytest.raises(Exception, match="nine"):
        metadata.normalize(spark.createDataFrame([('{"sensorArrangement": "rggb", "colorMatrix1": [1, 2]}', "{}")], "frame_json string, container_json string")).collect()


def test_publish_keeps_the_old_table_on_failure(spark, tmp_path):
    from lumaframe.sources.files import publish

    path = f"file://{tmp_path}/out"
    assert publish(spark.range(10), path) == 10
    with pytest.raises(Exception, match="exists"):
        publish(spark.range(5), path)
    with pytest.raises(Exception):
        publish(spark.range(5).selectExpr("id", "raise_error('no') as x"), path, overwrite=True)
    assert spark.read.parquet(path).count() == 10
    assert publish(spark.range(7), path, overwrite=True, order=["id"]) == 7 and spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_devices_and_commands(spark):
    from lumaframe import commands
    from lumaframe.config import Config
    from lumaframe.errors import InvalidArgument, UnsupportedFormat
    from lumaframe.operators.devices import satisfied, select_device

    rows = [(0, "Soft", "cpu", "00", 1, 2, True, True), (1, "Big One", "discrete", "ab12", 4318, 9476, False, True), (2, "Small", "integrated", "cd34", 32902, 1, False, True), (3, "Mute", "discrete", "ef", 7, 7, False, False)]
    devices = spark.createDataFrame(rows, "index int, name string, type string, uuid string, vendor long, device long, software boolean, compute boolean")
    for selector, want in (("auto", 1), ("2", 2), ("uuid:CD-34", 2), ("pci:10de:2504", 1), ("small", 2), ("big", 1)):
        assert select_device(devices, selector).first()["index"] == want
    for selector, error in (("", InvalidArgument), ("9", InvalidArgument), ("uuid:99", InvalidArgument), ("pci:zz", InvalidArgument), ("nothing", InvalidArgument), ("mute", UnsupportedFormat)):
        with pytest.raises(error):
            select_device(devices, selector)
    assert dict(commands.config_df(spark, Config()).collect())["demosaic"] == '"rcd"'
    assert commands.capabilities(spark).where("available and kind = 'stage'").count() == 5
    assert satisfied(spark.range(2), spark.range(3)) and not satisfied(spark.range(4), spark.range(3))
    frames = spark.createDataFrame([(0, 5), (1, 9)], "frame_index long, timestamp_ns long")
    assert commands.frame(frames, 1).first()["timestamp_ns"] == 9 and commands.inspect(frames).first()["max_step_ns"] == 4
    with pytest.raises(InvalidArgument):
        commands.frame(frames, 2)
    assert set(commands.benchmark(lambda: spark.range(3), 2)) == {"least", "median", "most"}


def test_array_checks(spark):
    from lumaframe.functions import arrays

    one = lambda column, **values: spark.range(1).select(column).first()[0]
    lit = lambda *x: F.array(*map(F.lit, x))
    assert one(arrays.vector3(lit(1.0, 2.0, 3.0))) == [1, 2, 3] and one(arrays.checked_number(F.lit("42"))) == 42
    assert one(arrays.unpack16(lit(0x00020001))) == [1, 2] and one(arrays.cropped(lit(1, 2, 3), F.lit(5))) == [1, 2, 3]
    assert one(arrays.samples_per_channel(F.lit(6), F.lit(2))) == 3
    for bad in (arrays.vector3(lit(1.0, 0.0, 3.0)), arrays.matrix9(lit(1.0)), arrays.checked_number(F.lit("4x")), arrays.samples_per_channel(F.lit(0), F.lit(2)), arrays.samples_per_channel(F.lit(5), F.lit(2))):
        with pytest.raises(Exception, match="invalid"):
            one(bad)
