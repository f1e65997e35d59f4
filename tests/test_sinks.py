"""Streams to sinks, clocks, files of frames, reports and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe import __main__ as cli
from lumaframe import commands, errors
from lumaframe.config import Config
from lumaframe.sources import files, sinks
from lumaframe.streaming import stateful


def _parts(spark, tmp_path, rows, schema, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_drain_publishes_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(9)], "x long")
    folder = _parts(spark, tmp_path, [(i,) for i in range(9)], "x long", 3)
    stream = sinks.packets_from(spark, folder, df.schema, 1)
    assert sinks.drain(stream, sinks.ParquetSink(spark, str(tmp_path / "out"), df.schema), str(tmp_path / "c1")) == 9
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["x"] for r in out.collect()) == list(range(9)) and out.select("trigger").distinct().count() == 3
    with pytest.raises(errors.IoFailed):
        sinks.ParquetSink(spark, str(tmp_path / "out"), df.schema)
    broken = stream.select(F.when(F.col("x") == 8, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("x")).alias("x"))
    for bad in (broken, stream.select(F.col("x").cast("string"))):
        with pytest.raises(Exception, match="broken|kind of rows"):
            sinks.drain(bad, sinks.ParquetSink(spark, str(tmp_path / "bad"), df.schema), str(tmp_path / f"c{bad.schema[0].dataType.simpleString()}"))
        assert not (tmp_path / "bad").exists() and not (tmp_path / "bad.partial").exists()


def test_what_still_waits(spark, tmp_path):
    rows = [(1, s, "p") for s in (0, 1, 3, 5)] + [(2, s, "q") for s in (1, 0)]
    folder = _parts(spark, tmp_path, rows, "container long, seq long, payload string", 2)
    schema = spark.read.parquet(folder).schema
    query = stateful.resequence(sinks.packets_from(spark, folder, schema, 1)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in stateful.still_waiting(spark, str(tmp_path / "cp")).collect()] == [(1, 2, 2)]
    assert sum(p["rows"] for p in stateful.progress(query)) == 6


def test_sample_clock(spark, tmp_path):
    rows = [(s, i, 1_000_000_000 + 7 + (99 if i else 0), 480 + i) for s in (1, 2) for i in (3, 0, 2, 1)]
    schema = "stream long, chunk_index long, ts_ns long, n long"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stateful.sample_clock(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 48_000, 500_000_000).writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((s, i, 24_000 + sum(480 + k for k in range(i))) for s in (1, 2) for i in range(4))
    assert sorted(map(tuple, spark.table("clock").collect())) == want == sorted(map(tuple, stateful.sample_clock_batch(df, 48_000, 500_000_000).collect()))
    for bad, origin in ((df.where("chunk_index <> 2"), 0), (df, 2_000_000_000)):
        with pytest.raises(Exception, match="invalid_metadata"):
            stateful.sample_clock_batch(bad, 48_000, origin).collect()


def test_dump(spark, tmp_path):
    planes = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0], [5.0] * 4, [6.0] * 4)], "frame long, r array<double>, g array<double>, b array<double>")
    assert [tuple(r) for r in commands.dump(planes, 2, 2, str(tmp_path / "x y")).collect()] == [("frame-00000007.pfm", 12 + 48)]
    body = np.frombuffer((tmp_path / "x y" / "frame-00000007.pfm").read_bytes()[-48:], "<f4").reshape(2, 2, 3)
    assert body[::-1, :, 0].ravel().tolist() == [1, 2, 3, 4] and (body[..., 1] == 5).all()
    codes = spark.createDataFrame([(7, [64, 940, 65, 66], [512, 513], [514, 515])], "frame long, y array<int>, cb array<int>, cr array<int>")
    commands.dump(codes, 2, 2, str(tmp_path)).collect()
    assert np.frombuffer((tmp_path / "frame-00000007.yuv").read_bytes(), "<u2").tolist() == [64, 940, 65, 66, 512, 513, 514, 515]
    assert len(list(tmp_path.iterdir())) == 2


def test_raw_mosaic(spark, tmp_path):
    values = np.arange(6 * 100, dtype="<u2")
    (tmp_path / "m.raw").write_bytes(values.tobytes())
    spark.dataSource.register(files.RawMosaic)
    df = spark.read.format("raw_u16le").options(width=6, height=100).load(str(tmp_path / "m.raw"))
    assert [v for r in df.orderBy("y").collect() for v in r["values"]] == values.tolist()


def test_sidecar_and_rows(spark):
    frames = spark.createDataFrame([(0,), (40,), (70,)], "timestamp_ns long")
    sound = spark.createDataFrame([("a", 3)], "stream string, chunks int")
    got = json.loads(commands.sidecar(frames, Config(), sound, {"resident": 1, "uploads": 0}).first()[0])
    assert got["video"] == {"frames": 3, "first_ns": 0, "last_ns": 70, "min_step_ns": 30, "max_step_ns": 40}
    assert got["audio"] == [{"stream": "a", "chunks": 3}] and got["configuration"]["demosaic"] == "rcd"
    with pytest.raises(errors.ProcessingFailed):
        commands.sidecar(frames, Config(), None, {"resident": 1, "readbacks": 2})
    assert [tuple(r) for r in commands.benchmark_rows(spark, "pack", {"least": 2.0}, 4, 500_000).collect()] == [("pack", "least", 2.0, 2.0, 1.0)]


def test_command_line(spark, tmp_path, capsys):
    files.write_container(str(tmp_path / "a.lfc"), [(30, b"three"), (10, b"one")])
    assert cli.main(["inspect", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["frames"] == 2
    assert cli.main(["frame", str(tmp_path), "1"]) == 0 and json.loads(capsys.readouterr().out)["timestamp_ns"] == 30
    for wrong in ("2", "1x", "-1"):
        with_dash = ["frame", "--", str(tmp_path), wrong]
        assert cli.main(with_dash) == 1 and json.loads(capsys.readouterr().err)["code"] == "invalid_argument"
    (tmp_path / "c.json").write_text('{"cpu_threads": 999}')
    assert cli.main(["config", str(tmp_path / "c.json")]) == 1 and json.loads(capsys.readouterr().err)["code"] == "invalid_argument"
    assert cli.main(["capabilities"]) == 0 and "rcd" in capsys.readouterr().out
