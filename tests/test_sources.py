"""Containers, their sound and manifests."""

import hashlib
import json

import numpy as np
import pytest

from lumaframe import errors
from lumaframe.operators import audio
from lumaframe.sources import files


def _write(folder, name="a.lfc", **more):
    files.write_container(str(folder / name), [(30, b"three"), (10, b"one"), (20, b"two")], **more)


def test_frames_by_index(spark, tmp_path):
    _write(tmp_path, "with space.lfc")
    _write(tmp_path, "b.lfc")
    assert sorted(r["payload"] for r in files.frames(spark, str(tmp_path)).collect()) == [b"one", b"one", b"three", b"three", b"two", b"two"]
    assert [(r["timestamp_ns"], bytes(r["payload"])) for r in files.frame_at(spark, str(tmp_path), 2).collect()] == [(30, b"three")] * 2
    for wrong in (3, -1):
        with pytest.raises(errors.InvalidArgument):
            files.frame_at(spark, str(tmp_path), wrong)
    assert "content" not in files.index(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_sound(spark, tmp_path):
    chunks = [(-5, np.array([1, -1, 2, -2])), (1_000, np.array([32767, -32768])), (900, np.arange(6))]
    _write(tmp_path, sound=(48_000, 2, chunks))
    _write(tmp_path, "silent.lfc")
    got = files.sound(spark, str(tmp_path)).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["ts_ns"], r["n"], r["samples"]) for r in got] == [(i, t, len(s) // 2, s.tolist()) for i, (t, s) in enumerate(chunks)]
    assert {(r["rate"], r["channels"]) for r in got} == {(48_000, 2)} and all(r["path"].endswith("a.lfc") for r in got)
    _write(tmp_path / "..", "later.lfc", sound=(48_000, 1, [(10, np.arange(480)), (5, np.arange(480))]))
    found = audio.diagnostics(files.sound(spark, str(tmp_path / ".." / "later.lfc")), ["path"], 48_000).first()
    assert (found["chunks"], found["non_monotonic_steps"], found["max_backward_ns"]) == (2, 1, 5)


@pytest.mark.parametrize("sound", [(48_000, 2, [(0, np.arange(3))]), (48_000, 2, [(0, np.arange(0))]), (0, 2, [])])
def test_bad_sound_raises(tmp_path, sound):
    _write(tmp_path, sound=sound)
    raw = (tmp_path / "a.lfc").read_bytes()
    with (tmp_path / "a.lfc").open("rb") as f, pytest.raises((errors.InvalidContainer, errors.InvalidMetadata)):
        list(files.read_sound(f, len(raw)))


def test_damaged_containers_raise(tmp_path):
    _write(tmp_path)
    raw = (tmp_path / "a.lfc").read_bytes()
    for bad in (b"", raw[:10], b"X" + raw[1:], raw[:-1], raw + b"x"):
        with pytest.raises(errors.InvalidContainer):
            files.parse_index(bad)


def test_manifest(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for name, content in (("good", b"12345"), ("short", b"1"), ("changed", b"54321")):
        (tmp_path / "data" / name).write_bytes(content)
    entry = lambda name: {"name": name, "bytes": 5, "sha256": hashlib.sha256(b"12345").hexdigest(), "frames": 1}
    (tmp_path / "m.json").write_text(json.dumps({"files": [entry(n) for n in ("good", "short", "changed", "gone")]}, indent=1))
    listed = files.manifest(spark, str(tmp_path / "m.json"))
    assert {tuple(r) for r in files.differing_files(spark, listed, str(tmp_path / "data")).collect()} == {("short", "size"), ("changed", "sha256"), ("gone", "missing")}
    (tmp_path / "bad.json").write_text(json.dumps({"files": [{"name": "x"}]}))
    with pytest.raises(Exception, match="invalid_metadata"):
        files.manifest(spark, str(tmp_path / "bad.json")).collect()
