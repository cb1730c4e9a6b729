"""Round trips of file formats and of streams."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from markerflow.sources import c3d, files
from markerflow.streaming import gate


def cube(n=30, m=5, seed=0):
    p = np.random.default_rng(seed).normal(size=(n, m, 3)) * 1000
    if m > 2:
        p[3, 2] = np.nan
    return p


def test_c3d_roundtrip():
    rec = c3d.read(c3d.write(cube(), ["A", "BB", "C", "D", "*4"], 120.0))
    assert np.allclose(rec.points[..., :3], cube(), atol=1e-3, equal_nan=True)
    assert (rec.labels, rec.rate, rec.unit) == (["A", "BB", "C", "D", "*4"], 120.0, "mm")


def test_integer_and_other_processors():
    data = bytearray(c3d.write(cube(4, 2), ["A", "B"], 50.0))
    start = (data[16] + 256 * data[17] - 1) * 512
    ints = np.zeros((4, 2, 4), "<i2")
    ints[..., :3] = np.arange(24).reshape(4, 2, 3)
    ints[1, 1, 3] = -1
    data[12:16] = np.array([0.5], "<f4").tobytes()
    rec = c3d.read(bytes(data[:start]) + ints.tobytes())
    want = np.arange(24).reshape(4, 2, 3) * 0.5
    want[1, 1] = np.nan
    assert np.allclose(rec.points[..., :3], want, equal_nan=True)
    values = np.array([1.0, -2.5, 1000.25], "<f4")
    dec = np.ascontiguousarray((values * 4).view("<u2").reshape(-1, 2)[:, ::-1]).tobytes()
    assert np.allclose(c3d.dec_floats(dec), values)
    with pytest.raises(ValueError):
        c3d.read(b"\0" * 600)


def test_files_through_spark(spark, tmp_path):
    rows = [("s", f, m, "ABCDE"[m] if m < 4 else None, *(float(v) if v == v else None for v in cube()[f, m] / 1000), 100.0) for f in range(30) for m in range(5)]
    df = spark.createDataFrame(rows, "seq_id string, frame int, marker_idx int, label string, x double, y double, z double, frame_rate double")
    saved = files.save_files(c3d.c3d_files(df), str(tmp_path), ".c3d").collect()
    assert [r.written for r in saved] == [True]
    assert [r.written for r in files.save_files(c3d.c3d_files(df), str(tmp_path), ".c3d").collect()] == [False]
    np.savez(tmp_path / "t.npz", markers=cube(), labels=np.array(["A"]), frame_rate=60.0)
    np.save(tmp_path / "u.npy", cube(7, 2))
    got = files.read_markers(spark, str(tmp_path))
    per = {os.path.basename(r.path): (r.n, r.missing, r.labels) for r in got.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("x").isNull().cast("int")).alias("missing"), F.array_sort(F.collect_set("label")).alias("labels")).collect()}
    assert per == {"s.c3d": (150, 1, ["*4", "A", "B", "C", "D"]), "t.npz": (150, 1, ["*0", "*1", "*2", "*3", "A"]), "u.npy": (14, 0, ["0", "1"])}
    back = got.where(F.col("path").endswith(".c3d")).join(df.select("frame", "marker_idx", F.col("x").alias("x0")), ["frame", "marker_idx"])
    assert back.where("abs(x / 1000 - x0) > 1e-5 or (x is null) != (x0 is null)").count() == 0


@pytest.mark.parametrize("half, suffix", [(False, ".pc2"), (True, ".pc16")])
def test_vertex_cache(spark, tmp_path, half, suffix):
    v = np.random.default_rng(1).normal(size=(6, 4, 3)).astype("f4")
    (tmp_path / f"m{suffix}").write_bytes(files.write_pc2(v, half=half))
    rows = files.read_vertex_caches(spark, str(tmp_path)).orderBy("frame").collect()
    assert np.allclose([r.vertices for r in rows], v.reshape(6, -1), atol=2e-3 if half else 0)


def with_analog(n=40, m=2, channels=3, samples=2):
    """A file of integers with analog channels and two events, put together by hand, and its analog values."""
    data = bytearray(c3d.write(np.zeros((n, m, 3)), ["A", "B"], 50.0))
    at = (data[0] - 1) * 512
    end = data[:at + data[at + 2] * 512].rstrip(b"\0")
    group = bytes([6, 256 - 2]) + b"ANALOG" + (3).to_bytes(2, "little") + b"\0"
    extra = [("LABELS", -1, [2, channels], b"c0c1c2"), ("SCALE", 4, [channels], np.array([1, 2, 3], "<f4").tobytes()), ("OFFSET", 2, [channels], np.array([0, 0, 5], "<i2").tobytes())]
    params = bytes(end) + b"\0" * (-len(end) % 1) + b"\0"
    params += group + b"".join(c3d._parameter(2, *e) for e in extra) + c3d._parameter(2, "GEN_SCALE", 4, [], np.array([0.5], "<f4").tobytes())
    blocks = -(-(len(params) - at) // 512)
    params = bytearray(params.ljust(at + blocks * 512, b"\0"))
    params[at + 2] = blocks
    params[4:6] = (channels * samples).to_bytes(2, "little")
    params[12:16] = np.array([0.5], "<f4").tobytes()
    params[16:20] = (len(params) // 512 + 1).to_bytes(2, "little") + samples.to_bytes(2, "little")
    params[300:302] = (2).to_bytes(2, "little")
    params[304:312], params[376:378], params[396:404] = np.array([0.25, 1.5], "<f4").tobytes(), b"\1\0", b"HEELTOE "
    body = np.zeros((n, m * 4 + channels * samples), "<i2")
    body[:, m * 4 :] = np.arange(n * channels * samples).reshape(n, -1)
    values = (body[:, m * 4 :].reshape(n, samples, channels) - [0, 0, 5]) * np.array([1, 2, 3]) * 0.5
    return bytes(params) + body.tobytes(), values


def test_analog_and_events(spark, tmp_path):
    data, values = with_analog()
    (tmp_path / "a.c3d").write_bytes(data)
    got = {(r.frame, r["sample"], r.channel): (r.label, r.value) for r in c3d.read_analog(spark, str(tmp_path), range_frames=7).collect()}
    assert got == {(f, s, c): (f"c{c}", values[f, s, c]) for f in range(40) for s in range(2) for c in range(3)}
    events = sorted((r.event, r.seconds, r.shown, r.label) for r in c3d.read_events(spark, str(tmp_path)).collect())
    assert events == [(0, 0.25, True, "HEEL"), (1, 1.5, False, "TOE")]


def test_ranges_of_frames_give_the_same_rows(spark, tmp_path):
    (tmp_path / "b c.c3d").write_bytes(c3d.write(cube(), ["A", "B", "C", "D", "E"], 100.0))
    read = lambda **kw: sorted(map(repr, c3d.read_c3d(spark, str(tmp_path), **kw).collect()))
    whole = read()
    assert len(whole) == 150 and read(range_frames=7) == whole
    assert read(frames=(5, 9), range_frames=7) == sorted(map(repr, c3d.read_c3d(spark, str(tmp_path)).where("frame between 5 and 8").collect()))
    v = np.random.default_rng(2).normal(size=(30, 4, 3)).astype("f4")
    (tmp_path / "m.pc2").write_bytes(files.appended_pc2(files.write_pc2(v[:20], start=10.0), v[20:]))
    cache = lambda **kw: [(r.frame, tuple(r.vertices)) for r in files.read_vertex_caches(spark, str(tmp_path), **kw).orderBy("frame").collect()]
    assert cache() == cache(range_samples=4) == [(10 + i, tuple(map(float, v[i].ravel()))) for i in range(30)]
    assert cache(frames=(15, 32), range_samples=4) == cache()[5:22]
    with pytest.raises(ValueError):
        files.appended_pc2(files.write_pc2(v), v[:, :2])


def test_arrays_become_recordings(spark, tmp_path):
    for name in ("u", "u_racket"):
        np.save(tmp_path / f"{name}.npy", cube(7, 2) / 1000)
    out = tmp_path / "out"
    out.mkdir()
    assert [(r.path, r.written) for r in files.arrays_to_c3d(spark, str(tmp_path), str(out)).collect()] == [(f"{out}/u.c3d", True)]
    assert [r.written for r in files.arrays_to_c3d(spark, str(tmp_path), str(out)).collect()] == [False]
    rec = c3d.read((out / "u.c3d").read_bytes())
    assert (rec.labels, rec.rate) == (["0", "1"], 30.0) and np.allclose(rec.points[..., :3], cube(7, 2), atol=1e-3)


def test_obj(spark, tmp_path):
    vertices = spark.createDataFrame([(0, 0.0, 0.5, 1.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid int, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "face int, v0 int, v1 int, v2 int")
    files.obj_lines(vertices, faces).coalesce(1).write.text(str(tmp_path / "o"))
    v, f = files.read_obj(spark, str(tmp_path / "o"))
    assert sorted(map(tuple, v.drop("path").collect())) == sorted(map(tuple, vertices.collect())) and list(map(tuple, f.drop("path").collect())) == [(0, 0, 1, 2)]
    files.obj_lines(vertices, faces).coalesce(1).write.mode("append").text(str(tmp_path / "o"))
    v, f = files.read_obj(spark, str(tmp_path / "o"))
    assert v.groupBy("path").count().count() == 2 and v.groupBy("vid").count().where("count != 2").count() == 0
    digests = files.file_digests(spark, str(tmp_path / "o"), "*.txt").collect()
    assert len(digests) == 2 and len({r.sha256 for r in digests}) == 1 and all(len(r.sha256) == 64 for r in digests)
    assert files.discovered(spark, str(tmp_path), "*.txt", ["/o/"]).count() == 2 and files.discovered(spark, str(tmp_path), "*.txt", ["/none/"]).count() == 0


def test_gate_rule():
    df = pd.DataFrame({"seq_id": "s", "frame": range(5), "value": [0.0, 1.0, 1.3, 5.0, 6.0]})
    whole, _ = gate.route_frames(df, None, 0.2, 0.25)
    first, last = gate.route_frames(df[:2], None, 0.2, 0.25)
    rest, _ = gate.route_frames(df[2:], last, 0.2, 0.25)
    assert [r[3] for r in whole] == ["exact", "exact", "fast", "exact", "fast"] and whole == first + rest
    again, same = gate.route_frames(df[1:3], last, 0.2, 0.25)
    assert [r[3] for r in again] == ["late", "fast"] and same == (1.3, 1.0, 2)


def test_streams(spark, tmp_path):
    rows = [("s", f, m, 1.0, 1.0, float(f) if m else 0.0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=f)) for f in range(30) for m in range(2)]
    df = spark.createDataFrame(rows + rows[:6], "seq_id string, frame int, marker_idx int, x double, y double, z double, ingested_at timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = gate.availability_stream(stream).writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.n_seen) for r in spark.table("seen").orderBy("window_start").collect()] == [(48, 48), (12, 12)]
    frames = stream.where("marker_idx = 1").select("seq_id", "frame", F.col("z").alias("value"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a timeout makes batches without data go on for ever
    q = gate.gate_stream(frames.dropDuplicates(["seq_id", "frame"]), 0.8).writeStream.format("memory").queryName("gate").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [r.route for r in spark.table("gate").orderBy("frame").collect()] == ["exact"] * 2 + ["fast"] * 28
