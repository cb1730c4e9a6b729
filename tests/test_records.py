"""Delivered and released records, layouts cut down, and jobs, worked out by hand."""

import json

import pytest

from markerflow.operators import layouts, records


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_records_of_both_forms_and_of_none(spark):
    newer = {"fullpose": [[0.0], [1.0]], "trans": [[0.0]], "stageii_debug_details": {"cfg": {"surface_model": {"gender": "male", "type": "smplx"}}, "mocap_frame_rate": "120"}}
    older = {"pose_est_fullposes": [[0.0]], "pose_est_trans": [[0.0]], "ps": {"fitting_model": "smplh"}, "mocap_framerate": 60, "mocap_timelength": 7, "shape_est_betas": [1.0, 2.0]}
    texts = [(1, json.dumps(newer)), (2, json.dumps(older)), (3, '{"fullpose": [[0.0'), (4, "[1]"), (5, None), (6, ""), (7, "{}"), (8, '{"fullpose": null, "trans": 5}')]
    df = records.normalized_records(spark.createDataFrame(texts, "raw_id bigint, payload string"))
    assert rows(df, "raw_id", "form", "gender", "model", "rate", "n_frames", "n_poses", "n_trans", "n_betas", "fault") == [
        (1, "newer", "male", "smplx", 120.0, 2, 2, 1, None, "frames"),
        (2, "older", "unknown", "smplh", 60.0, 7, 1, 1, 2, None),
        *[(i, None, "unknown", "unknown", 0.0, None, None, None, None, "unreadable") for i in (3, 4, 5, 6)],
        *[(i, None, "unknown", "unknown", 0.0, None, None, None, None, "no poses") for i in (7, 8)],
    ]


def test_released_rows_are_written_once(spark, tmp_path):
    poses = spark.createDataFrame([("a", 0, [float(i) for i in range(165)], [1.0, 2.0, 3.0]), ("b", 0, [0.5] * 72, None), ("c", 0, None, None)], "seq_id string, frame int, fullpose array<double>, trans array<double>")
    frames = records.released_frames(poses)
    a, b = sorted(frames.collect(), key=lambda r: r.seq_id)
    assert (a.pose_body[0], len(a.pose_body), a.pose_jaw, a.pose_eye[0], len(a.pose_eye), a.pose_hand[0], len(a.pose_hand)) == (3.0, 63, [66.0, 67.0, 68.0], 69.0, 6, 75.0, 90)
    assert len(b.pose_body) == 63 and (b.pose_jaw, b.pose_eye, b.pose_hand, b.trans) == (None,) * 4
    folder = str(tmp_path / "released")
    records.write_absent(frames.where("seq_id = 'a'"), folder)
    for _ in range(2):
        records.write_absent(frames, folder)
        assert rows(spark.read.parquet(folder), "seq_id") == [("a",), ("b",)]
    samples = spark.createDataFrame([("a", "male", "smplx", 100.0, 5, None, ["X", "Y", "X", None], [1.0, 2.0, 3.0]), ("b", None, None, None, None, None, None, None)],
                                    "seq_id string, gender string, surface_model_type string, mocap_frame_rate double, mocap_time_length int, markers_latent array<array<double>>, latent_labels array<string>, betas array<double>")
    heads = records.released_heads(samples, spark.createDataFrame([("X", 9), ("X", 4), ("Y", None)], "label string, vid int"), 2)
    assert rows(heads, "seq_id", "markers_latent_vids", "betas", "num_betas") == [("a", {"X": 4}, [1.0, 2.0], 2), ("b", None, None, None)]


def test_genders_from_settings(spark):
    takes = spark.createDataFrame([("1", "f", "s1"), ("2", "f", "s2"), ("3", "g", "s1"), ("4", "g", None), ("5", "h", "s1")], "seq_id string, folder string, subject string")
    settings = spark.createDataFrame([("f", '{"s1": {"gender": "female"}}'), ("g", '{"gender": "male"}'), ("g", '{"gender": "male"}'), ("h", "broken")], "folder string, text string")
    assert rows(records.resolved_genders(takes, settings, "neutral"), "seq_id", "gender") == [("1", "female"), ("2", "neutral"), ("3", "male"), ("4", "male"), ("5", "neutral")]
    with pytest.raises(Exception, match="no gender for s2"):
        records.resolved_genders(takes, settings).collect()


def test_jobs_wait_for_the_first_of_their_subject(spark):
    jobs = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t"), ("d", "t"), ("e", "t"), ("f", None), ("g", None)], "seq_id string, subject string")
    done = spark.createDataFrame([("d",), ("d",)], "seq_id string")
    assert rows(records.stage_jobs(jobs, done, "seq_id", "subject"), "seq_id") == [("a",), ("c",), ("e",), ("f",)]
    assert rows(records.stage_jobs(jobs, done.limit(0), "seq_id", "subject"), "seq_id") == [("a",), ("c",), ("f",)]


def test_layout_filters(spark):
    layout = spark.createDataFrame([("l", "body", "a", 1), ("l", "body", "B", 2), ("l", "hand", "C", 3), ("m", None, "D", None)], "layout_id string, marker_type string, label string, vid int")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "label string")
    aliases = spark.createDataFrame([("a", "A"), ("a", "Z"), ("q", "B")], "label string, new_label string")
    assert rows(layouts.filtered_layout(layout, ["hand"], names("B"), None, aliases, True), "layout_id", "label", "vid") == [("l", "A", 1), ("l", "nan", None), ("m", "D", None), ("m", "nan", None)]
    assert rows(layouts.filtered_layout(layout, only_labels=names("B", "C", "C")), "label") == [("B",), ("C",)]
    solved = spark.createDataFrame([("B", 9), ("D", None)], "label string, vid int")
    assert rows(layouts.solved_layout(layout, solved), "label", "vid") == [("B", 9), ("C", 3), ("D", None), ("a", 1)]


def test_sources_of_splits(spark):
    samples = spark.createDataFrame([("1", "x", "male", [1.0, 2.0]), ("2", "x", "female", [3.0]), ("3", "y", "male", None)], "seq_id string, dataset string, gender string, betas array<double>")
    splits = spark.createDataFrame([("train", "x"), ("vald", "x"), ("vald", "y"), ("vald", "y"), ("test", "z")], "split string, dataset string")
    assert rows(records.populate_sources(samples, splits, "male", 1), "split", "seq_id", "betas") == [("train", "1", [1.0]), ("vald", "1", [1.0]), ("vald", "3", None)]
