"""Spikes, schema drift and units on small fixtures."""

import json

import numpy as np
import pytest

from markerflow.quality import drift, spikes, units

POINTS = "seq_id string, frame int, marker_idx int, label string, x double, y double, z double"
SESSIONS = "seq_id string, rig string, frame_rate double, unit string, note string"


def take(n=120, markers=4, seed=0, seq="s", unit=1000.0, clash=False):
    """A walking take in millimetres with noise of a millimetre."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    heights, names = (1.7, 1.0, 0.5, 0.1), ("BROW", "L_HIP_FRONT", "R_KNEE_IN", "L_ANKLE_OUT")
    out = {}
    for m in range(markers):
        path = np.stack([0.3 * np.sin(t / 25 + m), 0.01 * t, heights[m] + 0.02 * np.sin(t / 9)], 1) * unit
        out[m] = np.round(path + rng.normal(size=path.shape) * 1e-3 * unit, 2)
    return out, names


def as_rows(out, names, seq="s"):
    return [(seq, f, m, names[m], *map(float, p)) for m, path in out.items() for f, p in enumerate(path)]


def found(spark, rows, **kw):
    sessions = spark.createDataFrame([("s", "R", 120.0, None, None)], SESSIONS)
    return {(r.frame, r.marker_idx): r.state for r in spikes.flag_readings(spark.createDataFrame(rows, POINTS), sessions, **kw).collect()}


def test_clean_take_has_no_flags(spark):
    assert found(spark, as_rows(*take())) == {}


def test_spikes_stuck_and_out_of_range(spark):
    out, names = take()
    out[0][40] += (120, 0, 0)
    out[1][60:63] += (0, 90, -60)
    out[2][70:78] = out[2][70] + np.array([0.01, 0, 0]) * (np.arange(8) % 2)[:, None]
    out[3][90] = (-32768, -32768, -32768)
    out[3][100:112, 2] += 9000
    want = {(40, 0): 1, **{(f, 1): 1 for f in (60, 61, 62)}, **{(f, 2): 2 for f in range(71, 78)}, (90, 3): 3, **{(f, 3): 3 for f in range(100, 112)}}
    assert found(spark, as_rows(out, names)) == want
    for block in (64, 200):
        assert found(spark, as_rows(out, names), block_frames=block) == want


def test_shake_of_all_markers(spark):
    out, names = take()
    for m in out:
        out[m][50] += (80, 40, 0)
    assert found(spark, as_rows(out, names)) == {(50, m): 1 for m in out}


def test_missing_and_repeated_readings(spark):
    out, names = take()
    rows = as_rows(out, names)
    rows += rows[:50]
    rows += [("s", 130, 0, None, None, 1.0, 1.0), ("s", 131, 0, None, float("nan"), 1.0, 1.0), ("s", 132, 0, None, 0.0, 0.0, 0.0), (None, 1, 0, None, 1.0, 1.0, 1.0)]
    assert found(spark, rows) == {}
    assert found(spark, []) == {}


def test_five_repeats_are_no_case(spark):
    out, names = take()
    out[2][70:76] = out[2][70]
    assert found(spark, as_rows(out, names)) == {}


def test_forward_backward_agrees_with_enumeration():
    rng = np.random.default_rng(3)
    e = rng.normal(size=(4, 1, 4))
    got, moved = spikes.posterior(e)
    got = got[:, 0]
    total, steps = np.zeros((4, 4)), np.zeros((4, 4))
    for path in np.ndindex(4, 4, 4, 4):
        p = np.exp(spikes.START[path[0]] + sum(e[k, 0, s] for k, s in enumerate(path))) * np.prod([spikes.STEP[a, b] for a, b in zip(path, path[1:])])
        for k, s in enumerate(path):
            total[k, s] += p
            if k:
                steps[path[k - 1], s] += p
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True))
    assert np.allclose(moved, steps / total[0].sum())
    learnt = spikes.learnt_steps(moved)
    assert np.allclose(learnt.sum(axis=1), 1)


def test_impossible_rates(spark):
    rows = [(f"t{i}", "R", 120.0 + 0.01 * i, None, None) for i in range(9)] + [("bad0", "R", 0.0, None, None), ("bad1", "R", 1200.0, None, None), ("bad2", "R", -120.0, None, None), ("none", "R", None, None, None)]
    assert {r.seq_id for r in spikes.impossible_rates(spark.createDataFrame(rows, SESSIONS)).collect()} == {"bad0", "bad1", "bad2"}


def test_conversion_graph():
    way = units.compositions(units.LENGTH_EDGES)
    assert way["in"] == pytest.approx((0.0254, 0)) and way["ft"] == pytest.approx((0.3048, 0)) and way["mm"] == pytest.approx((0.001, 0))
    heat = units.compositions([("F", "C", 5 / 9, -160 / 9), ("C", "K", 1.0, 273.15)], "K")
    assert heat["F"][0] * 212 + heat["F"][1] == pytest.approx(373.15)
    with pytest.raises(ValueError, match="cycle"):
        units.compositions([*units.LENGTH_EDGES, ("ft", "cm", 30.0, 0.0)])


@pytest.mark.parametrize("unit, factor", [("mm", 1000.0), ("cm", 100.0), ("in", 1 / 0.0254), ("ft", 1 / 0.3048), ("m", 1.0)])
def test_true_unit_of_a_take(spark, unit, factor):
    out, names = take(unit=factor)
    points = spark.createDataFrame(as_rows(out, names), POINTS)
    for said in (unit, None, "mm", "n/a"):
        sessions = spark.createDataFrame([("s", "R", 1.0, said, "14 mm marker balls")], SESSIONS)
        assert [r.unit for r in units.marker_units(points, sessions).collect()] == [unit]


def test_unit_from_words_alone(spark):
    points = spark.createDataFrame([("a", 0, 0, None, 0.0, 0.0, 0.0), ("b", 0, 0, None, None, None, None)], POINTS)
    sessions = spark.createDataFrame([("a", "R", 1.0, None, "good take; markers: unit=Zoll; lens 12 mm"), ("b", "R", 1.0, "FT", None)], SESSIONS)
    assert {r.seq_id: r.unit for r in units.marker_units(points, sessions).collect()} == {"a": "in", "b": "ft"}


def test_conversion_of_nested_columns(spark):
    df = spark.createDataFrame([("s", [1000.0, None], [[10.0]]), ("t", [1.0, 2.0], None)], "seq_id string, trans array<double>, m array<array<double>>")
    table = spark.createDataFrame([("s", "mm")], "seq_id string, unit string")
    got = {r.seq_id: (r.trans, r.m) for r in units.convert(df, table, ["trans", "m"]).collect()}
    assert got == {"s": ([1.0, None], [[0.01]]), "t": ([1.0, 2.0], None)}


RAW = "raw_id bigint, stream string, batch_no int, file_path string, payload string, received_at string"


def raw(spark, batches):
    rows, n = [], 0
    for number, records in enumerate(batches, 1):
        for k, record in enumerate(records):
            n += 1
            rows.append((n, "st", number, f"b{number}/{k}", record if isinstance(record, (str, type(None))) else json.dumps(record), None))
    return spark.createDataFrame(rows, RAW)


def changes(df):
    return {(r.batch_no, r.change_kind, r.field_name, r.new_name) for r in drift.schema_changes(df).collect()}


def test_every_kind_of_change(spark):
    rng = np.random.default_rng(4)
    def record(**names):
        base = {"rate": float(rng.integers(50, 200)), "betas": [round(float(v), 3) for v in rng.normal(size=4)], "cfg": {"gender": str(rng.choice(["male", "female"]))}}
        return {names.get(k, k): v for k, v in base.items()}
    first = [record() for _ in range(8)]
    second = [{**record(), "note": "keep"} for _ in range(8)]
    third = [{**record(betas="shape_betas"), "note": "keep"} for _ in range(8)]
    fourth = [{**{k: (str(v) if k == "rate" else v) for k, v in record(betas="shape_betas").items()}} for _ in range(8)]
    moved = [{**{k: (str(v) if k == "rate" else v) for k, v in record(betas="shape_betas").items() if k != "cfg"}, "gender": "male"} for _ in range(8)]
    assert changes(raw(spark, [first, second, third, fourth, moved])) == {
        (2, "added", "note", ""), (3, "renamed", "betas", "shape_betas"), (4, "removed", "note", ""), (4, "retyped", "rate", ""), (5, "renamed", "cfg.gender", "gender"),
    }


def test_unreadable_repeated_and_odd_files(spark):
    good = [{"a": 1.5, "b": "x"} for _ in range(4)]
    odd = [{"a": 1.5, "b": "x"}, {"a": 1.5, "b": "x"}, {"a": 1.5, "b": None}, {"a": 1.5, "b": "x", "tmp": 1}, '{"a": 1', None, "[1]"]
    assert changes(raw(spark, [good, odd])) == set()
    assert changes(spark.createDataFrame([], RAW)) == set()


def test_unified_table(spark):
    rng = np.random.default_rng(5)
    one = [{"betas": [round(float(v), 3) for v in rng.normal(size=4)], "n": int(rng.integers(100, 900))} for _ in range(6)]
    two = [{"shape_betas": [round(float(v), 3) for v in rng.normal(size=4)], "n": str(int(rng.integers(100, 900)))} for _ in range(6)]
    got = drift.unified_table(raw(spark, [one, two, ["{"]]))
    assert got.count() == 12 and len(got.columns) == 6
    assert got.where("n is null or betas is null").count() == 0


def test_unified_records_keep_every_value(spark):
    """Rare and odd fields have columns; what a column can't hold is in `rest`."""
    rng = np.random.default_rng(6)
    betas = lambda: [round(float(v), 3) for v in rng.normal(size=4)]
    one = [{"betas": betas(), "n": int(rng.integers(100, 900)), "flag": True} for _ in range(8)]
    two = [{"shape_betas": betas(), "n": 5, "flag": True} for _ in range(8)]
    one[0] |= {"tmp": {"trace": "x"}, "n": "many"}
    one[1] |= {"tmp_trace": 4, "n": "120 mm", "rest": "mine", "File_Path": "a/b"}
    two[0] |= {"betas": [9.0], "n": 2**60 + 1, "flag": "perhaps"}
    two[1] |= {"": "no name", "tmp": {"trace": "\ud800"}, "n": 10**400}
    got = drift.unified_records(raw(spark, [one, two]))
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    rows = {r.raw_id: r.asDict() for r in got.collect()}
    assert len(rows) == 16
    rest = {i: json.loads(r["rest"]) for i, r in rows.items() if r["rest"]}
    assert (rows[1]["tmp_trace"], rows[1]["n"], rest[1]) == ("x", None, {"n": ["many"]})
    assert (rows[2]["tmp_trace_2"], rows[2]["n"], rest[2]) == (4.0, 120.0, {"n": ["120 mm"]})
    assert (rows[2]["rest_2"], rows[2]["File_Path_2"], rows[2]["file_path"]) == ("mine", "a/b", "b1/1")
    assert json.loads(rows[9]["betas"]) == two[0]["shape_betas"] and rest[9] == {"betas": [[9.0]], "n": [2**60 + 1], "flag": ["perhaps"]}
    assert (rows[10]["_"], rest[10]) == ("no name", {"tmp.trace": ["\ud800"], "n": [10**400]})
    assert set(rest) == {1, 2, 9, 10}


def test_flooding_settles_and_words_speak_for_each_other():
    old = {"cap.rate": "number", "cap.note": "string", "kept": "string"}
    new = {"rec.rate": "number", "rec.note": "string", "kept": "string"}
    alike = {(a, b): 0.6 for a in ("cap.rate", "cap.note") for b in ("rec.rate", "rec.note")}
    score = drift.flood(old, new, alike)
    assert score["cap.rate", "rec.rate"] > score["cap.rate", "rec.note"] + 0.05
    alone = drift.flood({"cap.rate": "number"}, {"rec.rate": "number"}, {("cap.rate", "rec.rate"): 0.6})
    stronger = drift.flood(old, new, {**alike, ("cap.note", "rec.note"): 1.0})
    assert stronger["cap.rate", "rec.rate"] > score["cap.rate", "rec.rate"] and 0 < alone["cap.rate", "rec.rate"] < 1
    assert drift.flood({}, {}, {}) == {}


def test_one_path_of_two_streams_is_not_mixed(spark):
    rows, n = [], 0
    for stream, unit in (("a", 1.0), ("b", 1e6)):
        for number, name in ((1, "size"), (2, "extent")):
            for k in range(8):
                n += 1
                other = {"extra": 3.5 * (k + 1)} if stream == "b" and number == 2 else {}
                rows.append((n, stream, number, f"{stream}{number}/{k}", json.dumps({name: unit * (10.5 + k), "id": "x", **other}), None))
    got = {(r.stream, r.change_kind, r.field_name, r.new_name) for r in drift.schema_changes(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {("a", "renamed", "size", "extent"), ("b", "renamed", "size", "extent"), ("b", "added", "extra", "")}


def test_repeated_files_count_once(spark):
    good = [json.dumps({"a": 1.5, "b": "x"}) for _ in range(3)]
    rows = [(k, "s", 1, f"1/{k}", p, None) for k, p in enumerate(good)] + [(10 + k, "s", 2, f"2/{k}", p, None) for k, p in enumerate(good)]
    again = [(20, "s", 2, "2/0", '{"a": 1.5, "b": "x", "c": 1}', None), (21, "s", 2, "2/0", "{", None), (22, "s", 2, "2/0", '{"c": 2}', None)]
    df = spark.createDataFrame(rows + again, RAW)
    assert sorted(r.raw_id for r in drift.one_delivery(df).collect()) == [0, 1, 2, 10, 11, 12]
    torn = spark.createDataFrame([(1, "s", 1, "f", "{", None), (2, "s", 1, "f", '{"a": 1}', None), (3, "s", 1, "f", '{"a": 1}', None)], RAW)
    assert [r.raw_id for r in drift.one_delivery(torn).collect()] == [2]
