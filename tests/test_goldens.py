"""Literal cases with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerflow.functions.points import available
from markerflow.functions.stats import summarize
from markerflow.operators import augment, chunks, geometry, kernels, labels, layouts, temporal


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_summary_of_five_samples(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 20, 50, 100, 200)], "k string, v double")
    r = summarize(df, ["k"], "v").first()
    assert (r["p50"], r["p90"], r["p99"], r["n"]) == (50.0, 160.0, 196.0, 5)


def test_summary_of_one_sample_and_none(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("c", float("nan"))], "k string, v double")
    assert rows(summarize(df, ["k"], "v"), "k", "std") == [("a", 0.0)]


def test_percentiles_are_the_same_for_small_and_large_keys(spark):
    values = [(k % 3 and "a" or None, float((k * 7919) % 1013) / 7, k) for k in range(3_000)] + [("one", 5.0, 0), ("one", None, 1), ("one", float("nan"), 2)]
    df = spark.createDataFrame(values, "k string, v double, n int")
    found = [sorted(map(repr, summarize(df, ["k"], "v", few).collect())) for few in (10, 1_500, 100_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def frames(spark, xs, seq="s"):
    return spark.createDataFrame([(seq, i, i, [float(x), 0.0, 0.0]) for i, x in enumerate(xs)], "seq_id string, frame int, row int, vertices array<double>")


def settings(spark, size, overlap, keeps, seq="s"):
    return spark.createDataFrame([(seq, size, overlap, keeps)], "seq_id string, chunk_size int, chunk_overlap int, chunk_keep_starts array<int>")


def plan_of(spark, n, size, overlap, keeps=None):
    return chunks.chunk_plan(spark.createDataFrame([("s", n)], "seq_id string, n_frames bigint"), settings(spark, size, overlap, keeps))


@pytest.mark.parametrize("xs, accel, seam", [((0, 1, 2, 10, 11), 7.0, 8.0), ((0, 1, 2, 9, 10), 6.0, 7.0)])
def test_mesh_summary(spark, xs, accel, seam):
    moved = temporal.vector_motion(frames(spark, xs), "vertices")
    assert moved.agg(F.max("accel")).first()[0] == accel
    plan = plan_of(spark, 5, 3, 1)
    assert rows(chunks.seam_diagnostics(frames(spark, xs), plan, "vertices"), "seam_row", "seam_delta") == [(3, seam)]


def test_seam_window(spark):
    plan = plan_of(spark, 6, 4, 2, [0, 1])
    r = chunks.seam_windows(frames(spark, (0, 1, 2, 9, 7, 11)), plan, "vertices", 3).first()
    assert r["seam_row"] == 3 and (r["n"], r["mean"], r["max"], r["first"], r["last"], r["peak_row"]) == (3, 13 / 3, 7.0, 7.0, 4.0, 3)


def test_chunk_plan_equals_the_loop(spark):
    cases = [(n, size, over) for n in (1, 5, 9, 16, 31) for size in (1, 3, 4, 8) for over in (0, 1, 2, 3) if over < size]
    lengths = spark.createDataFrame([(f"{n}-{s}-{o}", n) for n, s, o in cases], "seq_id string, n_frames bigint")
    sets = spark.createDataFrame([(f"{n}-{s}-{o}", s, o, None) for n, s, o in cases], "seq_id string, chunk_size int, chunk_overlap int, chunk_keep_starts array<int>")
    plan = chunks.chunk_plan(lengths, sets)
    want = []
    for n, size, over in cases:
        start, number = 0, 0
        while True:
            want.append((f"{n}-{size}-{over}", number, start, min(start + size, n)))
            if start + size >= n:
                break
            start, number = start + max(size - over, 1), number + 1
    assert rows(plan, "seq_id", "chunk_no", "row_start", "row_end") == sorted(want, key=repr)
    owned = chunks.owned_rows(plan).groupBy("seq_id").agg(F.sum(F.col("end_row") - F.col("first_row")).alias("n"))
    assert rows(owned, "seq_id", "n") == sorted([(f"{n}-{s}-{o}", n) for n, s, o in cases], key=repr)


def test_bad_settings_are_reported(spark):
    sets = spark.createDataFrame(
        [("a", 4, 4, None), ("b", 0, 0, None), ("c", 4, -1, None), ("d", None, 1, None), ("e", 4, 1, [1, 1]), ("f", 4, 1, [0])],
        "seq_id string, chunk_size int, chunk_overlap int, chunk_keep_starts array<int>",
    )
    lengths = spark.createDataFrame([(k, 6) for k in "abcdef"], "seq_id string, n_frames bigint")
    report = dict(rows(chunks.settings_report(sets, chunks.chunk_plan(lengths, sets)), "seq_id", "problem"))
    assert report == {
        "a": "overlap not below size", "b": "size not positive", "c": "negative overlap", "d": "no size", "e": "first keep-start not 0", "f": "keep-starts of another length",
    }


@pytest.mark.parametrize(
    "before, after, keep",
    [
        (((90, 0), (100, 0)), ((89, 0), (91, 0), (92, 0), (93, 0)), 1),
        (((90, 0), (100, 10)), ((89, 0), (91.00044, 1), (101, 50), (102, 51)), 1),
        (((90, 0), (100, 10)), ((89, 0), (91.5, 1), (101, 50), (102, 51)), 2),
    ],
)
def test_stitching_takes_the_least_jump(spark, before, after, keep):
    parts = [("s", n, r, 0, 2, [float(x)], [float(p)]) for n, side in enumerate((before, after)) for r, (x, p) in enumerate(side)]
    df = spark.createDataFrame(parts, "seq_id string, chunk_no int, row int, row_start int, overlap int, x array<double>, pose array<double>")
    plan = spark.createDataFrame([("s", 0, 2), ("s", 1, 2)], "seq_id string, chunk_no int, overlap int")
    chosen = chunks.select_keep_starts(plan, chunks.stitch_candidates(df, "x", "pose"))
    assert rows(chosen, "keep_start") == [(keep,)]
    told = spark.createDataFrame([("s", 1, 3 - keep)], "seq_id string, chunk_no int, value int")
    assert rows(chunks.overridden_keep_starts(chosen, told), "keep_start", "selected_keep_start", "source") == [(3 - keep, keep, "override")]
    assert rows(chunks.overridden_keep_starts(chosen, told.withColumn("value", F.lit(3))), "keep_start", "source") == [(keep, "refused")]


def test_guards_exclude_what_jumps_further_than_the_default(spark):
    shape = "seq_id string, chunk_no int, overlap int, keep int, transl_jump double, pose_jump double, mesh_jump double"
    found = spark.createDataFrame([("s", 1, 3, 1, 0.0, 9.0, 0.0), ("s", 1, 3, 2, 0.5, 1.0, 5.0), ("s", 1, 3, 3, 2.0, 3.0, 1.0), ("s", 2, 2, 1, 0.0, 0.0, 0.0)], shape)
    plan = spark.createDataFrame([("s", 0, 3), ("s", 1, 3), ("s", 2, 2), ("s", 3, 0)], "seq_id string, chunk_no int, overlap int")
    keeps = lambda *guards: rows(chunks.select_keep_starts(plan, found, guards), "chunk_no", "keep_start")
    assert keeps("pose", "mesh") == [(1, 3), (2, 2), (3, 0)]
    assert keeps("pose") == [(1, 2), (2, 2), (3, 0)]
    assert keeps() == [(1, 1), (2, 1), (3, 0)]


def test_references_go_on_from_the_chunk_before(spark):
    prev = [("s", 0, r, 0, [202.0 + r]) for r in range(2)]
    cur = [("s", 1, r, 0, [22.0 + r]) for r in range(4)]
    df = spark.createDataFrame(prev + cur, "seq_id string, chunk_no int, row int, row_start int, x array<double>")
    made = lambda kind, w=2: [(k, v[0]) for k, v in rows(chunks.velocity_references(df, "x", "x", kind, w), "k", "reference")]
    assert made("window") == [(0, 203.0), (1, 204.0), (2, 205.0)]
    assert made("anchor") == [(0, 203.0)]
    assert made("full") == [(0, 202.0), (1, 203.0), (2, 204.0), (3, 205.0)]
    assert made("zero_seam") == [(0, 203.0), (1, 203.0), (2, 204.0)]
    terms = lambda mode: [t for (t,) in rows(chunks.chunk_velocity_terms(df, "x", "x", mode, 2.0, 2).where("chunk_no = 1").orderBy("row"), "term")]
    assert terms("plain") == [0.0, 4.0, 4.0, 4.0]
    assert sorted(terms("anchor")) == sorted([0.0, 4.0, 4 * 179.0**2, 4.0])
    assert sorted(terms("window")) == sorted([0.0, 4.0, 4 * 180.0**2, 0.0])
    assert sorted(terms("full")) == sorted([4 * 180.0**2, 0.0, 0.0, 0.0])
    edge = rows(chunks.boundary_terms(df, "x", "x", 1.0, 1), "row", "term")
    assert edge == [(2, 179.0**2), (3, 178.0**2)]
    assert rows(chunks.boundary_terms(df, "x", "x", 1.0, 2), "row", "term") == []
    swapped = chunks.replaced_window(df.withColumn("y", F.array(F.lit(0.0))), "x", "y", 1, 2).where("chunk_no = 1")
    assert [v[0] for _, v in rows(swapped, "row", "x")] == [22.0, 0.0, 0.0, 25.0]
    weights = df.where("chunk_no = 1").withColumn("w", F.lit(2.0))
    assert [w for _, w in rows(chunks.scaled_weights(weights, "w", F.col("row"), -1, 2, 0.5, F.lit(True)), "row", "w")] == [1.0, 1.0, 2.0, 2.0]
    spliced = chunks.spliced(df, "x").where("chunk_no = 1")
    assert [(r, v[0]) for r, v in rows(spliced, "row", "value")] == [(0, 202.0), (1, 203.0), (2, 204.0), (3, 205.0)]


POINTS = "seq_id string, frame int, marker_idx int, label string, x double, y double, z double"


def test_availability(spark):
    df = spark.createDataFrame([("s", i, 0, "A", *p) for i, p in enumerate([(0.0, 0.0, 0.0), (float("nan"), 1.0, 1.0), (None, 1.0, 1.0), (0.0, 0.0, 1.0)])], POINTS)
    assert rows(df.where(available("x", "y", "z")), "frame") == [(3,)]


def test_votes_and_ties(spark):
    seen = [("s", f, 0, lab, 1.0, 1.0, 1.0) for f, lab in enumerate(["B", "A", "A", "B"])]
    df = spark.createDataFrame([*seen, ("s", 0, 1, "A", 0.0, 0.0, 0.0)], POINTS)
    assert rows(labels.label_votes(df), "marker_idx", "label", "n") == [(0, "B", 2), (1, "nan", 0)]


def test_doubled_labels_overflow(spark):
    df = spark.createDataFrame([("s", 0, i, lab, 1.0, 1.0, 1.0) for i, lab in enumerate(["A", "B", "A", None])], POINTS)
    assert rows(labels.overflow_labels(df), "marker_idx", "final_label", "slot") == [(0, "nan", 0), (1, "B", None), (2, "nan", 1), (3, "nan", 2)]


def test_label_words(spark):
    df = spark.createDataFrame([("a:b: L_HEEL",), ("R TOE",), (None,)], "label string")
    assert rows(df.select(labels.clean_label(F.col("label")).alias("c")), "c") == [("L_HEEL",), ("RTOE",), (None,)]
    assert rows(df.select(labels.subject_of(F.col("label")).alias("s")), "s") == [("a",), ("null",), ("null",)]


def test_exact_matches(spark):
    kinds = "seq_id string, frame int, idx int, x double, y double, z double"
    left = spark.createDataFrame([("s", 0, 0, 1.0, 1.0, 1.0), ("s", 0, 1, 5.0, 5.0, 5.0), ("s", 0, 2, 2.0, 2.0, 2.0)], kinds)
    right = spark.createDataFrame([("s", 0, 7, 1.0, 1.0, 1.0), ("s", 0, 8, 5.0 + 2e-8, 5.0, 5.0), ("s", 0, 9, 2.0, 2.0, 2.0), ("s", 0, 10, 2.0, 2.0, 2.0)], kinds)
    assert rows(labels.exact_matches(left, right), "left_idx", "right_idx") == [(0, 7)]


def test_macro_scores_cover_the_union(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "gt string, rec string")
    r = labels.macro_scores(labels.confusion(df)).first()
    assert r["n_labels"] == 3 and r["accuracy"] == pytest.approx(2 / 3)
    assert r["recall"] == pytest.approx((0.5 + 0 + 1) / 3)


def test_layout_json_roundtrip(spark):
    text = '{"markersets": [{"type": "body", "distance_from_skin": 0.0095, "indices": {"B": 2, "A": 1}}]}'
    df = layouts.layout_from_json(spark.createDataFrame([("l", text)], "layout_id string, text string"))
    assert rows(df, "label", "vid", "ord", "surface_model_type") == [("A", 1, 0, "smplx"), ("B", 2, 1, "smplx")]
    again = layouts.layout_from_json(layouts.layout_to_json(df))
    assert rows(again, *sorted(df.columns)) == rows(df, *sorted(df.columns))


def test_rotations(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0)], "x double, y double, z double")
    turned = geometry.axis_angle_rotation([F.col(c) for c in "xyz"], [F.lit(np.pi / 2), F.lit(0.0), F.lit(0.0)])
    assert np.allclose(df.select(*turned).first(), (0, 0, 1))
    assert np.allclose(df.select(*geometry.axis_angle_rotation([F.col(c) for c in "xyz"], [F.lit(0.0)] * 3)).first(), (0, 1, 0))


def test_rigid_alignment_is_recovered(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20, 3))
    angle = 0.7
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    b = a @ turn.T + [1, 2, 3]
    df = spark.createDataFrame([("s", *map(float, p), *map(float, q)) for p, q in zip(a, b)], "seq_id string, ax double, ay double, az double, bx double, by double, bz double")
    r = kernels.rigid_alignments(df, ["seq_id"]).first()
    assert np.allclose([r["rx"], r["ry"], r["rz"], r["tx"], r["ty"], r["tz"]], [0, 0, angle, 1, 2, 3]) and r["error"] < 1e-6


def test_transport_prefers_the_nearest():
    off = np.abs(np.arange(4)[:, None] - np.arange(4)[None])
    p = np.exp(kernels.transport(-10.0 * off, -1.0))
    assert (p[:-1, :-1].argmax(axis=1) == np.arange(4)).all()
    assert np.allclose(p[:-1].sum(axis=1), 1, atol=1e-3)


def test_attachment_roundtrip():
    rng = np.random.default_rng(2)
    corners, marker = rng.normal(size=(3, 3)), rng.normal(size=3)
    assert np.allclose(kernels.attached(kernels.attachment(marker, corners), corners), marker)


def test_closest_on_triangles():
    tri = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 5], [1, 0, 5], [0, 1, 5]]], float)
    face, place, far = kernels.closest_on_triangles(np.array([0.2, 0.2, 1.0]), tri)
    assert face == 0 and far == pytest.approx(1) and np.allclose(place, (0.2, 0.2, 0))
    assert kernels.closest_on_triangles(np.array([-1.0, -1.0, 0.0]), tri)[2] == pytest.approx(np.sqrt(2))


def test_mixture_prior_picks_the_component(spark):
    df = spark.createDataFrame([("s", 0, [0.0, 0.0]), ("s", 1, [2.0, 2.0])], "seq_id string, frame int, vec array<double>")
    got = kernels.mixture_residuals(df, np.array([[0.0, 0.0], [2.0, 2.0]]), np.stack([np.eye(2)] * 2), np.array([0.5, 0.5]))
    assert rows(got, "frame", "component", "cost") == [(0, 0, pytest.approx(np.log(2))), (1, 1, pytest.approx(np.log(2)))]


def test_permutation_inverts(spark):
    df = spark.createDataFrame([("s", f, m, "A", 1.0, 1.0, 1.0) for f in range(3) for m in range(6)], POINTS)
    got = augment.shuffled_slots(df, 1)
    assert rows(got.groupBy("frame").agg(F.sort_array(F.collect_list("slot")).alias("s")), "frame", "s") == [(f, list(range(6))) for f in range(3)]


def test_exact_fraction_is_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for buckets in (1, 4, 4096):
        assert augment.exact_fraction(df, "k", 0.25, 3, buckets).count() == 250
    a, b = (augment.exact_fraction(df.repartition(n), "k", 0.25, 3) for n in (1, 7))
    assert a.exceptAll(b).count() == 0


def test_noise_model_keeps_every_residual(spark):
    key = ["seq_id", "frame", "marker_idx"]
    steps = [("s", f, m, label, float(f % 100 if m else f), 0.0, 1.0) for m, label, n in ((0, "A", 300), (1, "B", 130), (2, "C", 1)) for f in range(n)]
    residuals = spark.createDataFrame(steps, "seq_id string, frame int, marker_idx int, label string, dx double, dy double, dz double")
    model = augment.noise_model(residuals, key, 3)
    assert rows(model, "label", "dx", "dz") == sorted(((r[3], r[4], r[6]) for r in steps), key=repr)
    assert rows(model, "label", "slot") == sorted(((label, i) for label, n in (("A", 300), ("B", 130), ("C", 1)) for i in range(n)), key=repr)
    assert rows(augment.noise_sizes(model), "label", "n", "size") == [("A", 300, 300), ("B", 130, 300), ("C", 1, 300)]
    assert rows(augment.noise_model(residuals.repartition(5), key, 3), "label", "slot", "dx") == rows(model, "label", "slot", "dx")
    points = spark.createDataFrame([("t", f, m, label, 0.0, 0.0, 0.0) for m, label in enumerate(("A", "B", "C", "D", None)) for f in range(3_000)], "seq_id string, frame int, marker_idx int, label string, x double, y double, z double")
    moved = augment.with_noise(points, model, 5)
    drawn = {r.label: (r.n, r.d, r.z) for r in moved.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("x").alias("d"), F.sum("z").alias("z")).collect()}
    # 3,000 draws of 300 leave out none or very few.
    assert drawn["A"][0] == 3_000 and drawn["A"][1] > 290 and drawn["B"] == (3_000, 100, 3_000.0)
    assert drawn["C"] == (3_000, 1, 3_000.0) and drawn["D"] == drawn[None] == (3_000, 1, 0.0)


def test_smoothing_edges(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate((0, 4, 0))], "seq_id string, frame int, v double")
    assert rows(temporal.smooth_once(df, "v", "w", 0.5), "frame", "w") == [(0, 1.0), (1, 2.0), (2, 2.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], POINTS)
    assert labels.label_votes(none).count() == 0
    assert labels.occlusion_rates(none).count() == 0
    assert geometry.frame_offsets(none).count() == 0
    assert augment.ghosts(none, 2, 1).count() == 0


def test_blocks_give_what_whole_sequences_give(spark, monkeypatch):
    from markerflow.operators import ranges

    rng = np.random.default_rng(6)
    data = [(s, f, f, float(rng.normal())) for s in "ab" for f in range(37)]
    df = spark.createDataFrame(data, "seq_id string, frame int, row int, v double")
    whole = df.drop("row")
    for size in (1, 3, 8):
        monkeypatch.setattr(ranges, "BLOCK_ROWS", size)
        for f in (temporal.scalar_deltas, temporal.scalar_jitter, temporal.smooth_once, lambda d, v, n: temporal.extrapolated(d, v, n, 0.3)):
            assert rows(f(df, "v", "w"), "seq_id", "frame", "w") == rows(f(whole, "v", "w"), "seq_id", "frame", "w")


def test_positions_and_best_rows(spark):
    from markerflow.operators import ranges

    df = spark.createDataFrame([("a", f) for f in (5, 900, 7, 33, 901)] + [("b", 2), (None, 1)], "seq_id string, frame int")
    got = ranges.numbered(df, "seq_id", F.floor(F.col("frame") / 10), ["frame"], "row")
    assert rows(got, "seq_id", "frame", "row") == sorted([("a", 5, 0), ("a", 7, 1), ("a", 33, 2), ("a", 900, 3), ("a", 901, 4), ("b", 2, 0)], key=repr)
    best = ranges.top_k(df.dropna(), ["seq_id"], [F.desc("frame")], 2, ["frame"], "n")
    assert rows(best, "seq_id", "frame", "n") == [("a", 900, 2), ("a", 901, 1), ("b", 2, 1)]


def test_spread_percentiles_are_exact(spark):
    from markerflow.functions.stats import spread_percentiles

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=500), "b": np.repeat([1.0, 2.0], [400, 3]), "c": np.array([4.0]), "d": rng.integers(0, 5, size=200).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    for n in (4, 64):
        got = {r.k: (r.p50, r.p90, r.p99) for r in spread_percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, n).collect()}
        for k, vs in groups.items():
            assert np.allclose(got[k], np.percentile(vs, [50, 90, 99]))


def test_transport_finds_a_permutation_and_leaves_ghosts_and_gone_points_alone(spark):
    rng = np.random.default_rng(5)
    left, right = [], []
    for f in range(3):
        places = rng.normal(size=(8, 3)) * 3
        order = rng.permutation(8)
        left += [("s", f, k, *map(float, p)) for k, p in enumerate(places)]
        right += [("s", f, int(k), *map(float, places[k] + 0.001)) for k in order if k != f] + [("s", f, 50, 90.0, 90.0, 90.0)]
    left.append(("s", 9, 4, 0.0, 0.0, 0.0))
    shape = "seq_id string, frame int, idx int, x double, y double, z double"
    got = rows(kernels.transported(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape)), "frame", "left_idx", "right_idx")
    assert got == sorted([(f, k, -1 if k == f else k) for f in range(3) for k in range(8)] + [(9, 4, -1)], key=repr)


def test_attached_markers_move_with_their_mesh(spark):
    rng = np.random.default_rng(6)
    mesh = rng.normal(size=(7, 3))
    mesh[3] = 2 * mesh[1] - mesh[0]
    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    marks = rng.normal(size=(4, 3))
    frames = spark.createDataFrame([("s", 0, [float(v) for v in mesh.ravel()]), ("s", 1, [float(v) for v in (mesh @ turn.T + 5).ravel()])], "seq_id string, frame int, vertices array<double>")
    here = spark.createDataFrame([("s", str(k), [float(v) for v in m]) for k, m in enumerate(marks)], "seq_id string, label string, xyz array<double>")
    fixed = kernels.attachments(here.join(frames.where("frame = 0").select("seq_id", "vertices"), "seq_id"))
    got = {(r.frame, int(r.label)): (r.x, r.y, r.z) for r in kernels.decoded_markers(fixed, frames).collect()}
    for k, m in enumerate(marks):
        assert np.allclose(got[0, k], m) and np.allclose(got[1, k], turn @ m + 5)


def test_smoothing_rounds_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=90)
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)] + [("t", 0, 4.0)], "seq_id string, row int, v double")
    for _ in range(5):
        before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-2:-1]])
        x = x + 0.5 * ((before + after) / 2 - x)
    for block in (1, 20, 1_000):
        got = {(r.seq_id, r.row): r.y for r in temporal.smoothed_rounds(df, "v", "y", 5, block_rows=block).collect()}
        assert got.pop(("t", 0)) == 4.0 and np.allclose([got["s", k] for k in range(90)], x)


def test_kinds_of_ghosts(spark):
    points = spark.range(4_000).selectExpr("'s' AS seq_id", "CAST(id DIV 2 AS int) AS frame", "CAST(id % 2 AS double) * 2 AS x", "3.0D AS y", "CAST(id % 2 AS double) AS z")
    moments = lambda kind, c: augment.ghosts(points, 5, 3, kind).agg(F.avg(c), F.stddev(c), F.min(c), F.max(c)).first()
    mean, deviation, _, _ = moments("gaussian", "x")
    assert abs(mean) < 0.05 and abs(deviation - 2**0.5) < 0.05 and moments("gaussian", "y")[1] == 0
    mean, deviation, low, high = moments("uniform", "y")
    assert abs(mean) < 0.05 and abs(deviation - (4 / 3) ** 0.5) < 0.05 and -2 <= low < high <= 2
    skewed = augment.ghosts(points, 5, 3, "skewed")
    inner = skewed.groupBy("frame").agg(F.var_samp("z").alias("v"))
    assert abs(inner.agg(F.avg("v")).first()[0] - 1) < 0.06
    with pytest.raises(ValueError):
        augment.ghosts(points, 5, 3, "other")
