"""Queries that set one sequence against another: recorded vertices and poses against smoothed ones, markers against their simulated places, tables against tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.stats import NUDGE, exact_percentiles, rounded, summarize
from markerflow.operators import align, chunks, layouts, temporal, views
from markerflow.operators.views import with_views
from markerflow.plans.chunking import MOVES, PLAN
from markerflow.plans.quality import UNITS
from markerflow.plans.sequences import G1, L2
from markerflow.plans.sequences import BEND as BEND_SQL
from markerflow.quality import units
from markerflow.session import checkpointed, first_by, table


def _smoothed_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mesh frames with `reference`, the recorded vertices, and `candidate`, the same smoothed once."""
    frames = views.mesh(spark, sf_dir).withColumn("reference", F.transform("vertices", lambda v: v.cast("double"))).drop("vertices")
    return temporal.smoothed_vectors(frames, "reference", "candidate")


def frame_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames of a sample's poses and of its mesh have a partner on the other side."""
    poses = views.poses(spark, sf_dir).select("seq_id", "frame")
    return align.alignment_report(poses, views.mesh(spark, sf_dir).select("seq_id", "frame"))


def gt_rec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes and solved samples paired by the subject and the motion of their paths."""
    keys = lambda c: [layouts.path_keys(F.col(c))[k].alias(k) for k in ("subject", "motion")]
    takes = views.sessions(spark, sf_dir).select(F.col("seq_id").alias("take"), *keys("mocap_fname"))
    samples = views.samples(spark, sf_dir).select(F.col("seq_id").alias("sample"), *keys("sample_path"))
    samples = samples.withColumn("motion", F.regexp_replace("motion", "_stageii$", ""))
    return takes.join(samples, ["subject", "motion"])


def v2v_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the vertices of the smoothed sequence from the recorded ones, over frames and vertices."""
    off = checkpointed(align.vertex_distances(_smoothed_mesh(spark, sf_dir), "candidate", "reference"))
    moments = off.groupBy("seq_id").agg(rounded(F.avg("d")).alias("mean"), rounded(F.stddev_pop("d")).alias("std"))
    middle = exact_percentiles(off, ["seq_id"], "d", {"median": 0.5})
    return moments.join(middle, "seq_id").select("seq_id", "mean", "std", rounded(F.col("median")).alias("median"))


def v2v_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances by subject, whose groups take every subject that begins with their name, by dataset, and in all."""
    off = align.vertex_distances(_smoothed_mesh(spark, sf_dir), "candidate", "reference")
    sums = off.groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    takes = checkpointed(views.sessions(spark, sf_dir).select("seq_id", "dataset", "subject").join(sums, "seq_id"))
    level = lambda name, rows: rows.select(F.lit(name).alias("level"), "group_name", "n", "s", "q")
    rows = level("subject", align.prefix_groups(takes, "subject")).unionByName(level("dataset", takes.withColumn("group_name", F.col("dataset"))))
    rows = rows.unionByName(level("total", takes.withColumn("group_name", F.lit("all"))))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    std = F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0)))
    return rows.groupBy("level", "group_name").agg(F.count("*").alias("n_takes"), n.alias("n"), F.round(mean, 6).alias("mean"), F.round(std, 5).alias("std"))


DIAGNOSTICS = ["prev_delta", "seam_delta", "next_delta", "pre_accel", "post_accel"]


def seam_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and bends around the seams of the smoothed sequence beside those of the recorded one at the same places."""
    frames = _smoothed_mesh(spark, sf_dir)
    plan = chunks.chunk_plan(frames.groupBy("seq_id").agg(F.count("*").alias("n_frames")), views.mesh_settings(spark, sf_dir))
    sides = [chunks.seam_diagnostics(frames, plan, side).withColumnsRenamed({c: f"{side}_{c}" for c in DIAGNOSTICS}) for side in ("candidate", "reference")]
    both = sides[0].join(sides[1], ["seq_id", "chunk_no", "seam_row"], "full")
    deltas = [rounded(F.col(f"candidate_{c}") - F.col(f"reference_{c}")).alias(c) for c in DIAGNOSTICS]
    return both.select("seq_id", "chunk_no", "seam_row", rounded(F.col("candidate_seam_delta")).alias("candidate"), rounded(F.col("reference_seam_delta")).alias("reference"), *deltas)


def seam_window_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in the ten rows from each seam on, of the smoothed and the recorded sequence, and the differences of their figures."""
    frames = _smoothed_mesh(spark, sf_dir)
    plan = chunks.chunk_plan(frames.groupBy("seq_id").agg(F.count("*").alias("n_frames")), views.mesh_settings(spark, sf_dir))
    cols = ["mean", "max", "first", "last"]
    sides = [chunks.seam_windows(frames, plan, side, 10).select("seq_id", "chunk_no", "seam_row", *[F.col(c).alias(f"{side}_{c}") for c in cols]) for side in ("candidate", "reference")]
    both = sides[0].join(sides[1], ["seq_id", "chunk_no", "seam_row"])
    return both.select("seq_id", "chunk_no", "seam_row", *[rounded(F.col(f"candidate_{c}") - F.col(f"reference_{c}")).alias(c) for c in cols])


REGIONS = ("body", "left_hand", "right_hand", "both_hands")


def pose_window_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 15 frames where steps and bends of four parts of the smoothed poses grew or fell most against the recorded ones."""
    rows = views.with_rows(views.poses(spark, sf_dir).where("fullpose is not null").select("seq_id", "frame", "fullpose"))
    rows = temporal.smoothed_vectors(rows, "fullpose", "smooth")
    moved = temporal.part_motion(rows, {r: (temporal.region("smooth", r), temporal.region("fullpose", r)) for r in REGIONS})
    hot = temporal.window_hotspots(moved.withColumn("frame", F.col("row")), 15, 5, ["seq_id", "region", "metric"])
    return hot.select("seq_id", "region", "metric", "side", "rank", "window", "n", *[F.round(c, 5).alias(c) for c in ("candidate_mean", "reference_mean", "delta")])


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed markers beside their simulated places, both in metres, by label: the latent markers of the sample, moved by the mean offset of their frame."""
    points = units.points_in_metres(table(spark, sf_dir, "mocap_points"), table(spark, sf_dir, "mocap_sessions")).where("x is not null")
    samples = table(spark, sf_dir, "stageii_samples")
    once = first_by(samples.select("seq_id", "latent_labels", "markers_latent", "ingested_at"), ["seq_id"])
    latent = units.convert(once, units.latent_units(samples), ["markers_latent"])
    return align.simulated_offsets(points, latent)


def marker_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of seen markers from their simulated places, in millimetres, to the micrometre."""
    return summarize(_residuals(spark, sf_dir).withColumn("off", F.round(1000 * F.col("residual"), 3)), ["seq_id"], "off")


def frame_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame the mean residual in millimetres and the mean offset in metres."""
    rows = _residuals(spark, sf_dir).groupBy("seq_id", "frame").agg(
        F.count("*").alias("n"), F.round(1000 * F.avg("residual") + NUDGE, 4).alias("residual_mm"), *[F.round(F.first(f"t{c}") + NUDGE, 5).alias(f"t{c}") for c in "xyz"]
    )
    return rows


def residual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by the mean residual: up to 1.2 times the usual one of the take the fast way is accepted, else the exact one is due."""
    frames = checkpointed(_residuals(spark, sf_dir).groupBy("seq_id", "frame").agg(F.round(1000 * F.avg("residual"), 4).alias("off")))
    usual = exact_percentiles(frames, ["seq_id"], "off", {"usual": 0.5, "p90": 0.9})
    route = F.when(F.round(F.col("off") - 1.2 * F.col("usual"), 6) <= 0, "fast").otherwise("exact")
    rows = frames.join(usual, "seq_id").withColumn("route", route)
    return rows.groupBy("seq_id").agg(F.count_if(F.col("route") == "fast").alias("n_fast"), F.count_if(F.col("route") == "exact").alias("n_exact"), rounded(F.max("p90")).alias("p90"))


def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latent places of the labels seen in each frame, gathered by their position in the sample's list: how many there are and their middle height."""
    seen = units.points_in_metres(table(spark, sf_dir, "mocap_points"), table(spark, sf_dir, "mocap_sessions")).where("x is not null and label is not null")
    samples = table(spark, sf_dir, "stageii_samples")
    once = first_by(samples.select("seq_id", "latent_labels", "markers_latent", "ingested_at"), ["seq_id"])
    rows = align.gathered_rows(seen, units.convert(once, units.latent_units(samples), ["markers_latent"]))
    heights = F.transform("places", lambda p: F.get(p, F.lit(2)))
    mean = F.aggregate(heights, F.lit(0.0), lambda s, z: s + z) / F.size("places")
    return rows.select("seq_id", "frame", F.size("places").alias("n"), F.round(mean + NUDGE, 5).alias("height"))


QUERIES = {
    f.__name__: f
    for f in (
        frame_alignment, gt_rec_pairs, v2v_errors, v2v_rollups, seam_compare, seam_window_compare, pose_window_hotspots, marker_residuals, frame_residuals, residual_gate, visible_rows,
    )
}

SMOOTHED = """list_transform(list_zip({v}, coalesce(lag({v}) OVER w, {v}), coalesce(lead({v}) OVER w, lag({v}) OVER w, {v})), lambda p: p[1]::DOUBLE + 0.5 * ((p[2]::DOUBLE + p[3]) / 2 - p[1]))"""
TWO = f"""two AS (SELECT seq_id, row, frame, list_transform(vertices, lambda v: v::DOUBLE) AS reference, {SMOOTHED.format(v="vertices")} AS candidate FROM mesh WINDOW w AS (PARTITION BY seq_id ORDER BY frame))"""
VERTEX = "sqrt(sum((candidate[3 * i + k] - reference[3 * i + k]) ** 2))"
V2V = f"""{with_views("mesh", "ses")}, {TWO}, d AS (SELECT seq_id, row, i, {VERTEX} AS d FROM two, range(12) x(i), range(1, 4) y(k) WHERE i < len(reference) // 3 GROUP BY ALL)"""
SIDE = {side: MOVES.format(e=side).replace("FROM mesh", "FROM two").replace("l AS (", f"l_{side} AS (", 1).replace("m AS (", f"m_{side} AS (", 1).replace("FROM l)", f"FROM l_{side})") for side in ("candidate", "reference")}
PARTS = """CASE '{r}' WHEN 'body' THEN CASE WHEN len({v}) >= 66 THEN {v}[4:66] END
    WHEN 'left_hand' THEN CASE WHEN len({v}) >= 165 THEN {v}[76:120] WHEN len({v}) >= 156 THEN {v}[67:111] END
    WHEN 'right_hand' THEN CASE WHEN len({v}) >= 165 THEN {v}[121:165] WHEN len({v}) >= 156 THEN {v}[112:156] END
    ELSE CASE WHEN len({v}) >= 165 THEN {v}[76:165] WHEN len({v}) >= 156 THEN {v}[67:156] END END"""
RES = f"""{UNITS}, once AS (SELECT seq_id, frame, marker_idx, any_value(label) AS label, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM mocap_points GROUP BY ALL),
    obs AS (SELECT seq_id, frame, label, x * f AS x, y * f AS y, z * f AS z FROM once JOIN mu USING (seq_id) WHERE coalesce(NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) AND NOT (x = 0 AND y = 0 AND z = 0), false)),
    smp AS (SELECT DISTINCT ON (seq_id) * FROM stageii_samples ORDER BY seq_id, ingested_at),
    lat AS (SELECT seq_id, f, unnest(latent_labels) AS label, unnest(markers_latent) AS m FROM smp JOIN lu USING (seq_id)),
    met AS (SELECT o.seq_id, frame, o.x - m[1] * f AS dx, o.y - m[2] * f AS dy, o.z - m[3] * f AS dz FROM obs o JOIN lat ON o.seq_id = lat.seq_id AND o.label = lat.label WHERE m[1] IS NOT NULL AND m[2] IS NOT NULL AND m[3] IS NOT NULL),
    mid AS (SELECT seq_id, frame, avg(dx) AS tx, avg(dy) AS ty, avg(dz) AS tz FROM met GROUP BY ALL),
    res AS (SELECT seq_id, frame, tx, ty, tz, sqrt((dx - tx) ** 2 + (dy - ty) ** 2 + (dz - tz) ** 2) AS residual FROM met JOIN mid USING (seq_id, frame))"""

ORACLE_SQL = {
    "frame_alignment": f"""{with_views("pose", "mesh")}, a AS (SELECT seq_id, frame, 1 AS l FROM pose), b AS (SELECT seq_id, frame, 1 AS r FROM mesh)
        SELECT seq_id, count_if(l IS NOT NULL AND r IS NOT NULL) AS n_both, count_if(r IS NULL) AS n_left, count_if(l IS NULL) AS n_right FROM a FULL JOIN b USING (seq_id, frame) GROUP BY seq_id""",
    "gt_rec_pairs": f"""{with_views("ses", "smp")}, a AS (SELECT seq_id AS take, string_split(mocap_fname, '/')[-2] AS subject, regexp_replace(string_split(mocap_fname, '/')[-1], '\\.[^.]*$', '') AS motion FROM ses),
        b AS (SELECT seq_id AS sample, string_split(sample_path, '/')[-2] AS subject, regexp_replace(string_split(sample_path, '/')[-1], '(_stageii)?\\.[^.]*$', '') AS motion FROM smp)
        SELECT subject, motion, take, sample FROM a JOIN b USING (subject, motion)""",
    "v2v_errors": f"{V2V} SELECT seq_id, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(median(d), 6) AS median FROM d GROUP BY seq_id",
    "v2v_rollups": f"""{V2V}, t AS (SELECT d.seq_id, dataset, subject, d FROM d JOIN ses USING (seq_id)), s AS (SELECT DISTINCT subject AS g FROM t WHERE subject <> ''),
        every AS (SELECT 'subject' AS level, g AS group_name, seq_id, d FROM t JOIN s ON starts_with(subject, g) UNION ALL SELECT 'dataset', dataset, seq_id, d FROM t UNION ALL SELECT 'total', 'all', seq_id, d FROM t)
        SELECT level, group_name, count(DISTINCT seq_id) AS n_takes, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 5) AS std FROM every GROUP BY ALL""",
    "seam_compare": f"""{PLAN}, {TWO}, {SIDE['candidate']}, {SIDE['reference']} SELECT s.seq_id, s.chunk_no, s.seam_row, round(c.seam_delta, 6) AS candidate, round(r.seam_delta, 6) AS reference,
        {', '.join(f'round(c.{k} - r.{k}, 6) AS {k}' for k in DIAGNOSTICS)} FROM seams s JOIN m_candidate c ON s.seq_id = c.seq_id AND s.seam_row = c.row JOIN m_reference r ON s.seq_id = r.seq_id AND s.seam_row = r.row""",
    "seam_window_compare": f"""{PLAN}, {TWO}, {SIDE['candidate']}, {SIDE['reference']}, j AS (SELECT s.*, c.row, c.seam_delta AS c, r.seam_delta AS r FROM seams s JOIN m_candidate c ON s.seq_id = c.seq_id AND c.row BETWEEN seam_row AND seam_row + 9
            JOIN m_reference r ON r.seq_id = c.seq_id AND r.row = c.row WHERE c.seam_delta IS NOT NULL AND r.seam_delta IS NOT NULL)
        SELECT seq_id, chunk_no, seam_row, round(avg(c) - avg(r), 6) AS mean, round(max(c) - max(r), 6) AS max, round(arg_min(c, row) - arg_min(r, row), 6) AS first, round(arg_max(c, row) - arg_max(r, row), 6) AS last FROM j GROUP BY ALL""",
    "pose_window_hotspots": f"""{with_views("pose")}, p AS (SELECT seq_id, frame, fullpose AS a, row_number() OVER w - 1 AS row, {SMOOTHED.format(v="fullpose")} AS b FROM pose WHERE fullpose IS NOT NULL WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
        g AS ({' UNION ALL '.join(f"SELECT seq_id, row, '{r}' AS region, {PARTS.format(r=r, v='a')} AS a, {PARTS.format(r=r, v='b')} AS b FROM p" for r in REGIONS)}),
        l AS (SELECT *, lag(a) OVER w AS a1, lag(a, 2) OVER w AS a2, lag(b) OVER w AS b1, lag(b, 2) OVER w AS b2 FROM g WHERE a IS NOT NULL WINDOW w AS (PARTITION BY seq_id, region ORDER BY row)),
        d AS (SELECT seq_id, region, row, 'delta' AS metric, {L2.format(a="b", b="b1")} AS c, {L2.format(a="a", b="a1")} AS r FROM l WHERE a1 IS NOT NULL
            UNION ALL SELECT seq_id, region, row, 'accel', {BEND_SQL.format(a="b", b="b1", c="b2")}, {BEND_SQL.format(a="a", b="a1", c="a2")} FROM l WHERE a2 IS NOT NULL),
        w AS (SELECT seq_id, region, metric, row // 15 AS "window", count(*) AS n, avg(c) AS candidate_mean, avg(r) AS reference_mean, round(avg(c) - avg(r), 9) AS delta FROM d GROUP BY ALL),
        u AS (SELECT *, 'up' AS side, row_number() OVER (PARTITION BY seq_id, region, metric ORDER BY delta DESC, "window") AS rank FROM w WHERE delta >= 0
              UNION ALL SELECT *, 'down', row_number() OVER (PARTITION BY seq_id, region, metric ORDER BY delta, "window") FROM w WHERE delta <= 0)
        SELECT seq_id, region, metric, side, rank, "window", n, round(candidate_mean, 5) AS candidate_mean, round(reference_mean, 5) AS reference_mean, round(delta, 5) AS delta FROM u WHERE rank <= 5""",
    "marker_residuals": f"{RES}, v AS (SELECT seq_id, round(1000 * residual, 3) AS off FROM res) SELECT seq_id, {G1.format(v='off')} FROM v GROUP BY seq_id",
    "frame_residuals": f"{RES} SELECT seq_id, frame, count(*) AS n, round(1000 * avg(residual) + 1e-9, 4) AS residual_mm, round(any_value(tx) + 1e-9, 5) AS tx, round(any_value(ty) + 1e-9, 5) AS ty, round(any_value(tz) + 1e-9, 5) AS tz FROM res GROUP BY ALL",
    "residual_gate": f"""{RES}, f AS (SELECT seq_id, frame, round(1000 * avg(residual), 4) AS off FROM res GROUP BY ALL), u AS (SELECT seq_id, median(off) AS usual FROM f GROUP BY seq_id)
        SELECT seq_id, count_if(round(off - 1.2 * usual, 6) <= 0) AS n_fast, count_if(NOT round(off - 1.2 * usual, 6) <= 0) AS n_exact, round(quantile_cont(off, 0.9), 6) AS p90 FROM f JOIN u USING (seq_id) GROUP BY seq_id""",
    "visible_rows": f"""{RES}, v AS (SELECT DISTINCT seq_id, frame, label FROM obs WHERE label IS NOT NULL), g AS (SELECT v.seq_id, frame, m[3] * f AS z FROM v JOIN lat ON v.seq_id = lat.seq_id AND v.label = lat.label)
        SELECT seq_id, frame, count(*) AS n, round(avg(z) + 1e-9, 5) AS height FROM g GROUP BY ALL""",
}
