"""Queries over sequences in time: differences, windows, smoothing, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.points import available, finite
from markerflow.functions.stats import NUDGE, rounded, summarize
from markerflow.operators import temporal, views
from markerflow.operators.views import with_views

G1 = """count(*) AS n, round(avg({v}) + 1e-9, 6) AS mean, round(coalesce(stddev_samp({v}), 0) + 1e-9, 6) AS std, round(min({v}), 6) AS min,
    round(max({v}), 6) AS max, round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.9), 6) AS p90,
    round(quantile_cont({v}, 0.99), 6) AS p99"""
L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))"
BEND = "sqrt(list_sum(list_transform(list_zip({a}, {b}, {c}), lambda p: (p[1]::DOUBLE - 2 * p[2]::DOUBLE + p[3]::DOUBLE) ** 2)))"
SEQ = "OVER (PARTITION BY seq_id ORDER BY frame)"


def frame_delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(temporal.scalar_deltas(views.ts_frames(spark, sf_dir), "value", "delta"), ["seq_id"], "delta")


def jitter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(temporal.scalar_jitter(views.ts_frames(spark, sf_dir), "value", "accel"), ["seq_id"], "accel")


def mesh_motion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = temporal.vector_motion(views.mesh(spark, sf_dir), "vertices")
    stacked = moved.select("seq_id", F.explode(F.create_map(F.lit("delta"), "delta", F.lit("accel"), "accel")).alias("metric", "value"))
    return summarize(stacked, ["seq_id", "metric"], "value")


def vector_frame_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {k: F.slice("vec", a, b) for k, (a, b) in {"a": (1, 21), "b": (22, 21), "c": (43, 22)}.items()}
    return summarize(temporal.part_deltas(views.vec_frames(spark, sf_dir), parts), ["seq_id", "region"], "delta")


def pose_region_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.with_rows(views.poses(spark, sf_dir).where("fullpose is not null"))
    parts = {n: temporal.region("fullpose", n) for n in ("body", "left_hand", "right_hand")}
    return summarize(temporal.part_deltas(rows, parts), ["seq_id", "region"], "delta")


def smoothed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.smooth_once(views.ts_frames(spark, sf_dir), "value", "smoothed")
    return rows.select("seq_id", "frame", rounded(F.col("smoothed")).alias("smoothed"))


def smoothed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.smoothed_rounds(views.ts_frames(spark, sf_dir).select("seq_id", "row", "value"), "value", "smoothed")
    return rows.select("seq_id", "row", rounded(F.col("smoothed")).alias("smoothed"))


def masked_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of heights over the readings that are there: the sum of values times masks over the sum of masks, null without any."""
    mask = F.when(available("x", "y", "z"), 1.0).otherwise(0.0)
    rows = views.points(spark, sf_dir).select("seq_id", "marker_idx", mask.alias("m"), F.when(finite("z"), F.col("z")).otherwise(0.0).alias("z"))
    return rows.groupBy("seq_id", "marker_idx").agg(F.round(F.try_divide(F.sum(F.col("z") * F.col("m")), F.sum("m")) + NUDGE, 4).alias("mean"))


def window_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.smooth_once(views.ts_frames(spark, sf_dir), "value", "smoothed")
    rows = temporal.scalar_deltas(temporal.scalar_deltas(rows, "smoothed", "candidate"), "value", "reference")
    hot = temporal.window_hotspots(rows, 15, 5)
    return hot.select("seq_id", "side", "rank", "window", *[rounded(F.col(c)).alias(c) for c in ("candidate_mean", "reference_mean", "delta")])


def predicted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.extrapolated(views.ts_frames(spark, sf_dir), "value", "predicted", 0.5)
    kept = rows.where("predicted is not null").withColumn("off", F.abs(F.col("value") - F.col("predicted")))
    return summarize(kept, ["seq_id"], "off")


def downsampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = views.sessions(spark, sf_dir).select("seq_id", "frame_rate")
    rows = temporal.downsampled(views.points(spark, sf_dir).join(rates, "seq_id"), "frame_rate", 30.0)
    return rows.groupBy("seq_id").agg(F.count("*").alias("n_readings"), F.countDistinct("frame").alias("n_frames"), F.max("frame").alias("last_frame"))


def frame_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.frame_range(views.ts_frames(spark, sf_dir), 10, 60, 5)
    return rows.select("seq_id", "frame", rounded(F.col("value")).alias("value"))


#: Registered slices of sequences: a small dimension; frames from first to before last.
SEGMENTS = [("opening", 0, 20), ("middle", 20, 45), ("late", 40, 90)]


def registered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = spark.createDataFrame(SEGMENTS, "segment string, first int, last int")
    rows = views.ts_frames(spark, sf_dir).join(F.broadcast(segments), (F.col("frame") >= F.col("first")) & (F.col("frame") < F.col("last")))
    return rows.groupBy("seq_id", "segment").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"))


def ramped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.ramp_prepended(views.ts_frames(spark, sf_dir).select("seq_id", "frame", "value"), "value", 8)
    return rows.select("seq_id", "frame", rounded(F.col("value")).alias("value"))


def objective_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = temporal.velocity_terms(views.ts_frames(spark, sf_dir), "value")
    weights = {"data": 1.0, "velocity": 2.5, "acceleration": 0.5}
    stack = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.round(F.col(t) * w * w, 3))])
    return terms.select("seq_id", F.explode(stack).alias("term", "value"))


def reversed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.ts_frames(spark, sf_dir).withColumn("window", temporal.tumbling(F.col("frame"), 16))
    lists = rows.groupBy("seq_id", "window").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("w"))
    back = F.reverse(F.col("w"))
    return lists.where(F.size("w") == 16).select(
        "seq_id", "window", F.get(back, F.lit(0)).getField("frame").alias("first_frame"), rounded(F.get(back, F.lit(0)).getField("value")).alias("first_value"),
        rounded(F.get(back, F.lit(15)).getField("value")).alias("last_value"),
    )


def max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.smooth_once(views.ts_frames(spark, sf_dir), "value", "smoothed")
    off = F.abs(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)) - F.coalesce(F.nanvl("smoothed", F.lit(0.0)), F.lit(0.0)))
    return rows.groupBy("seq_id").agg(rounded(F.max(off)).alias("max_abs_diff"))


QUERIES = {
    "frame_delta_summary": frame_delta_summary,
    "jitter_summary": jitter_summary,
    "mesh_motion_summary": mesh_motion_summary,
    "vector_frame_delta": vector_frame_delta,
    "pose_region_motion": pose_region_motion,
    "smoothed_values": smoothed_values,
    "window_hotspots": window_hotspots,
    "smoothed_rounds": smoothed_rounds,
    "masked_means": masked_means,
    "predicted_values": predicted_values,
    "downsampled_points": downsampled_points,
    "frame_slices": frame_slices,
    "registered_segments": registered_segments,
    "ramped_values": ramped_values,
    "objective_terms": objective_terms,
    "reversed_windows": reversed_windows,
    "max_abs_diff": max_abs_diff,
}

SMOOTH = f"""sm AS (SELECT seq_id, frame, value, value + 0.5 * ((coalesce(lag(value) {SEQ}, value)
    + coalesce(lead(value) {SEQ}, lag(value) {SEQ}, value)) / 2 - value) AS smoothed FROM ts)"""

ROUNDS = ", ".join(
    f"s{k} AS (SELECT seq_id, frame, v + 0.5 * ((coalesce(lag(v) {SEQ}, v) + coalesce(lead(v) {SEQ}, lag(v) {SEQ}, v)) / 2 - v) AS v FROM {f's{k - 1}' if k > 1 else '(SELECT seq_id, frame, value AS v FROM ts)'})"
    for k in range(1, 16)
)

ORACLE_SQL = {
    "smoothed_rounds": f"""{with_views("ts")}, {ROUNDS} SELECT seq_id, frame AS row, round(v, 6) AS smoothed FROM s15""",
    "masked_means": f"""{with_views("pts", "ok")} SELECT seq_id, marker_idx, round(avg(z) FILTER (seen) + 1e-9, 4) AS mean FROM ok GROUP BY ALL""",
    "frame_delta_summary": f"""{with_views("ts")}, d AS (SELECT seq_id, frame, abs(coalesce(value - lag(value) {SEQ}, 0)) AS delta FROM ts)
        SELECT seq_id, {G1.format(v="delta")} FROM d WHERE frame > 0 GROUP BY seq_id""",
    "jitter_summary": f"""{with_views("ts")}, d AS (SELECT seq_id, frame, abs(coalesce(value - 2 * lag(value) {SEQ} + lag(value, 2) {SEQ}, 0)) AS a FROM ts)
        SELECT seq_id, {G1.format(v="a")} FROM d WHERE frame > 1 GROUP BY seq_id""",
    "mesh_motion_summary": f"""{with_views("mesh")}, l AS (SELECT seq_id, row, vertices AS v, lag(vertices) {SEQ} AS v1, lag(vertices, 2) {SEQ} AS v2 FROM mesh),
        d AS (SELECT seq_id, 'delta' AS metric, {L2.format(a="v", b="v1")} AS value FROM l WHERE row > 0
              UNION ALL SELECT seq_id, 'accel', {BEND.format(a="v", b="v1", c="v2")} FROM l WHERE row > 1)
        SELECT seq_id, metric, {G1.format(v="value")} FROM d GROUP BY seq_id, metric""",
    "vector_frame_delta": f"""{with_views("vec")}, r AS (SELECT seq_id, frame, unnest([{{'region': 'a', 'part': vec[1:21]}}, {{'region': 'b', 'part': vec[22:42]}}, {{'region': 'c', 'part': vec[43:64]}}], recursive := true) FROM vec),
        l AS (SELECT *, lag(part) OVER (PARTITION BY seq_id, region ORDER BY frame) AS p1 FROM r), d AS (SELECT seq_id, region, {L2.format(a="part", b="p1")} AS delta FROM l WHERE p1 IS NOT NULL)
        SELECT seq_id, region, {G1.format(v="delta")} FROM d GROUP BY seq_id, region""",
    "pose_region_motion": f"""{with_views("pose")}, r AS (
        SELECT seq_id, frame, 'body' AS region, fullpose[4:66] AS part FROM pose WHERE len(fullpose) >= 66
        UNION ALL SELECT seq_id, frame, 'left_hand', CASE WHEN len(fullpose) >= 165 THEN fullpose[76:120] ELSE fullpose[67:111] END FROM pose WHERE len(fullpose) >= 156
        UNION ALL SELECT seq_id, frame, 'right_hand', CASE WHEN len(fullpose) >= 165 THEN fullpose[121:165] ELSE fullpose[112:156] END FROM pose WHERE len(fullpose) >= 156),
        l AS (SELECT *, lag(part) OVER (PARTITION BY seq_id, region ORDER BY frame) AS p1 FROM r), d AS (SELECT seq_id, region, {L2.format(a="part", b="p1")} AS delta FROM l WHERE p1 IS NOT NULL)
        SELECT seq_id, region, {G1.format(v="delta")} FROM d GROUP BY seq_id, region""",
    "smoothed_values": f"""{with_views("ts")}, {SMOOTH} SELECT seq_id, frame, round(smoothed, 6) AS smoothed FROM sm""",
    "window_hotspots": f"""{with_views("ts")}, {SMOOTH}, d AS (SELECT seq_id, frame, CASE WHEN frame > 0 THEN abs(coalesce(smoothed - lag(smoothed) {SEQ}, 0)) END AS c,
            CASE WHEN frame > 0 THEN abs(coalesce(value - lag(value) {SEQ}, 0)) END AS r FROM sm),
        w AS (SELECT seq_id, frame // 15 AS "window", avg(c) AS candidate_mean, avg(r) AS reference_mean, round(avg(c) - avg(r), 9) AS delta FROM d WHERE c IS NOT NULL GROUP BY ALL),
        u AS (SELECT *, 'up' AS side, row_number() OVER (PARTITION BY seq_id ORDER BY delta DESC, "window") AS rank FROM w WHERE delta >= 0
              UNION ALL SELECT *, 'down', row_number() OVER (PARTITION BY seq_id ORDER BY delta, "window") FROM w WHERE delta <= 0)
        SELECT seq_id, side, rank, "window", round(candidate_mean, 6) AS candidate_mean, round(reference_mean, 6) AS reference_mean, round(delta, 6) AS delta FROM u WHERE rank <= 5""",
    "predicted_values": f"""{with_views("ts")}, d AS (SELECT seq_id, value - (lag(value) {SEQ} + 0.5 * (lag(value) {SEQ} - lag(value, 2) {SEQ})) AS o FROM ts), e AS (SELECT seq_id, abs(o) AS off FROM d WHERE o IS NOT NULL)
        SELECT seq_id, {G1.format(v="off")} FROM e GROUP BY seq_id""",
    "downsampled_points": f"""{with_views("pts", "ses")} SELECT pts.seq_id, count(*) AS n_readings, count(DISTINCT frame) AS n_frames, max(frame) AS last_frame FROM pts JOIN ses USING (seq_id)
        WHERE frame % greatest(1, floor(coalesce(frame_rate, 0) / 30)::BIGINT) = 0 GROUP BY pts.seq_id""",
    "frame_slices": f"""{with_views("ts")} SELECT seq_id, frame, round(value, 6) AS value FROM ts WHERE frame >= 10 AND frame < 60 AND (frame - 10) % 5 = 0""",
    "registered_segments": f"""{with_views("ts")}, s(segment, first, last) AS (VALUES {", ".join(map(str, SEGMENTS))})
        SELECT seq_id, segment, count(*) AS n, round(avg(value), 6) AS mean FROM ts JOIN s ON frame >= first AND frame < last GROUP BY seq_id, segment""",
    "ramped_values": f"""{with_views("ts")} SELECT seq_id, frame + 8 AS frame, round(value, 6) AS value FROM ts
        UNION ALL SELECT seq_id, g AS frame, round(value * g / 7, 6) FROM ts, range(8) r(g) WHERE frame = 0""",
    "objective_terms": f"""{with_views("ts")}, l AS (SELECT seq_id, value, lag(value) {SEQ} AS a, lag(value, 2) {SEQ} AS b FROM ts),
        s AS (SELECT seq_id, sum(value ** 2) AS d, coalesce(sum((value - a) ** 2), 0) AS v, coalesce(sum((value - 2 * a + b) ** 2), 0) AS c FROM l GROUP BY seq_id)
        SELECT seq_id, 'data' AS term, round(d, 3) AS value FROM s UNION ALL SELECT seq_id, 'velocity', round(v * 2.5 * 2.5, 3) FROM s UNION ALL SELECT seq_id, 'acceleration', round(c * 0.5 * 0.5, 3) FROM s""",
    "reversed_windows": f"""{with_views("ts")}, w AS (SELECT seq_id, frame // 16 AS "window", count(*) AS n, max(frame) AS first_frame, arg_max(value, frame) AS fv, arg_min(value, frame) AS lv FROM ts GROUP BY ALL)
        SELECT seq_id, "window", first_frame, round(fv, 6) AS first_value, round(lv, 6) AS last_value FROM w WHERE n = 16""",
    "max_abs_diff": f"""{with_views("ts")}, {SMOOTH} SELECT seq_id, round(max(abs(coalesce(value, 0) - coalesce(smoothed, 0))), 6) AS max_abs_diff FROM sm GROUP BY seq_id""",
}
