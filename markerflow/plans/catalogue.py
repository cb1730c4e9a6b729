"""Queries over layouts and the catalogue of takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.stats import rounded
from markerflow.operators import labels, layouts, views
from markerflow.operators.views import with_views
from markerflow.session import table


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "marker_layout")


def layout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts.merged_layout(_layout(spark, sf_dir))
    return rows.select("marker_type", "label", F.concat_ws(",", F.transform("vids", lambda v: v.cast("string"))).alias("vids"), "n_layouts", "n_distances")


def layout_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts written as JSON texts and read again."""
    rows = layouts.layout_from_json(layouts.layout_to_json(_layout(spark, sf_dir)))
    return rows.groupBy("layout_id", "marker_type").agg(F.count("*").alias("n"), F.sum("vid").alias("vid_sum"), F.min("ord").alias("first_ord"))


def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = views.sessions(spark, sf_dir).select(F.explode("labels").alias("label"))
    typed = typed.select(labels.clean_label(F.col("label")).alias("label"))
    return layouts.known_and_unknown(typed, _layout(spark, sf_dir).where("layout_id = 'superset'"))


def layout_vertex_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of one model renamed to those of another, by the labels that both have."""
    rows = _layout(spark, sf_dir)
    ours = rows.where("surface_model_type = 'smplh'").groupBy("label").agg(F.min("vid").alias("vid"))
    theirs = rows.where("layout_id = 'superset'").select("label", F.col("vid").alias("new_vid"))
    mapping = ours.join(theirs, "label").groupBy("vid").agg(F.min("new_vid").alias("new_vid"))
    return layouts.remapped_vertices(rows.where("surface_model_type = 'smplh'"), mapping).select("layout_id", "ord", "label", "vid")


def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = layouts.path_keys(F.col("mocap_fname"))
    return views.sessions(spark, sf_dir).select("seq_id", *[c.alias(k) for k, c in keys.items()])


def alias_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.alias_files(views.sessions(spark, sf_dir).select(F.col("mocap_fname").alias("path")))


def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes without a solved sample, one per subject."""
    jobs = views.sessions(spark, sf_dir).select("seq_id", "dataset", "subject")
    return layouts.pending_jobs(jobs, table(spark, sf_dir, "stageii_samples").select("seq_id"), "seq_id", "subject")


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = views.sessions(spark, sf_dir).withColumn("n_markers", F.size("labels"))
    rows = layouts.dataset_stats(takes)
    return rows.select("dataset", "median_markers", "n_subjects", "n_motions", rounded(F.col("minutes")).alias("minutes"))


def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of four motions, split by subject number."""
    number = F.regexp_extract("subject", r"(\d+)$", 1).cast("int")
    motion = F.get(F.split(F.element_at(F.split("mocap_fname", "/"), -1), "_"), F.lit(0))
    split = F.when(number.between(1, 15), "train").when(number.between(20, 40), "vald")
    rows = views.sessions(spark, sf_dir).select("seq_id", "subject", motion.alias("motion"), split.alias("split"))
    return rows.where(F.col("split").isNotNull() & F.col("motion").isin("sit", "hop", "walk", "turn"))


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sessions(spark, sf_dir)
    a = rows.where("frame_rate >= 100").select("dataset")
    return a.intersect(rows.where("frame_rate < 100").select("dataset"))


def settings_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets by occlusion and ghost settings, with the id of each combination."""
    sets = views.sessions(spark, sf_dir).select("dataset").distinct()
    oc = spark.createDataFrame([(0,), (5,), (10,)], "oc int")
    ghost = spark.createDataFrame([(0,), (3,)], "ghost int")
    grid = layouts.settings_grid(sets, oc, ghost)
    return grid.select("dataset", "oc", "ghost", F.format_string("OC_%02d_G_%02d_real_%03d_synt_%03d", "oc", "ghost", F.lit(100), F.lit(100)).alias("data_id"))


def rate_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame rate of a take: its own, else its rig's usual one, else its dataset's; a sample's recorded rate goes before all."""
    takes = views.sessions(spark, sf_dir)
    usual = lambda c: takes.where("frame_rate > 0").groupBy(c).agg(F.median("frame_rate").alias("rate"))
    base = takes.select("seq_id", "dataset", "rig").withColumn("rate", F.lit(None).cast("double"))
    own = takes.where("frame_rate > 0").select("seq_id", F.col("frame_rate").alias("rate"))
    sample = views.samples(spark, sf_dir).where("mocap_frame_rate > 0").select("seq_id", F.col("mocap_frame_rate").alias("rate"))
    rows = layouts.overridden(base, ["seq_id", "dataset", "rig"], usual("dataset"), usual("rig"), own, sample, columns=["rate"])
    return rows.select("seq_id", rounded(F.col("rate")).alias("rate"))


def normalized_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in one form: model type and gender in lower case with defaults, a usable rate or the take's, and the length
    in frames also where it was recorded in seconds, which is where it times the rate meets the take's frames better."""
    takes = views.sessions(spark, sf_dir).select("seq_id", "n_frames", F.when(F.col("frame_rate") > 0, F.col("frame_rate")).alias("take_rate"))
    rows = views.samples(spark, sf_dir).join(takes, "seq_id", "left")
    rate = F.coalesce(F.when(F.col("mocap_frame_rate") > 0, F.col("mocap_frame_rate")), F.col("take_rate"))
    length = F.col("mocap_time_length")
    seconds = F.abs(length * rate - F.col("n_frames")) < F.abs(length - F.col("n_frames"))
    gender = F.lower(F.trim("gender"))
    return rows.select(
        "seq_id",
        F.regexp_replace(F.lower(F.trim("surface_model_type")), "[^a-z]", "").alias("model"),
        F.when(gender.isin("male", "female", "neutral"), gender).otherwise("neutral").alias("gender"),
        rounded(rate).alias("rate"),
        F.when(seconds, F.round(length * rate)).otherwise(length).cast("bigint").alias("n_frames"),
        F.size(F.coalesce("latent_labels", F.array().cast("array<string>"))).alias("n_latent"),
        F.slice("betas", 1, 10).alias("b"),
    ).select("*", rounded(F.aggregate(F.coalesce("b", F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.abs(x))).alias("shape")).drop("b")


def repeated_layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _layout(spark, sf_dir).select("layout_id", F.upper(labels.clean_label(F.col("label"))).alias("label"))
    return layouts.repeated_labels(rows)


QUERIES = {
    f.__name__: f
    for f in (
        layout_merge, layout_roundtrip, unknown_labels, layout_vertex_remap, path_keys, alias_files, pending_jobs, dataset_stats, subject_split, split_overlap,
        settings_grid, rate_overrides, repeated_layout_labels, normalized_samples,
    )
}

CLEAN = "string_split(replace(label, ' ', ''), ':')[-1]"
ORACLE_SQL = {
    "layout_merge": """SELECT marker_type, label, coalesce(array_to_string(list_sort(list_distinct(list(vid) FILTER (vid IS NOT NULL))), ','), '') AS vids, count(DISTINCT layout_id) AS n_layouts,
        count(DISTINCT distance_from_skin) AS n_distances FROM marker_layout GROUP BY ALL""",
    "layout_roundtrip": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY layout_id ORDER BY marker_type, label) - 1 AS o FROM marker_layout WHERE vid IS NOT NULL)
        SELECT layout_id, marker_type, count(*) AS n, sum(vid)::BIGINT AS vid_sum, min(o) AS first_ord FROM o GROUP BY ALL""",
    "unknown_labels": f"""{with_views('ses')}, t AS (SELECT unnest(labels) AS label FROM ses), c AS (SELECT DISTINCT {CLEAN} AS label FROM t WHERE label IS NOT NULL)
        SELECT label, label IN (SELECT label FROM marker_layout WHERE layout_id = 'superset') AS known FROM c""",
    "layout_vertex_remap": """WITH a AS (SELECT label, min(vid) AS vid FROM marker_layout WHERE surface_model_type = 'smplh' GROUP BY label), b AS (SELECT label, vid AS new_vid FROM marker_layout WHERE layout_id = 'superset'),
        m AS (SELECT a.vid, min(new_vid) AS new_vid FROM a JOIN b USING (label) WHERE a.vid IS NOT NULL GROUP BY a.vid)
        SELECT layout_id, ord, label, coalesce(new_vid, l.vid) AS vid FROM marker_layout l LEFT JOIN m ON l.vid = m.vid WHERE surface_model_type = 'smplh'""",
    "path_keys": f"""{with_views('ses')}, p AS (SELECT seq_id, string_split(mocap_fname, '/') AS s FROM ses)
        SELECT seq_id, s[-3] AS dataset, s[-2] AS subject, regexp_replace(s[-1], '\\.[^.]*$', '') AS motion, string_split(s[-1], '.')[-1] AS suffix FROM p""",
    "alias_files": f"""{with_views('ses')}, p AS (SELECT regexp_replace(mocap_fname, '\\.[^./]*$', '') AS stem, regexp_extract(mocap_fname, '\\.([^./]*)$', 1) AS suffix FROM ses)
        SELECT stem, array_to_string(list_sort(list_distinct(list(suffix))), ',') AS suffixes FROM p GROUP BY stem HAVING count(DISTINCT suffix) > 1""",
    "pending_jobs": f"""{with_views('ses')}, o AS (SELECT seq_id, dataset, subject, row_number() OVER (PARTITION BY subject ORDER BY seq_id) AS n FROM ses WHERE seq_id NOT IN (SELECT seq_id FROM stageii_samples WHERE seq_id IS NOT NULL))
        SELECT seq_id, dataset, subject FROM o WHERE n = 1""",
    "dataset_stats": f"""{with_views('ses')} SELECT dataset, median(len(labels))::DOUBLE AS median_markers, count(DISTINCT subject) AS n_subjects, count(*) AS n_motions,
        round(sum(CASE WHEN frame_rate > 0 THEN n_frames / frame_rate END) / 60, 6) AS minutes FROM ses GROUP BY dataset""",
    "subject_split": f"""{with_views('ses')}, s AS (SELECT seq_id, subject, string_split(string_split(mocap_fname, '/')[-1], '_')[1] AS motion, try_cast(regexp_extract(subject, '(\\d+)$', 1) AS INT) AS k FROM ses),
        t AS (SELECT seq_id, subject, motion, CASE WHEN k BETWEEN 1 AND 15 THEN 'train' WHEN k BETWEEN 20 AND 40 THEN 'vald' END AS split FROM s) SELECT * FROM t WHERE split IS NOT NULL AND motion IN ('sit', 'hop', 'walk', 'turn')""",
    "split_overlap": f"{with_views('ses')} SELECT DISTINCT dataset FROM ses WHERE frame_rate >= 100 AND dataset IN (SELECT dataset FROM ses WHERE frame_rate < 100)",
    "settings_grid": f"""{with_views('ses')}, d AS (SELECT DISTINCT dataset FROM ses) SELECT dataset, oc, ghost, printf('OC_%02d_G_%02d_real_%03d_synt_%03d', oc, ghost, 100, 100) AS data_id
        FROM d, (VALUES (0), (5), (10)) a(oc), (VALUES (0), (3)) b(ghost)""",
    "rate_overrides": f"""{with_views('ses', 'smp')}, d AS (SELECT dataset, median(frame_rate) AS r FROM ses WHERE frame_rate > 0 GROUP BY dataset), g AS (SELECT rig, median(frame_rate) AS r FROM ses WHERE frame_rate > 0 GROUP BY rig)
        SELECT ses.seq_id, round(coalesce(CASE WHEN mocap_frame_rate > 0 THEN mocap_frame_rate END, CASE WHEN frame_rate > 0 THEN frame_rate END, g.r, d.r), 6) AS rate
        FROM ses LEFT JOIN smp ON ses.seq_id = smp.seq_id LEFT JOIN d ON d.dataset = ses.dataset LEFT JOIN g ON g.rig = ses.rig""",
    "normalized_samples": f"""{with_views('ses', 'smp')}, j AS (SELECT smp.*, ses.n_frames AS nf, coalesce(CASE WHEN mocap_frame_rate > 0 THEN mocap_frame_rate END, CASE WHEN frame_rate > 0 THEN frame_rate END) AS r FROM smp LEFT JOIN ses USING (seq_id))
        SELECT seq_id, regexp_replace(lower(trim(surface_model_type)), '[^a-z]', '', 'g') AS model, CASE WHEN lower(trim(gender)) IN ('male', 'female', 'neutral') THEN lower(trim(gender)) ELSE 'neutral' END AS gender, round(r, 6) AS rate,
        (CASE WHEN abs(mocap_time_length * r - nf) < abs(mocap_time_length - nf) THEN round(mocap_time_length * r) ELSE mocap_time_length END)::BIGINT AS n_frames, coalesce(len(latent_labels), 0) AS n_latent,
        round(coalesce(list_sum(list_transform(betas[1:10], lambda x: abs(x))), 0), 6) AS shape FROM j""",
    "repeated_layout_labels": f"SELECT layout_id, upper({CLEAN}) AS label, count(*) AS n FROM marker_layout GROUP BY ALL HAVING count(*) > 1",
}
