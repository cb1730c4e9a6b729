"""Samples as they are delivered, normalised and released, and the jobs that are still to be done for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from markerflow.operators.temporal import region

#: Fixed by the delivered formats: where each field of a record lies in the newer and in the older form; the first path that holds a value counts.
NEWER = {
    "gender": ["stageii_debug_details.cfg.surface_model.gender", "cfg.surface_model.gender", "gender"],
    "model": ["stageii_debug_details.cfg.surface_model.type", "cfg.surface_model.type", "surface_model_type"],
    "elapsed_s": ["stageii_debug_details.stageii_elapsed_time"],
    "rate": ["stageii_debug_details.mocap_frame_rate", "mocap_frame_rate"],
    "n_frames": ["stageii_debug_details.mocap_time_length", "mocap_time_length"],
    "poses": ["fullpose"],
    "trans": ["trans"],
    "betas": ["betas"],
    "latent_labels": ["latent_labels"],
    "marker_labels": ["stageii_debug_details.labels_obs", "labels_obs"],
}
OLDER = {
    "gender": ["ps.gender"],
    "model": ["ps.fitting_model"],
    "elapsed_s": [],
    "rate": ["mocap_framerate"],
    "n_frames": ["mocap_timelength"],
    "poses": ["pose_est_fullposes"],
    "trans": ["pose_est_trans"],
    "betas": ["shape_est_betas"],
    "latent_labels": ["shape_est_lmlabels"],
    "marker_labels": ["pose_est_mrk_labels"],
}


def normalized_records(raw: DataFrame) -> DataFrame:
    """`raw_id, form, gender, model, elapsed_s, rate, n_frames, n_poses, n_trans, n_betas, n_latent, n_labels, fault` of records in JSON.

    A record with poses and places under the newer names has form `newer`, one with poses under the older name `older`. The fault is `unreadable` for text that is no
    JSON object, `no poses` for records of neither form, `frames` where poses and places differ in number, else null; records with a fault stay. What is missing is
    `unknown`, a rate of 0, a length of as many frames as poses, and for lists a null number."""
    v = F.col("v")
    get = lambda paths, kind: F.coalesce(*[F.try_variant_get(v, f"$.{p}", kind) for p in paths], F.lit(None).cast(kind))
    count = lambda paths: F.coalesce(*[F.size(F.try_variant_get(v, f"$.{p}", "array<variant>")) for p in paths], F.lit(None).cast("int"))
    rows = raw.select("raw_id", F.try_parse_json("payload").alias("v"))
    rows = rows.withColumn("readable", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)))
    newer = count(NEWER["poses"]).isNotNull() & count(NEWER["trans"]).isNotNull()
    rows = rows.withColumn("form", F.when(F.col("readable") & newer, "newer").when(F.col("readable") & count(OLDER["poses"]).isNotNull(), "older"))

    def either(what: Column | None, field: str, kind: str = "") -> Column:
        one = lambda paths: get(paths, kind) if kind else count(paths)
        return F.when(F.col("form") == "newer", one(NEWER[field])).when(F.col("form") == "older", one(OLDER[field])).otherwise(F.lit(None)) if what is None else F.coalesce(either(None, field, kind), what)

    rows = rows.select(
        "raw_id", "form", "readable", either(F.lit("unknown"), "gender", "string").alias("gender"), either(F.lit("unknown"), "model", "string").alias("model"),
        either(None, "elapsed_s", "double").alias("elapsed_s"), either(F.lit(0.0), "rate", "double").alias("rate"),
        either(either(None, "poses").cast("double"), "n_frames", "double").cast("bigint").alias("n_frames"),
        *[either(None, f).alias(f"n_{name}") for f, name in (("poses", "poses"), ("trans", "trans"), ("betas", "betas"), ("latent_labels", "latent"), ("marker_labels", "labels"))],
    )
    fault = F.when(~F.col("readable"), "unreadable").when(F.col("form").isNull(), "no poses").when(~F.col("n_poses").eqNullSafe(F.col("n_trans")), "frames")
    return rows.withColumn("fault", fault).drop("readable")


def released_frames(poses: DataFrame) -> DataFrame:
    """`seq_id, frame, trans, poses` and the parts of the pose: root_orient, pose_body, pose_jaw, pose_eye, pose_hand; null where a model has no such part."""
    full = F.size("fullpose") >= 165
    return poses.where("fullpose is not null").select(
        "seq_id", "frame", "trans", F.col("fullpose").alias("poses"), F.slice("fullpose", 1, 3).alias("root_orient"), region("fullpose", "body").alias("pose_body"),
        F.when(full, F.slice("fullpose", 67, 3)).alias("pose_jaw"), F.when(full, F.slice("fullpose", 70, 6)).alias("pose_eye"), region("fullpose", "both_hands").alias("pose_hand"),
    )


def released_heads(samples: DataFrame, layout: DataFrame, num_betas: int = 16) -> DataFrame:
    """What a released record says once: `seq_id, gender, surface_model_type, mocap_frame_rate, mocap_time_length, markers_latent, latent_labels,
    markers_latent_vids, betas, num_betas`. Vertices are those of `label, vid` in `layout`, as a map without labels it doesn't have."""
    named = samples.select("seq_id", F.explode("latent_labels").alias("label")).join(layout.where("vid is not null").groupBy("label").agg(F.min("vid").alias("vid")), "label")
    vids = named.distinct().groupBy("seq_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "vid")))).alias("markers_latent_vids"))
    heads = samples.select(
        "seq_id", "gender", "surface_model_type", "mocap_frame_rate", "mocap_time_length", "markers_latent", "latent_labels", F.slice("betas", 1, num_betas).alias("betas")
    )
    return heads.join(vids, "seq_id", "left").withColumn("num_betas", F.size("betas"))


def write_absent(rows: DataFrame, folder: str, key: str = "seq_id") -> None:
    """Add to the Parquet folder the rows of keys that it doesn't hold yet; run again, it writes nothing."""
    spark: SparkSession = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(folder).select(key).distinct(), key, "left_anti")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    rows.write.mode("append").parquet(folder)


def populate_sources(samples: DataFrame, splits: DataFrame, gender: str | None = None, num_betas: int = 10) -> DataFrame:
    """`split, dataset, seq_id, betas`: the samples of the datasets of each split, of one gender if given, with the first shape values. A dataset may be in more splits than one."""
    rows = samples.where(F.col("gender") == gender) if gender else samples
    return rows.join(splits.distinct(), "dataset").select("split", "dataset", "seq_id", F.slice("betas", 1, num_betas).alias("betas"))


def resolved_genders(takes: DataFrame, settings: DataFrame, fallback: str | None = None) -> DataFrame:
    """`takes` (`folder`, `subject`) with `gender` from the `folder, text` settings: that of the subject, if the text has an object of its name, else that of the whole
    folder, else `fallback`; without a fallback, an unknown gender ends the query."""
    kind = "map<string, string>"
    read = settings.groupBy("folder").agg(F.min("text").alias("text")).select("folder", F.from_json("text", kind).alias("_s"))
    own = F.get(F.array(F.from_json(F.try_element_at("_s", F.col("subject")), kind)), F.lit(0))
    found = F.coalesce(F.try_element_at(own, F.lit("gender")), F.try_element_at("_s", F.lit("gender")), F.lit(fallback))
    rows = takes.join(read, "folder", "left").withColumn("gender", found).drop("_s")
    return rows if fallback else rows.withColumn("gender", F.coalesce("gender", F.raise_error(F.concat(F.lit("no gender for "), F.coalesce("subject", F.lit("null"))))))


def stage_jobs(jobs: DataFrame, done: DataFrame, key: str, per: str) -> DataFrame:
    """Jobs whose output isn't there yet; where nothing of a `per` is done, only the first by key, since the others need what it finds."""
    finished = done.select(key).distinct()
    begun = jobs.join(finished, key, "left_semi").select(per).distinct().withColumn("_begun", F.lit(True))
    waiting = jobs.join(finished, key, "left_anti").join(begun, per, "left")
    first = F.min(F.when(F.col("_begun").isNull(), F.col(key))).over(Window.partitionBy(per))
    return waiting.withColumn("_first", first).where("_begun or " + f"`{key}` = _first").select(*jobs.columns)
