"""Queries over delivered and released records, layouts for them and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.stats import rounded
from markerflow.operators import layouts, records, views
from markerflow.operators.views import with_views
from markerflow.plans import catalogue
from markerflow.session import table


def _superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "marker_layout").where("layout_id = 'superset'")


def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.normalized_records(table(spark, sf_dir, "raw_samples"))
    return rows.withColumns({"elapsed_s": rounded(F.col("elapsed_s")), "rate": rounded(F.col("rate"))})


def released_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and sums of the parts of each released frame."""
    parts = ["poses", "root_orient", "pose_body", "pose_jaw", "pose_eye", "pose_hand"]
    total = lambda c: F.round(F.aggregate(F.coalesce(c, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.abs(x)), 4)
    rows = records.released_frames(views.poses(spark, sf_dir))
    return rows.select("seq_id", "frame", *[total(F.col(c)).alias(c) for c in parts], (F.size("poses") - F.size("root_orient")).alias("n_rest"))


def released_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.released_heads(views.samples(spark, sf_dir), _superset(spark, sf_dir), 10)
    vids = F.aggregate(F.map_values(F.coalesce("markers_latent_vids", F.create_map().cast("map<string,int>"))), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return rows.select("seq_id", "gender", "surface_model_type", "mocap_time_length", F.size("markers_latent").alias("n_latent"), "num_betas", vids.alias("vid_sum"))


def populate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the male samples of the datasets of two splits, which are told apart by the length of their names."""
    takes = views.sessions(spark, sf_dir).select("seq_id", "dataset")
    splits = takes.select(F.when(F.length("dataset") % 2 == 0, "train").otherwise("vald").alias("split"), "dataset")
    rows = records.populate_sources(views.samples(spark, sf_dir).join(takes, "seq_id"), splits, "male", 10)
    return rows.select("split", "dataset", "seq_id", F.size("betas").alias("n_betas"), rounded(F.get("betas", F.lit(0))).alias("first"))


def resolved_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gender of each take from settings made of what its folder's samples say."""
    folder = F.regexp_replace("mocap_fname", "/[^/]*$", "")
    takes = views.sessions(spark, sf_dir).select("seq_id", "subject", folder.alias("folder"))
    told = views.samples(spark, sf_dir).where("gender in ('male', 'female', 'neutral')").select("seq_id", "gender").join(takes, "seq_id")
    settings = told.groupBy("folder").agg(F.min("gender").alias("gender")).select("folder", F.to_json(F.struct("gender")).alias("text"))
    return records.resolved_genders(takes, settings, "neutral").select("seq_id", "gender")


def layout_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of the body and head that the superset has, but for those with a vertex below 1,000, and the row of what belongs to none."""
    rows, known = table(spark, sf_dir, "marker_layout"), _superset(spark, sf_dir)
    aliases = known.select(F.lower("label").alias("label"), F.col("label").alias("new_label"))
    some = layouts.filtered_layout(rows, ["hand"], known.where("vid < 1000"), known, aliases, include_nan=True)
    return some.select("layout_id", "marker_type", "label", "vid", "ord")


def solved_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts with the superset's vertices for labels that samples hold, written as JSON and read again."""
    held = views.samples(spark, sf_dir).select(F.explode("latent_labels").alias("label")).distinct()
    solved = _superset(spark, sf_dir).join(held, "label", "left_semi").select("label", "vid")
    rows = layouts.solved_layout(table(spark, sf_dir, "marker_layout"), solved)
    return layouts.layout_from_json(layouts.layout_to_json(rows)).groupBy("layout_id", "marker_type").agg(F.count("*").alias("n"), F.sum("vid").alias("vid_sum"))


def catalogue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes still to be solved, with the rate that settings of dataset, rig and take give; one of a subject of which nothing is solved."""
    takes = views.sessions(spark, sf_dir).select("seq_id", "dataset", "subject")
    todo = records.stage_jobs(takes, table(spark, sf_dir, "stageii_samples").where("seq_id is not null"), "seq_id", "subject")
    return todo.join(catalogue.rate_overrides(spark, sf_dir), "seq_id", "left")


def settings_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of settings for every take, but for the plain setting of takes that are solved already."""
    grid = layouts.settings_grid(views.sessions(spark, sf_dir).select("seq_id"), spark.createDataFrame([(0,), (5,)], "oc int"), spark.createDataFrame([(0,), (3,)], "ghost int"))
    done = table(spark, sf_dir, "stageii_samples").select("seq_id").distinct().withColumns({"oc": F.lit(0), "ghost": F.lit(0)})
    return grid.join(done, ["seq_id", "oc", "ghost"], "left_anti").select("seq_id", "oc", "ghost")


QUERIES = {
    f.__name__: f
    for f in (normalized_records, released_frames, released_heads, populate_sources, resolved_genders, layout_subset, solved_layouts, catalogue_jobs, settings_jobs)
}

_PATH = lambda p: "'$." + p + "'"
_LEN = lambda p: f"CASE WHEN json_type(j, {_PATH(p)}) = 'ARRAY' THEN json_array_length(j, {_PATH(p)})::INT END"


def _sql(field: str, form: str, what: str) -> str:
    paths = {"newer": records.NEWER, "older": records.OLDER}[form][field]
    one = {
        "text": lambda p: f"json_extract_string(j, {_PATH(p)})",
        "number": lambda p: f"TRY_CAST(json_extract_string(j, {_PATH(p)}) AS DOUBLE)",
        "length": _LEN,
    }[what]
    return f"coalesce({', '.join([one(p) for p in paths] + ['NULL'])})"


def _either(field: str, what: str) -> str:
    return f"CASE form WHEN 'newer' THEN {_sql(field, 'newer', what)} WHEN 'older' THEN {_sql(field, 'older', what)} END"


_ABS = "round(coalesce(list_sum(list_transform({v}, lambda q: abs(q))), 0), 4)"
_LONG = "len(fullpose) >= 165"

ORACLE_SQL = {
    "normalized_records": f"""WITH r AS (SELECT raw_id, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS j FROM raw_samples),
        f AS (SELECT *, CASE WHEN json_type(j, '$.fullpose') = 'ARRAY' AND json_type(j, '$.trans') = 'ARRAY' THEN 'newer' WHEN json_type(j, '$.pose_est_fullposes') = 'ARRAY' THEN 'older' END AS form FROM r),
        n AS (SELECT raw_id, form, coalesce({_either('gender', 'text')}, 'unknown') AS gender, coalesce({_either('model', 'text')}, 'unknown') AS model, round({_either('elapsed_s', 'number')}, 6)::DOUBLE AS elapsed_s,
            round(coalesce({_either('rate', 'number')}, 0), 6) AS rate, trunc({_either('n_frames', 'number')})::BIGINT AS told, {', '.join(f"{_either(f, 'length')} AS n_{k}" for f, k in (('poses', 'poses'), ('trans', 'trans'), ('betas', 'betas'), ('latent_labels', 'latent'), ('marker_labels', 'labels')))}, j FROM f)
        SELECT raw_id, form, gender, model, elapsed_s, rate, coalesce(told, n_poses)::BIGINT AS n_frames, n_poses, n_trans, n_betas, n_latent, n_labels,
            CASE WHEN j IS NULL THEN 'unreadable' WHEN form IS NULL THEN 'no poses' WHEN n_poses IS DISTINCT FROM n_trans THEN 'frames' END AS fault FROM n""",
    "released_frames": f"""{with_views('pose')} SELECT seq_id, frame, {_ABS.format(v='fullpose')} AS poses, {_ABS.format(v='fullpose[1:3]')} AS root_orient,
        {_ABS.format(v='CASE WHEN len(fullpose) >= 66 THEN fullpose[4:66] END')} AS pose_body, {_ABS.format(v=f'CASE WHEN {_LONG} THEN fullpose[67:69] END')} AS pose_jaw, {_ABS.format(v=f'CASE WHEN {_LONG} THEN fullpose[70:75] END')} AS pose_eye,
        {_ABS.format(v=f'CASE WHEN {_LONG} THEN fullpose[76:165] WHEN len(fullpose) >= 156 THEN fullpose[67:156] END')} AS pose_hand, (len(fullpose) - 3)::INT AS n_rest FROM pose WHERE fullpose IS NOT NULL""",
    "released_heads": f"""{with_views('smp')}, l AS (SELECT DISTINCT seq_id, unnest(latent_labels) AS label FROM smp), v AS (SELECT label, min(vid) AS vid FROM marker_layout WHERE layout_id = 'superset' GROUP BY label),
        s AS (SELECT seq_id, sum(vid) AS vid_sum FROM l JOIN v USING (label) GROUP BY seq_id)
        SELECT seq_id, gender, surface_model_type, mocap_time_length, len(markers_latent)::INT AS n_latent, least(len(betas), 10)::INT AS num_betas, coalesce(vid_sum, 0)::BIGINT AS vid_sum FROM smp LEFT JOIN s USING (seq_id)""",
    "populate_sources": f"""{with_views('ses', 'smp')} SELECT CASE WHEN len(dataset) % 2 = 0 THEN 'train' ELSE 'vald' END AS split, dataset, seq_id, least(len(betas), 10)::INT AS n_betas, round(betas[1], 6) AS "first"
        FROM smp JOIN ses USING (seq_id) WHERE gender = 'male' AND dataset IS NOT NULL""",
    "resolved_genders": f"""{with_views('ses', 'smp')}, t AS (SELECT seq_id, regexp_replace(mocap_fname, '/[^/]*$', '') AS folder FROM ses),
        g AS (SELECT folder, min(gender) AS gender FROM smp JOIN t USING (seq_id) WHERE gender IN ('male', 'female', 'neutral') GROUP BY folder) SELECT seq_id, coalesce(gender, 'neutral') AS gender FROM t LEFT JOIN g USING (folder)""",
    "layout_subset": """WITH s AS (SELECT label, vid FROM marker_layout WHERE layout_id = 'superset'), a AS (SELECT layout_id, marker_type, coalesce(s.label, l.label) AS label, l.vid, ord FROM marker_layout l LEFT JOIN s ON lower(s.label) = l.label),
        r AS (SELECT * FROM a WHERE coalesce(marker_type, '') <> 'hand' AND label IN (SELECT label FROM s) AND label NOT IN (SELECT label FROM s WHERE vid < 1000))
        FROM r UNION ALL SELECT DISTINCT layout_id, NULL, 'nan', NULL::INT, NULL::INT FROM r""",
    "solved_layouts": f"""{with_views('smp')}, h AS (SELECT DISTINCT unnest(latent_labels) AS label FROM smp), s AS (SELECT label, vid FROM marker_layout WHERE layout_id = 'superset' AND label IN (SELECT label FROM h))
        SELECT layout_id, marker_type, count(*) AS n, sum(coalesce(s.vid, l.vid))::BIGINT AS vid_sum FROM marker_layout l LEFT JOIN s USING (label) WHERE coalesce(s.vid, l.vid) IS NOT NULL GROUP BY ALL""",
    "catalogue_jobs": f"""WITH r AS ({catalogue.ORACLE_SQL['rate_overrides']}), t AS (SELECT DISTINCT ON (seq_id) * FROM mocap_sessions ORDER BY seq_id, ingested_at), d AS (SELECT DISTINCT seq_id FROM stageii_samples WHERE seq_id IS NOT NULL),
        p AS (SELECT seq_id, dataset, subject, subject IN (SELECT subject FROM t WHERE seq_id IN (SELECT seq_id FROM d)) AS begun FROM t WHERE seq_id NOT IN (SELECT seq_id FROM d)),
        q AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq_id) AS n FROM p) SELECT seq_id, dataset, subject, rate FROM q LEFT JOIN r USING (seq_id) WHERE begun OR n = 1""",
    "settings_jobs": f"""{with_views('ses')} SELECT seq_id, oc, ghost FROM ses, (VALUES (0), (5)) a(oc), (VALUES (0), (3)) b(ghost)
        WHERE NOT (oc = 0 AND ghost = 0 AND seq_id IN (SELECT seq_id FROM stageii_samples WHERE seq_id IS NOT NULL))""",
}
