"""Queries over labels: cleaning, availability, votes, alignment, scores and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.stats import exact_percentiles, met_on, rounded
from markerflow.operators import align, labels, views
from markerflow.operators.views import with_views
from markerflow.session import checkpointed, table


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.sessions(spark, sf_dir).select("seq_id", F.posexplode("labels").alias("marker_idx", "label"))
    return rows.withColumn("label", labels.padded_label(F.col("label"), F.col("marker_idx")))


def label_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.kept_labels(_typed(spark, sf_dir), exclude=["xxx", "zzz", "test"])
    return rows.select("seq_id", "marker_idx", labels.clean_label(F.col("label")).alias("label"), labels.subject_of(F.col("label")).alias("subject"))


def subject_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.subject_ids(_typed(spark, sf_dir))


def crowded_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).groupBy("seq_id").agg(F.count("label").alias("n"), F.countDistinct(labels.clean_label(F.col("label"))).alias("n_distinct"))
    return rows.withColumn("crowded", F.col("n") > 1.5 * F.col("n_distinct"))


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.frame_availability(views.points(spark, sf_dir), 0.9)


def occlusion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.occlusion_rates(views.points(spark, sf_dir)).withColumn("rate", rounded(F.col("rate")))


def zero_heavy_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.zero_heavy_tracks(views.points(spark, sf_dir))


def tracklet_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_votes(views.points(spark, sf_dir))


def label_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.overflow_labels(views.points(spark, sf_dir)).select("seq_id", "frame", "marker_idx", "final_label", "slot")


def compress_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.compressed_slots(views.points(spark, sf_dir))


def percent_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.with_seen(views.points(spark, sf_dir)).where("seen")
    return rows.groupBy("seq_id").agg(rounded(100 * F.avg(F.col("label").isNotNull().cast("double"))).alias("percent"))


def superset_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "marker_layout").where("layout_id = 'superset'").select("label", "ord")
    rows, _ = labels.in_canonical_order(views.points(spark, sf_dir), order)
    return rows.groupBy("seq_id", "ord", "label").agg(
        F.count("*").alias("n_frames"), F.count_if((F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)).alias("n_held"), rounded(F.max("z")).alias("z_max")
    )


def unmatched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in which no canonical label is seen."""
    order = table(spark, sf_dir, "marker_layout").where("layout_id = 'superset' and label like 'L%'").select("label", "ord")
    return labels.in_canonical_order(views.points(spark, sf_dir), order)[1]


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_seen(views.points(spark, sf_dir)).where("seen").withColumnRenamed("marker_idx", "idx")


def exact_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings against themselves in reverse marker order, every fifth frame moved by twice the tolerance."""
    left = _cloud(spark, sf_dir)
    right = left.withColumn("idx", -F.col("idx")).withColumn("x", F.col("x") + F.when(F.col("frame") % 5 == 0, 2e-4).otherwise(0.0))
    found = labels.exact_matches(left, right, 1e-4)
    return found.groupBy("seq_id").agg(F.count("*").alias("n_matched"), F.countDistinct("frame").alias("n_frames"), F.sum(F.col("left_idx") + F.col("right_idx")).alias("off"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events relabelled for every seventh event, as a labeller that errs would."""
    rows = table(spark, sf_dir, "events")
    wrong = F.when(F.col("event_type") == "view", "click").when(F.col("event_type") == "click", "none").otherwise("view")
    return rows.select("user_id", "event_id", F.col("event_type").alias("gt"), F.when(F.col("event_id") % 7 == 0, wrong).otherwise(F.col("event_type")).alias("rec"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.confusion(_pairs(spark, sf_dir))


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.class_scores(labels.confusion(_pairs(spark, sf_dir)))
    return rows.select("label", "support", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.macro_scores(labels.confusion(_pairs(spark, sf_dir), ["user_id"]), ["user_id"])
    return rows.select("user_id", "n_labels", *[rounded(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def _take_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per take the share of seen readings that carry a label, with the keys of its path."""
    scores = labels.with_seen(views.points(spark, sf_dir)).where("seen").groupBy("seq_id").agg(F.avg(F.col("label").isNotNull().cast("double")).alias("score"), F.count("*").alias("n"))
    parts = F.split("mocap_fname", "/")
    keyed = views.sessions(spark, sf_dir).select(
        "seq_id", F.element_at(parts, -3).alias("dataset"), F.element_at(parts, -2).alias("subject"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("motion_id")
    )
    return keyed.join(scores, "seq_id")


def _rolled(rows: DataFrame) -> DataFrame:
    """Figures of groups of takes; a group may be most of them."""
    rows = checkpointed(rows.select("group_name", "n", "score"))
    sums = rows.groupBy("group_name").agg(
        F.count("*").alias("n_takes"), F.sum("n").alias("n_readings"), rounded(F.avg("score")).alias("mean"), rounded(F.stddev_pop("score")).alias("std")
    )
    middle = exact_percentiles(rows, ["group_name"], "score", {"median": 0.5})
    return met_on(sums, middle.withColumn("median", rounded(F.col("median"))), ["group_name"])


def rollup_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of takes whose subject begins with a subject's name: s001 also takes s0011."""
    return _rolled(align.prefix_groups(_take_scores(spark, sf_dir), "subject"))


#: Motions whose takes are gathered by a part of their name; the groups may overlap.
MOTIONS = ["walk", "hop", "turn", "take0", "take01", "carry"]


def rollup_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(m,) for m in MOTIONS], "group_name string")
    met = _take_scores(spark, sf_dir).join(F.broadcast(names), F.contains(F.col("motion_id"), F.col("group_name")))
    return _rolled(met)


def rollup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = _take_scores(spark, sf_dir)
    return _rolled(takes.withColumn("group_name", F.explode(F.array("dataset", F.lit("all")))))


def named_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned labels with their other names replaced, after a table of them: the descriptions of the canonical list."""
    cleaned = _typed(spark, sf_dir).withColumn("label", labels.clean_label(F.col("label")))
    superset = table(spark, sf_dir, "marker_layout").where("layout_id = 'superset' and description is not null")
    aliases = superset.select(F.regexp_replace("description", " ", "").alias("alias"), F.col("label").alias("name"))
    return labels.renamed_labels(cleaned, aliases).select("seq_id", "marker_idx", "label")


def subject_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the first subject of each take, and whether each take has what was asked for."""
    typed = _typed(spark, sf_dir)
    asked = labels.subject_ids(typed).where("subject_no = 0").select("seq_id", "subject").unionByName(
        views.sessions(spark, sf_dir).where("seq_id like '%5'").select("seq_id", F.lit("nobody").alias("subject"))
    )
    kept, missing = labels.of_subjects(typed, asked)
    n = kept.groupBy("seq_id").agg(F.count("*").alias("n"))
    return n.join(missing.groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("missing")), "seq_id", "full")


QUERIES = {
    f.__name__: f
    for f in (
        label_clean, subject_ids, crowded_takes, availability, occlusion_rate, zero_heavy_tracks, tracklet_mode, label_overflow, compress_points,
        percent_labelled, superset_align, exact_match_join, confusion_matrix, label_metrics, sequence_scores, rollup_subject, rollup_motion, rollup_total,
        named_labels, subject_points, unmatched_frames,
    )
}

TYPED = f"""{with_views("ses")}, u AS (SELECT seq_id, unnest(labels) AS l, unnest(range(len(labels))) AS marker_idx FROM ses),
    typed AS (SELECT seq_id, marker_idx, coalesce(l, '*' || marker_idx) AS label FROM u)"""
SUBJECT = "CASE WHEN contains(label, ':') THEN split_part(label, ':', 1) ELSE 'null' END"
CLEAN = "string_split(replace(label, ' ', ''), ':')[-1]"
PAIRS = """pairs AS (SELECT user_id, event_id, event_type AS gt, CASE WHEN event_id % 7 = 0 THEN CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'none' ELSE 'view' END ELSE event_type END AS rec FROM events)"""
SCORES = """lab AS (SELECT {k} gt AS label FROM pairs UNION SELECT {k} rec FROM pairs),
    sc AS (SELECT {k2} label, (SELECT count(*) FROM pairs p WHERE {j} p.gt = label) AS support, (SELECT count(*) FROM pairs p WHERE {j} p.rec = label) AS predicted,
        (SELECT count(*) FROM pairs p WHERE {j} p.rec = label AND p.gt = label) AS hits FROM lab),
    pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS pcs, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rcl FROM sc),
    fs AS (SELECT *, CASE WHEN pcs + rcl > 0 THEN 2 * pcs * rcl / (pcs + rcl) ELSE 0 END AS f1 FROM pr)"""
TAKES = f"""{with_views("pts", "ok", "ses")}, s AS (SELECT seq_id, avg((label IS NOT NULL)::INT) AS score, count(*) AS n FROM ok WHERE seen GROUP BY seq_id),
    takes AS (SELECT seq_id, string_split(mocap_fname, '/')[-3] AS dataset, string_split(mocap_fname, '/')[-2] AS subject, regexp_replace(string_split(mocap_fname, '/')[-1], '\\.[^.]*$', '') AS motion_id, score, n FROM ses JOIN s USING (seq_id))"""
ROLL = "count(*) AS n_takes, sum(n) AS n_readings, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(median(score), 6) AS median"

ORACLE_SQL = {
    "label_clean": f"{TYPED} SELECT seq_id, marker_idx, {CLEAN} AS label, {SUBJECT} AS subject FROM typed WHERE NOT starts_with(label, '*') AND label NOT IN ('xxx', 'zzz', 'test')",
    "subject_ids": f"{TYPED}, f AS (SELECT seq_id, {SUBJECT} AS subject, min(marker_idx) AS first_idx FROM typed GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY first_idx) - 1 AS subject_no FROM f",
    "crowded_takes": f"{TYPED} SELECT seq_id, count(label) AS n, count(DISTINCT {CLEAN}) AS n_distinct, count(label) > 1.5 * count(DISTINCT {CLEAN}) AS crowded FROM typed GROUP BY seq_id",
    "availability": f"{with_views('pts', 'ok')} SELECT seq_id, frame, count(*) AS n_markers, count_if(seen) AS n_seen FROM ok GROUP BY ALL HAVING count_if(seen) >= 0.9 * count(*)",
    "occlusion_rate": f"{with_views('pts', 'ok')} SELECT seq_id, count(*) AS n, count_if(NOT seen) AS occluded, round(avg((NOT seen)::INT), 6) AS rate FROM ok GROUP BY seq_id",
    "zero_heavy_tracks": f"""{with_views('pts')}, z AS (SELECT seq_id, marker_idx, list_sum(list_transform([x, y, z], lambda v: CASE WHEN v IS NULL OR isnan(v) OR v = 0 THEN 1 ELSE 0 END)) AS k FROM pts)
        SELECT seq_id, marker_idx FROM z GROUP BY ALL HAVING sum(k) >= count(*)""",
    "tracklet_mode": f"""{with_views('pts', 'ok')}, v AS (SELECT seq_id, marker_idx, label, count(*) AS n, min(frame) AS f FROM ok WHERE seen AND label IS NOT NULL GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY seq_id, marker_idx ORDER BY n DESC, f, label) AS r FROM v), t AS (SELECT DISTINCT seq_id, marker_idx FROM pts)
        SELECT t.seq_id, t.marker_idx, coalesce(b.label, 'nan') AS label, coalesce(n, 0) AS n FROM t LEFT JOIN b ON t.seq_id = b.seq_id AND t.marker_idx = b.marker_idx AND r = 1""",
    "label_overflow": f"""{with_views('pts', 'ok')}, c AS (SELECT *, CASE WHEN label IS NULL OR label = 'nan' OR count(*) OVER (PARTITION BY seq_id, frame, label) > 1 THEN 'nan' ELSE label END AS final_label FROM ok WHERE seen)
        SELECT seq_id, frame, marker_idx, final_label, CASE WHEN final_label = 'nan' THEN row_number() OVER (PARTITION BY seq_id, frame, final_label ORDER BY marker_idx) - 1 END AS slot FROM c""",
    "compress_points": f"{with_views('pts', 'ok')} SELECT seq_id, frame, row_number() OVER (PARTITION BY seq_id, frame ORDER BY marker_idx) - 1 AS slot, marker_idx FROM ok WHERE seen",
    "percent_labelled": f"{with_views('pts', 'ok')} SELECT seq_id, round(100 * avg((label IS NOT NULL)::INT), 6) AS percent FROM ok WHERE seen GROUP BY seq_id",
    "superset_align": f"""{with_views('pts', 'ok')}, o AS (SELECT label, ord FROM marker_layout WHERE layout_id = 'superset'), h AS (SELECT DISTINCT ON (seq_id, frame, label) seq_id, frame, ok.label, x, y, z FROM ok JOIN o USING (label) WHERE seen ORDER BY seq_id, frame, label, marker_idx),
        f AS (SELECT DISTINCT seq_id, frame FROM h), g AS (SELECT f.seq_id, f.frame, o.ord, o.label, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z FROM f CROSS JOIN o LEFT JOIN h ON f.seq_id = h.seq_id AND f.frame = h.frame AND o.label = h.label)
        SELECT seq_id, ord, label, count(*) AS n_frames, count_if(x <> 0 OR y <> 0 OR z <> 0) AS n_held, round(max(z), 6) AS z_max FROM g GROUP BY ALL""",
    "exact_match_join": f"""{with_views('pts', 'ok')}, a AS (SELECT * FROM ok WHERE seen), b AS (SELECT seq_id, frame, -marker_idx AS ri, x + CASE WHEN frame % 5 = 0 THEN 2e-4 ELSE 0 END AS x, y, z FROM a),
        m AS (SELECT a.seq_id, a.frame, a.marker_idx, count(*) AS n, min(ri) AS ri FROM a JOIN b ON a.seq_id = b.seq_id AND a.frame = b.frame AND abs(a.x - b.x) <= 1e-4 AND abs(a.y - b.y) <= 1e-4 AND abs(a.z - b.z) <= 1e-4 GROUP BY ALL)
        SELECT seq_id, count(*) AS n_matched, count(DISTINCT frame) AS n_frames, sum(marker_idx + ri)::BIGINT AS off FROM m WHERE n = 1 GROUP BY seq_id""",
    "confusion_matrix": f"WITH {PAIRS} SELECT gt, rec, count(*) AS n FROM pairs GROUP BY ALL",
    "label_metrics": f"WITH {PAIRS}, {SCORES.format(k='', k2='', j='')} SELECT label, support, round(pcs, 6) AS precision, round(rcl, 6) AS recall, round(f1, 6) AS f1 FROM fs",
    "sequence_scores": f"""WITH {PAIRS}, {SCORES.format(k='user_id,', k2='lab.user_id,', j='p.user_id = lab.user_id AND')}, t AS (SELECT user_id, avg((gt = rec)::INT) AS accuracy FROM pairs GROUP BY user_id)
        SELECT user_id, count(*) AS n_labels, round(any_value(accuracy), 6) AS accuracy, round(avg(pcs), 6) AS precision, round(avg(rcl), 6) AS recall, round(avg(f1), 6) AS f1 FROM fs JOIN t USING (user_id) GROUP BY user_id""",
    "unmatched_frames": f"""{with_views('pts', 'ok')}, o AS (SELECT label FROM marker_layout WHERE layout_id = 'superset' AND label LIKE 'L%')
        SELECT seq_id, frame FROM ok GROUP BY ALL HAVING coalesce(count_if(seen AND label IN (SELECT label FROM o)), 0) = 0""",
    "named_labels": f"""{TYPED}, c AS (SELECT seq_id, marker_idx, {CLEAN} AS label FROM typed), a AS (SELECT replace(description, ' ', '') AS alias, min(label) AS name FROM marker_layout WHERE layout_id = 'superset' AND description IS NOT NULL GROUP BY ALL)
        SELECT seq_id, marker_idx, coalesce(name, label) AS label FROM c LEFT JOIN a ON label = alias""",
    "subject_points": f"""{TYPED}, t AS (SELECT seq_id, marker_idx, {SUBJECT} AS subject FROM typed), f AS (SELECT seq_id, arg_min(subject, marker_idx) AS subject FROM t GROUP BY seq_id), n AS (SELECT seq_id, count(*) AS n FROM t JOIN f USING (seq_id, subject) WHERE NOT seq_id LIKE '%5' GROUP BY seq_id)
        SELECT seq_id, n, m.missing FROM n FULL JOIN (SELECT DISTINCT seq_id, 'nobody' AS missing FROM ses WHERE seq_id LIKE '%5') m USING (seq_id)""",
    "rollup_subject": f"{TAKES}, g AS (SELECT DISTINCT subject AS group_name FROM takes WHERE subject <> '') SELECT group_name, {ROLL} FROM takes JOIN g ON starts_with(subject, group_name) GROUP BY group_name",
    "rollup_motion": f"{TAKES}, g(group_name) AS (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in MOTIONS)}) SELECT group_name, {ROLL} FROM takes JOIN g ON contains(motion_id, group_name) GROUP BY group_name",
    "rollup_total": f"{TAKES} SELECT dataset AS group_name, {ROLL} FROM takes GROUP BY dataset UNION ALL SELECT 'all', {ROLL} FROM takes",
}
