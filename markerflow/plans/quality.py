"""Queries of the data-quality operators, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.quality import drift, spikes, units
from markerflow.session import first_by, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.faulty_readings(table(spark, sf_dir, "mocap_points"), table(spark, sf_dir, "mocap_sessions"))


def p3_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_readings(table(spark, sf_dir, "mocap_points"), table(spark, sf_dir, "mocap_sessions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "raw_samples"))


def p4_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified_records(table(spark, sf_dir, "raw_samples"))


def _unit_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("mocap_points", "mocap_sessions", "pose_frames", "stageii_samples")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.foreign_units(*_unit_tables(spark, sf_dir))


def p5_points_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, sessions, _, _ = _unit_tables(spark, sf_dir)
    return units.points_in_metres(points, sessions).withColumns({c: F.round(c, 9) for c in "xyz"})


def p5_trans_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, poses, samples = _unit_tables(spark, sf_dir)
    once = first_by(poses.select("seq_id", "frame", "trans", "ingested_at"), ["seq_id", "frame"]).drop("ingested_at")
    return units.convert(once, units.translation_units(poses, samples), ["trans"]).withColumn("trans", F.transform("trans", lambda v: F.round(v, 9)))


def p5_latent_in_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "stageii_samples")
    once = first_by(samples.select("seq_id", "latent_labels", "markers_latent", "ingested_at"), ["seq_id"]).drop("ingested_at")
    whole = units.convert(once, units.latent_units(samples), ["markers_latent"])
    return whole.withColumn("markers_latent", F.transform("markers_latent", lambda m: F.transform(m, lambda v: F.round(v, 9))))


QUERIES = {
    "p3_found": p3_found,
    "p3_states": p3_states,
    "p4_found": p4_found,
    "p4_unified": p4_unified,
    "p5_found": p5_found,
    "p5_points_in_metres": p5_points_in_metres,
    "p5_trans_in_metres": p5_trans_in_metres,
    "p5_latent_in_metres": p5_latent_in_metres,
}
#: The units of records in SQL, from measured heights alone: takes `mu`, translations `tu` and latent markers `lu`, each with the factor `f` to metres. Words only
#: decide where nothing can be measured.
LATIN = "translate(lower(string_split(label, ':')[-1]), '{}', '{}')".format(*units.LOOKALIKES)
PLAIN = f"regexp_replace({LATIN}, '[^a-z]+', '_', 'g')"
EXPECTED = "CASE " + " ".join(f"WHEN contains(p, '{part}') THEN {height}" for part, height in units.BODY_HEIGHTS.items()) + " END"
SCALES = "(VALUES " + ", ".join(f"('{u}', {f!r})" for u, (f, _) in sorted(units.compositions(units.LENGTH_EDGES).items())) + ")"
NEAREST = "SELECT seq_id, unit, f FROM {t}, " + SCALES + " c(unit, f) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY abs(s + ln(f)), unit <> 'm') = 1"
HIGH = "coalesce(NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) AND z > 0, false)"
UNITS = f"""WITH hm AS (SELECT seq_id, marker_idx, median(z) FILTER ({HIGH}) AS z, max(label) FILTER ({HIGH}) AS label FROM mocap_points WHERE seq_id IS NOT NULL GROUP BY ALL),
    he AS (SELECT seq_id, z, {EXPECTED} AS e FROM (SELECT *, {PLAIN} AS p FROM hm)),
    hs AS (SELECT seq_id, coalesce(median(ln(z / e)) FILTER (e >= 0.3), arg_max(ln(z / e), e), ln(max(z) / 1.4)) AS s FROM he GROUP BY seq_id), mu AS ({NEAREST.format(t="hs")}),
    ts AS (SELECT seq_id, ln(median(trans[3]) FILTER (trans[3] > 0) / 0.94) AS s FROM pose_frames GROUP BY seq_id HAVING bool_or(trans IS NOT NULL)), tu AS ({NEAREST.format(t="ts")}),
    lm AS (SELECT seq_id, unnest(markers_latent)[3] AS z, unnest(latent_labels) AS label FROM stageii_samples), le AS (SELECT seq_id, z, {EXPECTED} AS e FROM (SELECT *, {PLAIN} AS p FROM lm) WHERE z > 0),
    ls AS (SELECT seq_id, median(ln(z / e)) AS s FROM le GROUP BY seq_id), lu AS ({NEAREST.format(t="ls")})"""
MISSING = "CASE WHEN coalesce(NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) AND NOT (x = 0 AND y = 0 AND z = 0), false) THEN round({c} * f, 9) END AS {c}"

ORACLE_SQL: dict[str, str] = {
    "p5_found": f"""{UNITS} SELECT 'markers' AS field_name, seq_id, unit FROM mu WHERE unit <> 'm' UNION ALL SELECT 'trans', seq_id, unit FROM tu WHERE unit <> 'm'
        UNION ALL SELECT 'markers_latent', seq_id, unit FROM lu WHERE unit <> 'm'""",
    "p5_points_in_metres": f"""{UNITS}, o AS (SELECT seq_id, frame, marker_idx, any_value(label) AS label, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM mocap_points GROUP BY ALL)
        SELECT seq_id, frame, marker_idx, label, {', '.join(MISSING.format(c=c) for c in 'xyz')} FROM o JOIN mu USING (seq_id)""",
    "p5_trans_in_metres": f"""{UNITS}, o AS (SELECT seq_id, frame, any_value(trans) AS trans FROM pose_frames GROUP BY ALL)
        SELECT seq_id, frame, list_transform(trans, lambda v: round(v * coalesce(f, 1), 9)) AS trans FROM o LEFT JOIN tu USING (seq_id)""",
    "p5_latent_in_metres": f"""{UNITS}, o AS (SELECT DISTINCT ON (seq_id) seq_id, latent_labels, markers_latent FROM stageii_samples ORDER BY seq_id, ingested_at)
        SELECT seq_id, latent_labels, list_transform(markers_latent, lambda m: list_transform(m, lambda v: round(v * coalesce(f, 1), 9))) AS markers_latent FROM o LEFT JOIN lu USING (seq_id)""",
}
