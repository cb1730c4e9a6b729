"""The sequence views over the given tables; every delivery of a row counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.operators.ranges import RANGE, numbered
from markerflow.session import first_by, table


def ts_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one-dimensional sequences: `seq_id, frame, row, value, label`."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), "ts", "event_id", "value", F.col("event_type").alias("label"))
    placed = numbered(events, "seq_id", F.date_trunc("hour", "ts"), ["ts", "event_id"], "frame")
    return placed.select("seq_id", "frame", F.col("frame").alias("row"), "value", "label")


def vec_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vector sequences: `seq_id, frame, row, vec`."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq_id"), "vec_id", F.col("embedding").alias("vec"))
    placed = numbered(rows, "seq_id", F.floor(F.col("vec_id") / RANGE), ["vec_id"], "frame")
    return placed.select("seq_id", "frame", F.col("frame").alias("row"), "vec")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker readings: `seq_id, frame, marker_idx, label, x, y, z`."""
    rows = table(spark, sf_dir, "mocap_points")
    return first_by(rows, ["seq_id", "frame", "marker_idx"]).drop("ingested_at")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "mocap_sessions"), ["seq_id"])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "stageii_samples"), ["seq_id"])


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose frames: `seq_id, frame, fullpose, trans`."""
    return first_by(table(spark, sf_dir, "pose_frames"), ["seq_id", "frame"]).drop("ingested_at")


def with_rows(df: DataFrame) -> DataFrame:
    """Frames of sequences with `row`, their position from 0."""
    return numbered(df, "seq_id", F.floor(F.col("frame") / RANGE), ["frame"], "row")


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mesh frames: `seq_id, frame, vertices, row`."""
    return with_rows(first_by(table(spark, sf_dir, "mesh_frames"), ["seq_id", "frame"]).drop("ingested_at"))


def mesh_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "mesh_sequences"), ["seq_id"])


#: The same views as SQL, for the queries' own SQL.
SQL = {
    "ts": "ts AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type AS label FROM events)",
    "vec": "vec AS (SELECT label AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS vec FROM embeddings)",
    "pts": "pts AS (SELECT seq_id, frame, marker_idx, any_value(label) AS label, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z FROM mocap_points GROUP BY ALL)",
    "ok": "ok AS (SELECT *, coalesce(x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) AND NOT (x = 0 AND y = 0 AND z = 0), false) AS seen FROM pts)",
    "ses": "ses AS (SELECT DISTINCT ON (seq_id) * FROM mocap_sessions ORDER BY seq_id, ingested_at)",
    "smp": "smp AS (SELECT DISTINCT ON (seq_id) * FROM stageii_samples ORDER BY seq_id, ingested_at)",
    "pose": "pose AS (SELECT seq_id, frame, any_value(fullpose) AS fullpose, any_value(trans) AS trans FROM pose_frames GROUP BY ALL)",
    "mesh": "mesh AS (SELECT seq_id, frame, v AS vertices, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - 1 AS row FROM (SELECT seq_id, frame, any_value(vertices) AS v FROM mesh_frames GROUP BY ALL))",
    "cfg": "cfg AS (SELECT DISTINCT ON (seq_id) * FROM mesh_sequences ORDER BY seq_id, ingested_at)",
}


def with_views(*names: str) -> str:
    """The start of a SQL statement with the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names)
