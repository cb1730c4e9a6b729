"""The queries of this subpackage, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.llm import canonical, encode, pack, split, subjects
from markerflow.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized_boundaries(table(spark, sf_dir, "mesh_frames"), table(spark, sf_dir, "mesh_sequences"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_pieces(table(spark, sf_dir, "mesh_frames"), table(spark, sf_dir, "mesh_sequences"))


#: Words of marker names, beside the names and descriptions of the list itself: other words for them, words for the sides, and fillers.
LABEL_WORDS = {
    "upper": "up", "lower": "low", "middle": "mid", "outer": "out", "outside": "out", "inner": "in", "inside": "in", "sternum": "stern", "breastbone": "stern",
    "back": "rear", "second": "two", "2": "two", "fifth": "five", "5": "five", "pinkie": "pinky", "forehead": "brow", "tailbone": "sacrum", "upperarm": "uparm",
    "large": "big", "little": "small",
}
LABEL_SIDES = {"l": "l left lft lef lt", "r": "r right rgt rig rt"}
LABEL_FILLERS = "side new mk marker the of copy old"


def label_words(spark: SparkSession) -> DataFrame:
    """`alias, meaning, kind` for marker names."""
    rows = [(a, m, "word") for a, m in LABEL_WORDS.items()] + [(a, s, "side") for s, names in LABEL_SIDES.items() for a in names.split()]
    return spark.createDataFrame(rows + [(a, None, "filler") for a in LABEL_FILLERS.split()], "alias string, meaning string, kind string")


def _label_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [*(table(spark, sf_dir, t) for t in ("mocap_sessions", "stageii_samples", "marker_layout")), label_words(spark)]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.mistyped_labels(*_label_tables(spark, sf_dir))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_labels(*_label_tables(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"))


def p6_tokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = encode.encode_corpus(table(spark, sf_dir, "documents"), counts_only=True, keep=("source",))
    return counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = encode.encode_corpus(table(spark, sf_dir, "documents"), counts_only=True)
    return pack.pack_items(sizes, pack.container_kinds(table(spark, sf_dir, "containers")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_container = _packed(spark, sf_dir).groupBy("container", "container_id", "capacity").agg(F.sum("n_tokens").alias("used"))
    return by_container.groupBy("container_id", "capacity").agg(
        F.count("*").alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        F.sum(F.col("capacity") - F.col("used")).alias("room_left"),
    )


def _subject_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subject_areas")]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found_subjects(*_subject_tables(spark, sf_dir))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(*_subject_tables(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_labels": p2_labels,
    "p6_ids": p6_ids,
    "p6_tokens_by_source": p6_tokens_by_source,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

ORACLE_SQL: dict[str, str] = {
    "p1_found": """
        WITH f AS (SELECT seq_id, frame, any_value(vertices) AS v FROM mesh_frames
                   WHERE seq_id IS NOT NULL AND frame IS NOT NULL GROUP BY ALL),
        lim AS (SELECT seq_id, any_value(chunk_size) AS chunk_size FROM mesh_sequences GROUP BY ALL),
        big AS (SELECT seq_id FROM f JOIN lim USING (seq_id) WHERE chunk_size IS NOT NULL
                GROUP BY seq_id, chunk_size HAVING count(*) > chunk_size),
        p AS (SELECT seq_id, frame, v, lag(frame) OVER w AS pf, lag(v) OVER w AS pv FROM f WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
        d AS (SELECT seq_id, frame, pf, list_transform(range(1, 35, 3), lambda i: sqrt((v[i]::DOUBLE - pv[i])^2 + (v[i+1]::DOUBLE - pv[i+1])^2 + (v[i+2]::DOUBLE - pv[i+2])^2)) AS s FROM p),
        m AS (SELECT seq_id, frame, pf, coalesce(list_max(s) <= 0.001, false) AS still, coalesce(list_min(s) > 0.25, false) AS jump FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame) - row_number() OVER (PARTITION BY seq_id, still ORDER BY frame) AS g FROM m),
        b AS (SELECT seq_id, min(frame) AS frame FROM r WHERE still GROUP BY seq_id, g HAVING count(*) >= 5
              UNION SELECT seq_id, frame FROM m WHERE jump OR frame - pf > 5)
        SELECT big.seq_id, coalesce(b.frame, -1) AS frame FROM big LEFT JOIN b USING (seq_id)
    """,
}
