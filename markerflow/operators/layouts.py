"""Marker layouts and catalogues of takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layout_from_json(texts: DataFrame) -> DataFrame:
    """`layout_id, marker_type, label, vid, ord, distance_from_skin, surface_model_type` from one JSON text per layout_id.

    A text holds `markersets`, each with a type, a distance and a map of labels to vertex numbers, and perhaps the
    type of the surface model. Rows are numbered by type, then label."""
    shape = "struct<markersets: array<struct<type: string, distance_from_skin: double, indices: map<string, int>>>, surface_model_type: string>"
    read = texts.select("layout_id", F.from_json("text", shape).alias("j"))
    sets = read.select("layout_id", F.coalesce("j.surface_model_type", F.lit("smplx")).alias("surface_model_type"), F.explode("j.markersets").alias("s"))
    rows = sets.select("layout_id", "surface_model_type", F.col("s.type").alias("marker_type"), "s.distance_from_skin", F.explode("s.indices").alias("label", "vid"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("layout_id").orderBy("marker_type", "label")) - 1)


def layout_to_json(layout: DataFrame) -> DataFrame:
    """`layout_id, text`: the JSON text of each layout; null vertex numbers are left out."""
    sets = layout.where("vid is not null").groupBy("layout_id", "marker_type", "surface_model_type").agg(
        F.min("distance_from_skin").alias("distance_from_skin"), F.array_sort(F.collect_list(F.struct("label", "vid"))).alias("pairs")
    )
    one = F.struct(F.col("marker_type").alias("type"), "distance_from_skin", F.map_from_entries("pairs").alias("indices"))
    listed = sets.groupBy("layout_id").agg(F.min("surface_model_type").alias("surface_model_type"), F.collect_list(one).alias("markersets"))
    return listed.select("layout_id", F.to_json(F.struct("markersets", "surface_model_type")).alias("text"))


def repeated_labels(layout: DataFrame) -> DataFrame:
    """`layout_id, label, n`: labels that a layout gives more than once."""
    return layout.groupBy("layout_id", "label").agg(F.count("*").alias("n")).where("n > 1")


def merged_layout(layouts: DataFrame) -> DataFrame:
    """`marker_type, label, vids, n_layouts, n_distances`: the union of layouts by type and label; more than one distance is a conflict."""
    return layouts.groupBy("marker_type", "label").agg(
        F.array_sort(F.collect_set("vid")).alias("vids"), F.countDistinct("layout_id").alias("n_layouts"), F.countDistinct("distance_from_skin").alias("n_distances")
    )


def subset_layout(layout: DataFrame, labels: DataFrame) -> DataFrame:
    return layout.join(labels.select("label").distinct(), "label", "left_semi")


def filtered_layout(
    layout: DataFrame, exclude_types: list[str] | None = None, exclude_labels: DataFrame | None = None, only_labels: DataFrame | None = None,
    aliases: DataFrame | None = None, include_nan: bool = False,
) -> DataFrame:
    """`layout` with labels replaced by `new_label` of `aliases` where it has one, then without the types and labels named and with the only ones named; each table
    of labels has a column `label`. `include_nan` adds a row without a vertex for what belongs to no marker to each layout that has rows left."""
    rows = layout
    if aliases is not None:
        rows = rows.join(aliases.groupBy("label").agg(F.min("new_label").alias("_new")), "label", "left").withColumn("label", F.coalesce("_new", "label")).select(*layout.columns)
    if exclude_types:
        rows = rows.where(~F.coalesce(F.col("marker_type").isin(exclude_types), F.lit(False)))
    if exclude_labels is not None:
        rows = rows.join(exclude_labels.select("label").distinct(), "label", "left_anti").select(*layout.columns)
    if only_labels is not None:
        rows = subset_layout(rows, only_labels).select(*layout.columns)
    if include_nan:
        rows = rows.unionByName(rows.select("layout_id").distinct().withColumn("label", F.lit("nan")), allowMissingColumns=True)
    return rows


def solved_layout(layout: DataFrame, solved: DataFrame) -> DataFrame:
    """`layout` with the vertices of `label, vid` rows in `solved` where they have one."""
    found = solved.groupBy("label").agg(F.min("vid").alias("_vid"))
    return layout.join(found, "label", "left").withColumn("vid", F.coalesce("_vid", "vid")).select(*layout.columns)


def known_and_unknown(labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`label, known`: whether each distinct label is in the dictionary."""
    listed = dictionary.select("label").distinct().withColumn("known", F.lit(True))
    return labels.select("label").where("label is not null").distinct().join(listed, "label", "left").select("label", F.coalesce("known", F.lit(False)).alias("known"))


def remapped_vertices(layout: DataFrame, mapping: DataFrame) -> DataFrame:
    """`layout` with vid replaced by `new_vid` of `mapping` where it has one; others pass through."""
    return layout.join(mapping.select(F.col("vid"), "new_vid"), "vid", "left").withColumn("vid", F.coalesce("new_vid", "vid")).drop("new_vid")


def path_keys(path: Column) -> dict[str, Column]:
    """dataset, subject and motion of a path .../dataset/subject/motion.ext, and its suffix."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    return {
        "dataset": F.element_at(parts, -3),
        "subject": F.element_at(parts, -2),
        "motion": F.regexp_replace(last, r"\.[^.]*$", ""),
        "suffix": F.element_at(F.split(last, r"\."), -1),
    }


def alias_files(paths: DataFrame) -> DataFrame:
    """`stem, suffixes`: stems that come with more than one suffix."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    suffix = F.regexp_extract("path", r"\.([^./]*)$", 1)
    return paths.groupBy(stem.alias("stem")).agg(F.array_join(F.array_sort(F.collect_set(suffix)), ",").alias("suffixes")).where(F.contains("suffixes", F.lit(",")))


def pending_jobs(jobs: DataFrame, done: DataFrame, key: str, per: str) -> DataFrame:
    """Jobs whose output is not there yet; of several for one `per` only the first by key."""
    open_jobs = jobs.join(done.select(key).distinct(), key, "left_anti")
    return open_jobs.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy(key))).where("_n = 1").drop("_n")


def dataset_stats(takes: DataFrame) -> DataFrame:
    """`dataset, median_markers, n_subjects, n_motions, minutes` from `dataset, subject, n_markers, n_frames, frame_rate`."""
    seconds = F.when(F.col("frame_rate") > 0, F.col("n_frames") / F.col("frame_rate"))
    return takes.groupBy("dataset").agg(
        F.median("n_markers").alias("median_markers"), F.countDistinct("subject").alias("n_subjects"), F.count("*").alias("n_motions"), (F.sum(seconds) / 60).alias("minutes")
    )


def settings_grid(*axes: DataFrame) -> DataFrame:
    """Every combination of small setting tables, each of a handful of rows."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.join(F.broadcast(axis))
    return out


def overridden(base: DataFrame, key: list[str], *overrides: DataFrame, columns: list[str]) -> DataFrame:
    """`base` with `columns` taken from the last of `overrides` that has a value for the row's keys."""
    out = base
    for over in overrides:
        shared = [k for k in key if k in over.columns]
        renamed = over.select(*shared, *[F.col(c).alias(f"_{c}") for c in columns])
        out = out.join(renamed, shared, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])
    return out
