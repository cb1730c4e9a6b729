"""Labels of markers: cleaning, availability, votes per track, and alignment with a canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerflow.functions.points import available

NO_LABEL = "nan"
MAX_ORDER = 10_000


def clean_label(label: Column) -> Column:
    """Without spaces, and only what follows the last colon."""
    return F.element_at(F.split(F.regexp_replace(label, " ", ""), ":"), -1)


def subject_of(label: Column) -> Column:
    """What stands before the first colon, else the text `null`."""
    return F.when(F.contains(label, F.lit(":")), F.get(F.split(label, ":"), F.lit(0))).otherwise(F.lit("null"))


def padded_label(label: Column, index: Column, named: Column | int = 0) -> Column:
    """Unnamed markers become *0, *1, ...; `named` is the number that the first index stands for."""
    return F.coalesce(label, F.concat(F.lit("*"), (index - F.lit(named) if isinstance(named, int) else index - named).cast("string")))


def subject_ids(labels: DataFrame) -> DataFrame:
    """`seq_id, subject, subject_no`: numbers in order of first appearance within a take."""
    firsts = labels.groupBy("seq_id", subject_of(F.col("label")).alias("subject")).agg(F.min("marker_idx").alias("first_idx"))
    return firsts.withColumn("subject_no", F.row_number().over(Window.partitionBy("seq_id").orderBy("first_idx")) - 1)


def kept_labels(df: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None, drop_unnamed: bool = True) -> DataFrame:
    """Rows by label: `only` overrides the other rules; unnamed labels begin with a star."""
    if only:
        return df.where(F.col("label").isin(only))
    kept = df
    if drop_unnamed:
        kept = kept.where(~F.startswith(F.col("label"), F.lit("*")))
    return kept.where(~F.col("label").isin(exclude)) if exclude else kept


def renamed_labels(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """`rows` with `label` replaced by the `name` of its `alias`, where it is one; of an alias of several names the first."""
    named = aliases.where("alias is not null").groupBy("alias").agg(F.min("name").alias("_name"))
    return rows.join(named, F.col("label") == F.col("alias"), "left").withColumn("label", F.coalesce("_name", "label")).drop("alias", "_name")


def of_subjects(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the subjects asked for (`seq_id, subject`), of takes that have all of them, and the subjects that a take doesn't have; the rows of such
    a take are left out."""
    told = rows.withColumn("subject", subject_of(F.col("label")))
    missing = asked.distinct().join(told.select("seq_id", "subject").distinct(), ["seq_id", "subject"], "left_anti")
    kept = told.join(asked.distinct(), ["seq_id", "subject"], "left_semi").join(missing.select("seq_id").distinct(), "seq_id", "left_anti")
    return kept, missing


def with_seen(points: DataFrame) -> DataFrame:
    return points.withColumn("seen", available("x", "y", "z"))


def frame_availability(points: DataFrame, least: float) -> DataFrame:
    """`seq_id, frame, n_markers, n_seen`: frames of which at least the share `least` of markers is seen."""
    seen = with_seen(points).groupBy("seq_id", "frame").agg(F.count("*").alias("n_markers"), F.count_if("seen").alias("n_seen"))
    return seen.where(F.col("n_seen") >= least * F.col("n_markers"))


def occlusion_rates(points: DataFrame) -> DataFrame:
    """`seq_id, n, occluded, rate`: the share of readings of a take that are missing."""
    return with_seen(points).groupBy("seq_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("seen")).alias("occluded"), F.avg((~F.col("seen")).cast("double")).alias("rate")
    )


def zero_heavy_tracks(points: DataFrame) -> DataFrame:
    """`seq_id, marker_idx`: tracks with as many zero coordinates as frames or more. Counted are coordinates, of which a
    missing reading has three, so a track that misses a third of its frames goes."""
    zeros = sum(((F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) == 0).cast("int") for c in "xyz"), F.lit(0))
    tracks = points.groupBy("seq_id", "marker_idx").agg(F.sum(zeros).alias("zeros"), F.count("*").alias("n"))
    return tracks.where("zeros >= n").select("seq_id", "marker_idx")


def label_votes(points: DataFrame) -> DataFrame:
    """`seq_id, marker_idx, label, n`: the label most often given to a seen reading of a track; of equals the one seen first.
    Tracks without a label get NO_LABEL and 0."""
    votes = with_seen(points).where("seen and label is not null").groupBy("seq_id", "marker_idx", "label").agg(
        F.count("*").alias("n"), F.min("frame").alias("first_frame")
    )
    best = votes.groupBy("seq_id", "marker_idx").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "first_frame", "label")).alias("b"))
    tracks = points.select("seq_id", "marker_idx").distinct()
    return tracks.join(best, ["seq_id", "marker_idx"], "left").select(
        "seq_id", "marker_idx", F.coalesce("b.label", F.lit(NO_LABEL)).alias("label"), F.coalesce("b.n", F.lit(0)).alias("n")
    )


def overflow_labels(points: DataFrame) -> DataFrame:
    """Per reading `final_label` and `slot`: a label given twice in a frame is given to none, and such readings and unlabelled
    ones get overflow slots from 0 in marker order; others have a null slot."""
    same = Window.partitionBy("seq_id", "frame", "label")
    doubled = F.col("label").isNull() | (F.col("label") == NO_LABEL) | (F.count("*").over(same) > 1)
    rows = with_seen(points).where("seen").withColumn("final_label", F.when(doubled, F.lit(NO_LABEL)).otherwise(F.col("label")))
    order = Window.partitionBy("seq_id", "frame", "final_label").orderBy("marker_idx")
    return rows.withColumn("slot", F.when(F.col("final_label") == NO_LABEL, F.row_number().over(order) - 1))


def compressed_slots(points: DataFrame) -> DataFrame:
    """`seq_id, frame, slot, marker_idx`: seen readings moved to the front of their frame; marker_idx inverts it."""
    order = Window.partitionBy("seq_id", "frame").orderBy("marker_idx")
    return with_seen(points).where("seen").select("seq_id", "frame", (F.row_number().over(order) - 1).alias("slot"), "marker_idx")


def in_canonical_order(points: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`seq_id, frame, ord, label, x, y, z`: every label of `order` in every frame that holds at least one of them, 0 where missing; of
    a label given twice the marker of the lowest index. And `seq_id, frame` of the frames that hold none, which are in no row.

    Frames carry arrays of what they hold, and the canonical list, whose size is checked, is met inside each
    frame: no pair of frames and labels is ever shuffled.
    """
    if order.count() > MAX_ORDER:
        raise ValueError(f"a canonical order holds at most {MAX_ORDER} labels")
    listed = order.agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("all"))
    seen = with_seen(points).join(F.broadcast(order.select("label", F.lit(True).alias("_listed"))), "label", "left")
    held = F.when(F.col("seen") & F.col("_listed"), F.struct("x", "y", "z"))
    once = seen.groupBy("seq_id", "frame", "label").agg(F.min_by(held, F.when(held.isNotNull(), F.col("marker_idx"))).alias("p"))
    frames = once.groupBy("seq_id", "frame").agg(F.map_from_entries(F.array_agg(F.when(F.col("p").isNotNull(), F.struct("label", "p")))).alias("m"))
    rows = frames.where(F.size("m") > 0).join(F.broadcast(listed)).select("seq_id", "frame", "m", F.explode("all").alias("o"))
    at = F.element_at("m", F.col("o.label"))
    aligned = rows.select("seq_id", "frame", "o.ord", "o.label", *[F.coalesce(at.getField(c), F.lit(0.0)).alias(c) for c in "xyz"])
    return aligned, frames.where(F.size("m") == 0).select("seq_id", "frame")


def exact_matches(left: DataFrame, right: DataFrame, atol: float = 1e-8) -> DataFrame:
    """`seq_id, frame, left_idx, right_idx`: points of both sides within `atol` on every axis; left points with exactly one such partner.

    An equi-join on frame and grid cell. A cell is far wider than the tolerance, and the right side is placed in every
    cell that its tolerance reaches, which is one cell for all but points at an edge.
    """
    cell = max(atol * 1e3, 1e-3)

    def cells(c: str) -> Column:
        return F.array_distinct(F.array(F.floor((F.col(c) - atol) / cell), F.floor((F.col(c) + atol) / cell)))

    a = left.select("seq_id", "frame", F.col("idx").alias("left_idx"), *[F.col(c).alias(f"a{c}") for c in "xyz"]).withColumn("cx", F.floor(F.col("ax") / cell))
    b = right.select("seq_id", "frame", F.col("idx").alias("right_idx"), *[F.col(c).alias(f"b{c}") for c in "xyz"]).withColumn("cx", F.explode(cells("bx")))
    near = F.lit(True)
    for c in "xyz":
        near = near & (F.abs(F.col(f"a{c}") - F.col(f"b{c}")) <= atol)
    met = a.join(b, ["seq_id", "frame", "cx"]).where(near)
    once = met.groupBy("seq_id", "frame", "left_idx").agg(F.count("*").alias("n"), F.min("right_idx").alias("right_idx"))
    return once.where("n = 1").drop("n")


def confusion(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`keys, gt, rec, n`."""
    return pairs.groupBy(*(keys or []), "gt", "rec").count().withColumnRenamed("count", "n")


def class_scores(confused: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`keys, label, support, precision, recall, f1` over the union of the labels of both sides; a ratio without a base is 0."""
    keys = keys or []
    gt = confused.groupBy(*keys, F.col("gt").alias("label")).agg(F.sum("n").alias("support"))
    rec = confused.groupBy(*keys, F.col("rec").alias("label")).agg(F.sum("n").alias("predicted"))
    hit = confused.where("gt = rec").groupBy(*keys, F.col("gt").alias("label")).agg(F.sum("n").alias("hits"))
    rows = gt.join(rec, [*keys, "label"], "full").join(hit, [*keys, "label"], "left").fillna(0, ["support", "predicted", "hits"])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rows = rows.withColumn("precision", share("hits", "predicted")).withColumn("recall", share("hits", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rows.select(*keys, "label", "support", "precision", "recall", f1.alias("f1"))


def macro_scores(confused: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`keys, n_labels, accuracy, precision, recall, f1`: means over all labels."""
    keys = keys or []
    totals = confused.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gt") == F.col("rec"), F.col("n")).otherwise(0)).alias("hits"))
    scores = class_scores(confused, keys).groupBy(*keys).agg(
        F.count("*").alias("n_labels"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")
    )
    both = scores.join(totals, keys) if keys else scores.crossJoin(totals)
    return both.select(*keys, "n_labels", (F.col("hits") / F.col("n")).alias("accuracy"), "precision", "recall", "f1")
