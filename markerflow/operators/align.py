"""Setting sequences side by side: by frame, by vertex, by label, by the groups that a name begins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerflow.operators.temporal import l2_step


def alignment_report(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("seq_id", "frame")) -> DataFrame:
    """`seq_id, n_both, n_left, n_right`: how many frames both sides have, and only one of them."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, list(keys), "full")
    return both.groupBy(keys[0]).agg(
        F.count_if(F.col("_l") & F.col("_r")).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_left"), F.count_if(F.col("_l").isNull()).alias("n_right")
    )


def vertex_distances(frames: DataFrame, candidate: str, reference: str) -> DataFrame:
    """`seq_id, row, d`: the distance of each vertex of `candidate` from that of `reference`; what one side has more is left out."""
    n = (F.least(F.size(candidate), F.size(reference)) / 3).cast("int")
    part = lambda c, i: F.slice(c, i * 3 + 1, F.lit(3))
    far = F.transform(F.sequence(F.lit(0), n - 1), lambda i: l2_step(part(candidate, i), part(reference, i)))
    return frames.where(n > 0).select("seq_id", "row", F.explode(far).alias("d"))


def prefix_groups(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with `group_name`, once for every name among them that theirs begins with; an empty name is no group.

    A row meets groups by an equi-join on its prefixes, as many as its name has letters, so groups of any length are found."""
    groups = rows.where(F.length(name) > 0).select(F.col(name).alias("group_name")).distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(F.col(name), F.lit(1), i))
    return rows.where(F.length(name) > 0).withColumn("group_name", F.explode(prefixes)).join(groups, "group_name")


def simulated_offsets(points: DataFrame, latent: DataFrame) -> DataFrame:
    """`seq_id, frame, label, tx, ty, tz, residual`: seen markers of `points` against the latent markers of their sample, by label.

    A frame's simulated markers are the latent ones moved by the mean offset of the frame, `tx, ty, tz`; `residual` is the distance that is left.
    `latent` has `latent_labels` and `markers_latent`; latent markers with a missing axis don't count. Frames that meet none have no row."""
    places = latent.select("seq_id", F.explode(F.arrays_zip(F.col("latent_labels").alias("label"), F.col("markers_latent").alias("m"))).alias("l"))
    places = places.select("seq_id", F.col("l.label").alias("label"), *[F.get("l.m", F.lit(i)).alias(f"l{c}") for i, c in enumerate("xyz")]).dropna()
    met = points.join(places, ["seq_id", "label"]).select("seq_id", "frame", "label", *[(F.col(c) - F.col(f"l{c}")).alias(f"d{c}") for c in "xyz"])
    # A frame holds its markers: sums per frame, then each marker against them.
    frames = met.groupBy("seq_id", "frame").agg(
        *[F.avg(f"d{c}").alias(f"t{c}") for c in "xyz"], F.collect_list(F.struct("label", "dx", "dy", "dz")).alias("all")
    )
    rows = frames.select("seq_id", "frame", "tx", "ty", "tz", F.explode("all").alias("m"))
    square = sum((F.pow(F.col(f"m.d{c}") - F.col(f"t{c}"), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    return rows.select("seq_id", "frame", "m.label", "tx", "ty", "tz", F.sqrt(square).alias("residual"))


def gathered_rows(seen: DataFrame, latent: DataFrame) -> DataFrame:
    """`seq_id, frame, places`: the rows of `markers_latent` of the labels seen in each frame, by their position in `latent_labels`; a label counts once,
    one that the list doesn't have not at all."""
    frames = seen.groupBy("seq_id", "frame").agg(F.collect_set("label").alias("labels"))
    met = frames.join(latent.select("seq_id", "latent_labels", "markers_latent"), "seq_id")
    ids = F.filter(F.transform("labels", lambda x: F.array_position(F.col("latent_labels"), x)), lambda i: i > 0)
    return met.withColumn("places", F.transform(ids, lambda i: F.element_at("markers_latent", i.cast("int")))).where(F.size("places") > 0).select("seq_id", "frame", "places")
