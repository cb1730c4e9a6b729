"""Queries over numeric kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.points import finite
from markerflow.functions.stats import exact_percentiles
from markerflow.operators import augment, kernels, labels, temporal, views
from markerflow.operators.views import with_views
from markerflow.quality import units
from markerflow.session import checkpointed, first_by, table


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_seen(views.points(spark, sf_dir)).where("seen")


def sinkhorn_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which markers optimal transport finds again in the next frame, of which some are hidden and which has ghosts: how many are themselves, others, and none, and how
    many of those that are gone are told to be gone."""
    points = _seen(spark, sf_dir)
    ahead = points.withColumn("frame", F.col("frame") - 1).select("seq_id", "frame", "marker_idx", "label", "x", "y", "z")
    left = points.select("seq_id", "frame", F.col("marker_idx").alias("idx"), "x", "y", "z")
    right = augment.corrupted(ahead, 2, 1, 61).select("seq_id", "frame", F.col("marker_idx").alias("idx"), "x", "y", "z")
    there = right.select("seq_id", "frame", F.col("idx").alias("left_idx"), F.lit(True).alias("there"))
    # A ghost is -1 - its number, and no partner is -1: ghosts are told apart by going down by one more.
    rows = kernels.transported(left, right.withColumn("idx", F.when(F.col("idx") < 0, F.col("idx") - 1).otherwise(F.col("idx"))))
    rows = rows.join(there, ["seq_id", "frame", "left_idx"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    same, none = F.col("left_idx") == F.col("right_idx"), F.col("right_idx") == -1
    return rows.groupBy("seq_id").agg(
        F.count("*").alias("n"), F.count_if("there").alias("n_there"), F.count_if(same).alias("n_same"), F.count_if(~same & ~none).alias("n_wrong"), F.count_if(none & ~F.col("there")).alias("n_rightly_none")
    )


def rigid_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rigid motion of each frame's markers to those of the next frame."""
    now = _seen(spark, sf_dir).select("seq_id", "frame", "marker_idx", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    ahead = now.select("seq_id", (F.col("frame") - 1).alias("frame"), "marker_idx", *[F.col(f"a{c}").alias(f"b{c}") for c in "xyz"])
    rows = kernels.rigid_alignments(now.join(ahead, ["seq_id", "frame", "marker_idx"]), ["seq_id", "frame"]).where("n >= 4")
    rows = rows.select("seq_id", F.explode(F.create_map(F.lit("error"), "error", F.lit("turn"), F.sqrt(F.col("rx") ** 2 + F.col("ry") ** 2 + F.col("rz") ** 2))).alias("figure", "v"))
    rows = checkpointed(rows.where(finite("v")))
    middle = exact_percentiles(rows, ["seq_id", "figure"], "v", {"m": 0.5})
    of = lambda f: F.round(F.max(F.when(F.col("figure") == f, F.col("m"))), 5).alias(f)
    n = rows.where("figure = 'error'").groupBy("seq_id").agg(F.count("*").alias("n_frames"))
    return n.join(middle.groupBy("seq_id").agg(of("error"), of("turn")), "seq_id")


MAX_COMPONENTS = 1_000
#: Spread of a joint angle that is taken for granted beside what the poses show.
LEAST_VARIANCE = 0.01


def gmm_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest component of a mixture over whole body poses, one component a kind of motion, whose means, variances and shares come from all poses."""
    motion = F.get(F.split(F.element_at(F.split("mocap_fname", "/"), -1), "_"), F.lit(0))
    takes = views.sessions(spark, sf_dir).select("seq_id", motion.alias("motion")).where("motion is not null")
    poses = views.poses(spark, sf_dir).withColumn("vec", temporal.region("fullpose", "body")).where("vec is not null").select("seq_id", "frame", "vec")
    numbers = poses.join(takes, "seq_id").select("motion", F.posexplode("vec").alias("i", "v"))
    figures = numbers.groupBy("motion", "i").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")).groupBy("motion").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "mean", "var"))).alias("all")
    )
    # A row a kind of motion, of as many numbers as a body pose has.
    components = figures.orderBy("motion").limit(MAX_COMPONENTS + 1).collect()
    if len(components) > MAX_COMPONENTS:
        raise ValueError(f"more than {MAX_COMPONENTS} kinds of motion")
    if not components:
        return spark.createDataFrame([], "seq_id string, component int, n bigint, cost double")
    means = np.array([[x["mean"] for x in c["all"]] for c in components])
    precisions = np.stack([np.diag([1 / (x["var"] + LEAST_VARIANCE) for x in c["all"]]) for c in components])
    weights = np.array([float(c["n"]) for c in components])
    costs = kernels.mixture_residuals(poses, means, precisions, weights / weights.sum())
    return costs.groupBy("seq_id", "component").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 4).alias("cost"))


def surface_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the middle of each frame's vertices from its surface."""
    middle = F.transform(
        F.array(F.lit(0), F.lit(1), F.lit(2)),
        lambda k: F.aggregate(F.sequence(F.lit(0), (F.size("vertices") / 3).cast("int") - 1), F.lit(0.0), lambda s, i: s + F.get("vertices", i * 3 + k).cast("double")) / (F.size("vertices") / 3),
    )
    rows = views.mesh(spark, sf_dir).where((F.size("vertices") >= 9) & (F.size("vertices") % 3 == 0)).select("seq_id", "frame", F.lit(0).alias("point_id"), middle.alias("xyz"), "vertices")
    return kernels.surface_distances(rows).groupBy("seq_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 5).alias("distance"))


def attached_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent markers, in metres and about the middle of the first mesh frame, attached to its vertices and read off on every frame: how far they travel."""
    samples = table(spark, sf_dir, "stageii_samples")
    once = first_by(samples.select("seq_id", "latent_labels", "markers_latent", "ingested_at"), ["seq_id"])
    latent = units.convert(once, units.latent_units(samples), ["markers_latent"])
    marks = latent.select("seq_id", F.explode(F.arrays_zip(F.col("latent_labels").alias("label"), F.col("markers_latent").alias("m"))).alias("l")).select("seq_id", "l.label", F.col("l.m").alias("xyz"))
    mesh = views.mesh(spark, sf_dir)
    first = mesh.where("row = 0 and size(vertices) >= 9").select("seq_id", "vertices")
    fixed = kernels.attachments(marks.where(F.forall("xyz", finite)).join(first, "seq_id"))
    rows = kernels.decoded_markers(fixed, mesh)
    return rows.groupBy("seq_id", "label").agg(F.count("*").alias("n"), *[F.round(F.max(c) - F.min(c), 4).alias(f"span_{c}") for c in "xyz"])


QUERIES = {f.__name__: f for f in (sinkhorn_matches, rigid_align, gmm_prior, surface_distances, attached_markers)}
ORACLE_SQL: dict[str, str] = {
    "gmm_prior": f"""{with_views('pose', 'ses')}, b AS (SELECT seq_id, frame, unnest(fullpose[4:66]) AS v, unnest(range(63)) AS i FROM pose WHERE len(fullpose) >= 66),
        m AS (SELECT seq_id, string_split(string_split(mocap_fname, '/')[-1], '_')[1] AS motion FROM ses WHERE mocap_fname IS NOT NULL), s AS (SELECT motion, i, count(*) AS n, avg(v) AS mean, var_pop(v) + 0.01 AS var FROM b JOIN m USING (seq_id) GROUP BY ALL),
        w AS (SELECT motion, row_number() OVER (ORDER BY motion) - 1 AS component, max(n) / sum(max(n)) OVER () AS w, sum(ln(var)) / 2 AS d FROM s GROUP BY motion),
        c AS (SELECT seq_id, frame, component, 0.5 * sum((v - mean) ** 2 / var) + any_value(d) - ln(any_value(w)) AS cost FROM b JOIN s USING (i) JOIN w USING (motion) GROUP BY ALL),
        k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY cost, component) = 1) SELECT seq_id, component, count(*) AS n, round(avg(cost), 4) AS cost FROM k GROUP BY ALL""",
}
