"""Queries over points, vertices and poses in space."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.points import finite
from markerflow.functions.stats import exact_percentiles, ratio, rounded, summarize
from markerflow.operators import geometry, labels, temporal, views
from markerflow.operators.views import with_views
from markerflow.plans.sequences import L2
from markerflow.session import checkpointed, table


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_seen(views.points(spark, sf_dir)).where("seen")


def median_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.frame_offsets(views.points(spark, sf_dir))
    return rows.select("seq_id", "frame", *[rounded(F.col(c)).alias(c) for c in ("ox", "oy", "oz")])


def centred_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.centred(_seen(spark, sf_dir))
    return rows.groupBy("seq_id").agg(*[rounded(F.max(F.abs(c))).alias(f"reach_{c}") for c in "xyz"])


def rotated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = geometry.euler_rotation(F.col("x"), F.col("y"), F.col("z"), (90.0, 0.0, 30.0))
    rows = _seen(spark, sf_dir).select("seq_id", *[t.alias(c) for t, c in zip(turned, "xyz")])
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"), *[F.round(F.max(c), 4).alias(c) for c in "xyz"])


def facing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit mean of the forward direction of every pose of a sample; +y where it vanishes."""
    root = [F.get("fullpose", F.lit(i)) for i in range(3)]
    ahead = geometry.axis_angle_rotation([F.lit(0.0), F.lit(0.0), F.lit(1.0)], root)
    rows = views.poses(spark, sf_dir).where(F.size("fullpose") >= 3).select("seq_id", *[a.alias(c) for a, c in zip(ahead, "xyz")])
    means = rows.groupBy("seq_id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return means.select("seq_id", *[F.round(F.when(length < 1e-6, d).otherwise(F.col(c) / length), 5).alias(c) for c, d in (("x", 0.0), ("y", 1.0))])


def camera_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.get("trans", F.lit(i)) for i in range(3)]
    rows = views.poses(spark, sf_dir).where("trans is not null").select("seq_id", *[a.alias(c) for a, c in zip(at, "xyz")])
    axes = rows.select("seq_id", F.explode(F.create_map(*[c for a in "xyz" for c in (F.lit(a), F.col(a))])).alias("axis", "v"))
    middle = exact_percentiles(checkpointed(axes.where(finite("v"))), ["seq_id", "axis"], "v", {"m": 0.5})
    of = lambda a: F.max(F.when(F.col("axis") == a, F.col("m")))
    return middle.groupBy("seq_id").agg(rounded(of("x")).alias("x"), rounded(of("y")).alias("y"), rounded(F.greatest(F.lit(1.0), of("z") + 0.15)).alias("z"))


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views.mesh(spark, sf_dir)
    corner = F.transform(F.sequence(F.lit(0), (F.size("vertices") / 3).cast("int") - 1), lambda i: F.transform(F.slice("vertices", i * 3 + 1, 3), lambda v: v.cast("double")))
    return frames.select("seq_id", "frame", F.posexplode(corner).alias("vid", "xyz"))


def knn_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vertices of the first vertex of each frame among the others."""
    rows = _corners(spark, sf_dir)
    queries = rows.where("vid = 0").select("seq_id", "frame", F.col("vid").alias("query_id"), "xyz")
    points = rows.where("vid > 0").select("seq_id", "frame", F.col("vid").alias("point_id"), "xyz")
    near = geometry.nearest(queries, points, 3, ["seq_id", "frame"])
    return near.groupBy("seq_id", "rank").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 5).alias("distance"))


#: Triangles between the twelve vertices of a frame.
FACES = [(i, (i + 1) % 12, (i + 2) % 12) for i in range(12)]


def nring_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices within two edges of every third vertex of each mesh, over a strip of triangles."""
    meshes = views.mesh(spark, sf_dir).groupBy("seq_id").agg(F.max(F.size("vertices") / 3).cast("int").alias("n_vertices")).where("n_vertices >= 3")
    seeds = meshes.select("seq_id", F.explode(F.sequence(F.lit(0), F.col("n_vertices") - 1, F.lit(3))).alias("vid"))
    return geometry.mesh_rings(geometry.strip_faces(meshes), seeds, 2)


def vertex_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = spark.createDataFrame(FACES, "v0 int, v1 int, v2 int")
    rows = geometry.vertex_normals(views.mesh(spark, sf_dir), faces)
    return rows.groupBy("seq_id", "vid").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("nx", "ny", "nz")])


#: The parent of each of the first 22 joints of a body.
JOINT_PARENTS = [-1, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 12, 13, 14, 16, 17, 18, 19]


def joint_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the joints below each joint turn, over all poses."""
    tree = spark.createDataFrame([(c, p) for c, p in enumerate(JOINT_PARENTS)], "child int, parent int")
    below = geometry.descendants(tree.where("parent >= 0"), tree.select("child"), 8)
    turns = views.poses(spark, sf_dir).select(F.posexplode(F.slice("fullpose", 1, 66)).alias("i", "v")).groupBy(F.floor(F.col("i") / 3).cast("int").alias("child")).agg(F.sum(F.abs("v")).alias("turn"))
    return below.join(turns, "child").groupBy("root").agg(F.count("*").alias("n_below"), F.round(F.sum("turn"), 3).alias("turn"))


#: How many markers the pose weights were set for. A fixed value.
TRAINING_MARKERS = 46


def data_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.with_seen(views.points(spark, sf_dir)).groupBy("seq_id", "frame").agg(F.count("*").alias("n"), F.count_if("seen").alias("visible"))
    anneal = 1 + (F.col("n") - F.col("visible")) / F.col("n") * 2.0
    return rows.select("seq_id", "frame", "visible", rounded(anneal).alias("anneal"), rounded(F.when(F.col("visible") > 0, F.lit(float(TRAINING_MARKERS)) / F.col("visible"))).alias("weight"))


def unavailable_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    latent = views.samples(spark, sf_dir).select("seq_id", F.explode("latent_labels").alias("label"))
    return latent.join(_seen(spark, sf_dir).select("seq_id", "label").distinct(), ["seq_id", "label"], "left_anti")


def common_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    latent = views.samples(spark, sf_dir).select("seq_id", F.explode("latent_labels").alias("label")).distinct()
    held = _seen(spark, sf_dir).join(latent, ["seq_id", "label"])
    return held.groupBy("seq_id", "frame").agg(F.countDistinct("label").alias("n_common"))


def pose_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size("fullpose")
    norm = lambda c: F.sqrt(F.aggregate(F.coalesce(c, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x * x))
    rows = views.poses(spark, sf_dir).where("fullpose is not null")
    face = F.when(size >= 165, F.slice("fullpose", 67, 9))
    return rows.select(
        "seq_id", "frame", size.alias("size"), rounded(norm(F.slice("fullpose", 1, 3))).alias("root"), rounded(norm(temporal.region("fullpose", "body"))).alias("body"),
        rounded(norm(face)).alias("face"), rounded(norm(temporal.region("fullpose", "left_hand"))).alias("left_hand"),
    )


def render_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses in the largest layout with a neutral face: shorter vectors get zeros where they have no joints."""
    size = F.size("fullpose")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    wide = (
        F.when(size >= 165, F.concat(F.slice("fullpose", 1, 66), zeros(9), F.slice("fullpose", 76, 90)))
        .when(size >= 156, F.concat(F.slice("fullpose", 1, 66), zeros(9), F.slice("fullpose", 67, 90)))
        .otherwise(F.concat(F.slice("fullpose", 1, 66), zeros(99)))
    )
    rows = views.poses(spark, sf_dir).where("fullpose is not null").withColumn("wide", wide)
    return rows.select("seq_id", "frame", F.size("wide").alias("size"), rounded(F.aggregate("wide", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("total"))


def robust_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 50.0).alias("r"))
    sums = [F.round(F.sum(geometry.robust_loss(k, F.col("r"), 10.0)), 3).alias(k) for k in ("geman_mcclure", "signed_sqrt", "sigmoid")]
    return rows.groupBy("event_type").agg(*sums)


def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, p90 and max of steps of poses beside those of smoothed ones: differences and ratios; null where either is."""
    parts = views.with_rows(views.poses(spark, sf_dir).where("trans is not null").select("seq_id", "frame", F.get("trans", F.lit(2)).alias("value")))
    rows = temporal.scalar_deltas(temporal.smooth_once(parts, "value", "smoothed"), "value", "reference")
    rows = temporal.scalar_deltas(rows, "smoothed", "candidate")
    steps = rows.select("seq_id", F.explode(F.create_map(F.lit("c"), "candidate", F.lit("r"), "reference")).alias("side", "v")).where("v is not null")
    figures = summarize(steps, ["seq_id", "side"], "v").select("seq_id", "side", F.explode(F.create_map(*[x for m in ("mean", "p90", "max") for x in (F.lit(m), F.col(m))])).alias("metric", "v"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    both = figures.groupBy("seq_id", "metric").agg(of("c").alias("c"), of("r").alias("r"))
    return both.select("seq_id", "metric", rounded(F.col("c") - F.col("r")).alias("delta"), F.round(ratio(F.col("c"), F.col("r")), 4).alias("ratio"))


#: A turn that brings y up to z up.
UPRIGHT = (math.pi / 2, 0.0, 0.0)


def turned_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root orientation of every pose after the turn of its world."""
    rows = views.poses(spark, sf_dir).where(F.size("fullpose") >= 3)
    turned = geometry.composed_rotation([F.get("fullpose", F.lit(i)) for i in range(3)], UPRIGHT)
    return rows.select("seq_id", "frame", *[F.round(c, 5).alias(a) for c, a in zip(turned, "xyz")])


#: The smoothest waves over the 45 numbers of a hand, which are orthonormal.
HAND_WAVES = [[math.sqrt((1 if k == 0 else 2) / 45) * math.cos(math.pi * k * (2 * i + 1) / 90) for i in range(45)] for k in range(6)]


def hand_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left hands as six weights, and how far they are from what the weights stand for."""
    rows = views.poses(spark, sf_dir).withColumn("hand", temporal.region("fullpose", "left_hand")).where("hand is not null")
    rows = rows.withColumn("w", geometry.encoded(F.col("hand"), HAND_WAVES))
    off = temporal.l2_step(F.col("hand"), geometry.decoded(F.col("w"), HAND_WAVES))
    return rows.select("seq_id", "frame", *[F.round(F.get("w", F.lit(k)), 5).alias(f"w{k}") for k in range(6)], F.round(off, 5).alias("off"))


QUERIES = {
    f.__name__: f
    for f in (
        median_center, centred_spread, rotated_points, facing, camera_targets, knn_vertices, nring_neighbours, vertex_normals, joint_subtrees,
        data_weights, unavailable_latent, common_labels, pose_parts, render_poses, robust_losses, metric_deltas, turned_poses, hand_weights,
    )
}

OFFSETS = """off AS (SELECT seq_id, frame, coalesce(quantile_disc(x, 0.5) FILTER (k AND NOT isnan(x)), 0) AS ox, coalesce(quantile_disc(y, 0.5) FILTER (k AND NOT isnan(y)), 0) AS oy,
    coalesce(quantile_disc(z, 0.5) FILTER (k AND NOT isnan(z)), 0) AS oz FROM (SELECT *, coalesce(x <> 0, false) OR coalesce(y <> 0, false) OR coalesce(z <> 0, false) AS k FROM {t}) GROUP BY ALL)"""
CORNERS = "cor AS (SELECT seq_id, frame, i AS vid, list_transform(vertices[3 * i + 1 : 3 * i + 3], lambda v: v::DOUBLE) AS xyz FROM mesh, range(12) r(i))"
NORM = "sqrt(coalesce(list_sum(list_transform({v}, lambda q: q * q)), 0))"

Q = "sqrt(fullpose[1] ** 2 + fullpose[2] ** 2 + fullpose[3] ** 2)"

ORACLE_SQL = {
    "turned_poses": f"""{with_views('pose')}, q AS (SELECT seq_id, frame, cos({Q} / 2) AS c, CASE WHEN {Q} < 1e-12 THEN 0.5 ELSE sin({Q} / 2) / {Q} END AS h, fullpose AS p FROM pose WHERE len(fullpose) >= 3),
        d AS (SELECT seq_id, frame, c, p[1] * h AS x, p[2] * h AS y, p[3] * h AS z, cos(pi() / 4) AS a, sin(pi() / 4) AS b FROM q), e AS (SELECT seq_id, frame, a * c - b * x AS w, a * x + b * c AS x, a * y - b * z AS y, a * z + b * y AS z FROM d),
        f AS (SELECT *, sqrt(x * x + y * y + z * z) AS l, CASE WHEN w < 0 THEN -1.0 ELSE 1.0 END AS s FROM e) SELECT seq_id, frame, {', '.join(f'round({c} * s * CASE WHEN l < 1e-12 THEN 2.0 ELSE 2 * atan2(l, w * s) / l END, 5) AS {c}' for c in 'xyz')} FROM f""",
    "hand_weights": f"""{with_views('pose')}, h AS (SELECT seq_id, frame, CASE WHEN len(fullpose) >= 165 THEN fullpose[76:120] WHEN len(fullpose) >= 156 THEN fullpose[67:111] END AS v FROM pose), b AS (SELECT k, i, sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 45) * cos(pi() * k * (2 * i + 1) / 90) AS b FROM range(6) x(k), range(45) y(i)),
        w AS (SELECT seq_id, frame, k, sum(v[i + 1] * b) AS w FROM h, b WHERE v IS NOT NULL GROUP BY ALL), d AS (SELECT seq_id, frame, i, sum(w * b) AS r FROM w JOIN b USING (k) GROUP BY ALL),
        o AS (SELECT d.seq_id, d.frame, sqrt(sum((v[i + 1] - r) ** 2)) AS off FROM d JOIN h ON d.seq_id = h.seq_id AND d.frame = h.frame GROUP BY ALL)
        SELECT seq_id, frame, {', '.join(f'round(any_value(w) FILTER (k = {k}), 5) AS w{k}' for k in range(6))}, round(any_value(off), 5) AS off FROM w JOIN o USING (seq_id, frame) GROUP BY seq_id, frame""",
    "median_center": f"{with_views('pts')}, {OFFSETS.format(t='pts')} SELECT seq_id, frame, round(ox, 6) AS ox, round(oy, 6) AS oy, round(oz, 6) AS oz FROM off",
    "centred_spread": f"""{with_views('pts', 'ok')}, s AS (SELECT * FROM ok WHERE seen), {OFFSETS.format(t='s')} SELECT seq_id, round(max(abs(x - ox)), 6) AS reach_x, round(max(abs(y - oy)), 6) AS reach_y, round(max(abs(z - oz)), 6) AS reach_z
        FROM s JOIN off USING (seq_id, frame) GROUP BY seq_id""",
    "rotated_points": f"""{with_views('pts', 'ok')}, a AS (SELECT seq_id, x, y * cos(radians(90)) - z * sin(radians(90)) AS y, y * sin(radians(90)) + z * cos(radians(90)) AS z FROM ok WHERE seen)
        SELECT seq_id, count(*) AS n, round(max(x * cos(radians(30)) - y * sin(radians(30))), 4) AS x, round(max(x * sin(radians(30)) + y * cos(radians(30))), 4) AS y, round(max(z), 4) AS z FROM a GROUP BY seq_id""",
    "facing": f"""{with_views('pose')}, r AS (SELECT seq_id, fullpose[1] AS a, fullpose[2] AS b, fullpose[3] AS c, sqrt(fullpose[1] ** 2 + fullpose[2] ** 2 + fullpose[3] ** 2) AS t FROM pose WHERE len(fullpose) >= 3),
        k AS (SELECT seq_id, t, a / greatest(t, 1e-12) AS a, b / greatest(t, 1e-12) AS b, c / greatest(t, 1e-12) AS c FROM r),
        v AS (SELECT seq_id, CASE WHEN t < 1e-8 THEN 0 ELSE b * sin(t) + a * c * (1 - cos(t)) END AS x, CASE WHEN t < 1e-8 THEN 0 ELSE -a * sin(t) + b * c * (1 - cos(t)) END AS y FROM k),
        m AS (SELECT seq_id, avg(x) AS x, avg(y) AS y FROM v GROUP BY seq_id)
        SELECT seq_id, round(CASE WHEN sqrt(x * x + y * y) < 1e-6 THEN 0 ELSE x / sqrt(x * x + y * y) END, 5) AS x, round(CASE WHEN sqrt(x * x + y * y) < 1e-6 THEN 1 ELSE y / sqrt(x * x + y * y) END, 5) AS y FROM m""",
    "camera_targets": f"{with_views('pose')} SELECT seq_id, round(median(trans[1]), 6) AS x, round(median(trans[2]), 6) AS y, round(greatest(1.0, median(trans[3]) + 0.15), 6) AS z FROM pose WHERE trans IS NOT NULL GROUP BY seq_id",
    "knn_vertices": f"""{with_views('mesh')}, {CORNERS}, d AS (SELECT q.seq_id, q.frame, p.vid, {L2.format(a='q.xyz', b='p.xyz')} AS d FROM cor q JOIN cor p ON q.seq_id = p.seq_id AND q.frame = p.frame AND q.vid = 0 AND p.vid > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, frame ORDER BY d, vid) - 1 AS rank FROM d) SELECT seq_id, rank, count(*) AS n, round(avg(d), 5) AS distance FROM r WHERE rank < 3 GROUP BY ALL""",
    "nring_neighbours": f"""{with_views('mesh')}, n AS (SELECT seq_id, max(len(vertices)) // 3 AS n FROM mesh GROUP BY seq_id HAVING n >= 3)
        SELECT seq_id, a AS seed, b AS vid FROM n, range(100) x(a), range(100) y(b) WHERE a < n AND b < n AND a % 3 = 0 AND least((a - b + n) % n, (b - a + n) % n) <= 4""",
    "vertex_normals": f"""{with_views('mesh')}, f AS (SELECT i AS v0, (i + 1) % 12 AS v1, (i + 2) % 12 AS v2 FROM range(12) r(i)),
        p AS (SELECT seq_id, frame, v0, v1, v2, list_transform(range(3), lambda k: vertices[3 * v1 + k + 1]::DOUBLE - vertices[3 * v0 + k + 1]) AS u, list_transform(range(3), lambda k: vertices[3 * v2 + k + 1]::DOUBLE - vertices[3 * v0 + k + 1]) AS w FROM mesh, f),
        n AS (SELECT seq_id, frame, unnest([v0, v1, v2]) AS vid, u[2] * w[3] - u[3] * w[2] AS nx, u[3] * w[1] - u[1] * w[3] AS ny, u[1] * w[2] - u[2] * w[1] AS nz FROM p),
        s AS (SELECT seq_id, frame, vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz, greatest(sqrt(sum(nx) ** 2 + sum(ny) ** 2 + sum(nz) ** 2), 1e-12) AS l FROM n GROUP BY ALL)
        SELECT seq_id, vid, count(*) AS n, round(avg(nx / l), 4) AS nx, round(avg(ny / l), 4) AS ny, round(avg(nz / l), 4) AS nz FROM s GROUP BY ALL""",
    "joint_subtrees": f"""WITH RECURSIVE {with_views('pose')[5:]}, t(child, parent) AS (VALUES {', '.join(f'({c}, {p})' for c, p in enumerate(JOINT_PARENTS))}),
        b AS (SELECT parent AS root, child FROM t WHERE parent >= 0 UNION ALL SELECT b.root, t.child FROM b JOIN t ON t.parent = b.child),
        v AS (SELECT unnest(fullpose[1:66]) AS v, unnest(range(66)) AS i FROM pose WHERE fullpose IS NOT NULL), s AS (SELECT i // 3 AS child, sum(abs(v)) AS turn FROM v GROUP BY ALL)
        SELECT root, count(*) AS n_below, round(sum(turn), 3) AS turn FROM b JOIN s USING (child) GROUP BY root""",
    "data_weights": f"""{with_views('pts', 'ok')}, c AS (SELECT seq_id, frame, count(*) AS n, count_if(seen) AS visible FROM ok GROUP BY ALL)
        SELECT seq_id, frame, visible, round(1 + (n - visible) / n * 2.0, 6) AS anneal, round(CASE WHEN visible > 0 THEN 46.0 / visible END, 6) AS weight FROM c""",
    "unavailable_latent": f"""{with_views('pts', 'ok', 'smp')}, l AS (SELECT seq_id, unnest(latent_labels) AS label FROM smp) SELECT seq_id, label FROM l WHERE NOT EXISTS (SELECT 1 FROM ok WHERE seen AND ok.seq_id = l.seq_id AND ok.label = l.label)""",
    "common_labels": f"""{with_views('pts', 'ok', 'smp')}, l AS (SELECT DISTINCT seq_id, unnest(latent_labels) AS label FROM smp) SELECT ok.seq_id, frame, count(DISTINCT ok.label) AS n_common FROM ok JOIN l ON ok.seq_id = l.seq_id AND ok.label = l.label WHERE seen GROUP BY ALL""",
    "pose_parts": f"""{with_views('pose')} SELECT seq_id, frame, len(fullpose) AS size, round({NORM.format(v='fullpose[1:3]')}, 6) AS root, round(CASE WHEN len(fullpose) >= 66 THEN {NORM.format(v='fullpose[4:66]')} ELSE 0 END, 6) AS body,
        round(CASE WHEN len(fullpose) >= 165 THEN {NORM.format(v='fullpose[67:75]')} ELSE 0 END, 6) AS face,
        round(CASE WHEN len(fullpose) >= 165 THEN {NORM.format(v='fullpose[76:120]')} WHEN len(fullpose) >= 156 THEN {NORM.format(v='fullpose[67:111]')} ELSE 0 END, 6) AS left_hand FROM pose WHERE fullpose IS NOT NULL""",
    "render_poses": f"""{with_views('pose')}, p AS (SELECT seq_id, frame, list_transform(CASE WHEN len(fullpose) >= 165 THEN fullpose[1:66] || fullpose[76:165] WHEN len(fullpose) >= 156 THEN fullpose[1:156] ELSE fullpose[1:66] END, lambda v: abs(v)) AS k FROM pose WHERE fullpose IS NOT NULL)
        SELECT seq_id, frame, 165 AS size, round(list_sum(k), 6) AS total FROM p""",
    "robust_losses": """WITH r AS (SELECT event_type, value - 50.0 AS r FROM events) SELECT event_type, round(sum(r * r * 100 / (100 + r * r)), 3) AS geman_mcclure, round(sum(sign(r) * sqrt(abs(r))), 3) AS signed_sqrt,
        round(sum(1 / (1 + exp(-r / 10)) - 0.5), 3) AS sigmoid FROM r GROUP BY event_type""",
    "metric_deltas": f"""{with_views('pose')}, ts AS (SELECT seq_id, frame, trans[3] AS value FROM pose WHERE trans IS NOT NULL),
        sm AS (SELECT seq_id, frame, value, value + 0.5 * ((coalesce(lag(value) OVER w, value) + coalesce(lead(value) OVER w, lag(value) OVER w, value)) / 2 - value) AS s FROM ts WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
        d AS (SELECT seq_id, CASE WHEN row_number() OVER w > 1 THEN abs(coalesce(s - lag(s) OVER w, 0)) END AS c, CASE WHEN row_number() OVER w > 1 THEN abs(coalesce(value - lag(value) OVER w, 0)) END AS r FROM sm WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
        g AS (SELECT seq_id, unnest(['mean', 'p90', 'max']) AS metric, unnest([round(avg(c) + 1e-9, 6), round(quantile_cont(c, 0.9), 6), round(max(c), 6)]) AS c, unnest([round(avg(r) + 1e-9, 6), round(quantile_cont(r, 0.9), 6), round(max(r), 6)]) AS r FROM d WHERE c IS NOT NULL GROUP BY seq_id)
        SELECT seq_id, metric, round(c - r, 6) AS delta, round(CASE WHEN r > 0 THEN c / r END, 4) AS ratio FROM g""",
}
