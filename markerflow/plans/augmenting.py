"""Queries over seeded sampling and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.stats import rounded
from markerflow.operators import augment, geometry, labels, views
from markerflow.operators.ranges import along, tracks
from markerflow.operators.views import with_views
from markerflow.session import table


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_seen(views.points(spark, sf_dir)).where("seen")


def picked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve well-seen frames of each take."""
    rates = labels.with_seen(views.points(spark, sf_dir)).groupBy("seq_id", "frame").agg(F.avg(F.col("seen").cast("double")).alias("rate"))
    return augment.picked_frames(rates.where("rate >= 0.9").select("seq_id", "frame"), 12, 7)


def relaxed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = labels.with_seen(views.points(spark, sf_dir)).groupBy("seq_id", "frame").agg(F.avg(F.col("seen").cast("double")).alias("rate"))
    return augment.relaxed_threshold(rates, 1.0, 60)


def occluded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.occluded(_seen(spark, sf_dir), 3, 11)
    return rows.groupBy("seq_id", "marker_idx").agg(F.count_if("occluded").alias("n_occluded"), F.count("x").alias("n_left"))


def ghost_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.ghosts(_seen(spark, sf_dir), 2, 13)
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"), *[F.round(F.max(c), 3).alias(c) for c in "xyz"])


def ghost_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where ghosts of three kinds lie, two in each frame."""
    seen = _seen(spark, sf_dir)
    kinds = [augment.ghosts(seen, 2, 14, k).withColumn("kind", F.lit(k)) for k in ("gaussian", "uniform", "skewed")]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return rows.groupBy("seq_id", "kind").agg(F.count("*").alias("n"), *[F.round(F.max(c) + 1e-7, 3).alias(c) for c in "xyz"])


def broken_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.broken_tracks(_seen(spark, sf_dir), 17)
    return rows.groupBy("seq_id", "track").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def shuffled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.shuffled_slots(_seen(spark, sf_dir), 19)
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"), F.sum(F.col("slot") * F.col("marker_idx")).alias("check"), F.count_if(F.col("slot") == F.col("marker_idx")).alias("fixed"))


def training_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.exact_fraction(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.3, 23)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of seen markers: their step from the frame before."""
    rows = tracks(_seen(spark, sf_dir).where("label is not null"))
    rows = along(rows, lambda w: {f"d{c}": F.round(F.col(c) - F.lag(c).over(w), 6) for c in "xyz"}, halo=1, key="track")
    return rows.where("dx is not null and dy is not null and dz is not null").select("seq_id", "frame", "marker_idx", "label", "dx", "dy", "dz")


READING = ["seq_id", "frame", "marker_idx"]


def noise_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of each label, as many as the largest label has residuals, and how many of them differ.

    The model holds every residual, so what it says of a label needs no numbering of them."""
    pools = _steps(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("dx", "dy", "dz").alias("n_distinct"), *[rounded(F.max(f"d{c}")).alias(f"d{c}") for c in "xyz"])
    return augment.with_size(pools).select("label", F.col("size").alias("n"), "n_distinct", "dx", "dy", "dz")


def noisy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = augment.noise_model(_steps(spark, sf_dir), READING, 29)
    rows = augment.with_noise(_seen(spark, sf_dir), model, 31)
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"), *[F.round(F.max(c), 4).alias(c) for c in "xyz"])


def concatenated_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded and augmented rows in one table, missing columns tolerated, counted by origin."""
    real = _seen(spark, sf_dir).select("seq_id", "frame", "label", "x", F.lit("real").alias("origin"))
    made = augment.ghosts(_seen(spark, sf_dir), 1, 37).select("seq_id", "frame", "ghost", "x", F.lit("ghost").alias("origin"))
    rows = real.unionByName(made, allowMissingColumns=True)
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.count("label").alias("n_labelled"), F.count("ghost").alias("n_ghosts"))


def corrupted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes as poor recordings would give them, with the place of each reading's label in the canonical order."""
    order = table(spark, sf_dir, "marker_layout").where("layout_id = 'superset'").select("label", "ord")
    rows = augment.assigned(augment.corrupted(_seen(spark, sf_dir), 3, 2, 41), order)
    return rows.groupBy("seq_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("marker_idx") < 0).alias("n_ghosts"), F.countDistinct("track").alias("n_tracks"), F.sum(F.col("slot") * F.col("ord")).alias("check"),
        F.sum(F.col("slot") * F.col("track")).alias("tracks"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.max("x"), 3).alias("x"),
    )


def manual_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of the middle frame of each take, asked for by name."""
    names = views.sessions(spark, sf_dir).select(F.concat_ws("_", "seq_id", F.floor(F.col("n_frames") / 2).cast("string")).alias("name"))
    return augment.frames_by_name(views.points(spark, sf_dir), names).groupBy("seq_id", "frame").agg(F.count("*").alias("n"))


def frames_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve frames of all takes together."""
    return augment.frames_in_all(views.points(spark, sf_dir).select("seq_id", "frame").distinct(), 12, 51, strict=True)


def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = augment.sampled_windows(views.mesh(spark, sf_dir), "vertices", 8, 3, 53)
    return rows.select("seq_id", "row", "window", F.round(F.get("vertices", F.lit(0)), 4).alias("x"), F.round(F.get("vertices", F.lit(1)), 4).alias("y"), F.round(F.get("vertices", F.lit(2)), 4).alias("z"))


def _first_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.mesh(spark, sf_dir).where("row = 0 and size(vertices) >= 9")
    return rows.select("seq_id", F.transform("vertices", lambda v: v.cast("double")).alias("vertices"), (F.size("vertices") / 3).cast("int").alias("n_vertices"))


def surface_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 200 points drawn on the first frame of each mesh fall."""
    meshes = _first_mesh(spark, sf_dir)
    at = lambda v, k: F.get("vertices", F.col(v) * 3 + k)
    u, w = ([at(v, k) - at("v0", k) for k in range(3)] for v in ("v1", "v2"))
    cross = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    area = F.round(F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2, 9)
    faces = geometry.strip_faces(meshes).join(meshes, "seq_id").select("seq_id", "face", area.alias("area"))
    return augment.surface_draws(faces, 200, 57).groupBy("seq_id", "face").agg(F.count("*").alias("n"))


def moved_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of each mesh exchanged for neighbours within two edges."""
    meshes = _first_mesh(spark, sf_dir)
    layout = meshes.select("seq_id", F.explode(F.sequence(F.lit(0), F.col("n_vertices") - 1)).alias("vid")).withColumn("ord", F.col("vid"))
    near = geometry.mesh_rings(geometry.strip_faces(meshes), layout, 2)
    return augment.moved_vertices(layout, near, 59).select("seq_id", "ord", "vid")


QUERIES = {
    f.__name__: f
    for f in (
        picked_frames, relaxed_thresholds, occluded_points, ghost_points, ghost_kinds, broken_tracks, shuffled_frames, training_fraction, noise_model, noisy_points, concatenated_sets,
        corrupted_points, manual_frames, frames_in_all, sampled_windows, surface_draws, moved_vertices,
    )
}

RATES = "rates AS (SELECT seq_id, frame, avg(seen::INT) AS rate FROM ok GROUP BY ALL)"
HEX = "('0x' || substr({m}, 1, 6))::BIGINT"
STEPS = """st AS (SELECT label, round(x - lag(x) OVER w, 6) AS dx, round(y - lag(y) OVER w, 6) AS dy, round(z - lag(z) OVER w, 6) AS dz FROM ok WHERE seen AND label IS NOT NULL WINDOW w AS (PARTITION BY seq_id, marker_idx ORDER BY frame))"""

KEY = "'14|' || seq_id || '|' || frame || '|' || "
PART = lambda k: f"{HEX.format(m=f'md5({KEY}{k})')} / 16777215"
WIDE = lambda k: f"(4 * {HEX.format(m=f'md5({KEY}{k})')} / 16777215 - 2)"
NORMAL = lambda c: f"""sqrt(-2 * ln(greatest({PART(f"g || '|{c}|r'")}, 1.0::DOUBLE / 16777216))) * cos(2 * pi() * {PART(f"g || '|{c}|a'")})"""
SKEWED = {
    "x": f"""{WIDE("'mx'")} + nx""",
    "y": f"""{WIDE("'my'")} + (wyx * nx + ny) / sqrt(wyx * wyx + 1)""",
    "z": f"""{WIDE("'mz'")} + (wzx * nx + wzy * ny + nz) / sqrt(wzx * wzx + wzy * wzy + 1)""",
}

UNIFORM = "('0x' || substr(md5({k}), 1, 6))::BIGINT / 16777216"

ORACLE_SQL = {
    "corrupted_points": f"""{with_views('pts', 'ok')}, h AS (SELECT seq_id, frame, marker_idx, label, x, y, z FROM ok WHERE seen QUALIFY row_number() OVER (PARTITION BY seq_id, frame ORDER BY md5('41|' || seq_id || '|' || frame || '|' || marker_idx), marker_idx) > 3),
        m AS (SELECT seq_id, frame, {', '.join(f"quantile_disc({c}, 0.5) AS m{c}, coalesce(stddev_samp({c}), 0) AS s{c}" for c in 'xyz')} FROM h GROUP BY ALL),
        g AS (SELECT seq_id, frame, -1 - g AS marker_idx, 'nan' AS label, {', '.join(f"m{c} + s{c} * (4 * {HEX.format(m=f"md5('42|' || seq_id || '|' || frame || '|' || g || '|{c}')")} / 16777215 - 2) AS {c}" for c in 'xyz')} FROM m, range(2) r(g)),
        u AS (SELECT *, row_number() OVER (PARTITION BY seq_id, frame ORDER BY md5('43|' || seq_id || '|' || frame || '|' || marker_idx), marker_idx) - 1 AS slot FROM (FROM h UNION ALL FROM g)),
        t AS (SELECT seq_id, marker_idx, min(frame) AS lo, max(frame) AS hi, {HEX.format(m="md5('44|' || seq_id || '|' || marker_idx)")} AS k FROM u GROUP BY ALL),
        c AS (SELECT seq_id, marker_idx, CASE WHEN k % 2 = 0 THEN lo + 1 + (k // 2) % greatest(hi - lo, 1) END AS cut, max(marker_idx) OVER (PARTITION BY seq_id) + 1 AS above FROM t),
        o AS (SELECT label, ord FROM marker_layout WHERE layout_id = 'superset'), e AS (SELECT u.seq_id, u.marker_idx, slot, x, CASE WHEN frame >= cut THEN u.marker_idx + above ELSE u.marker_idx END AS track, coalesce(ord, (SELECT max(ord) + 1 FROM o)) AS ord
            FROM u JOIN c ON u.seq_id = c.seq_id AND u.marker_idx = c.marker_idx LEFT JOIN o ON u.label = o.label),
        w AS (SELECT *, 1 - count(*) OVER (PARTITION BY seq_id, ord) / count(*) OVER (PARTITION BY seq_id) AS weight FROM e)
        SELECT seq_id, count(*) AS n, count_if(marker_idx < 0) AS n_ghosts, count(DISTINCT track) AS n_tracks, sum(slot * ord)::BIGINT AS "check", sum(slot * track)::BIGINT AS tracks, round(sum(weight), 4) AS weight, round(max(x), 3) AS x FROM w GROUP BY seq_id""",
    "manual_frames": f"""{with_views('pts', 'ses')} SELECT pts.seq_id, frame, count(*) AS n FROM pts JOIN ses ON pts.seq_id = ses.seq_id AND frame = n_frames // 2 GROUP BY ALL""",
    "frames_in_all": """SELECT seq_id, frame FROM (SELECT DISTINCT seq_id, frame FROM mocap_points) ORDER BY md5('51|' || seq_id || '|' || frame), seq_id, frame LIMIT 12""",
    "sampled_windows": f"""{with_views('mesh')}, w AS (SELECT seq_id, row, row // 8 AS "window", vertices AS v, {UNIFORM.format(k="'54|' || seq_id || '|' || (row // 8)")} * 2 * pi() AS a FROM mesh WHERE floor({UNIFORM.format(k="'53|' || seq_id || '|' || (row // 8)")} * 3) = 0),
        f AS (SELECT *, count(*) OVER (PARTITION BY seq_id, "window") AS n FROM w) SELECT seq_id, row, "window", round(v[1]::DOUBLE * cos(a) - v[2]::DOUBLE * sin(a), 4) AS x, round(v[1]::DOUBLE * sin(a) + v[2]::DOUBLE * cos(a), 4) AS y, round(v[3]::DOUBLE, 4) AS z FROM f WHERE n = 8""",
    "surface_draws": f"""{with_views('mesh')}, q AS (SELECT seq_id, i AS face, i AS a, (i + 1) % n AS b, (i + 2) % n AS c, [x::DOUBLE for x in vertices] AS v FROM (SELECT *, len(vertices) // 3 AS n FROM mesh WHERE row = 0 AND len(vertices) >= 9), range(100) r(i) WHERE i < n),
        s AS (SELECT seq_id, face, [v[3 * b + k] - v[3 * a + k] for k in [1, 2, 3]] AS u, [v[3 * c + k] - v[3 * a + k] for k in [1, 2, 3]] AS w FROM q),
        t AS (SELECT seq_id, face, round(sqrt((u[2] * w[3] - u[3] * w[2]) ** 2 + (u[3] * w[1] - u[1] * w[3]) ** 2 + (u[1] * w[2] - u[2] * w[1]) ** 2) / 2, 9) AS area FROM s),
        c AS (SELECT seq_id, face, sum(area) OVER (PARTITION BY seq_id ORDER BY face) / sum(area) OVER (PARTITION BY seq_id) AS upto FROM t),
        d AS (SELECT c.seq_id, k, min(face) AS face FROM c, range(200) x(k) WHERE upto > {UNIFORM.format(k="'57|' || seq_id || '|' || k")} GROUP BY ALL) SELECT seq_id, face, count(*) AS n FROM d GROUP BY ALL""",
    "moved_vertices": f"""{with_views('mesh')}, q AS (SELECT seq_id, i AS vid, len(vertices) // 3 AS n FROM mesh, range(100) r(i) WHERE row = 0 AND len(vertices) >= 9 AND i < len(vertices) // 3),
        p AS (SELECT a.seq_id, a.vid AS ord, b.vid FROM q a JOIN q b ON a.seq_id = b.seq_id AND least((a.vid - b.vid + a.n) % a.n, (b.vid - a.vid + a.n) % a.n) <= 4)
        SELECT seq_id, ord, arg_min(vid, md5('59|' || seq_id || '|' || ord || '|' || vid)) AS vid FROM p GROUP BY ALL""",
    "noise_model": f"""{with_views('pts', 'ok')}, {STEPS}, n AS (SELECT label, count(*) AS n, count(DISTINCT (dx, dy, dz)) AS n_distinct, round(max(dx), 6) AS dx, round(max(dy), 6) AS dy, round(max(dz), 6) AS dz FROM st WHERE dx IS NOT NULL AND dy IS NOT NULL AND dz IS NOT NULL GROUP BY label)
        SELECT label, max(n) OVER () AS n, n_distinct, dx, dy, dz FROM n""",
    "picked_frames": f"""{with_views('pts', 'ok')}, {RATES}, r AS (SELECT seq_id, frame, row_number() OVER (PARTITION BY seq_id ORDER BY md5('7|' || seq_id || '|' || frame), frame) AS n FROM rates WHERE rate >= 0.9)
        SELECT seq_id, frame FROM r WHERE n <= 12""",
    "relaxed_thresholds": f"""{with_views('pts', 'ok')}, {RATES}, t AS (SELECT i FROM range(101) r(i)), c AS (SELECT seq_id, i, count_if(rate >= 1.0 - i * 0.01 - 1e-9) AS n FROM rates, t GROUP BY ALL)
        SELECT seq_id, coalesce(round(1.0::DOUBLE - min(i) FILTER (n >= 60) * 0.01, 6), 0)::DOUBLE AS threshold FROM c GROUP BY seq_id""",
    "occluded_points": f"""{with_views('pts', 'ok')}, r AS (SELECT seq_id, marker_idx, row_number() OVER (PARTITION BY seq_id, frame ORDER BY md5('11|' || seq_id || '|' || frame || '|' || marker_idx), marker_idx) AS n FROM ok WHERE seen)
        SELECT seq_id, marker_idx, count_if(n <= 3) AS n_occluded, count_if(n > 3) AS n_left FROM r GROUP BY ALL""",
    "ghost_points": f"""{with_views('pts', 'ok')}, m AS (SELECT seq_id, frame, quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my, quantile_disc(z, 0.5) AS mz, coalesce(stddev_samp(x), 0) AS sx, coalesce(stddev_samp(y), 0) AS sy, coalesce(stddev_samp(z), 0) AS sz FROM ok WHERE seen GROUP BY ALL),
        g AS (SELECT seq_id, {', '.join(f"m{c} + s{c} * (4 * {HEX.format(m=f"md5('13|' || seq_id || '|' || frame || '|' || g || '|{c}')")} / 16777215 - 2) AS {c}" for c in 'xyz')} FROM m, range(2) r(g))
        SELECT seq_id, count(*) AS n, round(max(x), 3) AS x, round(max(y), 3) AS y, round(max(z), 3) AS z FROM g GROUP BY seq_id""",
    "ghost_kinds": f"""{with_views('pts', 'ok')}, m AS (SELECT seq_id, frame, {', '.join(f'quantile_disc({c}, 0.5) AS m{c}, coalesce(stddev_samp({c}), 0) AS s{c}' for c in 'xyz')} FROM ok WHERE seen GROUP BY ALL),
        g AS (SELECT *, {', '.join(f'{NORMAL(c)} AS n{c}' for c in 'xyz')}, {', '.join(WIDE(f"'{k}'") + f' AS w{k}' for k in ('yx', 'zx', 'zy'))} FROM m, range(2) r(g)),
        k AS (SELECT seq_id, 'gaussian' AS kind, {', '.join(f'm{c} + s{c} * n{c} AS {c}' for c in 'xyz')} FROM g UNION ALL SELECT seq_id, 'uniform', {', '.join(WIDE(f"g || '|{c}'") for c in 'xyz')} FROM g
            UNION ALL SELECT seq_id, 'skewed', {', '.join(SKEWED[c] for c in 'xyz')} FROM g)
        SELECT seq_id, kind, count(*) AS n, round(max(x) + 1e-7, 3) AS x, round(max(y) + 1e-7, 3) AS y, round(max(z) + 1e-7, 3) AS z FROM k GROUP BY ALL""",
    "broken_tracks": f"""{with_views('pts', 'ok')}, t AS (SELECT seq_id, marker_idx, min(frame) AS lo, max(frame) AS hi, {HEX.format(m="md5('17|' || seq_id || '|' || marker_idx)")} AS k FROM ok WHERE seen GROUP BY ALL),
        c AS (SELECT seq_id, marker_idx, CASE WHEN k % 2 = 0 THEN lo + 1 + (k // 2) % greatest(hi - lo, 1) END AS cut, max(marker_idx) OVER (PARTITION BY seq_id) + 1 AS above FROM t),
        r AS (SELECT ok.seq_id, frame, CASE WHEN frame >= cut THEN ok.marker_idx + above ELSE ok.marker_idx END AS track FROM ok JOIN c ON ok.seq_id = c.seq_id AND ok.marker_idx = c.marker_idx WHERE seen)
        SELECT seq_id, track, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame FROM r GROUP BY ALL""",
    "shuffled_frames": f"""{with_views('pts', 'ok')}, r AS (SELECT seq_id, marker_idx, row_number() OVER (PARTITION BY seq_id, frame ORDER BY md5('19|' || seq_id || '|' || frame || '|' || marker_idx), marker_idx) - 1 AS slot FROM ok WHERE seen)
        SELECT seq_id, count(*) AS n, sum(slot * marker_idx)::BIGINT AS "check", count_if(slot = marker_idx) AS fixed FROM r GROUP BY seq_id""",
    "training_fraction": f"""WITH d AS (SELECT event_id, md5('23|' || event_id) AS d FROM events), b AS (SELECT *, {HEX.format(m='d')} % 4096 AS b FROM d), r AS (SELECT event_id, row_number() OVER (ORDER BY b, d, event_id) AS n, count(*) OVER () AS c FROM b)
        SELECT event_id FROM r WHERE n <= floor(c * 0.3)""",
    "noisy_points": None,
    "concatenated_sets": f"""{with_views('pts', 'ok')} SELECT 'real' AS origin, count(*) AS n, count(label) AS n_labelled, 0 AS n_ghosts FROM ok WHERE seen UNION ALL
        SELECT 'ghost', count(*), 0, count(*) FROM (SELECT DISTINCT seq_id, frame FROM ok WHERE seen)""",
}
ORACLE_SQL = {k: v for k, v in ORACLE_SQL.items() if v}
