"""Queries over chunks, seams and stitching of mesh sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.stats import rounded, summarize
from markerflow.operators import chunks, temporal, views
from markerflow.operators.views import with_views
from markerflow.plans.sequences import BEND, G1, L2


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = views.mesh(spark, sf_dir)
    lengths = frames.groupBy("seq_id").agg(F.count("*").alias("n_frames"))
    return frames, chunks.chunk_plan(lengths, views.mesh_settings(spark, sf_dir))


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1]


def seam_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.seam_plan(_plan(spark, sf_dir)[1])


def settings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.settings_report(views.mesh_settings(spark, sf_dir), _plan(spark, sf_dir)[1])


def keep_starts_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1].where("chunk_no > 0 and keep_start != overlap").select("seq_id", "chunk_no", "keep_start", "overlap")


def seam_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.seam_diagnostics(*_plan(spark, sf_dir), "vertices")
    return rows.select("seq_id", "chunk_no", "seam_row", *[rounded(F.col(c)).alias(c) for c in ("prev_delta", "seam_delta", "next_delta", "pre_accel", "post_accel")])


def seam_jump_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(chunks.seam_diagnostics(*_plan(spark, sf_dir), "vertices"), ["seq_id"], "seam_delta")


def seam_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.seam_windows(*_plan(spark, sf_dir), "vertices", 10)
    return rows.select("seq_id", "chunk_no", "seam_row", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "max", "first", "last")], "peak_row")


def stitched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, plan = _plan(spark, sf_dir)
    owned = chunks.owned_rows(plan)
    covered = chunks.chunked_frames(frames.select("seq_id", "frame", "row"), plan).join(owned, ["seq_id", "chunk_no"])
    return covered.where("row >= first_row and row < end_row").groupBy("seq_id", "chunk_no").agg(
        F.count("*").alias("n_rows"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    )


def _drifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The plan, and chunks with the recorded vertices as `base` and, as a solver would leave them, `mesh`: odd chunks shifted by a millimetre a row. `root` is
    the middle of the vertices and `pose` what they are about it."""
    frames, plan = _plan(spark, sf_dir)
    base = frames.select("seq_id", "row", F.transform("vertices", lambda v: v.cast("double")).alias("base"))
    rows = chunks.chunked_frames(base, plan)
    drift = F.when(F.col("chunk_no") % 2 == 1, 0.001 * (F.col("row") - F.col("row_start"))).otherwise(0.0)
    rows = rows.withColumn("_drift", drift).withColumn("mesh", F.transform("base", lambda v: F.round(v + F.col("_drift"), 6))).drop("_drift")
    n = F.size("mesh") / 3
    middle = F.array(*[F.aggregate(F.filter("mesh", lambda v, i: i % 3 == k), F.lit(0.0), lambda s, v: s + v) / n for k in range(3)])
    rows = rows.withColumn("root", middle)
    return plan, rows.withColumn("pose", F.transform("mesh", lambda v, i: v - F.get("root", i % 3)))


JUMPS = ["transl_jump", "pose_jump", "mesh_jump"]


#: The rows of a chunk at which another may take over from it, or it from another; nothing is measured elsewhere.
NEAR_SEAMS = "row - row_start <= overlap or row >= row_end - overlap - 1"


def stitch_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to enter each chunk, by the jump of the root, guarded by those of pose and mesh."""
    plan, rows = _drifted(spark, sf_dir)
    # Jumps that differ in their last bits only are equal.
    found = chunks.stitch_candidates(rows.where(NEAR_SEAMS), "root", "pose", "mesh").withColumns({j: F.round(j, 9) for j in JUMPS})
    chosen = chunks.select_keep_starts(plan, found)
    return chosen.select("seq_id", "chunk_no", "keep_start", *[rounded(F.col(j)).alias(j) for j in JUMPS])


def stitch_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the recorded keep-starts as overrides, and where each keep-start comes from."""
    plan, rows = _drifted(spark, sf_dir)
    found = chunks.stitch_candidates(rows.where(NEAR_SEAMS), "root", "pose", "mesh").withColumns({j: F.round(j, 9) for j in JUMPS})
    told = views.mesh_settings(spark, sf_dir).select("seq_id", F.posexplode("chunk_keep_starts").alias("chunk_no", "value"))
    return chunks.overridden_keep_starts(chunks.select_keep_starts(plan, found), told).select("seq_id", "chunk_no", "keep_start", "selected_keep_start", "source")


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, plan = _plan(spark, sf_dir)
    moved = temporal.vector_motion(frames, "vertices").select("seq_id", "row", "delta")
    covered = chunks.chunked_frames(moved, plan)
    in_overlap = (F.col("row") - F.col("row_start") < F.col("overlap")) & (F.col("chunk_no") > 0)
    return covered.groupBy("seq_id", "chunk_no").agg(
        rounded(F.avg(F.when(in_overlap, F.col("delta")))).alias("overlap_mean"), rounded(F.avg(F.when(~in_overlap, F.col("delta")))).alias("rest_mean")
    )


def _total(v: str) -> Column:
    return rounded(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total")


def velocity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of reference of every chunk, by the sum of the numbers of each row."""
    rows = _drifted(spark, sf_dir)[1]
    kinds = [chunks.velocity_references(rows, "mesh", "base", kind, 3).withColumn("kind", F.lit(kind)) for kind in ("anchor", "full", "window", "zero_seam")]
    every = kinds[0]
    for one in kinds[1:]:
        every = every.unionByName(one)
    return every.select("kind", "seq_id", "chunk_no", "k", _total("reference"))


def velocity_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The velocity term of every chunk against each kind of reference."""
    rows = _drifted(spark, sf_dir)[1]
    every = None
    for mode in ("plain", "full", "anchor", "window"):
        one = chunks.chunk_velocity_terms(rows, "mesh", "base", mode, 2.5, 3).groupBy("seq_id", "chunk_no").agg(rounded(F.sum("term")).alias("term")).withColumn("mode", F.lit(mode))
        every = one if every is None else every.unionByName(one)
    return every.select("mode", "seq_id", "chunk_no", "term")


def boundary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.boundary_terms(_drifted(spark, sf_dir)[1], "mesh", "base", 2.0, 3)
    return rows.select("seq_id", "chunk_no", "row", rounded(F.col("term")).alias("term"))


def replaced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose rows 2 to 5 are taken from the recorded vertices."""
    rows = chunks.replaced_window(_drifted(spark, sf_dir)[1], "mesh", "base", 2, 4)
    return rows.select("seq_id", "chunk_no", "row", _total("mesh"))


def spliced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.spliced(_drifted(spark, sf_dir)[1], "mesh").select("seq_id", "chunk_no", "row", _total("value"))


def seam_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of three metrics of each seam, and the seams whose step reaches the threshold."""
    rows = chunks.seam_diagnostics(*_plan(spark, sf_dir), "vertices").withColumns({c: F.round(c, 6) for c in ("seam_delta", "pre_accel", "post_accel")})
    peak = chunks.peak_metric(["seam_delta", "pre_accel", "post_accel"])
    return rows.select("seq_id", "chunk_no", peak.getField("name").alias("metric"), peak.getField("value").alias("value"), (F.col("seam_delta") >= 0.05).alias("hot"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per sequence: its settings and the summary of its seams."""
    seams = summarize(chunks.seam_diagnostics(*_plan(spark, sf_dir), "vertices"), ["seq_id"], "seam_delta")
    rows = views.mesh_settings(spark, sf_dir).join(seams, "seq_id", "left")
    inner = F.when(F.col("n").isNotNull(), F.struct("n", "max"))
    return rows.select("seq_id", F.to_json(F.struct("chunk_overlap", "chunk_size", inner.alias("seams")), {"ignoreNullFields": "false"}).alias("report"))


QUERIES = {
    "stitch_override": stitch_override,
    "velocity_modes": velocity_modes,
    "boundary_terms": boundary_terms,
    "replaced_windows": replaced_windows,
    "velocity_references": velocity_references,
    "spliced_chunks": spliced_chunks,
    "seam_peaks": seam_peaks,
    "quality_report": quality_report,
    "chunk_plan": chunk_plan,
    "seam_plan": seam_plan,
    "settings_report": settings_report,
    "keep_starts_changed": keep_starts_changed,
    "seam_diagnostics": seam_diagnostics,
    "seam_jump_summary": seam_jump_summary,
    "seam_windows": seam_windows,
    "stitched_rows": stitched_rows,
    "stitch_select": stitch_select,
    "chunk_summary": chunk_summary,
}

PLAN = f"""{with_views("mesh", "cfg")}, u AS (SELECT seq_id, chunk_size, coalesce(chunk_overlap, 0) AS overlap, chunk_keep_starts AS ks FROM cfg
        WHERE chunk_size > 0 AND coalesce(chunk_overlap, 0) >= 0 AND coalesce(chunk_overlap, 0) < chunk_size),
    n AS (SELECT seq_id, count(*) AS n_frames FROM mesh GROUP BY seq_id),
    c AS (SELECT u.*, n_frames, greatest(chunk_size - overlap, 1) AS step FROM u JOIN n USING (seq_id)),
    k AS (SELECT *, unnest(range(0, 1 + ceil(greatest(n_frames - chunk_size, 0) / step)::BIGINT)) AS chunk_no FROM c),
    plan AS (SELECT seq_id, chunk_no, chunk_no * step AS row_start, least(chunk_no * step + chunk_size, n_frames) AS row_end,
        CASE WHEN chunk_no = 0 THEN 0 ELSE least(greatest(coalesce(ks[chunk_no + 1], overlap), 0), overlap) END AS keep_start, overlap FROM k),
    seams AS (SELECT seq_id, chunk_no, row_start + keep_start AS seam_row FROM plan WHERE chunk_no > 0)"""
MOVES = f"""l AS (SELECT seq_id, row, frame, {{e}} AS v, lag({{e}}) OVER w AS v1, lag({{e}}, 2) OVER w AS v2, lead({{e}}) OVER w AS n1 FROM mesh WINDOW w AS (PARTITION BY seq_id ORDER BY frame)),
    m AS (SELECT seq_id, row, frame, CASE WHEN v2 IS NOT NULL THEN {L2.format(a="v1", b="v2")} END AS prev_delta, CASE WHEN v1 IS NOT NULL THEN {L2.format(a="v", b="v1")} END AS seam_delta,
        CASE WHEN n1 IS NOT NULL THEN {L2.format(a="n1", b="v")} END AS next_delta, CASE WHEN v2 IS NOT NULL THEN {BEND.format(a="v", b="v1", c="v2")} END AS pre_accel,
        CASE WHEN n1 IS NOT NULL AND v1 IS NOT NULL THEN {BEND.format(a="n1", b="v", c="v1")} END AS post_accel FROM l)"""
ALL = MOVES.format(e="vertices")
COLS = ", ".join(f"round({c}, 6) AS {c}" for c in ("prev_delta", "seam_delta", "next_delta", "pre_accel", "post_accel"))

DRIFTED = """r AS (SELECT seq_id, chunk_no, row, row_start, overlap, list_transform(vertices, lambda v: v::DOUBLE) AS base,
        list_transform(vertices, lambda v: round(v::DOUBLE + CASE WHEN chunk_no % 2 = 1 THEN 0.001 * (row - row_start) ELSE 0 END, 6)) AS mesh FROM plan JOIN mesh USING (seq_id) WHERE row >= row_start AND row < row_end),
    e AS (SELECT seq_id, chunk_no + 1 AS chunk_no, max(row) AS edge, arg_max(mesh, row) AS anchor FROM r GROUP BY ALL),
    b AS (SELECT e.*, x.base AS at_base, y.base AS next_base FROM e JOIN (SELECT DISTINCT seq_id, chunk_no FROM r) k USING (seq_id, chunk_no)
        LEFT JOIN r x ON x.seq_id = e.seq_id AND x.chunk_no = e.chunk_no AND x.row = edge LEFT JOIN r y ON y.seq_id = e.seq_id AND y.chunk_no = e.chunk_no AND y.row = edge + 1),
    j AS (SELECT r.*, edge, anchor, at_base, next_base FROM r JOIN b USING (seq_id, chunk_no)),
    refs AS (SELECT 'anchor' AS kind, seq_id, chunk_no, 0 AS k, anchor AS ref FROM b
        UNION ALL SELECT 'full', seq_id, chunk_no, row - row_start, list_transform(list_zip(base, anchor, at_base), lambda p: p[1] + (p[2] - p[3])) FROM j WHERE at_base IS NOT NULL
        UNION ALL SELECT 'full', seq_id, chunk_no, 0, anchor FROM b WHERE at_base IS NULL
        UNION ALL SELECT w.kind, seq_id, chunk_no, 0, anchor FROM b, (VALUES ('window'), ('zero_seam')) w(kind)
        UNION ALL SELECT w.kind, seq_id, chunk_no, row - edge, list_transform(list_zip(anchor, base, CASE WHEN w.kind = 'window' THEN at_base ELSE next_base END), lambda p: p[1] + (p[2] - p[3]))
            FROM j, (VALUES ('window'), ('zero_seam')) w(kind) WHERE at_base IS NOT NULL AND next_base IS NOT NULL AND row > edge AND row <= edge + 3)"""
SQUARES = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) ** 2))"
BENT = "list_sum(list_transform(list_zip({a}, {b}, {c}, {d}), lambda p: ((p[1] - p[2]) - (p[3] - p[4])) ** 2))"
STITCH = f"""mid AS (SELECT *, list_transform(range(3), lambda k: list_sum([mesh[3 * i + k + 1] for i in range(len(mesh) // 3)]) / (len(mesh) // 3)) AS root FROM r),
    pos AS (SELECT *, [mesh[i] - root[(i - 1) % 3 + 1] for i in range(1, len(mesh) + 1)] AS pose FROM mid),
    cand AS (SELECT a.seq_id, a.chunk_no, a.overlap, a.row - a.row_start AS keep, round({L2.format(a="a.root", b="b.root")}, 9) AS t, round({L2.format(a="a.pose", b="b.pose")}, 9) AS p, round({L2.format(a="a.mesh", b="b.mesh")}, 9) AS m
        FROM pos a JOIN pos b ON a.seq_id = b.seq_id AND b.chunk_no = a.chunk_no - 1 AND b.row = a.row - 1 WHERE a.row - a.row_start BETWEEN 1 AND a.overlap),
    able AS (SELECT c.*, min(c.t) OVER (PARTITION BY c.seq_id, c.chunk_no) AS least FROM cand c JOIN cand d ON c.seq_id = d.seq_id AND c.chunk_no = d.chunk_no AND d.keep = d.overlap WHERE c.p <= d.p AND c.m <= d.m),
    best AS (SELECT * FROM able WHERE t <= least + 4.5e-4 QUALIFY row_number() OVER (PARTITION BY seq_id, chunk_no ORDER BY p, t, m, keep DESC) = 1),
    chosen AS (SELECT plan.seq_id, plan.chunk_no, plan.overlap, coalesce(keep, plan.overlap) AS keep_start, t, p, m FROM plan LEFT JOIN best ON plan.seq_id = best.seq_id AND plan.chunk_no = best.chunk_no WHERE plan.chunk_no > 0)"""

ORACLE_SQL = {
    "velocity_references": f"""{PLAN}, {DRIFTED} SELECT kind, seq_id, chunk_no, k, round(list_sum(ref), 6) AS total FROM refs""",
    "velocity_modes": f"""{PLAN}, {DRIFTED}, l AS (SELECT *, row - row_start AS k, lag(mesh) OVER (PARTITION BY seq_id, chunk_no ORDER BY row) AS v1 FROM r),
        q AS (SELECT *, lag(ref) OVER (PARTITION BY kind, seq_id, chunk_no ORDER BY k) AS r1 FROM refs),
        t AS (SELECT l.*, edge, CASE WHEN v1 IS NULL THEN 0 ELSE {SQUARES.format(a="mesh", b="v1")} END AS plain FROM l LEFT JOIN b USING (seq_id, chunk_no)),
        every AS (SELECT 'plain' AS mode, seq_id, chunk_no, plain AS term FROM t
            UNION ALL SELECT 'full', t.seq_id, t.chunk_no, CASE WHEN ref IS NULL OR (t.k > 0 AND r1 IS NULL) THEN plain WHEN t.k = 0 THEN {SQUARES.format(a="mesh", b="ref")} ELSE {BENT.format(a="mesh", b="v1", c="ref", d="r1")} END
                FROM t LEFT JOIN q ON q.kind = 'full' AND q.seq_id = t.seq_id AND q.chunk_no = t.chunk_no AND q.k = t.k
            UNION ALL SELECT 'anchor', t.seq_id, t.chunk_no, CASE WHEN ref IS NULL THEN plain ELSE {SQUARES.format(a="mesh", b="ref")} END
                FROM t LEFT JOIN q ON q.kind = 'anchor' AND q.seq_id = t.seq_id AND q.chunk_no = t.chunk_no AND t.row = edge + 1
            UNION ALL SELECT 'window', t.seq_id, t.chunk_no, CASE WHEN ref IS NULL THEN plain WHEN q.k = 1 THEN {SQUARES.format(a="mesh", b="ref")} ELSE {BENT.format(a="mesh", b="v1", c="ref", d="r1")} END
                FROM t LEFT JOIN q ON q.kind = 'window' AND q.k > 0 AND q.seq_id = t.seq_id AND q.chunk_no = t.chunk_no AND q.k = t.row - edge)
        SELECT mode, seq_id, chunk_no, round(sum(term * 6.25), 6) AS term FROM every GROUP BY ALL""",
    "boundary_terms": f"""{PLAN}, {DRIFTED}, z AS (SELECT *, max(k) OVER (PARTITION BY seq_id, chunk_no) AS last FROM refs WHERE kind = 'zero_seam'), fins AS (SELECT seq_id, chunk_no, max(row) AS fin FROM r GROUP BY ALL)
        SELECT j.seq_id, j.chunk_no, j.row, round({SQUARES.format(a="mesh", b="ref")} * 4, 6) AS term FROM j JOIN fins USING (seq_id, chunk_no) JOIN z ON z.seq_id = j.seq_id AND z.chunk_no = j.chunk_no AND j.row = edge + 1 + k WHERE edge + 1 + last <= fin""",
    "replaced_windows": f"""{PLAN}, {DRIFTED} SELECT seq_id, chunk_no, row, round(list_sum(CASE WHEN row - row_start BETWEEN 2 AND 5 THEN base ELSE mesh END), 6) AS total FROM r""",
    "spliced_chunks": f"""{PLAN}, {DRIFTED}, m AS (SELECT a.seq_id, a.chunk_no, a.row, a.mesh AS x, c.mesh AS p FROM r a LEFT JOIN r c ON a.seq_id = c.seq_id AND a.chunk_no = c.chunk_no + 1 AND a.row = c.row),
        s AS (SELECT seq_id, chunk_no, list_transform(list_zip(arg_max(p, row), arg_max(x, row)), lambda q: q[1] - q[2]) AS d FROM m WHERE p IS NOT NULL GROUP BY ALL)
        SELECT m.seq_id, m.chunk_no, m.row, round(list_sum(CASE WHEN p IS NOT NULL THEN p WHEN d IS NULL THEN x ELSE list_transform(list_zip(x, d), lambda q: q[1] + q[2]) END), 6) AS total FROM m LEFT JOIN s ON m.seq_id = s.seq_id AND m.chunk_no = s.chunk_no""",
    "seam_peaks": f"""{PLAN}, {ALL}, d AS (SELECT seq_id, chunk_no, coalesce(round(seam_delta, 6), 0) AS a, coalesce(round(pre_accel, 6), 0) AS b, coalesce(round(post_accel, 6), 0) AS c, round(seam_delta, 6) >= 0.05 AS hot FROM seams JOIN m USING (seq_id) WHERE row = seam_row)
        SELECT seq_id, chunk_no, CASE WHEN a >= b AND a >= c THEN 'seam_delta' WHEN b >= c THEN 'pre_accel' ELSE 'post_accel' END AS metric, greatest(a, b, c) AS value, hot FROM d""",
    "chunk_plan": f"{PLAN} SELECT * FROM plan",
    "seam_plan": f"{PLAN} SELECT * FROM seams",
    "settings_report": f"""{PLAN}, q AS (SELECT seq_id, count(*) AS n_chunks FROM plan GROUP BY seq_id), r AS (SELECT cfg.seq_id, CASE
        WHEN chunk_size IS NULL THEN 'no size' WHEN chunk_size <= 0 THEN 'size not positive' WHEN coalesce(chunk_overlap, 0) < 0 THEN 'negative overlap'
        WHEN coalesce(chunk_overlap, 0) >= chunk_size THEN 'overlap not below size' WHEN chunk_keep_starts IS NULL THEN 'no keep-starts'
        WHEN len(chunk_keep_starts) <> n_chunks THEN 'keep-starts of another length' WHEN chunk_keep_starts[1] <> 0 THEN 'first keep-start not 0'
        WHEN len(list_filter(chunk_keep_starts, lambda x: x < 0 OR x > coalesce(chunk_overlap, 0))) > 0 THEN 'keep-start out of range' END AS problem
        FROM cfg LEFT JOIN q USING (seq_id)) SELECT * FROM r WHERE problem IS NOT NULL""",
    "keep_starts_changed": f"{PLAN} SELECT seq_id, chunk_no, keep_start, overlap FROM plan WHERE chunk_no > 0 AND keep_start <> overlap",
    "seam_diagnostics": f"{PLAN}, {ALL} SELECT seq_id, chunk_no, seam_row, {COLS} FROM seams JOIN m USING (seq_id) WHERE row = seam_row",
    "seam_jump_summary": f"{PLAN}, {ALL} SELECT seq_id, {G1.format(v='seam_delta')} FROM seams JOIN m USING (seq_id) WHERE row = seam_row AND seam_delta IS NOT NULL GROUP BY seq_id",
    "seam_windows": f"""{PLAN}, {ALL} SELECT seq_id, chunk_no, seam_row, count(*) AS n, round(avg(seam_delta), 6) AS mean, round(max(seam_delta), 6) AS max,
        round(arg_min(seam_delta, row), 6) AS first, round(arg_max(seam_delta, row), 6) AS last, arg_min(row, (-round(seam_delta, 9), row)) AS peak_row
        FROM seams JOIN m USING (seq_id) WHERE row BETWEEN seam_row AND seam_row + 9 AND seam_delta IS NOT NULL GROUP BY ALL""",
    "stitched_rows": f"""{PLAN}, o AS (SELECT seq_id, chunk_no, row_start + keep_start AS a, coalesce(lead(row_start + keep_start) OVER (PARTITION BY seq_id ORDER BY chunk_no), row_end) AS b FROM plan)
        SELECT seq_id, chunk_no, count(*) AS n_rows, min(frame) AS first_frame, max(frame) AS last_frame FROM o JOIN mesh USING (seq_id) WHERE row >= a AND row < b GROUP BY ALL""",
    "stitch_select": f"""{PLAN}, {DRIFTED}, {STITCH} SELECT seq_id, chunk_no, keep_start, round(t, 6) AS transl_jump, round(p, 6) AS pose_jump, round(m, 6) AS mesh_jump FROM chosen""",
    "stitch_override": f"""{PLAN}, {DRIFTED}, {STITCH}, o AS (SELECT seq_id, unnest(chunk_keep_starts) AS value, unnest(range(len(chunk_keep_starts))) AS chunk_no FROM cfg)
        SELECT c.seq_id, c.chunk_no, CASE WHEN value BETWEEN 0 AND overlap THEN value ELSE keep_start END AS keep_start, keep_start AS selected_keep_start,
            CASE WHEN value IS NULL THEN 'selected' WHEN value BETWEEN 0 AND overlap THEN 'override' ELSE 'refused' END AS source FROM chosen c LEFT JOIN o ON c.seq_id = o.seq_id AND c.chunk_no = o.chunk_no""",
    "chunk_summary": f"""{PLAN}, {ALL} SELECT seq_id, chunk_no, round(avg(seam_delta) FILTER (row - row_start < overlap AND chunk_no > 0), 6) AS overlap_mean,
        round(avg(seam_delta) FILTER (NOT (row - row_start < overlap AND chunk_no > 0)), 6) AS rest_mean FROM plan JOIN m USING (seq_id) WHERE row >= row_start AND row < row_end GROUP BY seq_id, chunk_no""",
}
