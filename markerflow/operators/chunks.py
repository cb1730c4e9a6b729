"""Overlapping chunks of sequences, their seams, and choosing where to stitch them.

A chunk plan is arithmetic on the length of a sequence: starts step by size less overlap until the end
is reached. Starts are exploded, never frames, so a plan costs as many rows as it has chunks. Frames meet chunks by
an equi-join on the sequence and the chunk numbers that can cover them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from markerflow.operators.ranges import along
from markerflow.operators.temporal import l2_bend, l2_step


def usable_settings(settings: DataFrame) -> DataFrame:
    """Settings that can be planned with: a size above 0, and an overlap of 0 to less than it (null is 0).
    Out-of-range settings are left out here and reported by `settings_report`."""
    kept = settings.withColumn("overlap", F.coalesce("chunk_overlap", F.lit(0)))
    return kept.where("chunk_size > 0 and overlap >= 0 and overlap < chunk_size")


def settings_report(settings: DataFrame, plan: DataFrame) -> DataFrame:
    """`seq_id, problem`: settings that break a rule, the first rule broken; sound ones are not listed."""
    chunks = plan.groupBy("seq_id").agg(F.count("*").alias("n_chunks"))
    rows = settings.join(chunks, "seq_id", "left")
    keeps = F.col("chunk_keep_starts")
    problem = (
        F.when(F.col("chunk_size").isNull(), "no size")
        .when(F.col("chunk_size") <= 0, "size not positive")
        .when(F.coalesce("chunk_overlap", F.lit(0)) < 0, "negative overlap")
        .when(F.coalesce("chunk_overlap", F.lit(0)) >= F.col("chunk_size"), "overlap not below size")
        .when(keeps.isNull(), "no keep-starts")
        .when(F.size(keeps) != F.col("n_chunks"), "keep-starts of another length")
        .when(F.get(keeps, F.lit(0)) != 0, "first keep-start not 0")
        .when(F.exists(keeps, lambda k: (k < 0) | (k > F.coalesce(F.col("chunk_overlap"), F.lit(0)))), "keep-start out of range")
    )
    return rows.select("seq_id", problem.alias("problem")).where("problem is not null")


def chunk_plan(lengths: DataFrame, settings: DataFrame) -> DataFrame:
    """`seq_id, chunk_no, row_start, row_end, keep_start, overlap`: row_end is exclusive; a keep-start that isn't recorded is the overlap."""
    rows = lengths.join(usable_settings(settings), "seq_id")
    step = F.greatest(F.col("chunk_size") - F.col("overlap"), F.lit(1))
    beyond = F.greatest(F.col("n_frames") - F.col("chunk_size"), F.lit(0))
    count = F.lit(1) + F.ceil(beyond / step)
    numbers = F.sequence(F.lit(0), (count - 1).cast("int"))
    plan = rows.select("seq_id", "n_frames", "chunk_size", "overlap", "chunk_keep_starts", step.alias("step"), F.explode(numbers).alias("chunk_no"))
    kept = F.coalesce(F.get("chunk_keep_starts", F.col("chunk_no")), F.col("overlap"))
    return plan.select(
        "seq_id",
        "chunk_no",
        (F.col("chunk_no") * F.col("step")).cast("int").alias("row_start"),
        F.least(F.col("chunk_no") * F.col("step") + F.col("chunk_size"), F.col("n_frames")).cast("int").alias("row_end"),
        F.when(F.col("chunk_no") == 0, F.lit(0)).otherwise(F.least(F.greatest(kept, F.lit(0)), F.col("overlap"))).cast("int").alias("keep_start"),
        F.col("overlap").cast("int").alias("overlap"),
    )


def seam_plan(plan: DataFrame) -> DataFrame:
    """`seq_id, chunk_no, seam_row`: where a chunk takes over in the stitched sequence, row_start + keep_start; the first chunk has no seam."""
    return plan.where("chunk_no > 0").select("seq_id", "chunk_no", (F.col("row_start") + F.col("keep_start")).alias("seam_row"))


def owned_rows(plan: DataFrame) -> DataFrame:
    """`seq_id, chunk_no, first_row, end_row`: the rows that each chunk gives to the stitched sequence, every row exactly once."""
    first = F.col("row_start") + F.col("keep_start")
    order = Window.partitionBy("seq_id").orderBy("chunk_no")
    after = F.coalesce(F.lead(first).over(order), F.col("row_end"))
    return plan.select("seq_id", "chunk_no", first.alias("first_row"), after.alias("end_row"))


def chunked_frames(frames: DataFrame, plan: DataFrame, bucket: int = 64) -> DataFrame:
    """Every (chunk, frame) pair, frames in an overlap twice: an equi-join on buckets of rows, then the exact range."""
    covers = plan.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("row_start") / bucket), F.floor((F.col("row_end") - 1) / bucket))))
    placed = frames.withColumn("bucket", F.floor(F.col("row") / bucket))
    return placed.join(covers, ["seq_id", "bucket"]).where("row >= row_start and row < row_end").drop("bucket")


def motion_columns(frames: DataFrame, vec: str) -> DataFrame:
    """Per frame the step into it, the steps around it and the bends before and after it, all from one window."""

    def motion(w: WindowSpec) -> dict[str, Column]:
        one, two, ahead, here = F.lag(vec, 1).over(w), F.lag(vec, 2).over(w), F.lead(vec, 1).over(w), F.col(vec)
        return {
            "prev_delta": F.when(_all_there(one, two), l2_step(one, two)),
            "seam_delta": F.when(_all_there(one), l2_step(here, one)),
            "next_delta": F.when(_all_there(ahead), l2_step(ahead, here)),
            "pre_accel": F.when(_all_there(one, two), l2_bend(here, one, two)),
            "post_accel": F.when(_all_there(ahead, one), l2_bend(ahead, here, one)),
        }

    return along(frames, motion)


def _all_there(*columns: Column) -> Column:
    there = F.lit(True)
    for c in columns:
        there = there & c.isNotNull()
    return there


def seam_diagnostics(frames: DataFrame, plan: DataFrame, vec: str) -> DataFrame:
    """The motion columns at every seam; null where a neighbour is out of range."""
    at = seam_plan(plan).withColumnRenamed("seam_row", "row")
    columns = ["prev_delta", "seam_delta", "next_delta", "pre_accel", "post_accel"]
    return motion_columns(frames, vec).join(at, ["seq_id", "row"]).select("seq_id", "chunk_no", F.col("row").alias("seam_row"), *columns)


def seam_windows(frames: DataFrame, plan: DataFrame, vec: str, width: int) -> DataFrame:
    """`seq_id, chunk_no, seam_row, n, mean, max, first, last, peak_row`: steps in the `width` rows from each seam on."""
    steps = along(frames, lambda w: {"delta": F.when(F.lag(vec).over(w).isNotNull(), l2_step(F.col(vec), F.lag(vec).over(w)))}).select("seq_id", "row", "delta")
    rows = seam_plan(plan).withColumn("row", F.explode(F.sequence(F.col("seam_row"), F.col("seam_row") + width - 1)))
    return (
        rows.join(steps, ["seq_id", "row"])
        .where("delta is not null")
        .groupBy("seq_id", "chunk_no", "seam_row")
        .agg(
            F.count("*").alias("n"),
            F.avg("delta").alias("mean"),
            F.max("delta").alias("max"),
            F.min_by("delta", "row").alias("first"),
            F.max_by("delta", "row").alias("last"),
            F.min_by("row", F.struct(-F.round("delta", 9), F.col("row"))).alias("peak_row"),
        )
    )


def stitch_candidates(chunks: DataFrame, transl: str, pose: str | None = None, mesh: str | None = None) -> DataFrame:
    """`seq_id, chunk_no, overlap, keep, transl_jump, pose_jump, mesh_jump`: for every way to enter a chunk, from keeping its second frame
    to the end of its overlap, how far its vectors lie from those of the frame that the chunk before would end with; 0 for a vector not named."""
    named = {"transl": transl, "pose": pose, "mesh": mesh}
    held = {k: c for k, c in named.items() if c}
    prev = chunks.select("seq_id", (F.col("chunk_no") + 1).alias("chunk_no"), (F.col("row") + 1).alias("row"), *[F.col(c).alias(f"_{k}") for k, c in held.items()])
    keep = F.col("row") - F.col("row_start")
    both = chunks.where("chunk_no > 0").join(prev, ["seq_id", "chunk_no", "row"]).where((keep >= 1) & (keep <= F.col("overlap")))
    jumps = [(l2_step(F.col(named[k]), F.col(f"_{k}")) if k in held else F.lit(0.0)).alias(f"{k}_jump") for k in named]
    return both.select("seq_id", "chunk_no", "overlap", keep.alias("keep"), *jumps)


def select_keep_starts(plan: DataFrame, candidates: DataFrame, guards: tuple[str, ...] = ("pose", "mesh"), near: float = 4.5e-4) -> DataFrame:
    """`seq_id, chunk_no, overlap, keep_start, transl_jump, pose_jump, mesh_jump` of every chunk but the first.

    A candidate with a larger jump of a guard than at the default, the whole overlap, is out. With guards, of the candidates within `near` of the
    least jump of the translation that with the least jump of the pose is taken, without guards the least jump; further ties go to the other jumps and
    then to the longest overlap. Where the default can't be measured, or nothing is left, it is taken."""
    chunk = ["seq_id", "chunk_no"]
    jumps = ["transl_jump", "pose_jump", "mesh_jump"]
    usual = candidates.where("keep = overlap").select(*chunk, *[F.col(f"{g}_jump").alias(f"_{g}") for g in guards])
    able = candidates.join(usual, chunk) if guards else candidates
    for g in guards:
        able = able.where(F.col(f"{g}_jump") <= F.col(f"_{g}"))
    rank = ["transl_jump", "pose_jump", "mesh_jump"]
    if guards:
        able = able.withColumn("_least", F.min("transl_jump").over(Window.partitionBy(*chunk))).where(F.col("transl_jump") <= F.col("_least") + near)
        rank = ["pose_jump", "transl_jump", "mesh_jump"]
    best = able.groupBy(*chunk).agg(F.min_by(F.struct("keep", *jumps), F.struct(*rank, -F.col("keep"))).alias("b"))
    rows = plan.where("chunk_no > 0").select(*chunk, "overlap").join(best, chunk, "left")
    return rows.select(*chunk, "overlap", F.coalesce("b.keep", "overlap").cast("int").alias("keep_start"), *[F.col(f"b.{j}").alias(j) for j in jumps])


def overridden_keep_starts(selected: DataFrame, overrides: DataFrame) -> DataFrame:
    """`selected` with `keep_start` from `overrides` (`seq_id, chunk_no, value`, one per chunk), and where it comes from: `selected_keep_start` before, and
    `source`, which is `selected`, `override` or, for a value that is not from 0 to the overlap and not applied, `refused`."""
    met = selected.join(overrides.select("seq_id", "chunk_no", "value"), ["seq_id", "chunk_no"], "left")
    able = F.col("value").between(F.lit(0), F.col("overlap"))
    source = F.when(F.col("value").isNull(), "selected").when(able, "override").otherwise("refused")
    return met.withColumn("source", source).withColumn("selected_keep_start", F.col("keep_start")).withColumn(
        "keep_start", F.when(F.col("source") == "override", F.col("value")).otherwise(F.col("keep_start")).cast("int")
    ).drop("value")


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def square_sum(v: Column) -> Column:
    return F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)


def seam_anchors(chunks: DataFrame, vec: str, base: str) -> DataFrame:
    """`seq_id, chunk_no, at, anchor, at_base, next_base`: the last row of the chunk before, its vector there, and the chunk's own base there and one
    row on, null where it has none."""
    last = chunks.groupBy("seq_id", (F.col("chunk_no") + 1).alias("chunk_no")).agg(F.max("row").alias("at"), F.max_by(vec, "row").alias("anchor"))
    here = chunks.select("seq_id", "chunk_no", F.col("row").alias("at"), F.col(base).alias("at_base"))
    after = chunks.select("seq_id", "chunk_no", (F.col("row") - 1).alias("at"), F.col(base).alias("next_base"))
    known = chunks.select("seq_id", "chunk_no").distinct()
    key = ["seq_id", "chunk_no", "at"]
    return last.join(known, ["seq_id", "chunk_no"]).join(here, key, "left").join(after, key, "left")


def velocity_references(chunks: DataFrame, vec: str, base: str, kind: str, window: int = 1) -> DataFrame:
    """`seq_id, chunk_no, k, reference`: what a chunk would be if it went on from the end of the chunk before; k counts from 0.

    `anchor` is the last vector of the chunk before alone. `full` moves the whole base of the chunk so that it meets the anchor at its row. `window` is the
    anchor and how far the base comes from there in the next `window` rows. `zero_seam` begins with the anchor, stays there for one row and goes
    on as the base does from the seam on. Chunks without a predecessor have none; where the base does not reach the seam the anchor alone is left."""
    anchors = seam_anchors(chunks, vec, base)
    alone = anchors.select("seq_id", "chunk_no", F.lit(0).alias("k"), F.col("anchor").alias("reference"))
    if kind == "anchor":
        return alone
    met = chunks.select("seq_id", "chunk_no", "row", "row_start", F.col(base).alias("_base")).join(anchors, ["seq_id", "chunk_no"])
    whole = F.col("at_base").isNotNull()
    if kind == "full":
        rows = met.where(whole).select("seq_id", "chunk_no", (F.col("row") - F.col("row_start")).alias("k"), plus(F.col("_base"), minus(F.col("anchor"), F.col("at_base"))).alias("reference"))
        return rows.unionByName(anchors.where(~whole).select("seq_id", "chunk_no", F.lit(0).alias("k"), F.col("anchor").alias("reference")))
    start = {"window": F.col("at_base"), "zero_seam": F.col("next_base")}[kind]
    seam = whole & F.col("next_base").isNotNull()
    later = met.where(seam & (F.col("row") > F.col("at")) & (F.col("row") <= F.col("at") + window))
    return alone.unionByName(later.select("seq_id", "chunk_no", (F.col("row") - F.col("at")).alias("k"), plus(F.col("anchor"), minus(F.col("_base"), start)).alias("reference")))


def chunk_velocity_terms(chunks: DataFrame, vec: str, base: str, mode: str, weight: float = 1.0, window: int = 1) -> DataFrame:
    """`seq_id, chunk_no, row, term`: squared steps along a chunk, weighed, 0 on its first row.

    With mode `plain` that is all. `full` measures steps against those of the full reference, and the first row against its start. `anchor`
    measures the seam, the row after the end of the chunk before, against that end. `window` measures the `window` rows from the seam on against the steps of
    the window reference."""
    order = Window.partitionBy("seq_id", "chunk_no").orderBy("row")
    rows = chunks.select("seq_id", "chunk_no", "row", "row_start", F.col(vec).alias("_v"), F.lag(vec).over(order).alias("_v1"))
    scale = F.lit(weight * weight)
    plain = F.when(F.col("_v1").isNotNull(), square_sum(minus(F.col("_v"), F.col("_v1")))).otherwise(F.lit(0.0))
    if mode == "plain":
        return rows.select("seq_id", "chunk_no", "row", (plain * scale).alias("term"))
    refs = velocity_references(chunks, vec, base, mode, window).withColumn("_r1", F.lag("reference").over(Window.partitionBy("seq_id", "chunk_no").orderBy("k")))
    if mode == "full":
        told = refs.select("seq_id", "chunk_no", "k", "reference", "_r1")
        met = rows.withColumn("k", F.col("row") - F.col("row_start")).join(told, ["seq_id", "chunk_no", "k"], "left")
        against = F.when(F.col("k") == 0, square_sum(minus(F.col("_v"), F.col("reference")))).otherwise(square_sum(minus(minus(F.col("_v"), F.col("_v1")), minus(F.col("reference"), F.col("_r1")))))
        term = F.when(F.col("reference").isNotNull() & ((F.col("k") == 0) | F.col("_r1").isNotNull()), against).otherwise(plain)
        return met.select("seq_id", "chunk_no", "row", (term * scale).alias("term"))
    ends = seam_anchors(chunks, vec, base).select("seq_id", "chunk_no", F.col("at"))
    shift = 0 if mode == "anchor" else 1
    met = rows.join(ends, ["seq_id", "chunk_no"], "left").withColumn("k", (F.col("row") - F.col("at") - 1 + shift).cast("int"))
    met = met.join(refs.select("seq_id", "chunk_no", "k", "reference", "_r1"), ["seq_id", "chunk_no", "k"], "left")
    first = F.col("row") == F.col("at") + 1
    against = F.when(first, square_sum(minus(F.col("_v"), F.col("reference")))).otherwise(square_sum(minus(minus(F.col("_v"), F.col("_v1")), minus(F.col("reference"), F.col("_r1")))))
    term = F.when(F.col("reference").isNotNull() & (F.col("row") > F.col("at")), against).otherwise(plain)
    return met.select("seq_id", "chunk_no", "row", (term * scale).alias("term"))


def boundary_terms(chunks: DataFrame, vec: str, base: str, weight: float = 1.0, window: int = 1) -> DataFrame:
    """`seq_id, chunk_no, row, term`: the weighed squared distance of the rows from the seam on from the zero-seam reference, where that lies wholly in the chunk."""
    refs = velocity_references(chunks, vec, base, "zero_seam", window)
    spans = refs.groupBy("seq_id", "chunk_no").agg(F.max("k").alias("last"))
    ends = chunks.groupBy("seq_id", "chunk_no").agg(F.max("row").alias("end"))
    seams = seam_anchors(chunks, vec, base).select("seq_id", "chunk_no", (F.col("at") + 1).alias("seam"))
    able = seams.join(spans, ["seq_id", "chunk_no"]).join(ends, ["seq_id", "chunk_no"]).where("seam + last <= end")
    rows = chunks.select("seq_id", "chunk_no", "row", F.col(vec).alias("_v")).join(able, ["seq_id", "chunk_no"]).withColumn("k", (F.col("row") - F.col("seam")).cast("int"))
    term = square_sum(minus(F.col("_v"), F.col("reference"))) * weight * weight
    return rows.join(refs, ["seq_id", "chunk_no", "k"]).select("seq_id", "chunk_no", "row", term.alias("term"))


def replaced_window(chunks: DataFrame, base: str, other: str, start: int, size: int) -> DataFrame:
    """`chunks` with `base` taken from `other` in the `size` rows of each chunk from its row `start` on, where `other` has a value."""
    at = F.col("row") - F.col("row_start")
    return chunks.withColumn(base, F.when((at >= start) & (at < start + size), F.coalesce(other, base)).otherwise(F.col(base)))


def scaled_weights(rows: DataFrame, weight: str, at: Column, start: int, size: int, scale: float, masked: Column) -> DataFrame:
    """`rows` with `weight` scaled where `masked` and `at`, the place in its chunk, lies in the `size` places from `start` on."""
    inside = (at >= max(start, 0)) & (at < max(start, 0) + size) & masked
    return rows.withColumn(weight, F.when(inside, F.col(weight) * scale).otherwise(F.col(weight)))


def spliced(chunks: DataFrame, vec: str) -> DataFrame:
    """`seq_id, chunk_no, row, value`: each chunk with its overlap overwritten by the end of the chunk before, and the
    rest moved by as much as the seam frame was."""
    prev = chunks.select("seq_id", (F.col("chunk_no") + 1).alias("chunk_no"), "row", F.col(vec).alias("_prev"))
    met = chunks.join(prev, ["seq_id", "chunk_no", "row"], "left")
    seam = met.where("_prev is not null").groupBy("seq_id", "chunk_no").agg(F.max_by(minus(F.col("_prev"), F.col(vec)), "row").alias("_moved"))
    rows = met.join(seam, ["seq_id", "chunk_no"], "left")
    moved = F.when(F.col("_moved").isNull(), F.col(vec)).otherwise(plus(F.col(vec), F.col("_moved")))
    return rows.select("seq_id", "chunk_no", "row", F.coalesce("_prev", moved).alias("value"))


def peak_metric(columns: list[str]) -> Column:
    """Name and value of the largest of some metrics; null counts as 0, of equals the first named."""
    rank = F.array(*[F.struct(F.coalesce(c, F.lit(0.0)).alias("value"), F.lit(-i).alias("order"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    return F.array_max(rank)
