"""Differences, windows and smoothing along a sequence.

Sequences with a `row` column are worked on in blocks of positions with halos, so a sequence of any length is
many bounded tasks; the columns of one call share one exchange and one sort. Null and NaN differences count as no movement. The first frames of a sequence, which have no predecessor,
give null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from markerflow.operators.ranges import BLOCK_ROWS, along, follows
from markerflow.operators.ranges import top_k as first_k

#: Parts of a pose vector by its size: (first, length), counted from 0. Fixed by the layout of poses.
POSE_REGIONS = {
    165: {"body": (3, 63), "left_hand": (75, 45), "right_hand": (120, 45), "both_hands": (75, 90)},
    156: {"body": (3, 63), "left_hand": (66, 45), "right_hand": (111, 45), "both_hands": (66, 90)},
    66: {"body": (3, 63)},
}


def zero_if_missing(value: Column) -> Column:
    """NaN and null differences count as no movement."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def scalar_deltas(df: DataFrame, value: str, name: str) -> DataFrame:
    """|x_t - x_(t-1)|; null on the first frame of a sequence."""
    return along(df, lambda w: {name: F.when(follows(w), F.abs(zero_if_missing(F.col(value) - F.lag(value).over(w))))})


def scalar_jitter(df: DataFrame, value: str, name: str) -> DataFrame:
    """|x_t - 2 x_(t-1) + x_(t-2)|; null on the first two frames."""

    def bend(w: WindowSpec) -> dict[str, Column]:
        return {name: F.when(follows(w, 2), F.abs(zero_if_missing(F.col(value) - 2 * F.lag(value).over(w) + F.lag(value, 2).over(w))))}

    return along(df, bend)


def l2_step(now: Column, before: Column) -> Column:
    """Length of the difference of two vectors."""
    squares = F.zip_with(now, before, lambda a, b: F.pow(zero_if_missing(a.cast("double") - b.cast("double")), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def l2_bend(now: Column, before: Column, before2: Column) -> Column:
    """Length of the second difference of three vectors."""
    ahead = F.zip_with(now, before, lambda a, b: a.cast("double") - 2 * b.cast("double"))
    return F.sqrt(
        F.aggregate(
            F.zip_with(ahead, before2, lambda a, b: F.pow(zero_if_missing(a + b.cast("double")), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x
        )
    )


def vector_motion(df: DataFrame, vec: str) -> DataFrame:
    """`delta` and `accel` of a vector column; null where frames before are missing."""

    def motion(w: WindowSpec) -> dict[str, Column]:
        before, before2 = F.lag(vec).over(w), F.lag(vec, 2).over(w)
        return {"delta": F.when(follows(w), l2_step(F.col(vec), before)), "accel": F.when(follows(w, 2), l2_bend(F.col(vec), before, before2))}

    return along(df, motion)


def part_deltas(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """`seq_id, frame, region, delta`: steps of parts of a vector; null where a part or its predecessor is missing."""
    named = df.withColumns({f"_{k}": part for k, part in parts.items()})

    def steps(w: WindowSpec) -> dict[str, Column]:
        return {f"_d{k}": F.when(F.lag(f"_{k}").over(w).isNotNull() & F.col(f"_{k}").isNotNull(), l2_step(F.col(f"_{k}"), F.lag(f"_{k}").over(w))) for k in parts}

    stacked = F.create_map(*[x for k in parts for x in (F.lit(k), F.col(f"_d{k}"))])
    return along(named, steps).select("seq_id", "frame", F.explode(stacked).alias("region", "delta"))


def part_motion(df: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """`seq_id, row, region, metric, candidate, reference`: steps (`delta`) and bends (`accel`) of parts of two vectors; no row where a part or the frames
    before are missing, or the two differ in length."""
    named = df.withColumns({f"_{s}{k}": part for k, sides in parts.items() for s, part in zip("cr", sides)})

    def motion(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for k in parts:
            for s in "cr":
                now, one, two = F.col(f"_{s}{k}"), F.lag(f"_{s}{k}").over(w), F.lag(f"_{s}{k}", 2).over(w)
                out[f"_{s}delta{k}"] = F.when(now.isNotNull() & one.isNotNull(), l2_step(now, one))
                out[f"_{s}accel{k}"] = F.when(now.isNotNull() & one.isNotNull() & two.isNotNull(), l2_bend(now, one, two))
        return out

    rows = [
        F.struct(F.lit(k).alias("region"), F.lit(m).alias("metric"), F.col(f"_c{m}{k}").alias("candidate"), F.col(f"_r{m}{k}").alias("reference"))
        for k in parts
        for m in ("delta", "accel")
    ]
    moved = along(named, motion).select("seq_id", "row", F.explode(F.array(*rows)).alias("m")).select("seq_id", "row", "m.*")
    return moved.where("candidate is not null and reference is not null")


def region(vec: str, name: str) -> Column:
    """The part of a pose vector, null if a vector of its size has none."""
    out = F.lit(None).cast("array<double>")
    for size, parts in sorted(POSE_REGIONS.items()):
        if name in parts:
            first, length = parts[name]
            out = F.when(F.size(vec) >= size, F.slice(vec, first + 1, length)).otherwise(out)
    return out


def smooth_once(df: DataFrame, value: str, name: str, alpha: float = 0.5) -> DataFrame:
    """x + alpha (mean of both neighbours - x); before the first frame stands the first, after the last the one before it."""

    def smoothed(w: WindowSpec) -> dict[str, Column]:
        before = F.coalesce(F.lag(value).over(w), F.col(value))
        after = F.coalesce(F.lead(value).over(w), F.lag(value).over(w), F.col(value))
        return {name: F.col(value) + alpha * ((before + after) / 2 - F.col(value))}

    return along(df, smoothed)


def smoothed_vectors(df: DataFrame, vec: str, name: str, alpha: float = 0.5) -> DataFrame:
    """`smooth_once` of a vector column, number by number."""

    def smoothed(w: WindowSpec) -> dict[str, Column]:
        before = F.coalesce(F.lag(vec).over(w), F.col(vec))
        after = F.coalesce(F.lead(vec).over(w), F.lag(vec).over(w), F.col(vec))
        middle = F.zip_with(before, after, lambda a, b: (a + b) / 2)
        return {name: F.zip_with(F.col(vec), middle, lambda x, m: x + alpha * (m - x))}

    return along(df, smoothed, halo=1)


def smoothed_rounds(df: DataFrame, value: str, name: str, rounds: int = 15, alpha: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`smooth_once` as many times over as there are rounds, of a number column of `seq_id, row`.

    A round reaches one row further, so a block with a halo of as many rows as there are rounds, and one more, needs nothing else."""
    size, halo = max(block_rows, rounds + 1), rounds + 1
    block = lambda shift: F.floor(F.greatest(F.col("row") + shift, F.lit(0)) / size)
    spread = df.select("seq_id", "row", F.col(value).cast("double").alias(value), F.explode(F.array_distinct(F.array(block(-halo), block(0), block(halo)))).alias("_block"))
    schema = pa.schema([("seq_id", pa.from_numpy_dtype("int64") if dict(df.dtypes)["seq_id"] in ("bigint", "int") else pa.string()), ("row", pa.int64()), (name, pa.float64())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        at, x = rows.column("row").to_numpy(), rows.column(value).to_numpy().copy()
        for _ in range(rounds):
            before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-2:-1] if len(x) > 1 else x])
            x = x + alpha * ((before + after) / 2 - x)
        mine = np.flatnonzero(at // size == key[1].as_py())
        return pa.table([pa.array([key[0].as_py()] * len(mine), schema.types[0]), pa.array(at[mine], pa.int64()), pa.array(x[mine])], schema=schema)

    kind = "bigint" if schema.types[0] == pa.int64() else "string"
    done = spread.groupBy("seq_id", "_block").applyInArrow(run, f"seq_id {kind}, row bigint, {name} double")
    return done.withColumn("row", F.col("row").cast("int"))


def extrapolated(df: DataFrame, value: str, name: str, alpha: float) -> DataFrame:
    """What the two frames before predict: x_(t-1) + alpha (x_(t-1) - x_(t-2)); null where there aren't two."""

    def predicted(w: WindowSpec) -> dict[str, Column]:
        one, two = F.lag(value).over(w), F.lag(value, 2).over(w)
        return {name: one + alpha * (one - two)}

    return along(df, predicted)


def tumbling(frame: Column, size: int) -> Column:
    """The number of the window of `size` frames that a frame lies in."""
    return F.floor(frame / size)


def window_hotspots(
    df: DataFrame, size: int, top_k: int, keys: list[str] | None = None, positive: float = 0.0, negative: float = 0.0
) -> DataFrame:
    """`keys, side, rank, window, n, candidate_mean, reference_mean, delta` from per-frame `candidate` and `reference`:
    the windows whose mean grew by `positive` or more (side `up`) and fell by `negative` or more (side `down`) most; ties go to the earlier
    window. Frames where a side is missing do not count. `keys` are those of a sequence."""
    keys = keys or ["seq_id"]
    both = df.where(F.col("candidate").isNotNull() & F.col("reference").isNotNull())
    windows = both.groupBy(*keys, tumbling(F.col("frame"), size).alias("window")).agg(
        F.count("*").alias("n"), F.avg("candidate").alias("candidate_mean"), F.avg("reference").alias("reference_mean")
    )
    windows = windows.withColumn("delta", F.round(F.col("candidate_mean") - F.col("reference_mean"), 9))
    sides = []
    for side, order, keep in (("up", F.desc("delta"), F.col("delta") >= positive), ("down", F.asc("delta"), F.col("delta") <= -negative)):
        sides.append(first_k(windows.where(keep), keys, [order, "window"], top_k, ["window"], "rank").withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def downsampled(df: DataFrame, rate: str, unified: float) -> DataFrame:
    """Every n-th frame, n = the whole times that `unified` fits into the rate, 1 at least; a null or not positive rate keeps all."""
    step = F.greatest(F.lit(1), F.floor(F.coalesce(F.col(rate), F.lit(0.0)) / unified))
    return df.where(F.col("frame") % step == 0)


def frame_range(df: DataFrame, start: int, end: int | None, step: int) -> DataFrame:
    """Frames from start to before end, every step-th."""
    kept = df.where((F.col("frame") >= start) & ((F.col("frame") - start) % step == 0))
    return kept if end is None else kept.where(F.col("frame") < end)


def ramp_prepended(df: DataFrame, value: str, steps: int) -> DataFrame:
    """`steps` frames of a straight line from 0 to the first value before each sequence, whose frames move up by as many."""
    first = df.groupBy("seq_id").agg(F.min_by(value, "frame").alias("_first"))
    ramp = first.select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("frame"), "_first").select(
        "seq_id", "frame", (F.col("_first") * F.col("frame") / (steps - 1)).alias(value)
    )
    return ramp.unionByName(df.select("seq_id", (F.col("frame") + steps).cast("int").alias("frame"), value))


def velocity_terms(df: DataFrame, value: str) -> DataFrame:
    """Per sequence the sums of squared values, first and second differences."""

    def squares(w: WindowSpec) -> dict[str, Column]:
        one, two = F.lag(value).over(w), F.lag(value, 2).over(w)
        return {
            "_velo": F.pow(F.col(value) - one, F.lit(2.0)),
            "_accel": F.pow(F.col(value) - 2 * one + two, F.lit(2.0)),
            "_value": F.pow(F.col(value), F.lit(2.0)),
        }

    return along(df, squares).groupBy("seq_id").agg(
        F.coalesce(F.sum("_value"), F.lit(0.0)).alias("data"), F.coalesce(F.sum("_velo"), F.lit(0.0)).alias("velocity"), F.coalesce(F.sum("_accel"), F.lit(0.0)).alias("acceleration")
    )
