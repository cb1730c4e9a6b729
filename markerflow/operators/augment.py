"""Sampling and augmentation that gives the same rows however they are partitioned.

Every draw is the rank of a keyed hash, never a generator's state, so results survive lost executors and
repartitioning. The key names the seed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerflow.operators.geometry import area_shares
from markerflow.operators.ranges import numbered, top_k


def draw(seed: int, *keys: str | Column) -> Column:
    """A text that orders rows at random, the same for the same seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def picked_frames(frames: DataFrame, per_seq: int, seed: int) -> DataFrame:
    """Up to `per_seq` frames of each sequence without replacement."""
    return top_k(frames, ["seq_id"], [draw(seed, "seq_id", "frame"), "frame"], per_seq, ["frame"], "_n").drop("_n")


def relaxed_threshold(frames: DataFrame, least: float, wanted: int, step: float = 0.01) -> DataFrame:
    """`seq_id, threshold`: the highest availability, going down from `least` by `step`, that enough frames reach, 0 if none.

    The frames' rates are counted by step, so no threshold is tried one by one."""
    level = F.least(F.floor((F.lit(least) - F.col("rate")) / step + F.lit(1 - 1e-9)), F.lit(int(round(least / step))))
    levels = frames.withColumn("level", F.greatest(level, F.lit(0))).groupBy("seq_id", "level").count()
    upto = levels.withColumn("upto", F.sum("count").over(Window.partitionBy("seq_id").orderBy("level")))
    enough = upto.groupBy("seq_id").agg(F.min(F.when(F.col("upto") >= wanted, F.col("level"))).alias("level"))
    return enough.select("seq_id", F.when(F.col("level").isNull(), 0.0).otherwise(F.round(least - F.col("level") * step, 6)).alias("threshold"))


def occluded(points: DataFrame, per_frame: int, seed: int) -> DataFrame:
    """`points` with `occluded`: up to `per_frame` seen markers of each frame, drawn without replacement, lose their place."""
    order = Window.partitionBy("seq_id", "frame").orderBy(draw(seed, "seq_id", "frame", "marker_idx"), "marker_idx")
    hit = F.row_number().over(order) <= per_frame
    return points.withColumn("occluded", hit).withColumns({c: F.when(~F.col("occluded"), F.col(c)) for c in "xyz"})


def closed(seed: int, *keys: str | Column, width: float = 1.0) -> Column:
    """A number from 0 to `width`, both included, the same for the same seed and keys."""
    return width * F.conv(F.substring(draw(seed, *keys), 1, 6), 16, 10).cast("double") / 16_777_215


def normal(seed: int, *keys: str | Column) -> Column:
    """A number drawn from the standard normal distribution, from two uniform ones."""
    far = F.sqrt(-2 * F.log(F.greatest(closed(seed, *keys, F.lit("r")), F.lit(1 / 16_777_216))))
    return far * F.cos(2 * math.pi * closed(seed, *keys, F.lit("a")))


def ghosts(points: DataFrame, per_frame: int, seed: int, kind: str = "spread") -> DataFrame:
    """`seq_id, frame, ghost, x, y, z`: points that belong to no marker.

    `spread`: the lower median of the frame's markers plus -2 to 2 times the sample deviation of each axis, all parts equally likely. `gaussian`: the median plus a
    normal part of that deviation. `uniform`: -2 to 2 on each axis, whatever the markers. `skewed`: normal about a middle drawn for the frame, -2 to 2 on each axis,
    with axes that depend on each other to a degree drawn for the frame, each of deviation 1."""
    middle = points.groupBy("seq_id", "frame").agg(
        *[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").alias(f"m{c}") for c in "xyz"], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"s{c}") for c in "xyz"]
    )
    rows = middle.withColumn("ghost", F.explode(F.sequence(F.lit(0), F.lit(per_frame - 1))))
    wide = lambda *keys: closed(seed, "seq_id", "frame", *keys, width=4.0) - 2
    of = {c: normal(seed, "seq_id", "frame", "ghost", F.lit(c)) for c in "xyz"}

    def skewed(c: str) -> Column:
        weights = [wide(F.lit(f"{c}{d}")) if d != c else F.lit(1.0) for d in "xyz"[: "xyz".index(c) + 1]]
        length = F.sqrt(sum((w * w for w in weights[1:]), weights[0] * weights[0]))
        return wide(F.lit(f"m{c}")) + sum((w * of[d] for w, d in zip(weights[1:], "yz")), weights[0] * of["x"]) / length

    def place(c: str) -> Column:
        if kind == "uniform":
            return wide("ghost", F.lit(c))
        if kind == "skewed":
            return skewed(c)
        if kind not in ("spread", "gaussian"):
            raise ValueError(f"no such kind of ghosts: {kind}")
        return F.col(f"m{c}") + F.nanvl(F.col(f"s{c}"), F.lit(0.0)) * (wide("ghost", F.lit(c)) if kind == "spread" else of[c])

    return rows.select("seq_id", "frame", "ghost", *[place(c).alias(c) for c in "xyz"])


def broken_tracks(points: DataFrame, seed: int) -> DataFrame:
    """`points` with `track`: half of the tracks are cut at a drawn frame; what follows is a new track, numbered after all others."""
    tracks = points.groupBy("seq_id", "marker_idx").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    number = F.conv(F.substring(draw(seed, "seq_id", "marker_idx"), 1, 6), 16, 10).cast("bigint")
    cut = F.when(number % 2 == 0, F.col("lo") + 1 + F.floor(number / 2) % F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    cuts = tracks.select("seq_id", "marker_idx", cut.alias("cut"), (F.max("marker_idx").over(Window.partitionBy("seq_id")) + 1).alias("above"))
    rows = points.join(cuts, ["seq_id", "marker_idx"])
    return rows.withColumn("track", F.when(F.col("frame") >= F.col("cut"), F.col("marker_idx") + F.col("above")).otherwise(F.col("marker_idx"))).drop("cut", "above")


def shuffled_slots(points: DataFrame, seed: int) -> DataFrame:
    """`points` with `slot`, a permutation of the markers of each frame; ordering by marker_idx again inverts it."""
    order = Window.partitionBy("seq_id", "frame").orderBy(draw(seed, "seq_id", "frame", "marker_idx"), "marker_idx")
    return points.withColumn("slot", F.row_number().over(order) - 1)


def exact_fraction(rows: DataFrame, key: str, fraction: float, seed: int, buckets: int = 4_096) -> DataFrame:
    """The whole part of `fraction` of all rows, drawn without replacement by `key`.

    Rows are counted by the first digits of their draw. Whole buckets below the one where the count is reached are
    kept, and only rows of that one bucket are ranked, so no task orders all rows."""
    drawn = rows.withColumn("_d", draw(seed, key)).withColumn("_b", F.conv(F.substring("_d", 1, 6), 16, 10).cast("bigint") % buckets)
    sizes = drawn.groupBy("_b").count()
    upto = sizes.select("_b", "count", F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("count").over(Window.partitionBy(F.lit(1))).alias("all"))
    quota = upto.select("_b", F.least(F.greatest(F.floor(F.col("all") * fraction) - F.coalesce("before", F.lit(0)), F.lit(0)), F.col("count")).alias("take"), "count")
    placed = drawn.join(F.broadcast(quota), "_b")
    whole = placed.where(F.col("take") == F.col("count"))
    part = placed.where((F.col("take") > 0) & (F.col("take") < F.col("count"))).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_d", key)))
    return whole.unionByName(part.where(F.col("_n") <= F.col("take")).drop("_n")).drop("_d", "_b", "take", "count")


def noise_model(residuals: DataFrame, key: list[str], seed: int) -> DataFrame:
    """`label, slot, dx, dy, dz`: every residual of each label, numbered from 0 in drawn order; `key` names a residual.

    A label has as many samples as the largest label has residuals; its sample k is the residual at slot k modulo its own
    count. The repeats are not written out: their number is that of labels times the largest pool."""
    drawn = residuals.withColumn("_d", draw(seed, "label", *key))
    # The first digits of a draw are buckets that grow with it.
    placed = numbered(drawn, "label", F.substring("_d", 1, 3), ["_d", *key], "slot")
    return placed.select("label", "slot", "dx", "dy", "dz")


def noise_sizes(model: DataFrame) -> DataFrame:
    """`label, n, size`: the residuals of each label, and the samples that all labels have: the count of the largest."""
    return with_size(model.groupBy("label").agg(F.count("*").alias("n")))


def with_size(counts: DataFrame) -> DataFrame:
    """`counts`, a row for each label, with `size`, the largest `n`; only this row of each label is gathered."""
    return counts.withColumn("size", F.max("n").over(Window.partitionBy(F.lit(1))))


def with_noise(points: DataFrame, model: DataFrame, seed: int) -> DataFrame:
    """`points` moved by a drawn sample of their label's model; labels without one stay."""
    number = F.conv(F.substring(draw(seed, "seq_id", "frame", "marker_idx"), 1, 15), 16, 10).cast("bigint")
    sized = points.join(noise_sizes(model), "label", "left").withColumn("slot", (number % F.col("size") % F.col("n")).cast("int"))
    met = sized.join(model, ["label", "slot"], "left")
    return met.withColumns({c: F.col(c) + F.coalesce(f"d{c}", F.lit(0.0)) for c in "xyz"}).drop("dx", "dy", "dz", "n", "size")


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1), the same for the same seed and keys."""
    return F.conv(F.substring(draw(seed, *keys), 1, 6), 16, 10).cast("double") / 16_777_216


GHOST_LABEL = "nan"


def corrupted(points: DataFrame, hidden: int, n_ghosts: int, seed: int) -> DataFrame:
    """`seq_id, frame, marker_idx, label, x, y, z, slot, track`: recorded readings as a poor recording would give them, with the label of each.

    Up to `hidden` markers of a frame are hidden, ghosts are added about its middle (markers -1, -2, ... with the label GHOST_LABEL), the readings of a frame are
    permuted (`slot`), and half of the tracks break at a frame into two (`track`). Every step draws by its own seed."""
    left = occluded(points, hidden, seed).where(~F.col("occluded")).select("seq_id", "frame", "marker_idx", "label", "x", "y", "z")
    extra = ghosts(left, n_ghosts, seed + 1).select("seq_id", "frame", (-1 - F.col("ghost")).alias("marker_idx"), F.lit(GHOST_LABEL).alias("label"), "x", "y", "z")
    return broken_tracks(shuffled_slots(left.unionByName(extra), seed + 2), seed + 3)


def assigned(rows: DataFrame, order: DataFrame) -> DataFrame:
    """`rows` with `ord`, the place of their label in the canonical order, or its length for a label that it doesn't have, and `weight`, the share of
    rows of a take that have another place: rare places weigh more. `order` is a list of labels of bounded size."""
    size = order.agg((F.max("ord") + 1).alias("_size"))
    met = rows.join(F.broadcast(order.select("label", "ord")), "label", "left").join(F.broadcast(size)).withColumn("ord", F.coalesce("ord", "_size")).drop("_size")
    counts = met.groupBy("seq_id", "ord").agg(F.count("*").alias("_n"))
    shares = counts.withColumn("weight", 1 - F.col("_n") / F.sum("_n").over(Window.partitionBy("seq_id"))).drop("_n")
    return met.join(shares, ["seq_id", "ord"])


def frames_by_name(frames: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of `frames` whose take and frame are named as `take_frame` in the column `name` of `names`; the frame is what follows the last underscore."""
    at = names.select(F.regexp_extract("name", r"^(.*)_(\d+)$", 1).alias("seq_id"), F.regexp_extract("name", r"^(.*)_(\d+)$", 2).try_cast("int").alias("frame"))
    return frames.join(at.distinct(), ["seq_id", "frame"], "left_semi")


def frames_in_all(frames: DataFrame, n: int, seed: int, strict: bool = False) -> DataFrame:
    """`n` frames drawn from all sequences together without replacement; with `strict` fewer are an error."""
    drawn = top_k(frames.withColumn("_all", F.lit(0)), ["_all"], [draw(seed, "seq_id", "frame"), "seq_id", "frame"], n, ["seq_id", "frame"], "_n").drop("_all", "_n")
    if strict and drawn.count() < n:
        raise ValueError(f"fewer than {n} frames to draw from")
    return drawn


def sampled_windows(frames: DataFrame, vec: str, size: int, one_in: int, seed: int) -> DataFrame:
    """`seq_id, frame, window, angle` and `vec` of the windows of `size` rows that a draw picks, one in `one_in` on average, turned about the vertical axis
    by an angle drawn for each window; windows that a sequence doesn't fill are left out. `vec` is flat, of points."""
    rows = frames.withColumn("window", F.floor(F.col("row") / size))
    picked = rows.where(F.floor(uniform(seed, "seq_id", "window") * one_in) == 0).withColumn("angle", uniform(seed + 1, "seq_id", "window") * 2 * math.pi)
    full = picked.groupBy("seq_id", "window").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("seq_id", "window")
    cos, sin = F.cos("angle"), F.sin("angle")

    def turned(v: Column, i: Column) -> Column:
        other = F.get(F.col(vec), F.when(i % 3 == 0, i + 1).otherwise(i - 1)).cast("double")
        return F.when(i % 3 == 0, v * cos - other * sin).when(i % 3 == 1, other * sin + v * cos).otherwise(v.cast("double"))

    return picked.join(full, ["seq_id", "window"], "left_semi").withColumn(vec, F.transform(vec, turned))


def surface_draws(faces: DataFrame, n: int, seed: int) -> DataFrame:
    """`seq_id, k, face`: `n` faces of each mesh, drawn with replacement by their areas; `faces` has `seq_id, face, area`. A mesh's faces are one row's work."""
    listed = area_shares(faces).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("upto", "face"))).alias("_f"))
    drawn = listed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_u", uniform(seed, "seq_id", "k"))
    first = F.filter("_f", lambda f: f.getField("upto") > F.col("_u"))
    return drawn.select("seq_id", "k", F.coalesce(F.get(first, F.lit(0)).getField("face"), F.element_at("_f", -1).getField("face")).alias("face"))


def moved_vertices(layout: DataFrame, near: DataFrame, seed: int) -> DataFrame:
    """`layout` with `vid` replaced by a vertex drawn from its neighbourhood `near` (`seq_id, seed, vid`); a vertex without neighbours stays."""
    rows = near.withColumnRenamed("vid", "_new").withColumn("_d", draw(seed, "seq_id", "seed", "_new"))
    first = rows.groupBy("seq_id", "seed").agg(F.min_by("_new", "_d").alias("_new"))
    met = layout.join(first, (layout["seq_id"] == first["seq_id"]) & (layout["vid"] == first["seed"]), "left").drop(first["seq_id"])
    return met.withColumn("vid", F.coalesce("_new", "vid")).drop("seed", "_new")
