"""Summary statistics in the flavours the operators need; each is named after what it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerflow.functions.points import finite
from markerflow.session import checkpointed

ROUND_TO = 6
NUDGE = 1e-9


def rounded(value: Column) -> Column:
    """Six decimals: sums differ in their last bits with the order of addition."""
    return F.round(value, ROUND_TO)


def sample_std(value: str | Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0))


CUTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def moment_columns(value: str) -> list[Column]:
    """count, mean, sample std, min and max: sums that combine map-side."""
    return [
        F.count(value).alias("n"),
        # Means of decimals often end in a 5 just where they are cut; a nudge decides them all alike.
        rounded(F.avg(value) + NUDGE).alias("mean"),
        rounded(sample_std(value) + NUDGE).alias("std"),
        rounded(F.min(value)).alias("min"),
        rounded(F.max(value)).alias("max"),
    ]


#: Values of one key that a task may hold at once for its percentiles.
FEW_VALUES = 200_000


def _split_by_size(clean: DataFrame, keys: list[str], few: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of keys with up to `few` values, and those of the others; None where there are none."""
    many = clean.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*keys)
    if many.isEmpty():
        return clean, None
    many = checkpointed(many)
    return met_on(clean, many, keys, "left_anti"), met_on(clean, many, keys, "left_semi")


def _held_percentiles(value: str, cuts: dict[str, float]) -> list[Column]:
    held = F.percentile(value, [float(q) for q in cuts.values()])
    return [F.get(held, F.lit(i)).alias(c) for i, c in enumerate(cuts)]


def exact_percentiles(clean: DataFrame, keys: list[str], value: str, cuts: dict[str, float], few: int = FEW_VALUES) -> DataFrame:
    """`keys` and the exact, linearly interpolated percentiles of each key's values, of which none is null or NaN.

    Keys of few values are each one aggregation buffer; the values of others are never gathered. `clean` is read
    more than once, so it is best written first.
    """
    small, large = _split_by_size(clean, keys, few)
    rows = small.groupBy(*keys).agg(*_held_percentiles(value, cuts))
    return rows if large is None else rows.unionByName(spread_percentiles(large, keys, value, cuts))


def summarize(df: DataFrame, keys: list[str], value: str, few: int = FEW_VALUES) -> DataFrame:
    """One row per key of count, mean, sample std, min, max and the linearly interpolated p50, p90 and p99.

    Keys without a value give no row; nulls, NaN and infinite values do not count. The keys and values are written once, since
    they are read for the sizes of keys and for the figures.
    """
    clean = checkpointed(df.where(finite(value)).select(*keys, F.col(value).cast("double").alias(value)))
    small, large = _split_by_size(clean, keys, few)
    figures = [*keys, "n", "mean", "std", "min", "max", *[rounded(F.col(c)).alias(c) for c in CUTS]]
    rows = small.groupBy(*keys).agg(*moment_columns(value), *_held_percentiles(value, CUTS)).select(*figures)
    if large is None:
        return rows
    cuts = spread_percentiles(large, keys, value, CUTS)
    return rows.unionByName(met_on(large.groupBy(*keys).agg(*moment_columns(value)), cuts, keys).select(*figures))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the bottom is not positive."""
    return F.when(bottom > 0, top / bottom)


BUCKETS = 128


def met_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys that lets null meet null; the keys come once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def spread_percentiles(df: DataFrame, keys: list[str], value: str, cuts: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """`keys` and the exact, linearly interpolated percentiles of each key, without gathering a key's values in one task.

    A bounded sketch of each key gives bounds; values are counted by the bucket between bounds, and those equal to a
    bound by themselves. Prefix sums tell in which bucket each wanted rank lies; a bucket of one value answers at
    once, and only the values of the few other wanted buckets are ranked, each bucket by itself.
    """
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    bounds = clean.groupBy(*keys).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 4 * buckets).alias("_b"), F.count("*").alias("_n"))
    met = met_on(clean, bounds, keys)
    # How many bounds lie below a value, by halving steps.
    halves = [1 << k for k in reversed(range(buckets.bit_length()))]
    below = F.aggregate(
        F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda at, h: F.when(F.get("_b", at + h - 1) < F.col("_v"), at + h).otherwise(at)
    )
    place = 2 * F.col("_below") + F.coalesce(F.get("_b", F.col("_below")) == F.col("_v"), F.lit(False)).cast("int")
    met = met.withColumn("_below", below)
    tagged = met.select(*keys, "_v", "_n", place.alias("_k"))
    counts = tagged.groupBy(*keys, "_k").agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_n").alias("_n"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), ((F.ceil if up else F.floor)(F.lit(q) * (F.col("_n") - 1))).cast("bigint").alias("rank"))
            for name, q in cuts.items()
            for up in (False, True)
        ]
    )
    wanted = counts.withColumn("_before", before).withColumn("_t", F.explode(targets)).where("_t.rank >= _before and _t.rank < _before + _c")
    wanted = wanted.select(*keys, "_k", "_lo", "_hi", "_n", "_t.name", "_t.up", (F.col("_t.rank") - F.col("_before")).alias("_r"))
    easy = wanted.where("_lo = _hi").select(*keys, "name", "up", "_n", F.col("_lo").alias("_v"))
    hard = wanted.where("_lo < _hi")
    needed = hard.select(*keys, "_k").distinct()
    inside = met_on(tagged, needed, [*keys, "_k"], "left_semi")
    ranked = inside.withColumn("_r", (F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("_v")) - 1).cast("bigint")).drop("_n")
    found = met_on(hard, ranked, [*keys, "_k", "_r"]).select(*keys, "name", "up", "_n", "_v")
    sides = easy.unionByName(found)

    def one(name: str, q: float) -> Column:
        pick = lambda up: F.max(F.when((F.col("name") == name) & (F.col("up") == up), F.col("_v")))
        at = F.lit(q) * (F.max("_n") - 1)
        return pick(False) + (pick(True) - pick(False)) * (at - F.floor(at))

    return sides.groupBy(*keys).agg(*[one(name, q).alias(name) for name, q in cuts.items()])
