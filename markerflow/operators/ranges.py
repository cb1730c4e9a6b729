"""Long sequences in bounded parts.

One sequence may hold a third of all rows, so nothing here sorts a whole sequence in one task. Positions come from
prefix sums of the counts of ranges, neighbours from blocks of positions with a halo, and the best few
rows of a key from the best few of its salted parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RANGE = 65_536
BLOCK_ROWS = 8_192
SALTS = 64


def numbered(df: DataFrame, key: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, the position from 0 of each row of a key in `order`. `bucket` grows with the order and holds a bounded
    number of rows of a key; only counts per bucket are ordered over a whole key. Rows with a null key are left out."""
    keyed = df.withColumn("_bucket", bucket).where(F.col(key).isNotNull())
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(key, "_bucket").agg(F.count("*").alias("_size")).select(key, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)))
    met = placed.join(offsets, (placed[key] == offsets[key]) & placed["_bucket"].eqNullSafe(offsets["_bucket"]))
    at = (F.col("_n") + F.col("_offset") - 1).cast("int").alias(name)
    return met.select(*[placed[c] for c in df.columns], at)


def along(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], halo: int = 2, key: str = "seq_id", block_rows: int | None = None) -> DataFrame:
    """`df` with columns that look up to `halo` rows back or ahead in their sequence.

    With a `row` column, the position in the sequence, the work is done in blocks of positions, each with a
    halo of its neighbours' rows; without one, a sequence is one window, which suits short sequences.
    """
    if "row" not in df.columns:
        return df.withColumns(columns(Window.partitionBy(key).orderBy("frame")))
    size = max(block_rows or BLOCK_ROWS, halo)
    block = lambda shift: F.floor(F.greatest(F.col("row") + shift, F.lit(0)) / size)
    spread = df.withColumn("_block", F.explode(F.array_distinct(F.array(block(-halo), block(0), block(halo)))))
    done = spread.withColumns(columns(Window.partitionBy(key, "_block").orderBy("row")))
    return done.where(F.col("_block") == block(0)).drop("_block")


def tracks(points: DataFrame) -> DataFrame:
    """Marker readings with `track`, a name for the take and marker, and `row`, the position in it."""
    named = points.withColumn("track", F.concat_ws("/", "seq_id", F.col("marker_idx").cast("string")))
    return numbered(named, "track", F.floor(F.col("frame") / RANGE), ["frame"], "row")


def follows(w: WindowSpec, n: int = 1) -> Column:
    """Whether a row has n rows before it."""
    return F.lag(F.lit(1), n).over(w).isNotNull()


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, salt: list[str], name: str) -> DataFrame:
    """The first k rows of each key in `order`, numbered from 1 as `name`: the first k of each of a key's parts by salt, then of those."""
    part = F.pmod(F.xxhash64(*salt), F.lit(SALTS))
    some = df.withColumn("_salt", part).withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col(name) <= k)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k).drop("_salt")
