"""Splitting long frame sequences at natural boundaries.

Method: byte-range processing for giant files. A sequence is read as ranges of `range_frames`
frame numbers, each a row group of its own. A range reports its frame count, its still runs and
jumps, and its edge frames; the edge of the range before is the halo that settles its first
frame. The boundary tables are stitched (still runs that touch across ranges become one), lengths
are prefix-summed to positions, and pieces are emitted by offset. No task holds more than one
range of vertices, however long a sequence is.

Natural boundaries: the first frame of a hold (`hold_frames` or more in a row in which no vertex
moves more than `still_m` from the frame before), the first frame after a hole of `hole_frames` or
more missing frame numbers, and a frame in which every vertex is more than `jump_m` from the frame
before. The frame before is the one present before, whatever its number.

Pieces: a piece is cut at the last boundary that keeps it within the limit, else at the limit.
Consecutive pieces share `overlap` frames; the
keep-start of a piece is the number of its leading frames that the pieces before already gave, so
that frames from keep-start on, in piece order, are the sequence again.

Where a piece ends depends on where it began, and so on back to the start of the sequence. Blocks of
positions, at least as long as the limit, therefore first find for themselves where a piece would leave the block from each place
at which one may enter it; then one pass over a sequence's blocks, a step each, tells where each block is
entered, and blocks emit their pieces. The pieces do not depend on the size of ranges or blocks.

Defined cases: rows with a null seq_id or frame are left out; repeated frames count once; a frame with
null vertices or another number of them has no boundary of motion; a null limit means no limit (one piece); a
limit below 1 is taken as 1; a null or negative overlap is 0, and one of the limit or more is the limit less 1; a
sequence without settings has no limit; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerflow.session import checkpointed, first_by

RANGE_FRAMES = 4_096
BLOCK_ROWS = 16_384
HOLD_FRAMES = 5
STILL_M = 0.001
HOLE_FRAMES = 5
JUMP_M = 0.25

_RANGE_TYPE = (
    "seq_id string, range_no int, n int, frames array<int>, first_vertices array<float>, last_vertices array<float>, "
    "still array<boolean>, jump array<boolean>"
)
_RANGE_SCHEMA = pa.schema(
    [
        ("seq_id", pa.string()), ("range_no", pa.int32()), ("n", pa.int32()), ("frames", pa.list_(pa.int32())), ("first_vertices", pa.list_(pa.float32())),
        ("last_vertices", pa.list_(pa.float32())), ("still", pa.list_(pa.bool_())), ("jump", pa.list_(pa.bool_())),
    ]
)


def _moves(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest distance of a vertex from the frame before; NaN where unknown."""
    n = len(lists)
    most, least = np.full(n, np.nan), np.full(n, np.nan)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    sizes = np.where(sizes % 3, -1, sizes)
    starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        flat = values[starts[rows][:, None] + np.arange(size)].astype(np.float64)
        step = np.sqrt((np.diff(flat, axis=0).reshape(len(rows) - 1, size // 3, 3) ** 2).sum(axis=2))
        near = np.diff(rows) == 1
        most[rows[1:][near]] = step.max(axis=1)[near]
        least[rows[1:][near]] = step.min(axis=1)[near]
    return most, least


def _range_rows(still_m: float, jump_m: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("frame", "ascending"), ("ingested_at", "ascending")])
        frame = rows.column("frame").to_numpy()
        first = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1))
        vertices = rows.column("vertices").combine_chunks().take(pa.array(first))
        most, least = _moves(vertices)
        ends = vertices.take(pa.array([0, len(first) - 1])).to_pylist()
        return pa.table(
            [
                pa.array(column, kind)
                for column, kind in zip(
                    ([key[0].as_py()], [key[1].as_py()], [len(first)], [frame[first]], ends[:1], ends[1:], [most <= still_m], [least > jump_m]), _RANGE_SCHEMA.types
                )
            ],
            schema=_RANGE_SCHEMA,
        )

    return run


def _distances(a: str, b: str) -> Column:
    def one(i: Column) -> Column:
        square = [
            F.pow(F.get(F.col(a), i * 3 + k).cast("double") - F.get(F.col(b), i * 3 + k).cast("double"), F.lit(2.0)) for k in range(3)
        ]
        return F.sqrt(square[0] + square[1] + square[2])

    return F.transform(F.sequence(F.lit(0), (F.size(a) / 3).cast("int") - 1), one)


def scan_ranges(
    frames: DataFrame, range_frames: int = RANGE_FRAMES, still_m: float = STILL_M, jump_m: float = JUMP_M
) -> DataFrame:
    """One row per (sequence, range): its frames and flags, the range before it as halo, and `offset`."""
    keyed = frames.where(F.col("seq_id").isNotNull() & F.col("frame").isNotNull()).select(
        "seq_id", F.floor(F.col("frame") / range_frames).cast("int").alias("range_no"), "frame", "vertices", "ingested_at"
    )
    ranges = keyed.groupBy("seq_id", "range_no").applyInArrow(_range_rows(still_m, jump_m), _RANGE_TYPE)
    before = Window.partitionBy("seq_id").orderBy("range_no")
    ranges = (
        ranges.withColumn("prev_vertices", F.lag("last_vertices").over(before))
        .withColumn("prev_frame", F.lag(F.element_at("frames", -1)).over(before))
        .withColumn("offset", F.coalesce(F.sum(F.col("n").cast("bigint")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    same = (F.size("prev_vertices") == F.size("first_vertices")) & (F.size("first_vertices") >= 3)
    step = F.when(same & F.col("prev_vertices").isNotNull(), _distances("prev_vertices", "first_vertices"))
    head = ranges.withColumn("head_step", step)
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    # Several tables are made of these flags; written once, no vertices are read again for them.
    flags = head.select(
        "seq_id",
        "range_no",
        "n",
        "offset",
        "frames",
        "prev_frame",
        F.concat(F.array(F.coalesce(F.array_max("head_step") <= still_m, F.lit(False))), rest("still")).alias("still"),
        F.concat(F.array(F.coalesce(F.array_min("head_step") > jump_m, F.lit(False))), rest("jump")).alias("jump"),
    )
    return checkpointed(flags)


def _boundary_rows(hole_frames: int):
    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                frames = np.asarray(r.frames)
                still, jump = np.asarray(r.still, bool), np.asarray(r.jump, bool)
                before = np.concatenate([[np.iinfo(np.int64).max if pd.isna(r.prev_frame) else int(r.prev_frame)], frames[:-1]])
                hole = frames - before > hole_frames
                for k in np.flatnonzero(hole | jump).tolist():
                    out.append((r.seq_id, r.range_no, r.offset + k, int(frames[k]), "cut", 0, False, False))
                edges = np.diff(np.concatenate([[False], still, [False]]).astype(np.int8))
                for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
                    out.append((r.seq_id, r.range_no, r.offset + a, int(frames[a]), "still", b - a, a == 0, b == len(frames)))
            yield pd.DataFrame(out, columns=["seq_id", "range_no", "pos", "frame", "kind", "n", "at_start", "at_end"])

    return run


def natural_boundaries(
    ranges: DataFrame, hold_frames: int = HOLD_FRAMES, hole_frames: int = HOLE_FRAMES
) -> DataFrame:
    """`seq_id, range_no, pos, frame`: each boundary once, from the stitched tables of `scan_ranges`."""
    found = ranges.mapInPandas(
        _boundary_rows(hole_frames),
        "seq_id string, range_no int, pos bigint, frame int, kind string, n int, at_start boolean, at_end boolean",
    )
    # Only runs at the edge of a range can go on in another: at most two of each range are ordered over a sequence.
    still = found.where("kind = 'still'")
    inside = still.where(f"not at_start and not at_end and n >= {int(hold_frames)}").select("seq_id", "range_no", "pos", "frame")
    order = Window.partitionBy("seq_id").orderBy("pos")
    runs = still.where("at_start or at_end")
    # A run joins the one before if both touch the edge between their ranges: it then starts where that one ended.
    goes_on = F.col("at_start") & F.lag("at_end").over(order) & (F.lag(F.col("pos") + F.col("n")).over(order) == F.col("pos"))
    runs = runs.withColumn("run_no", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    holds = (
        runs.groupBy("seq_id", "run_no")
        .agg(F.sum("n").alias("length"), F.min(F.struct("pos", "frame", "range_no")).alias("first"))
        .where(F.col("length") >= hold_frames)
        .select("seq_id", "first.range_no", "first.pos", "first.frame")
    )
    return holds.unionByName(inside).unionByName(found.where("kind = 'cut'").select("seq_id", "range_no", "pos", "frame")).distinct()


def sequence_lengths(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("seq_id").agg(F.sum(F.col("n").cast("bigint")).alias("n_frames"))


def _limits(sequences: DataFrame) -> DataFrame:
    limit = F.when(F.col("chunk_size").isNotNull(), F.greatest(F.col("chunk_size"), F.lit(1))).cast("bigint")
    settings = first_by(sequences.where("seq_id is not null").select("seq_id", "chunk_size", "chunk_overlap", "ingested_at"), ["seq_id"])
    overlap = F.greatest(F.coalesce(F.col("chunk_overlap"), F.lit(0)), F.lit(0)).cast("bigint")
    return settings.select(
        "seq_id", "chunk_size", limit.alias("limit"), F.when(limit.isNotNull(), F.least(overlap, limit - 1)).alias("overlap")
    )


def oversized_boundaries(frames: DataFrame, sequences: DataFrame, **ranges_with) -> DataFrame:
    """`seq_id, frame`: the natural boundaries of every sequence longer than its limit; one row with
    frame -1 for such a sequence without any."""
    ranges = scan_ranges(frames, **ranges_with)
    over = sequence_lengths(ranges).join(_limits(sequences), "seq_id").where(F.col("n_frames") > F.col("chunk_size"))
    found = natural_boundaries(ranges).select("seq_id", "frame")
    return over.select("seq_id").join(found, "seq_id", "left").select("seq_id", F.coalesce("frame", F.lit(-1)).alias("frame"))


def _ahead(at: np.ndarray, cuts: np.ndarray, limit: int, overlap: int, n_frames: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position where a piece takes over: where the next one does, and whether that is a boundary or the end."""
    reach = np.minimum(np.maximum(at - overlap, 0) + limit, n_frames)
    if not len(cuts):
        return reach, reach == n_frames
    last = cuts[np.maximum(np.searchsorted(cuts, reach, side="right") - 1, 0)]
    natural = (last > at) & (last <= reach)
    whole = reach == n_frames
    return np.where(whole | ~natural, reach, last), whole | natural


def _way_through(low: int, high: int, *settings) -> tuple[np.ndarray, np.ndarray]:
    """For each position at which a block [low, high) may be entered: where it is left, and after how many pieces."""
    after, _ = _ahead(np.arange(low, high), *settings)
    exits, pieces = after.copy(), np.ones(high - low, np.int64)
    # Leaps double: each round follows the leaps found so far, until all have left the block.
    while (inside := exits < high).any():
        then = exits[inside] - low
        exits[inside], pieces[inside] = exits[then], pieces[inside] + pieces[then]
    return exits, pieces


def _ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's way through it from every position at which a piece can first take over."""
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.limit >= r.n_frames:  # one piece
                out.append((r.seq_id, r.block, r.low, [r.n_frames], [1]))
                continue
            exits, pieces = _way_through(r.low, r.high, np.sort(np.asarray(r.cuts, np.int64)), r.limit, r.overlap, r.n_frames)
            enter = 1 if r.low == 0 else min(r.limit, r.high - r.low)
            out.append((r.seq_id, r.block, r.low, exits[:enter], pieces[:enter]))
        yield pd.DataFrame(out, columns=["seq_id", "block", "low", "exits", "pieces"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where each block is entered and how many pieces lie before: one step a block, blocks in order, nothing kept but the place."""
    seq_id, at, pieces = None, 0, 0
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.seq_id != seq_id:
                seq_id, at, pieces = r.seq_id, 0, 0
            if at - r.low < len(r.exits):
                out.append((seq_id, r.block, at, pieces))
                at, pieces = int(r.exits[at - r.low]), pieces + int(r.pieces[at - r.low])
        yield pd.DataFrame(out, columns=["seq_id", "block", "entry", "before"])


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pieces that end the way through each block from its entry."""
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            cuts, at, n = np.sort(np.asarray(r.cuts, np.int64)), int(r.entry), int(r.before)
            while at < r.high:
                start = max(at - int(r.overlap), 0)
                end, natural = _ahead(np.array([at]), cuts, int(r.limit), int(r.overlap), int(r.n_frames))
                out.append((r.seq_id, n, start, int(end[0]), at - start, bool(natural[0])))
                at, n = int(end[0]), n + 1
        yield pd.DataFrame(out, columns=["seq_id", "piece_no", "start_pos", "end_pos", "keep_start", "natural_end"])


def split_pieces(
    frames: DataFrame, sequences: DataFrame, range_frames: int = RANGE_FRAMES, block_rows: int = BLOCK_ROWS, **ranges_with
) -> DataFrame:
    """`seq_id, piece_no, start_pos, n_frames, first_frame, last_frame, keep_start, natural_end` of every sequence."""
    ranges = scan_ranges(frames, range_frames=range_frames, **ranges_with)
    sizes = sequence_lengths(ranges).join(_limits(sequences), "seq_id", "left").select(
        "seq_id", "n_frames", F.coalesce(F.least("limit", "n_frames"), "n_frames").alias("limit"), F.coalesce("overlap", F.lit(0)).cast("bigint").alias("overlap")
    )
    # A piece reaches at most one limit ahead, so a block of at least a limit needs the boundaries of the next block only.
    sizes = sizes.withColumn("overlap", F.least("overlap", F.col("limit") - 1)).withColumn("rows", F.greatest("limit", F.lit(block_rows).cast("bigint")))
    blocks = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_frames") - 1) / F.col("rows")))))
    cut = sizes.where("n_frames > limit").select("seq_id", "rows")
    bounds = natural_boundaries(ranges).select("seq_id", "pos").join(cut, "seq_id")
    mine = F.floor(F.col("pos") / F.col("rows"))
    cuts = bounds.select("seq_id", "pos", F.explode(F.array_distinct(F.array(mine, F.greatest(mine - 1, F.lit(0))))).alias("block"))
    cuts = cuts.groupBy("seq_id", "block").agg(F.collect_list("pos").alias("cuts"))
    plain = blocks.join(cuts, ["seq_id", "block"], "left").select(
        "seq_id", "block", "limit", "overlap", "n_frames", (F.col("block") * F.col("rows")).alias("low"),
        F.least((F.col("block") + 1) * F.col("rows"), "n_frames").alias("high"), F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"),
    )
    plain = checkpointed(plain)
    ways = plain.mapInPandas(_ways, "seq_id string, block bigint, low bigint, exits array<bigint>, pieces array<bigint>")
    entered = ways.repartition("seq_id").sortWithinPartitions("seq_id", "block").mapInPandas(_entries, "seq_id string, block bigint, entry bigint, before bigint")
    pieces = plain.join(entered, ["seq_id", "block"]).mapInPandas(
        _walk, "seq_id string, piece_no bigint, start_pos bigint, end_pos bigint, keep_start bigint, natural_end boolean"
    )
    pieces = pieces.withColumn("piece_no", F.col("piece_no").cast("int"))
    # Positions to frame numbers: a range covers at most two position buckets of its own size.
    bucket = lambda p: F.floor(p / range_frames)
    placed = ranges.select(
        "seq_id", "offset", "n", "frames", F.explode(F.sequence(bucket(F.col("offset")), bucket(F.col("offset") + F.col("n") - 1))).alias("bucket")
    )
    ends = pieces.select("*", F.explode(F.array(F.col("start_pos"), F.col("end_pos") - 1)).alias("pos")).withColumn("bucket", bucket(F.col("pos")))
    named = ends.join(placed, ["seq_id", "bucket"]).where("pos >= offset and pos < offset + n")
    return (
        named.groupBy("seq_id", "piece_no", "start_pos", "end_pos", "keep_start", "natural_end")
        .agg(
            F.min(F.get("frames", (F.col("pos") - F.col("offset")).cast("int"))).alias("first_frame"),
            F.max(F.get("frames", (F.col("pos") - F.col("offset")).cast("int"))).alias("last_frame"),
        )
        .select(
            "seq_id", "piece_no", "start_pos", (F.col("end_pos") - F.col("start_pos")).alias("n_frames"),
            "first_frame", "last_frame", "keep_start", "natural_end",
        )
    )
