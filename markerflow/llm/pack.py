"""Filling fixed-capacity containers with items of varying length.

Method: minimum bin slack. A window (container) starts with the largest item left; a bitset
subset-sum dynamic programme over the multiset of remaining lengths finds the sum closest to the
room that is left, and walking the stored bitsets backwards gives how many items of each length
reach it. A found multiset is used as often as the counts allow.

Items spread evenly by hash over blocks of about `block_items`, and each block is packed by
itself, so the work of a task is bounded and the number of tasks grows with the corpus; a block
leaves at most one badly filled container.

Defined cases: an item longer than the largest capacity is split into full containers and one
rest, and nothing else is split; items of length 0 (null or empty texts) take no room and go to
the first container of their block; repeated rows are separate items; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerflow.session import checkpointed

BLOCK_ITEMS = 20_000
#: Room that a container may keep, as a share of its capacity, before its first item is put aside
#: for the largest containers, where closer sums exist.
SLACK_SHARE = 0.002
MOST_TASKS = 4_000
MAX_KINDS = 1_000
LOT = 10_000


def closest_subset(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """`(length, how many)` from the multiset `counts` with the largest sum up to `room`."""
    lengths = np.flatnonzero(counts[: room + 1])
    lengths = lengths[lengths > 0][::-1]
    mask, target = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in lengths.tolist():
        for _ in range(min(int(counts[length]), room // length)):
            wider = (reach | (reach << length)) & mask
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
            if reach & target:
                break
        if reach & target:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, before in reversed(steps):
        if not at:
            break
        if not (before >> at) & 1:
            used[length] = used.get(length, 0) + 1
            at -= length
    return list(used.items())


def fill_windows(lengths: np.ndarray, capacities: Iterable[int]) -> tuple[np.ndarray, list[int]]:
    """The window of each item, and the capacity of each window, for items up to the largest capacity."""
    caps = sorted({int(c) for c in capacities})
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=caps[-1] + 1)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    zeros, counts[0] = int(counts[0]), 0
    windows: list[tuple[int, list[tuple[int, int]]]] = []
    aside = np.zeros_like(counts)

    def largest(low: int, high: int) -> int:
        found = np.flatnonzero(counts[low + 1 : high + 1])
        return low + 1 + int(found[-1]) if len(found) else 0

    def use(capacity: int, chosen: dict[int, int]) -> None:
        times = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        windows.extend([(capacity, list(chosen.items()))] * times)

    def best(seed: int, room: int) -> tuple[dict[int, int], int]:
        counts[seed] -= 1
        chosen = dict(closest_subset(counts, room))
        counts[seed] += 1
        left = room - sum(length * n for length, n in chosen.items())
        chosen[seed] = chosen.get(seed, 0) + 1
        return chosen, left

    for low, capacity in zip([0, *caps[:-1]], caps):
        while seed := largest(low, capacity):
            chosen, left = best(seed, capacity - seed)
            if left > SLACK_SHARE * capacity:
                aside[seed] += 1
                counts[seed] -= 1
            else:
                use(capacity, chosen)
    counts += aside
    while seed := largest(0, caps[-1]):
        chosen, left = best(seed, caps[-1] - seed)
        size = caps[-1] - left
        use(next(c for c in caps if c >= size), chosen)
    if zeros and not windows:
        windows.append((caps[0], []))

    place = np.zeros(len(lengths), np.int64)
    taken = first.copy()
    for number, (_, chosen) in enumerate(windows):
        for length, n in chosen:
            place[order[taken[length] : taken[length] + n]] = number
            taken[length] += n
    return place, [c for c, _ in windows]


def _pack_block(rows: pd.DataFrame, capacities: list[int]) -> pd.DataFrame:
    rows = rows.sort_values("uid", kind="stable")
    place, kinds = fill_windows(rows["n"].to_numpy(), capacities)
    return pd.DataFrame(
        {
            "key": rows["key"].to_numpy(),
            "piece_no": rows["piece_no"].to_numpy(),
            "n": rows["n"].to_numpy(),
            "container": [f"b{b}.{n}" for b, n in zip(rows["block"].tolist(), place.tolist())],
            "capacity": np.asarray(kinds, np.int64)[place],
        }
    )


def container_kinds(containers: DataFrame, id_col: str = "container_id", capacity_col: str = "capacity_tokens") -> dict[int, int]:
    """Capacity -> id of the kinds of container, after a check of their number; of equal capacities the lowest id."""
    rows = containers.where(F.col(capacity_col).isNotNull()).groupBy(capacity_col).agg(F.min(id_col).alias("id")).limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    return {int(r[capacity_col]): r["id"] for r in rows}


def pack_items(
    items: DataFrame, kinds: dict[int, int], id_col: str = "doc_id", size_col: str = "n_tokens", block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """`id_col, piece_no, size_col, container, container_id, capacity`: the container of every item or piece.

    `container` names one container; `kinds` maps the capacities to the ids of their kinds.
    """
    capacities = sorted(kinds)
    if not capacities or capacities[0] < 1:
        raise ValueError("capacities must be positive")
    top = capacities[-1]
    sized = checkpointed(
        items.select(
            F.col(id_col).alias("key"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("n")
        ).withColumn("uid", F.monotonically_increasing_id())
    )
    blocks = max(1, -(-sized.count() // block_items))
    whole = F.floor(F.col("n") / top)
    # Full pieces are numbered from 0, the rest after them; an item of any size gives its pieces as rows, not as one array.
    lots = F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / LOT))
    full = (
        sized.where(F.col("n") >= top)
        .withColumn("lot", F.explode(lots))
        .withColumn("piece_no", F.explode(F.sequence(F.col("lot") * LOT, F.least((F.col("lot") + 1) * LOT, whole) - 1)))
        .select(
            "key",
            "piece_no",
            F.lit(top).cast("bigint").alias("n"),
            # A full piece fills a container alone, which is named after its item and number.
            F.concat_ws(".", F.concat(F.lit("f"), F.col("uid").cast("string")), F.col("piece_no").cast("string")).alias("container"),
            F.lit(top).cast("bigint").alias("capacity"),
        )
    )
    rest = (
        sized.where((F.col("n") == 0) | (F.col("n") % top > 0))
        .select("key", "uid", whole.cast("bigint").alias("piece_no"), (F.col("n") % top).alias("n"))
        .withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("bigint"))
    )
    key_type = dict(sized.dtypes)["key"]
    # A set number of partitions: the rows are few beside the work, so they must not be gathered into few tasks.
    packed = rest.repartition(min(blocks, MOST_TASKS), "block").groupBy("block").applyInPandas(
        lambda rows: _pack_block(rows, capacities),
        f"key {key_type}, piece_no bigint, n bigint, container string, capacity bigint",
    )
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("capacity").cast("int"))
    return packed.unionByName(full).select(
        F.col("key").alias(id_col), "piece_no", F.col("n").alias(size_col), "container", kind.alias("container_id"), "capacity"
    )
