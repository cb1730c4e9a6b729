"""Frame-to-frame state as Structured Streaming.

Readings arrive late and more than once. `availability_stream` counts what is seen in windows of arrival time behind a watermark;
`gate_stream` keeps two accepted values per take and decides for each new frame whether their
extrapolation predicts it well enough or the exact way is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from markerflow.functions.points import available

GATE = "seq_id string, frame int, residual double, route string"


def once_per_key(points: DataFrame, delay: str = "10 days") -> DataFrame:
    """A stream's readings without repeats of a key whose arrival lies within the watermark."""
    timed = points.withColumn("arrived", F.col("ingested_at").cast("timestamp")).withWatermark("arrived", delay)
    return timed.dropDuplicatesWithinWatermark(["seq_id", "frame", "marker_idx"])


def availability_stream(points: DataFrame, window: str = "1 day", delay: str = "10 days") -> DataFrame:
    """`window_start, n, n_seen` of windows of arrival."""
    seen = once_per_key(points, delay).withColumn("seen", available("x", "y", "z"))
    counts = seen.groupBy(F.window("arrived", window)).agg(F.count("*").alias("n"), F.count_if("seen").alias("n_seen"))
    return counts.select(F.col("window.start").alias("window_start"), "n", "n_seen")


#: The last accepted value, the one before and the number of the last frame.
State = tuple[float, float, int]


def route_frames(rows: pd.DataFrame, last: State | None, limit: float, alpha: float) -> tuple[list, State | None]:
    """Routes of frames in order. The first two frames are exact; a predicted frame within the limit is fast.

    A frame whose successor has been judged already, or a repeat of one, is `late`: it changes no later judgement."""
    out = []
    for r in rows.sort_values("frame").itertuples(index=False):
        frame = int(r.frame)
        if last is not None and frame <= last[2]:
            out.append((r.seq_id, frame, None, "late"))
            continue
        if last is None or last[1] != last[1]:
            residual, route = None, "exact"
        else:
            residual = abs(r.value - (last[0] + alpha * (last[0] - last[1])))
            route = "fast" if residual <= limit else "exact"
        last = (r.value, float("nan") if last is None else last[0], frame)
        out.append((r.seq_id, frame, residual, route))
    return out, last


def gate_stream(frames: DataFrame, limit: float, alpha: float = 0.25, idle_minutes: int = 24 * 60) -> DataFrame:
    """`GATE` rows for a stream of `seq_id, frame, value`; the state is the two last values of a take and its last frame.

    A take that gives nothing for `idle_minutes` is forgotten, so the state holds running takes only; should it go on later, its first two frames are exact again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = tuple(state.get) if state.exists else None
        rows, last = route_frames(pd.concat(list(batches)), last, limit, alpha)
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame(rows, columns=["seq_id", "frame", "residual", "route"])

    return frames.groupBy("seq_id").applyInPandasWithState(step, GATE, "last double, before double, frame int", "append", GroupStateTimeout.ProcessingTimeTimeout)
