"""Flagging implausible measurements of a source against that source's own normal behaviour.

Method: a hidden Markov model per source with the states normal, spike, stuck and out of range.
A take is read in blocks of frames, each with a halo of its neighbours' frames; a block learns the
take's noise and motion from its own readings, scores every reading for each state, learns how often
states follow each other by a round of expectation and maximisation from a prior, and
forward-backward probabilities along each marker, with hard bounds of the capture room in the take's own unit, give the
flags. A flag of the stuck state must then hold a run of the full length, exactly counted.

The score of a spike is how far readings lie from the cubic through their neighbours on both sides
if they were left out, in terms of how well those neighbours fit each other across the gap and of
the take's usual departure, so that fast motion explains itself.

Defined cases: missing readings (null or NaN on any axis, or all axes 0) are never flagged; a
repeated reading counts once; a marker with fewer than 8 readings in a block is only held against the hard bounds and
the rule for stuck values; rows with null keys are left out; a null rate is no case; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerflow.functions.points import available
from markerflow.quality.units import marker_units

BLOCK_FRAMES = 1_024
HALO_FRAMES = 48
LONGEST_SPIKE = 4
SHORTEST = 8
#: A spike departs this many times further than its neighbours from each other, and this many usual departures.
SPIKE_RATIO = 4.0
SPIKE_SIGMA = 8.0
STUCK_REPEATS = 6
#: Hard bounds in metres: height above the floor, and distance from the middle of the take.
LOWEST_M, HIGHEST_M, FARTHEST_M = -0.6, 3.6, 20.0
RATE_TOLERANCE = 0.1

NORMAL, SPIKE, STUCK, OUT = range(4)
START = np.log([0.985, 0.005, 0.005, 0.005])
STEP = np.array([[0.990, 0.004, 0.003, 0.003], [0.45, 0.54, 0.005, 0.005], [0.095, 0.003, 0.90, 0.002], [0.20, 0.005, 0.005, 0.79]])
#: How many steps the transitions above count for beside those of a block.
PRIOR_STEPS = 2_000.0
#: Below this log likelihood beside the normal state a reading is not in doubt, and how many steps around those in doubt the model runs.
DOUBT, AROUND = -5.0, 12
_KEYS = ["seq_id", "frame", "marker_idx"]


def _gap(t: np.ndarray, p: np.ndarray, around: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Distance of the readings `at` from the polynomial through the readings `around`, all of them index arrays."""
    guess = 0.0
    for a in around:
        weight = 1.0
        for b in around:
            if a is not b:
                weight = weight * ((t[at] - t[b]) / (t[a] - t[b]))
        guess = guess + weight[:, None] * p[a]
    return np.sqrt(np.square(p[at] - guess).sum(axis=1))


def _departures(t: np.ndarray, p: np.ndarray, place: np.ndarray, left: np.ndarray, length: int):
    """For each start i: how far the `length` readings from i lie from the path, how well the path fits itself,
    and how much longer than without missing frames it is.

    Series follow one another; `place` is a reading's place in its series and `left` how many follow it there.
    """
    i = np.flatnonzero((place >= 3) & (left >= length + 2))
    after = i + length
    inner = np.min([_gap(t, p, [i - 2, i - 1, after, after + 1], i + k) for k in range(length)], axis=0)
    fit = np.maximum(_gap(t, p, [i - 3, i - 2, after, after + 1], i - 1), _gap(t, p, [i - 2, i - 1, after + 1, after + 2], after))
    extra = np.maximum(np.abs(t[after + 2] - t[i - 3]) - (length + 5), 0.0)
    return i, inner, fit, 1.0 + np.square(extra / 5.0)


def _edge_departures(t: np.ndarray, p: np.ndarray, place: np.ndarray, left: np.ndarray, length: int):
    """The same for readings within three of the start of a series, from the readings after them alone, where no
    frame is missing."""
    i = np.flatnonzero((place < 3) & (left >= length + 3))
    ref = [i + length + k for k in range(4)]
    i = i[np.abs(t[ref[3]] - t[i]) == length + 3]
    ref = [i + length + k for k in range(4)]
    inner = np.min([_gap(t, p, ref[:3], i + k) for k in range(length)], axis=0)
    fit = _gap(t, p, ref[1:], ref[0])
    for back in (1, 2):
        some = np.flatnonzero(place[i] >= back)
        if len(some):
            fit[some] = np.maximum(fit[some], _gap(t, p, [r[some] for r in ref[:3]], i[some] - back))
    return i, inner, fit


def _series(marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each reading's place in its series and how many follow it there."""
    first = np.flatnonzero(np.concatenate([[True], marker[1:] != marker[:-1]]))
    sizes = np.diff(np.append(first, len(marker)))
    place = np.arange(len(marker)) - np.repeat(first, sizes)
    return place, np.repeat(sizes, sizes) - 1 - place


def _score(inner: np.ndarray, fit: np.ndarray, usual: np.ndarray | float) -> np.ndarray:
    return np.minimum(inner / np.maximum(fit, usual) / SPIKE_RATIO, inner / usual / SPIKE_SIGMA)


def _spike_scores(t: np.ndarray, p: np.ndarray, marker: np.ndarray) -> np.ndarray:
    """Per reading, 1 or more where it belongs to a departure of up to LONGEST_SPIKE readings."""
    best = np.zeros(len(t))
    place, left = _series(marker)
    by_length = [_departures(t, p, place, left, length) for length in range(1, LONGEST_SPIKE + 1)]
    if not len(by_length[0][0]):
        return best
    sigma = max(float(np.median(by_length[0][1])), _last_digit(p))
    for length, (i, inner, fit, slack) in enumerate(by_length, 1):
        score = _score(inner, fit, sigma * slack)
        for k in range(length):
            np.maximum.at(best, i + k, score)
    # The ends of a series are extrapolated from what is left; that multiplies noise by about four.
    calm = np.flatnonzero(best < 1)
    for order in (calm, calm[::-1]):
        place, left = _series(marker[order])
        for length in range(1, LONGEST_SPIKE + 1):
            i, inner, fit = _edge_departures(t[order], p[order], place, left, length)
            score = _score(inner, fit, 4 * sigma)
            for k in range(length):
                np.maximum.at(best, order[i + k], score)
    return best


def _last_digit(p: np.ndarray) -> float:
    """The value of the last recorded digit of a take."""
    flat = np.abs(p.ravel())
    flat = flat[flat < 1e5]
    for digits in range(0, 8):
        scaled = flat * 10.0**digits
        if len(flat) and np.mean(np.abs(scaled - np.round(scaled)) < 1e-4) > 0.98:
            return 10.0**-digits
    return 10.0**-8


def posterior(log_emission: np.ndarray, step: np.ndarray = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward state probabilities of shape (steps, series, states), and the expected number of each step from state to state;
    flat emissions stand for no reading."""
    steps = len(log_emission)
    emission = np.exp(log_emission - log_emission.max(axis=2, keepdims=True))
    forward = np.empty_like(emission)
    row = np.exp(START) * emission[0]
    forward[0] = row / row.sum(axis=1, keepdims=True)
    for k in range(1, steps):
        row = (forward[k - 1] @ step) * emission[k]
        forward[k] = row / row.sum(axis=1, keepdims=True)
    back, moved = np.ones_like(emission[0]), np.zeros_like(step)
    for k in range(steps - 1, -1, -1):
        ahead = emission[k] * back
        forward[k] *= back
        forward[k] /= forward[k].sum(axis=1, keepdims=True)
        back = ahead @ step.T
        if k:
            moved += (forward[k - 1] / (forward[k - 1] * back).sum(axis=1, keepdims=True)).T @ ahead
        back /= back.sum(axis=1, keepdims=True)
    return forward, moved * step


def learnt_steps(moved: np.ndarray) -> np.ndarray:
    """Transitions from expected steps and the prior."""
    total = STEP * PRIOR_STEPS + moved
    return total / total.sum(axis=1, keepdims=True)


def _run_lengths(flags: np.ndarray) -> np.ndarray:
    """For each True the length of its run, 0 elsewhere."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    out = np.zeros(len(flags), np.int64)
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        out[a:b] = b - a
    return out


def flag_block(marker: np.ndarray, frame: np.ndarray, xyz: np.ndarray, unit: float) -> np.ndarray:
    """The state of each reading of one block; rows sorted by (marker, frame), none missing, none repeated; `unit` is in metres."""
    state = np.zeros(len(frame), np.int8)
    starts = np.flatnonzero(np.diff(marker, prepend=marker[0] - 1))
    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]))
    middle = np.median(xyz[:, :2], axis=0)
    metres = xyz * unit
    out = (metres[:, 2] < LOWEST_M) | (metres[:, 2] > HIGHEST_M) | (np.abs(metres[:, :2] - middle * unit).max(axis=1) > FARTHEST_M)

    digit = _last_digit(xyz[~out] if (~out).any() else xyz)
    same = np.zeros(len(frame), bool)
    same[1:] = (np.abs(np.diff(xyz, axis=0)).max(axis=1) < 9.5 * digit) & (np.diff(marker) == 0)
    run = _run_lengths(same)
    held = run >= STUCK_REPEATS

    # Only readings that may be normal make a path, and short series say nothing of one.
    kept = np.flatnonzero(~out & ~held)
    place, left = _series(marker[kept]) if len(kept) else (kept, kept)
    kept = kept[place + left + 1 >= SHORTEST]
    score = np.zeros(len(frame))
    if len(kept):
        score[kept] = _spike_scores(frame[kept].astype(float), xyz[kept], marker[kept])

    longest = max(b - a for a, b in spans)
    emission = np.zeros((longest, len(spans), 4))
    odds = np.clip(20 * np.log(np.maximum(score, 1e-3) / 0.95), -12, 14)
    for j, (a, b) in enumerate(spans):
        e = emission[: b - a, j]
        e[:, SPIKE] = odds[a:b]
        e[:, STUCK] = np.where(same[a:b], 5.0, -8.0)
        e[:, OUT] = np.where(out[a:b], 30.0, -30.0)
    # Where no state but the normal one is likely, or the stuck one for fewer repeats than a flag must hold, there is nothing to decide; the model
    # runs over the rest and some steps around it.
    doubt = (odds > DOUBT) | out | held
    doubtful = np.zeros((longest, len(spans)), bool)
    for j, (a, b) in enumerate(spans):
        doubtful[: b - a, j] = doubt[a:b]
    steps = np.flatnonzero(doubtful.any(axis=1))
    parts = []
    for some in np.split(steps, np.flatnonzero(np.diff(steps) > 2 * AROUND) + 1) if len(steps) else []:
        low, high = max(int(some[0]) - AROUND, 0), min(int(some[-1]) + AROUND + 1, longest)
        series = np.flatnonzero(doubtful[low:high].any(axis=0))
        parts.append((low, series, np.ascontiguousarray(emission[low:high, series])))
    if parts:
        moved = sum(posterior(part)[1] for _, _, part in parts)
        moved[NORMAL, NORMAL] += max(len(frame) - sum(part.shape[0] * part.shape[1] for _, _, part in parts), 0)
        learnt = learnt_steps(moved)
        for low, series, part in parts:
            likely = posterior(part, learnt)[0].argmax(axis=2)
            for k, j in enumerate(series.tolist()):
                a, b = spans[j]
                n = min(low + len(part), b - a) - low
                if n > 0:
                    state[a + low : a + low + n] = likely[:n, k]
    state[(state == STUCK) & ~held] = NORMAL
    state[out] = OUT
    return state


def _flag_rows(block_frames: int):
    schema = pa.schema([("seq_id", pa.string()), ("frame", pa.int32()), ("marker_idx", pa.int32()), ("state", pa.int32())])

    def run(key: tuple, rows: pa.Table, take: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        block = key[1].as_py()
        frame = rows.column("frame").to_numpy()
        marker = rows.column("marker_idx").to_numpy()
        order = np.lexsort((frame, marker))
        order = order[np.concatenate([[True], (np.diff(frame[order]) != 0) | (np.diff(marker[order]) != 0)])]
        xyz = np.column_stack([rows.column(c).to_numpy() for c in "xyz"])[order]
        frame, marker = frame[order].astype(np.int64), marker[order].astype(np.int64)
        state = flag_block(marker, frame, xyz, take.column("factor")[0].as_py() if take.num_rows else 1.0)
        mine = np.flatnonzero((state != NORMAL) & (frame // block_frames == block))
        return pa.table(
            [pa.array([key[0].as_py()] * len(mine), pa.string()), pa.array(frame[mine], pa.int32()), pa.array(marker[mine], pa.int32()), pa.array(state[mine], pa.int32())],
            schema=schema,
        )

    return run


def flag_readings(points: DataFrame, sessions: DataFrame, block_frames: int = BLOCK_FRAMES, halo_frames: int = HALO_FRAMES) -> DataFrame:
    """`seq_id, frame, marker_idx, state` of every faulty reading; state is 1 spike, 2 stuck, 3 out of range.

    Blocks bound what a task holds: a take of any length is as many groups as it has blocks. Each block meets the unit of its take.
    """
    keyed = points.where(available("x", "y", "z") & F.col("seq_id").isNotNull() & F.col("frame").isNotNull() & F.col("marker_idx").isNotNull())
    block = lambda f: F.floor(f / block_frames).cast("int")
    near = F.array_distinct(F.array(*[F.greatest(block(F.col("frame") + d), F.least(F.lit(0), block(F.col("frame")))) for d in (-halo_frames, 0, halo_frames)]))
    spread = keyed.select("seq_id", F.explode(near).alias("block"), "frame", "marker_idx", "x", "y", "z")
    takes = marker_units(points, sessions).where("recorded").select("seq_id", "factor", "first_frame", "last_frame")
    blocks = F.sequence(block(F.col("first_frame")) - 1, block(F.col("last_frame")) + 1)
    units = takes.select("seq_id", F.explode(blocks).alias("block"), "factor")
    return spread.groupBy("seq_id", "block").cogroup(units.groupBy("seq_id", "block")).applyInArrow(
        _flag_rows(block_frames), "seq_id string, frame int, marker_idx int, state int"
    )


def impossible_rates(sessions: DataFrame, tolerance: float = RATE_TOLERANCE) -> DataFrame:
    """`seq_id` of every take whose frame rate cannot be its rig's: not positive, or off the rig's median rate."""
    rates = sessions.where("frame_rate is not null").groupBy("seq_id").agg(F.max(F.struct("rig", "frame_rate")).alias("r")).select("seq_id", "r.*")
    usual = rates.where(F.col("frame_rate") > 0).groupBy("rig").agg(F.percentile_approx("frame_rate", 0.5, 1000).alias("usual"))
    off = F.abs(F.col("frame_rate") / F.col("usual") - 1) > tolerance
    wrong = F.isnan("frame_rate") | (F.col("frame_rate") <= 0) | F.coalesce(off, F.lit(False))
    joined = rates.join(usual, rates["rig"].eqNullSafe(usual["rig"]), "left")
    return joined.where(wrong).select("seq_id")


def faulty_readings(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """`seq_id, frame, marker_idx` of faulty readings, and -1, -1 for takes with an impossible rate."""
    rates = impossible_rates(sessions).select("seq_id", F.lit(-1).alias("frame"), F.lit(-1).alias("marker_idx"))
    return flag_readings(points, sessions).select(*_KEYS).unionByName(rates)
