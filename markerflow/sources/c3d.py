"""C3D files: binary recordings of labelled points.

Spark lists the files; tasks read the head of each and then ranges of frames by their byte offsets.
The layout is decoded with numpy: a header block of 512 bytes, parameter groups, then frames of points
(four numbers each: place and residual) and analog samples, as 16-bit integers or floats of one of
three processor kinds.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.sources import ranged

BLOCK = 512
INTEL, DEC, MIPS = 84, 85, 86
#: Sizes of the parameter types: characters, bytes, 16-bit integers, floats.
TYPES = {-1: 1, 1: 1, 2: 2, 4: 4}


@dataclass
class Recording:
    points: np.ndarray  # frames x markers x (x, y, z, residual), in the file's unit; missing is NaN
    labels: list[str]
    rate: float
    unit: str = "mm"
    first_frame: int = 1
    parameters: dict[str, object] = field(default_factory=dict)


def dec_floats(raw: bytes) -> np.ndarray:
    """Floats of a DEC processor: words swapped, exponent two higher."""
    words = np.frombuffer(raw, "<u2").reshape(-1, 2)[:, ::-1]
    return (np.ascontiguousarray(words).view("<f4").ravel() / 4.0).astype(np.float64)


def _floats(raw: bytes, processor: int) -> np.ndarray:
    if processor == DEC:
        return dec_floats(raw)
    return np.frombuffer(raw, ">f4" if processor == MIPS else "<f4").astype(np.float64)


def _value(kind: int, dims: list[int], raw: bytes, processor: int) -> object:
    order = ">" if processor == MIPS else "<"
    if kind == -1:
        if len(dims) <= 1:
            return raw.decode("latin-1").rstrip(" \0")
        width = dims[0]
        return [raw[i : i + width].decode("latin-1").rstrip(" \0") for i in range(0, len(raw), width)] if width else []
    if kind == 4:
        values = _floats(raw, processor)
    else:
        values = np.frombuffer(raw, {1: "i1", 2: f"{order}i2"}[kind])
    return values.tolist() if dims else (values[0].item() if len(values) else None)


def read_parameters(data: bytes, at: int) -> tuple[dict[str, object], int]:
    """GROUP:NAME -> value, and the processor kind."""
    processor = data[at + 3]
    end, pos = at + max(data[at + 2], 1) * BLOCK, at + 4
    groups: dict[int, str] = {}
    found: list[tuple[int, str, object]] = []
    order = ">" if processor == MIPS else "<"
    while pos + 2 <= min(end, len(data)):
        length, number = struct.unpack_from("bb", data, pos)
        if not length or not number:
            break
        name = data[pos + 2 : pos + 2 + abs(length)].decode("latin-1").upper()
        link = pos + 2 + abs(length)
        (step,) = struct.unpack_from(f"{order}h", data, link)
        if number < 0:
            groups[-number] = name
        else:
            kind, n_dims = struct.unpack_from("bB", data, link + 2)
            dims = list(data[link + 4 : link + 4 + n_dims])
            size = TYPES.get(kind, 1) * int(np.prod(dims)) if dims else TYPES.get(kind, 1)
            start = link + 4 + n_dims
            found.append((number, name, _value(kind, dims, data[start : start + size], processor)))
        if step <= 0:
            break
        pos = link + step
    return {f"{groups.get(number, number)}:{name}": value for number, name, value in found}, processor


@dataclass
class Head:
    """What a file says before its frames."""

    n_points: int
    n_analog: int  # values a frame
    per_frame: int  # samples of each channel a frame
    first_frame: int
    n_frames: int
    start: int  # byte of the first frame
    frame_bytes: int
    scale: float
    rate: float
    processor: int
    parameters: dict[str, object]

    def texts(self, name: str) -> list[str]:
        """A list of texts, carried on by the parameters of the same name with a number from 2."""
        out, n = [], 1
        while (held := self.parameters.get(name if n == 1 else f"{name}{n}")) is not None:
            out += [held] if isinstance(held, str) else list(held)
            n += 1
        return out

    @property
    def labels(self) -> list[str]:
        return self.texts("POINT:LABELS")[: self.n_points]

    @property
    def unit(self) -> str:
        return str(self.parameters.get("POINT:UNITS") or "mm")


def head_bytes(first_block: bytes, read_at: Callable[[int, int], bytes]) -> bytes:
    """A file up to the end of its parameters, of which the first block is known."""
    if len(first_block) < BLOCK or first_block[1] != 0x50:
        raise ValueError("not a C3D file")
    at = (first_block[0] - 1) * BLOCK
    blocks = read_at(at, 4)[2]
    return first_block + read_at(BLOCK, at + max(blocks, 1) * BLOCK - BLOCK)


def read_head(data: bytes, length: int) -> Head:
    """The head of a file of `length` bytes from its first bytes, parameters included."""
    if len(data) < BLOCK or data[1] != 0x50:
        raise ValueError("not a C3D file")
    parameters, processor = read_parameters(data, (data[0] - 1) * BLOCK)
    order = ">" if processor == MIPS else "<"
    n_points, n_analog, first, last = struct.unpack_from(f"{order}4H", data, 2)
    start, per_frame = struct.unpack_from(f"{order}2H", data, 16)
    scale, rate = _floats(data[12:16], processor)[0], float(_floats(data[20:24], processor)[0])
    frame_bytes = (n_points * 4 + n_analog) * (2 if scale > 0 else 4)
    begin = (start - 1) * BLOCK
    held = max(length - begin, 0) // frame_bytes if frame_bytes else 0
    told = max(last - first + 1, 0)
    n_frames = held if last == 65_535 or not told else min(told, held)
    return Head(n_points, n_analog, per_frame, first, n_frames, begin, frame_bytes, float(scale), rate, processor, parameters)


def _numbers(head: Head, raw: bytes) -> np.ndarray:
    """Frames x numbers of a frame."""
    if head.scale > 0:
        flat = np.frombuffer(raw, ">i2" if head.processor == MIPS else "<i2").astype(np.float64)
    else:
        flat = _floats(raw, head.processor)
    return flat.reshape(len(raw) // head.frame_bytes if head.frame_bytes else 0, -1)


def frame_points(head: Head, raw: bytes) -> np.ndarray:
    """Frames x points x (place, residual) of whole frames. A point whose residual is negative, or that has no finite place, is missing."""
    numbers = _numbers(head, raw)
    points = numbers[:, : head.n_points * 4].reshape(len(numbers), head.n_points, 4).copy()
    if head.scale > 0:
        points[..., :3] *= head.scale
        word = points[..., 3].astype(np.int64)
    else:
        word = np.nan_to_num(points[..., 3], nan=-1.0).astype(np.int64)
    points[..., 3] = np.where(word < 0, -1.0, (word & 0xFF) * abs(head.scale))
    points[(points[..., 3] < 0) | ~np.isfinite(points[..., :3]).all(axis=2)] = np.nan
    return points


def frame_analog(head: Head, raw: bytes) -> np.ndarray:
    """Frames x samples x channels of whole frames, in the units that the parameters give."""
    samples = max(head.per_frame, 1)
    channels = head.n_analog // samples
    values = _numbers(head, raw)[:, head.n_points * 4 : head.n_points * 4 + samples * channels].reshape(-1, samples, channels)
    each = lambda name, other: np.resize(np.atleast_1d(np.asarray(head.parameters.get(name) or other, float)), channels)
    general = head.parameters.get("ANALOG:GEN_SCALE")
    return (values - each("ANALOG:OFFSET", 0.0)) * each("ANALOG:SCALE", 1.0) * (1.0 if general is None else float(np.atleast_1d(general)[0]))


def header_events(data: bytes, processor: int) -> list[tuple[float, bool, str]]:
    """Time in seconds, whether it is shown, and label of the events in a file's first block."""
    order = ">" if processor == MIPS else "<"
    (count,) = struct.unpack_from(f"{order}H", data, 300)
    count = min(count, 18)
    times = _floats(data[304 : 304 + 4 * 18], processor)
    return [(float(times[i]), data[376 + i] > 0, data[396 + 4 * i : 400 + 4 * i].decode("latin-1").strip(" \0")) for i in range(count)]


def read(data: bytes) -> Recording:
    """One whole file."""
    head = read_head(data, len(data))
    points = frame_points(head, data[head.start : head.start + head.n_frames * head.frame_bytes])
    return Recording(points, head.labels, head.rate, head.unit, head.first_frame, head.parameters)


def _parameter(group: int, name: str, kind: int, dims: list[int], raw: bytes) -> bytes:
    body = struct.pack("bB", kind, len(dims)) + bytes(dims) + raw + b"\0"
    return struct.pack("bb", len(name), group) + name.encode() + struct.pack("<h", len(body) + 2) + body


def write(points: np.ndarray, labels: list[str], rate: float, unit: str = "mm") -> bytes:
    """A file of floats for Intel processors; missing points get a residual of -1."""
    n_frames, n_points = points.shape[:2]
    if n_points > 255:
        raise ValueError("a parameter list holds at most 255 labels")
    width = max([len(x.encode("latin-1", "replace")) for x in labels] + [1])
    width = min(width, 127)
    names = b"".join(x.encode("latin-1", "replace")[:width].ljust(width) for x in labels)
    group = struct.pack("bb", 5, -1) + b"POINT" + struct.pack("<h", 3) + b"\0"
    group += _parameter(1, "USED", 2, [], struct.pack("<h", n_points)) + _parameter(1, "SCALE", 4, [], struct.pack("<f", -1.0))
    group += _parameter(1, "RATE", 4, [], struct.pack("<f", rate)) + _parameter(1, "FRAMES", 2, [], struct.pack("<H", min(n_frames, 65_535)))
    group += _parameter(1, "UNITS", -1, [len(unit)], unit.encode()) + _parameter(1, "LABELS", -1, [width, n_points], names)
    blocks = -(-(len(group) + 5) // BLOCK)
    params = (bytes([1, 0x50, blocks, INTEL]) + group).ljust(blocks * BLOCK, b"\0")
    header = struct.pack("<BB5Hf2Hf", 2, 0x50, n_points, 0, 1, min(n_frames, 65_535), 0, -1.0, 2 + blocks, 0, rate).ljust(BLOCK, b"\0")
    out = np.zeros((n_frames, n_points, 4), "<f4")
    out[..., :3] = points[..., :3]
    out[..., 3] = np.where(np.isfinite(points[..., :3]).all(axis=2), 0.0, -1.0)
    return header + params + out.tobytes()


POINTS = "path string, frame int, marker_idx int, label string, x double, y double, z double, residual double, frame_rate double, unit string"


def point_rows(path: str, rec: Recording, frames_per_batch: int = 512, first: int = 0) -> Iterator[pd.DataFrame]:
    """Long rows of a recording, some frames at a time, numbered on from `first`. Unnamed points are numbered on from the named ones."""
    n_frames, n_points = rec.points.shape[:2]
    named = [x or f"*{i}" for i, x in enumerate(rec.labels)]
    labels = named + [f"*{len(named) + i}" for i in range(n_points - len(named))]
    for lo in range(0, n_frames, frames_per_batch):
        some = rec.points[lo : lo + frames_per_batch]
        flat = some.reshape(-1, 4)
        k = len(some)
        yield pd.DataFrame(
            {
                "path": path, "frame": np.repeat(np.arange(first + lo, first + lo + k), n_points), "marker_idx": np.tile(np.arange(n_points), k), "label": labels * k,
                **{c: flat[:, i] for i, c in enumerate(("x", "y", "z", "residual"))}, "frame_rate": rec.rate, "unit": rec.unit,
            }
        )


def file_head(path: str, length: int) -> tuple[Head, bytes]:
    """The head of a file and its bytes, of which no more than header and parameters are read."""
    data = head_bytes(ranged.read_at(path, 0, BLOCK), lambda offset, n: ranged.read_at(path, offset, n))
    return read_head(data, length), data


def frame_ranges(spark: SparkSession, path: str, glob: str, range_frames: int) -> DataFrame:
    """`path, length, lo, hi`: every file's frames in ranges of at most `range_frames`, dealt out to tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                head, _ = file_head(r.path, r.length)
                lo = np.arange(0, head.n_frames, range_frames)
                yield pd.DataFrame({"path": r.path, "length": r.length, "lo": lo, "hi": np.minimum(lo + range_frames, head.n_frames)})

    ranges = ranged.listed(spark, path, glob).mapInPandas(run, "path string, length bigint, lo bigint, hi bigint")
    return ranged.spread(spark, ranges, "path", "lo")


def _some_frames(head: Head, path: str, lo: int, hi: int) -> bytes:
    return ranged.read_at(path, head.start + lo * head.frame_bytes, (hi - lo) * head.frame_bytes)


def read_c3d(spark: SparkSession, path: str, glob: str = "*.c3d", frames: tuple[int, int] | None = None, range_frames: int = 16_384) -> DataFrame:
    """Long rows `POINTS` of every file below `path`; missing points are null.

    Tasks read ranges of `range_frames` frames by their byte offsets, so a giant file is read by many; `frames` (from, to,
    the latter not included) reads only the bytes of those frames. Rows are the same for any size of ranges."""
    ranges = frame_ranges(spark, path, glob, range_frames)
    if frames:
        ranges = ranges.withColumns({"lo": F.greatest("lo", F.lit(frames[0])), "hi": F.least("hi", F.lit(frames[1]))}).where("lo < hi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                head, _ = file_head(r.path, r.length)
                for lo in range(r.lo, r.hi, 512):
                    points = frame_points(head, _some_frames(head, r.path, lo, min(lo + 512, r.hi)))
                    yield from point_rows(r.path, Recording(points, head.labels, head.rate, head.unit), first=lo)

    rows = ranges.mapInPandas(run, POINTS)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "z", "residual")})


def read_analog(spark: SparkSession, path: str, glob: str = "*.c3d", range_frames: int = 16_384) -> DataFrame:
    """`path, frame, sample, channel, label, value` of the analog channels of every file below `path`; files without any give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                head, _ = file_head(r.path, r.length)
                for lo in range(r.lo, r.hi, 512) if head.n_analog else ():
                    values = frame_analog(head, _some_frames(head, r.path, lo, min(lo + 512, r.hi)))
                    n, samples, channels = values.shape
                    labels = (head.texts("ANALOG:LABELS") + [""] * channels)[:channels]
                    frame, sample, channel = (a.ravel() for a in np.indices(values.shape))
                    yield pd.DataFrame({"path": r.path, "frame": frame + lo, "sample": sample, "channel": channel, "label": labels * (n * samples), "value": values.ravel()})

    return frame_ranges(spark, path, glob, range_frames).mapInPandas(run, "path string, frame int, sample int, channel int, label string, value double")


def read_events(spark: SparkSession, path: str, glob: str = "*.c3d") -> DataFrame:
    """`path, event, seconds, shown, label` of the events in the headers of all files below `path`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                head, data = file_head(r.path, r.length)
                rows = [(r.path, i, *e) for i, e in enumerate(header_events(data, head.processor))]
                yield pd.DataFrame(rows, columns=["path", "event", "seconds", "shown", "label"])

    return ranged.listed(spark, path, glob).mapInPandas(run, "path string, event int, seconds double, shown boolean, label string")


def c3d_files(points: DataFrame, rate: str = "frame_rate", scale: float = 1000.0) -> DataFrame:
    """`seq_id, content` of one file per take from rows in metres; a take is one file, so one task's work by the format's nature."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frames, f = np.unique(rows["frame"].to_numpy(), return_inverse=True)
        marks, m = np.unique(rows["marker_idx"].to_numpy(), return_inverse=True)
        cube = np.full((len(frames), len(marks), 3), np.nan)
        cube[f, m] = rows[["x", "y", "z"]].to_numpy(float) * scale
        first = rows.drop_duplicates("marker_idx").set_index("marker_idx")["label"]
        labels = [first[k] if isinstance(first[k], str) else f"*{k}" for k in marks]
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[:1], "content": [write(cube, labels, float(rows[rate].iloc[0]))]})

    return points.select("seq_id", "frame", "marker_idx", "label", "x", "y", "z", rate).groupBy("seq_id").applyInPandas(run, "seq_id string, content binary")
