"""Vertex caches, text meshes and array files, read as Spark's binary or text files, and writing of one file per row."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markerflow.sources import c3d, ranged

#: Fixed by the format: the head of a vertex cache.
PC2_HEAD = "<12siiffi"
PC2_BYTES = struct.calcsize(PC2_HEAD)


def pc2_head(data: bytes) -> tuple[int, float, float, int]:
    """Points, first frame, rate and samples that the start of a vertex cache tells."""
    sign, _, n_points, start, rate, n_samples = struct.unpack_from(PC2_HEAD, data)
    if not sign.startswith(b"POINTCACHE2"):
        raise ValueError("not a vertex cache")
    return n_points, start, rate, n_samples


def pc2_samples(data: bytes, n_points: int, half: bool) -> np.ndarray:
    """Samples x points x 3 of whole samples; `half` for 16-bit floats."""
    return np.frombuffer(data, "<f2" if half else "<f4").reshape(-1, n_points, 3).astype(np.float32)


def write_pc2(vertices: np.ndarray, start: float = 0.0, rate: float = 1.0, half: bool = False) -> bytes:
    head = struct.pack(PC2_HEAD, b"POINTCACHE2\0", 1, vertices.shape[1], start, rate, vertices.shape[0])
    return head + np.ascontiguousarray(vertices, "<f2" if half else "<f4").tobytes()


def appended_pc2(data: bytes, vertices: np.ndarray, half: bool = False) -> bytes:
    """A vertex cache with further samples after its own, and their number in its head."""
    n_points, start, rate, n_samples = pc2_head(data)
    if vertices.shape[1] != n_points:
        raise ValueError(f"samples of {vertices.shape[1]} points for a cache of {n_points}")
    head = struct.pack(PC2_HEAD, b"POINTCACHE2\0", 1, n_points, start, rate, n_samples + len(vertices))
    held = data[PC2_BYTES : PC2_BYTES + n_samples * n_points * (6 if half else 12)]
    return head + held + np.ascontiguousarray(vertices, "<f2" if half else "<f4").tobytes()


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_vertex_caches(spark: SparkSession, path: str, frames: tuple[int, int] | None = None, range_samples: int = 1_024) -> DataFrame:
    """`path, frame, vertices` of every .pc2 and .pc16 file below `path`; vertices flat, frames numbered from the cache's first.

    Tasks read ranges of samples by their byte offsets; `frames` (from, to, the latter not included) reads only the bytes of those frames."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                n_points, start, _, n_samples = pc2_head(ranged.read_at(r.path, 0, PC2_BYTES))
                width = n_points * (6 if r.path.endswith(".pc16") else 12)
                held = min(n_samples, (r.length - PC2_BYTES) // width) if width else 0
                lo, hi = (0, held) if frames is None else (max(frames[0] - int(start), 0), min(frames[1] - int(start), held))
                at = np.arange(lo, hi, range_samples)
                yield pd.DataFrame({"path": r.path, "n_points": n_points, "start": int(start), "lo": at, "hi": np.minimum(at + range_samples, hi)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                half = r.path.endswith(".pc16")
                width = r.n_points * (6 if half else 12)
                for lo in range(r.lo, r.hi, 256):
                    hi = min(lo + 256, r.hi)
                    some = pc2_samples(ranged.read_at(r.path, PC2_BYTES + lo * width, (hi - lo) * width), r.n_points, half)
                    yield pd.DataFrame({"path": r.path, "frame": np.arange(lo, hi) + r.start, "vertices": list(some.reshape(hi - lo, -1))})

    parts = ranged.listed(spark, path, "*.pc{2,16}").mapInPandas(ranges, "path string, n_points int, start int, lo bigint, hi bigint")
    return ranged.spread(spark, parts, "path", "lo").mapInPandas(run, "path string, frame int, vertices array<float>")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Long rows, as of C3D files, of .npz files with `markers`, maybe `labels` and `frame_rate`, and of .npy files of markers at 30 frames a second.

    Arrays of objects are refused, so nothing in a file is executed. Unnamed points are numbered from 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                held = np.load(io.BytesIO(bytes(r.content)), allow_pickle=False)
                if isinstance(held, np.ndarray):
                    markers, labels, rate = held, [str(i) for i in range(held.shape[1])], 30.0
                else:
                    markers = held["markers"]
                    labels = [str(x) for x in held["labels"]] if "labels" in held else []
                    rate = float(held["frame_rate"]) if "frame_rate" in held else float("nan")
                labels = labels + [f"*{i}" for i in range(markers.shape[1] - len(labels))]
                cube = np.concatenate([markers.astype(float), np.zeros((*markers.shape[:2], 1))], axis=2)
                yield from c3d.point_rows(r.path, c3d.Recording(cube, labels, rate, "m"))

    rows = _binary(spark, path, "*.np{y,z}").mapInPandas(run, c3d.POINTS)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "z", "frame_rate")})


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of all marker files below `path`, whatever their kind; pickled files are not read, for they run code."""
    return c3d.read_c3d(spark, path, "*.{c3d,mcp}").unionByName(read_arrays(spark, path))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`path, vid, x, y, z` and `path, face, v0, v1, v2` of all text meshes of `path`, numbered from 0 by the lines of each file; only triangles are read.

    A file's lines of a kind are ordered in one task: a mesh is of bounded size."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where(F.startswith("line", F.lit("v ")) | F.startswith("line", F.lit("f ")))
    parts = lines.select("path", "at", F.split("line", r"\s+").alias("p")).withColumn("kind", F.get("p", F.lit(0)))
    ranked = parts.withColumn("n", F.row_number().over(Window.partitionBy("path", "kind").orderBy("at")) - 1)
    corner = lambda i: F.get(F.split(F.get("p", F.lit(i)), "/"), F.lit(0)).cast("int") - 1
    vertices = ranked.where("kind = 'v'").select("path", F.col("n").alias("vid"), *[F.get("p", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate("xyz")])
    faces = ranked.where((F.col("kind") == "f") & (F.size("p") == 4)).select("path", F.col("n").alias("face"), *[corner(i + 1).alias(f"v{i}") for i in range(3)])
    return vertices, faces


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """`path, size, sha256` of every file below `path`."""
    return _binary(spark, path, glob).select("path", F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def discovered(spark: SparkSession, path: str, glob: str, any_of: list[str] | None = None) -> DataFrame:
    """`path` of every file below `path` that matches `glob` and, if any are given, whose path holds one of the texts `any_of`; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path")
    return files.where(F.exists(F.array(*[F.lit(t) for t in any_of]), lambda t: F.contains("path", t))) if any_of else files


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """`value`: the lines of a text mesh in order, for `write.text`."""
    v = vertices.select(F.lit(0).alias("kind"), F.col("vid").alias("n"), F.format_string("v %.4f %.4f %.4f", "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("kind"), F.col("face").alias("n"), F.format_string("f %d %d %d", *[F.col(f"v{i}") + 1 for i in range(3)]).alias("value"))
    return v.unionByName(f).orderBy("kind", "n").select("value")


def save_files(files: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Write `seq_id, content` rows as files of a folder that all executors share; files that are there are kept.
    Returns `path, size, written`; the work is done where the rows are, through Arrow's file systems."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [f"{folder.rstrip('/')}/{seq_id}{suffix}" for seq_id in batch["seq_id"]]
            written = [ranged.write_absent(path, bytes(content)) for path, content in zip(paths, batch["content"])]
            yield pd.DataFrame({"path": paths, "size": batch["content"].map(len), "written": written})

    return files.select("seq_id", "content").mapInPandas(run, "path string, size bigint, written boolean")


def arrays_to_c3d(spark: SparkSession, path: str, folder: str, leave_out: str = "_racket") -> DataFrame:
    """Write a C3D file into `folder` for every array file below `path` whose name doesn't hold `leave_out`, unless it is there; rows as of `save_files`.
    Labels are the numbers of the columns, the rate is that of the array file."""
    name = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    rows = read_arrays(spark, path).withColumn("seq_id", name).where(~F.contains("seq_id", F.lit(leave_out)))
    return save_files(c3d.c3d_files(rows), folder, ".c3d")
