"""Parts of files by byte offset, so that a giant file is the work of many tasks.

Spark lists the files (paths and lengths only); tasks open them through Arrow's file systems and read the bytes of their part.
"""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark gives it, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def size_of(path: str) -> int:
    """Bytes of a file."""
    system, at = located(path)
    return system.get_file_info(at).size


def read_at(path: str, offset: int, length: int) -> bytes:
    system, at = located(path)
    with system.open_input_file(at) as file:
        return file.read_at(length, offset)


def write_absent(path: str, content: bytes) -> bool:
    """Write a file unless it is there, under another name first, so that no half file is ever seen; whether it was written."""
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        return False
    part = posixpath.join(posixpath.dirname(at), f".{posixpath.basename(at)}.{uuid.uuid4().hex}")
    with system.open_output_stream(part) as file:
        file.write(content)
    system.move(part, at)
    return True


def listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """`path, length` of every file below `path` that matches `glob`; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def spread(spark: SparkSession, parts: DataFrame, *keys: str) -> DataFrame:
    """Rows that name parts of files, dealt out to four tasks a core; they are too small for Spark to see the work behind them."""
    return parts.repartition(4 * spark.sparkContext.defaultParallelism, *[F.col(k) for k in keys])
