"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: overlapping chunk encoding. A text longer than `chunk_chars` is cut into overlapping
chunks that are pre-tokenised in parallel; where the pre-token boundaries of two neighbours agree
inside their overlap the chunks are stitched, and the pieces between stitches are encoded by
themselves. Pre-tokenisation has no memory to its left, so from a boundary that both neighbours
share onwards they agree for good, and the concatenated ids are exactly those of the whole text.
Where a stretch has no common boundary its chunks are encoded together, in one task: a byte-pair encoding
can't be cut within a pre-token, so such a stretch, a single run of letters beyond the halo, is the least unit there is.

Inside a task the same idea saves work: a line break before a printable character and the place
between a colon, comma or full stop and a digit are always pre-token boundaries, so lines are encoded one by one and
repeated lines and time stamps come from a bounded cache.

Defined cases: a null or empty text gives an empty list; a row with a null id keeps it; special
tokens in a text are ordinary text; repeated rows give repeated results, whatever their length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markerflow.session import checkpointed

CHUNK_CHARS = 65_536
HALO_CHARS = 1_024
CACHE_ENTRIES = 150_000

_LINE = re.compile(r"\n(?=[!-~]|\w)")
_CLOCK = re.compile(r"(?<=[:,.])(?=[0-9])")
_loaded: dict[str, "ByteBpe"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Default place of the vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ByteBpe:
    """A tiktoken encoding with a line cache; ids are kept as little-endian int32 bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = public_tokenizers.PATTERN
        self.bpe = tiktoken.Encoding("corpus", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.line_break = self._plain("\n")
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<i4").tobytes()

    def _remembered(self, piece: str) -> bytes:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self._plain(piece)
            if len(piece) < 200:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def _line_ids(self, line: str) -> bytes:
        if " --> " not in line or len(line) > 200:
            return self._remembered(line)
        known = self.cache.get
        return b"".join([known(p) or self._remembered(p) for p in _CLOCK.split(line)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, out = self.cache.get, []
        for line in _LINE.split(text):
            ids = known(line)
            out.append(self._line_ids(line) if ids is None else ids)
        return self.line_break.join(out)

    def starts(self, text: str) -> list[int]:
        """Offsets at which a pre-token begins, but for the last three characters, where a longer
        text could still change the match."""
        import regex

        limit = len(text) - 3
        return [m.start() for m in regex.finditer(self.pattern, text) if m.start() < limit]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bpe.decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")


def _id_lists(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("<i4")
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _encode_batches(path: str, keys: list[str], counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                parts = [bpe.encode(t) for t in batch.column("text").to_pylist()]
                if counts_only:
                    made = pa.array([len(p) // 4 for p in parts], pa.int64())
                else:
                    made = _id_lists(parts)
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [made], [*keys, "made"])

    return run


def _count_short(path: str, keys: list[str], chunk_chars: int):
    """Token counts of short texts; long texts are passed on uncounted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("text").to_pylist()
                long = [t is not None and len(t) > chunk_chars for t in texts]
                counts = pa.array([None if far else len(bpe.encode(t)) // 4 for t, far in zip(texts, long)], pa.int64())
                left = pa.array([t if far else None for t, far in zip(texts, long)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), counts, left], [*keys, "made", "text"])

    return run


def _chunk_batches(step: int, halo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "text"))):
                starts = range(0, len(text), step)
                for k in range(0, len(starts), 64):
                    some = starts[k : k + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc] * len(some), pa.int64()),
                            pa.array(range(k, k + len(some)), pa.int64()),
                            pa.array(list(some), pa.int64()),
                            pa.array([text[s : s + step + halo] for s in some], pa.string()),
                        ],
                        ["doc", "chunk_no", "start", "text"],
                    )

    return run


def _boundary_batches(path: str, step: int, halo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path)
        for batch in batches:
            heads, tails = [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist()):
                found = bpe.starts(text)
                heads.append([start + b for b in found if b < halo])
                tails.append([start + b for b in found if b >= step])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc", "chunk_no", "start")] + lists, ["doc", "chunk_no", "start", "head", "tail"]
            )

    return run


def _encode_long(long: DataFrame, path: str, chunk_chars: int, halo_chars: int, counts_only: bool) -> DataFrame:
    """`doc, made` of the texts `doc, text`, spread over the cluster by (document, chunk)."""
    kind = "made bigint" if counts_only else "made array<int>"
    chunks = long.select("doc", "text").mapInArrow(_chunk_batches(chunk_chars, halo_chars), "doc bigint, chunk_no bigint, start bigint, text string")
    spread = chunks.repartition(F.col("doc"), F.col("chunk_no"))
    bounds = spread.mapInArrow(
        _boundary_batches(path, chunk_chars, halo_chars),
        "doc bigint, chunk_no bigint, start bigint, head array<bigint>, tail array<bigint>",
    )
    # One row per chunk, no text: the boundary table of a document.
    per_doc = Window.partitionBy("doc").orderBy("chunk_no")
    stitched = bounds.withColumn(
        "cut",
        F.when(F.col("chunk_no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(per_doc)))),
    )
    stitched = stitched.select(
        "doc",
        "chunk_no",
        "cut",
        F.lead("cut").over(per_doc).alias("next_cut"),
        F.count("cut").over(per_doc).alias("piece_no"),
        (F.lead("chunk_no").over(per_doc).isNull()).alias("is_last"),
    )
    low = F.coalesce(F.col("cut"), F.col("start")) - F.col("start")
    high = F.when(F.col("is_last"), F.length("text")).otherwise(
        F.coalesce(F.col("next_cut"), F.col("start") + chunk_chars) - F.col("start")
    )
    parts = spread.join(stitched, ["doc", "chunk_no"]).select(
        "doc", "piece_no", "chunk_no", F.substring("text", (low + 1).cast("int"), (high - low).cast("int")).alias("part")
    )
    pieces = parts.groupBy("doc", "piece_no").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))).getField("part"), "").alias("text")
    )
    encoded = pieces.mapInArrow(_encode_batches(path, ["doc", "piece_no"], counts_only), f"doc bigint, piece_no bigint, {kind}")
    if counts_only:
        return encoded.groupBy("doc").agg(F.sum("made").alias("made"))
    return encoded.groupBy("doc").agg(F.flatten(F.array_sort(F.collect_list(F.struct("piece_no", "made"))).getField("made")).alias("made"))


def encode_corpus(
    documents: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    halo_chars: int = HALO_CHARS,
    counts_only: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """`id_col, *keep, ids` (or `n_tokens` for `ids` with `counts_only`) for every row of `documents`.

    Texts up to `chunk_chars` are encoded where they are read, without a shuffle. Longer ones are
    spread over the cluster by (document, chunk), so no document however long is one task's work.

    The long rows are written once, with a number of their own each. Counts take one scan of `documents`; ids take two, the
    first to pick the long rows, since writing all ids beside them would cost more than reading the texts again.
    """
    if chunk_chars <= 2 * halo_chars:
        raise ValueError("chunk_chars must exceed twice halo_chars")
    path = tokenizer or tokenizer_path()
    made = "n_tokens" if counts_only else "ids"
    if {made, id_col} & set(keep):
        raise ValueError(f"{made} and {id_col} can't be among the kept columns")
    keys = ["key", *(f"kept_{i}" for i in range(len(keep)))]
    docs = documents.select(
        F.col(id_col).cast("bigint").alias("key"), *[F.col(c).alias(k) for c, k in zip(keep, keys[1:])], F.col(text_col).cast("string").alias("text")
    )
    shape = ", ".join(f"{k} {t}" for k, t in docs.select(*keys).dtypes)
    if counts_only:
        told = checkpointed(docs.mapInArrow(_count_short(path, keys, chunk_chars), f"{shape}, made bigint, text string").withColumn("doc", F.monotonically_increasing_id()))
        short, long = told.where("made is not null").select(*keys, "made"), told.where("made is null")
    else:
        is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
        long = checkpointed(docs.where(is_long).withColumn("doc", F.monotonically_increasing_id()))
        short = docs.where(~is_long).mapInArrow(_encode_batches(path, keys, counts_only), f"{shape}, made array<int>")
    whole = long.select("doc", *keys).join(_encode_long(long, path, chunk_chars, halo_chars, counts_only), "doc")
    return short.unionByName(whole.select(*keys, "made")).select(F.col("key").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, keys[1:])], F.col("made").alias(made))


def decode_corpus(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """`id_col, text`: concatenates the raw bytes of the ids and reads them as UTF-8."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path)
        for batch in batches:
            texts = [bpe.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    rows = encoded.select(F.col(id_col).cast("bigint").alias("key"), "ids").mapInArrow(run, "key bigint, text string")
    return rows.withColumnRenamed("key", id_col)
