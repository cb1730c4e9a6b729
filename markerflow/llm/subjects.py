"""Subject areas of documents.

Method: the document-term matrix is factored by seeded non-negative alternating updates. Every
subject is a component anchored at the terms that its labelled documents use more than others, and
one more component takes what belongs to none. Each round the documents' mixtures are solved where
the documents lie, and only sums over terms are shuffled; the components are then renewed from the sums and their
anchors. The mixtures come straight from the anchored components; a cue is about the component that
explains most of its terms under its document's mixture if it explains one of them surely, and cue counts decide a document's subjects.

Terms are words and pairs of neighbouring words of the dialogue, folded so that what optical recognition
confuses is equal, and hashed. A component holds the terms found in at least `MIN_SHARE` and at most `MOST_SHARE` of the
documents, of which there can be no more than the mean number of terms of a document over that share.

Defined cases: null, empty and blank texts give no subject; labels are trimmed and lower-cased, and `none`, null and
unknown ones are no subject; several labels of a document all count; labels of missing documents are left out;
without any label the descriptions of the subjects alone are the anchors; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerflow.llm.cues import HASH_BITS, CueReader, fold, hashed, split_cues
from markerflow.session import checkpointed

MIN_SHARE = 5e-5
MIN_DOCS = 3
MAX_TERMS = 2_000_000
MAX_BRANDS = 100_000
#: Terms of more than this share of the documents tell nothing of a subject.
MOST_SHARE = 0.2
ROUNDS = 4
INNER_ROUNDS = 6
ANCHOR = 0.2
LIFT = 3.0
CLEAR = 3.0
SHARED = 1.5
FORETOLD = 1.5
CHANCE = 2.0
SURE = 0.6
LEAST_CUES = 3
LEAST_SHARE = 0.1
_READ_SCHEMA = "doc_id bigint, lengths array<int>, terms array<int>"


def read_cues(documents: DataFrame) -> DataFrame:
    """`doc_id, lengths, terms`: per cue the number of its terms, negative less one for a cue with an address; the terms in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CueReader()
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                lengths, terms = [], []
                for text in batch.column("text").to_pylist():
                    read = [reader.terms(c) for c in split_cues(text)]
                    lengths.append([-1 - len(t) if address else len(t) for address, t in read])
                    terms.append([x for _, t in read for x in t])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lengths, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.int32()))],
                    ["doc_id", "lengths", "terms"],
                )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _READ_SCHEMA)


def _slices(batch: pa.RecordBatch, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column, of this slice alone."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)


class Flat:
    """The cues and terms of some documents in a row: for each term its cue, for each cue its document."""

    def __init__(self, batch: pa.RecordBatch):
        per_doc, lengths = _list(batch.column("lengths"))
        _, self.terms = _list(batch.column("terms"))
        self.n_docs = len(per_doc)
        self.address = lengths < 0
        self.doc_of_cue = np.repeat(np.arange(self.n_docs), per_doc)
        self.cue_of_term = np.repeat(np.arange(len(lengths)), np.where(self.address, -1 - lengths, lengths))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many documents hold a term, and how many addresses name it."""
    size = 1 << HASH_BITS
    docs, named, n = np.zeros(size, np.int32), np.zeros(size, np.int32), 0
    for whole in batches:
        for batch in _slices(whole):
            flat = Flat(batch)
            n += flat.n_docs
            address = flat.address[flat.cue_of_term]
            of_doc = flat.doc_of_cue[flat.cue_of_term]
            pairs = np.unique(of_doc[~address].astype(np.int64) * size + flat.terms[~address])
            np.add.at(docs, pairs % size, 1)
            np.add.at(named, flat.terms[address], 1)
    held = np.flatnonzero(docs | named)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(held, -1), pa.int64()), pa.array(np.append(docs[held], n), pa.int64()), pa.array(np.append(named[held], 0), pa.int64())],
        ["term", "docs", "named"],
    )


class Space:
    """The kept terms in order of their hash, the brands of addresses, and the components over the terms."""

    def __init__(self, terms: np.ndarray, brands: np.ndarray, names: list[str]):
        self.terms, self.brands, self.names = terms, brands, names
        self.components = np.zeros((len(names) + 1, len(terms)))

    def dialogue(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document how many cues are no adverts; the places of their kept terms, and the cue of each."""
        advert = flat.address.copy()
        if len(self.brands):
            at = np.minimum(np.searchsorted(self.brands, flat.terms), len(self.brands) - 1)
            advert[flat.cue_of_term[self.brands[at] == flat.terms]] = True
        place = np.minimum(np.searchsorted(self.terms, flat.terms), max(len(self.terms) - 1, 0))
        kept = (self.terms[place] == flat.terms) & ~advert[flat.cue_of_term] if len(self.terms) else np.zeros(len(flat.terms), bool)
        n_cues = np.bincount(flat.doc_of_cue[~advert], minlength=flat.n_docs)
        return n_cues, place[kept], flat.cue_of_term[kept]

    def matrix(self, flat: Flat, places: np.ndarray, cues: np.ndarray) -> "Matrix":
        """The document-term counts of kept terms."""
        n = max(len(self.terms), 1)
        keys, counts = np.unique(flat.doc_of_cue[cues].astype(np.int64) * n + places, return_counts=True)
        return Matrix(keys // n, (keys % n).astype(np.int32), counts.astype(np.float32))


class Matrix:
    """Sparse rows of some documents, sorted by document; `rows` are the documents that have any term."""

    def __init__(self, doc: np.ndarray, place: np.ndarray, count: np.ndarray):
        self.place, self.count = place, count
        self.first = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
        self.rows = doc[self.first] if len(doc) else doc
        self.row = np.repeat(np.arange(len(self.rows)), np.diff(np.append(self.first, len(doc))))

    def mixtures(self, components: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """Weights (components x rows) by multiplicative updates with the components fixed."""
        h = components[:, self.place]
        w = np.ones((len(h), len(self.rows)), np.float32) if allowed is None else allowed
        w = w / w.sum(axis=0)
        total = np.add.reduceat(self.count, self.first)
        for _ in range(INNER_ROUNDS):
            w = np.add.reduceat(self.shared(w, h), self.first, axis=1) / total
        return w

    def shared(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Each entry's count, shared among the components."""
        parts = np.take(w, self.row, axis=1)
        parts *= h
        parts *= self.count / np.maximum(parts.sum(axis=0), np.float32(1e-30))
        return parts


def _anchors(held: np.ndarray, sizes: np.ndarray, docs: np.ndarray, total: int) -> np.ndarray:
    """Weights of the terms that a subject's labelled documents hold clearly more often than other labelled ones.

    `held` counts the documents of each subject, and last of any label, that hold a term; `sizes` those documents
    themselves; `docs` all documents that hold it. A term of many more documents than the labels of its subject foretell,
    such as a phrase of a language with few labels, is no anchor.
    """
    inside, outside = held[:-1], held[-1] - held[:-1]
    expected = sizes[:-1, None] * outside / np.maximum(sizes[-1] - sizes[:-1], 1)[:, None]
    clear = (inside >= 2) & (inside >= LIFT * expected) & (inside - expected >= CLEAR * np.sqrt(np.maximum(expected, 0.25)))
    own = docs[None, :] <= (FORETOLD * inside + CHANCE * np.sqrt(inside)) * total / max(sizes[-1], 1)
    return np.where(clear & own, inside - expected, 0.0)


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(rows.sum(axis=1, keepdims=True), 1e-30)


def _renewed(sums: np.ndarray, anchors: np.ndarray, overall: np.ndarray) -> np.ndarray:
    """Components from the sums of a round and their anchors. What most subjects share belongs to none of them."""
    subjects = _normal(sums[:-1])
    subjects = np.maximum(subjects - SHARED * np.median(subjects, axis=0), 0)
    subjects = (1 - ANCHOR) * _normal(subjects) + ANCHOR * anchors
    rest = _normal(sums[-1:] + overall * 1e-3 * max(sums[-1].sum(), 1.0))
    return np.vstack([_normal(subjects + 1e-7 * overall), rest])


def clean_labels(labels: DataFrame) -> DataFrame:
    """`doc_id, subjects`: the distinct trimmed lower-case labels of each document."""
    plain = F.lower(F.trim("subject"))
    return labels.where("doc_id is not null and subject is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_set(plain).alias("subjects"))


def _described(space: Space, described: list, docs: np.ndarray, total: int) -> np.ndarray:
    """A weight for the rarer words of each subject's name and description."""
    out = np.zeros((len(space.names), len(space.terms)))
    for r in described:
        words = {hashed(w) for w in re.findall(r"[^\W\d_]{4,}", fold(f"{r.subject} {r.description or ''}"))}
        at = np.flatnonzero(np.isin(space.terms, list(words)) & (docs < MOST_SHARE * total))
        out[space.names.index(r.subject), at] += 1.0
    return out


def _labelled_anchors(labelled: DataFrame, space: Space, number: dict[str, int], docs: np.ndarray, total: int) -> np.ndarray:
    k, width = len(number), len(space.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Row k is any label; the last column counts documents.
        held = np.zeros((k + 1, width + 1))
        for whole in batches:
            for batch in _slices(whole):
                flat = Flat(batch)
                _, places, cues = space.dialogue(flat)
                doc = flat.doc_of_cue[cues]
                pairs = np.unique(doc.astype(np.int64) * (width + 1) + places)
                doc, place = np.append(pairs // (width + 1), np.arange(flat.n_docs)), np.append(pairs % (width + 1), np.full(flat.n_docs, width))
                own = [[number[s] for s in subjects if s in number] + [k] for subjects in batch.column("subjects").to_pylist()]
                order = np.argsort(doc, kind="stable")
                ends = np.cumsum(np.bincount(doc, minlength=flat.n_docs))
                for d, mine in enumerate(own):
                    at = place[order[ends[d - 1] if d else 0 : ends[d]]]
                    for s in mine:
                        held[s, at] += 1
        some = np.flatnonzero(held.sum(axis=0))
        flat_sums = pa.FixedSizeListArray.from_arrays(pa.array(held[:, some].T.ravel()), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), flat_sums.cast(pa.list_(pa.float64()))], ["place", "sums"])

    held = _summed(labelled.mapInArrow(run, "place bigint, sums array<double>"), k + 1, width + 1)
    return _anchors(held[:, :-1], held[:, -1], docs, total)


def _summed(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sums over tasks of their vectors: as large as the kept terms, however large the corpus."""
    added = parts.groupBy("place").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(rows)]).toPandas()
    out = np.zeros((rows, width))
    out[:, added["place"].to_numpy(np.int64)] = added[[f"s{i}" for i in range(rows)]].to_numpy(float).T
    return out


def fit_subjects(cues: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> Space:
    """The anchored components, fitted to every document; only sums over terms come to the driver."""
    described = areas.where("subject is not null").select(F.lower(F.trim("subject")).alias("subject"), "description").distinct().orderBy("subject").limit(1_001).collect()
    if len(described) > 1_000:
        raise ValueError("at most 1000 subjects")
    names = sorted({r.subject for r in described})
    counted = cues.mapInArrow(_count_rows, "term bigint, docs bigint, named bigint").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("named").alias("named"))
    counted = checkpointed(counted)
    total = sum(r.docs for r in counted.where("term = -1").select("docs").collect())
    least = max(MIN_DOCS, int(MIN_SHARE * total))
    kept = counted.where((F.col("term") >= 0) & (F.col("docs") >= least)).select("term", "docs").limit(MAX_TERMS + 1).toPandas()
    brands = counted.where((F.col("term") >= 0) & (F.col("named") >= 2) & (F.col("named") * 20 >= F.col("docs"))).select("term").limit(MAX_BRANDS + 1).toPandas()
    if len(kept) > MAX_TERMS or len(brands) > MAX_BRANDS:
        raise ValueError("more terms than their share of documents allows")
    kept = kept.sort_values("term")
    terms, docs = kept["term"].to_numpy(np.int64), kept["docs"].to_numpy(float)
    space = Space(terms, np.sort(brands["term"].to_numpy(np.int64)), names)
    if not len(terms):
        return space
    number = {name: i for i, name in enumerate(names)}
    anchors = _described(space, described, docs, total) + _labelled_anchors(cues.join(clean_labels(labels), "doc_id"), space, number, docs, total)
    # What most documents hold tells nothing of a subject, unless labels say that it does.
    telling = (docs <= MOST_SHARE * total) | (anchors.max(axis=0) > 0)
    anchors, docs = _normal(anchors[:, telling]), docs[telling]
    space.terms = terms = terms[telling]
    if not len(terms):
        return space
    overall = docs / docs.sum()
    rest = np.maximum(overall - anchors.max(axis=0), 0.05 * overall)
    space.components = np.vstack([_normal(anchors + 1e-7 * overall), _normal(rest[None, :])])
    k = len(names)

    def to_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                flat = Flat(batch)
                _, places, cues = space.dialogue(flat)
                if not len(places):
                    continue
                m = space.matrix(flat, places, cues)
                own = batch.column("subjects").to_pylist()
                offsets = pa.array(np.append(m.first, len(m.place)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(offsets, pa.array(m.place, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(m.count, pa.float32())),
                        pa.array([None if own[d] is None else [number[s] for s in own[d] if s in number] for d in m.rows.tolist()], pa.list_(pa.int32())),
                    ],
                    ["places", "counts", "subjects"],
                )

    labelled = cues.join(clean_labels(labels), "doc_id", "left")
    matrix = checkpointed(labelled.mapInArrow(to_matrix, "places array<int>, counts array<float>, subjects array<int>"))

    def passing() -> np.ndarray:
        components = space.components.astype(np.float32)
        width = len(terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k + 1, width))
            for whole in batches:
                for batch in _slices(whole):
                    sizes, places = _list(batch.column("places"))
                    m = Matrix(np.repeat(np.arange(len(sizes)), sizes), places, _list(batch.column("counts"))[1])
                    subjects = [(j, s) for j, s in enumerate(batch.column("subjects").to_pylist()) if s is not None]
                    allowed = np.ones((k + 1, len(sizes)), np.float32)
                    for j, mine in subjects:
                        allowed[:k, j] = 0.02
                        allowed[mine, j] = 1.0
                    parts = m.shared(m.mixtures(components, allowed), components[:, m.place])
                    for c in range(k + 1):
                        sums[c] += np.bincount(m.place, parts[c], width)
            held = np.flatnonzero(sums.sum(axis=0))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(sums[:, held].T.ravel()), k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), flat.cast(pa.list_(pa.float64()))], ["place", "sums"])

        return _summed(matrix.mapInArrow(run, "place bigint, sums array<double>"), k + 1, width)

    for _ in range(rounds):
        space.components = _renewed(passing(), anchors, overall)
    return space


def _scored(space: Space, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document how many of its cues are no adverts, and, by subject and last of none, how many are about it and the weight."""
    n_cues, places, cues = space.dialogue(flat)
    last = len(space.names)
    about, weight = np.zeros((flat.n_docs, last + 1), np.int64), np.zeros((flat.n_docs, last + 1))
    weight[:, last] = 1.0  # as long as no kept term tells more
    if len(places) and last:
        components = space.components.astype(np.float32)
        m = space.matrix(flat, places, cues)
        w = m.mixtures(components)
        row_of_doc = np.zeros(flat.n_docs, np.int64)
        row_of_doc[m.rows] = np.arange(len(m.rows))
        # Each term of each cue, shared among the components by its document's mixture.
        parts = w[:, row_of_doc[flat.doc_of_cue[cues]]] * components[:, places]
        parts = parts[:-1] / np.maximum(parts.sum(axis=0), 1e-30)
        starts = np.flatnonzero(np.diff(cues, prepend=-1))
        best = np.add.reduceat(parts, starts, axis=1).argmax(axis=0)
        sure = np.maximum.reduceat(parts, starts, axis=1)[best, np.arange(len(starts))] >= SURE
        doc = flat.doc_of_cue[cues[starts[sure]]]
        about[:, :last] = np.bincount(doc * last + best[sure], minlength=flat.n_docs * last).reshape(flat.n_docs, last)
        weight[m.rows] = w.T
    about[:, last] = n_cues - about.sum(axis=1)
    return n_cues, about, weight


_RESULT = "doc_id bigint, subject string, n_about int, n_cues int, share double"


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`doc_id, subject, n_about, n_cues, share` for every subject with a cue about it: how many of its cues
    that are no adverts are about it, how many there are, and the document's weight of the component."""
    cues = checkpointed(read_cues(documents))
    space = fit_subjects(cues, labels, areas, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(space.names, pa.string())
        for whole in batches:
            for batch in _slices(whole):
                n_cues, about, weight = _scored(space, Flat(batch))
                doc, subject = np.nonzero(about[:, :-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        names.take(pa.array(subject)),
                        pa.array(about[doc, subject], pa.int32()),
                        pa.array(n_cues[doc], pa.int32()),
                        pa.array(weight[doc, subject], pa.float64()),
                    ],
                    [f.split()[0] for f in _RESULT.split(", ")],
                )

    return cues.mapInArrow(run, _RESULT)


NO_SUBJECT = "none"


def composition(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`subject, n_docs, n_cues_about, weight` of the corpus, with a row `none`.

    `n_docs` counts the documents that have a subject as in found_subjects, at `none` those that have no subject at all. Cues and
    weights are those of all documents: at `none` the cues about no subject and the weight of no subject, 1 for a document without
    a known term. So the cues of all rows are all cues that are no adverts, and the weights add up to the number of documents."""
    cues = checkpointed(read_cues(documents))
    space = fit_subjects(cues, labels, areas, rounds)
    result = "subject string, n_docs bigint, n_cues_about bigint, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*space.names, NO_SUBJECT], pa.string())
        for whole in batches:
            for batch in _slices(whole):
                n_cues, about, weight = _scored(space, Flat(batch))
                found = (about >= LEAST_CUES) & (about >= LEAST_SHARE * n_cues[:, None])
                found[:, -1] = ~found[:, :-1].any(axis=1)
                sums = [pa.array(found.sum(axis=0), pa.int64()), pa.array(about.sum(axis=0), pa.int64()), pa.array(weight.sum(axis=0), pa.float64())]
                yield pa.RecordBatch.from_arrays([names, *sums], [f.split()[0] for f in result.split(", ")])

    parts = cues.mapInArrow(run, result)
    return parts.groupBy("subject").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_cues_about").alias("n_cues_about"), F.round(F.sum("weight"), 3).alias("weight"))


def found_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """`doc_id, subject`: the subjects of at least LEAST_CUES and LEAST_SHARE of a document's cues."""
    rows = document_subjects(documents, labels, areas)
    return rows.where((F.col("n_about") >= LEAST_CUES) & (F.col("n_about") >= LEAST_SHARE * F.col("n_cues"))).select("doc_id", "subject").distinct()
