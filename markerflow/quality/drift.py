"""Reading records whose schema drifts from batch to batch into one table, with a report of every change.

Method: similarity flooding. The schemas of a batch and of the batch before are graphs: fields lead to the object that holds them, to
their type and to the words of their names, objects to the objects that hold them. Pairs of nodes, one of each graph, begin with a likeness of their own (of
fields: of their values) and then take up the scores of the pairs they lead to and come from, round after round until no score changes; so
a word that two renamed fields changed alike, or an object that moved, speaks for the other fields with it. The best pairs
of fields that agree from both sides and are likely enough are the same quantity renamed. Then values are cast and put into
one table; what a cast can't hold is kept beside it as JSON text.

The likeness of values comes from histograms of features (kind, magnitude, sign, length, pairs of letters and
values) of each path and type of a stream over all its files; they are counted where the files are read and only
counts are shuffled. Only pairs of fields whose values share a feature are ever formed, by an equi-join on features. The graphs of two batches are one row, bounded
by the width of a schema, which is checked; rows are spread over a set number of tasks.

Defined cases: a payload that is null or not a JSON object is unreadable and counts nowhere; a file
delivered more than once counts once, a readable delivery before an unreadable one; null values
and empty objects are absent; where two types are equally frequent the first in order of the alphabet counts; the first
batch of a stream has no changes; a repeated file is dropped by its raw_id, so files with a null raw_id all count; empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerflow.session import checkpointed

SHARE = 3  # a batch has a field if at least one in SHARE of its readable files holds it
ACCEPT = 0.58
LEAST_OVERLAP = 0.03
#: How much of a score is taken up from around, and what of that from objects, types and words.
FLOOD_SHARE = 0.5
PARENT_SHARE, TYPE_SHARE, WORD_SHARE = 0.25, 0.25, 0.5
OTHER_TYPE = 0.4
SETTLED = 1e-6
MAX_FIELDS = 10_000
MAX_DROPPED = 1_000_000
COUNTED_VALUES = 1_000_000
VALUE_BUCKETS = 64
_NUMBER = re.compile(r"\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*[a-zA-Z%\"']{0,3}\s*")
_DIGITS = re.compile(r"\d+")
#: Weights of the feature families in the likeness of values.
FAMILIES = {"kind": 1.0, "mag": 2.0, "frac": 1.5, "sign": 0.5, "len": 1.5, "inner": 1.0, "val": 0.6, "pair": 2.0}


def leaves(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths to the values that are not objects."""
    for key, value in record.items():
        if isinstance(value, dict):
            yield from leaves(value, f"{prefix}{key}.")
        else:
            yield prefix + key, value


def simple_type(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array"


def read_record(payload: str | None) -> dict | None:
    try:
        record = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _plain(value: object) -> object:
    """What a value says whatever its type: numbers and lists written as text are read."""
    if isinstance(value, str):
        if found := _NUMBER.fullmatch(value):
            return float(found[1])
        if value[:1] in "[{":
            try:
                return json.loads(value)
            except ValueError:
                return value
        if re.search(r"[;,]", value) and " " not in value:
            return re.split(r"[;,]", value)
    if isinstance(value, list) and len(value) == 1 and isinstance(value[0], str):
        return value[0]
    return value


def _kind(value: object) -> str:
    if isinstance(value, list):
        return f"list of {_kind(value[0]) if value else 'nothing'}"
    return "object" if isinstance(value, dict) else simple_type(value)


def features(value: object) -> list[str]:
    """Features of one value, each with its family before the colon."""
    value = _plain(value)
    return [f"kind:{_kind(value)}", *_parts(value, 0)]


@lru_cache(100_000)
def _number_parts(size: int, sign: int, frac: bool) -> list[str]:
    return [f"mag:{size}", f"sign:{sign}", f"frac:{frac}"]


def _parts(value: object, depth: int) -> list[str]:
    if isinstance(value, bool):
        return [f"val:{value}"]
    if isinstance(value, (int, float)):
        known = value and (isinstance(value, int) or math.isfinite(value))
        size = math.floor(2 * math.log10(abs(value))) if known else -99
        return _number_parts(size, (value > 0) - (value < 0), bool(known and value != math.floor(value)))
    if isinstance(value, str):
        value = value.encode("utf-8", "replace").decode()
        text = "^" + _DIGITS.sub("9", value.lower()) + "$"
        return [*{f"pair:{x}" for x in map("".join, zip(text, text[1:]))}, f"val:{zlib.crc32(value.lower().encode()) % VALUE_BUCKETS}"]
    if isinstance(value, list):
        inner = [f for item in value for f in _parts(item, depth + 1)]
        return [f"{'inner' if depth else 'len'}:{len(value)}", *inner]
    return []


def one_delivery(raw: DataFrame) -> DataFrame:
    """`stream, batch_no, file_path, raw_id, payload`: each file once.

    Deliveries are compared by their ids; payloads stay where they are read. The ids of further deliveries, which are few, are
    broadcast if they are at most MAX_DROPPED, else joined."""
    path = F.coalesce("file_path", F.concat(F.lit("raw:"), F.col("raw_id").cast("string")))
    rows = raw.select("stream", "batch_no", path.alias("file_path"), "raw_id", "payload")
    torn = F.try_parse_json("payload").isNull().cast("int")
    again = rows.where("raw_id is not null").groupBy("stream", "batch_no", "file_path").agg(
        F.count("*").alias("n"), F.min_by("raw_id", F.struct(torn, "raw_id")).alias("kept"), F.collect_set("raw_id").alias("ids")
    ).where("n > 1")
    dropped = checkpointed(again.select(F.explode("ids").alias("raw_id"), "kept").where("raw_id != kept").select("raw_id"))
    return rows.join(F.broadcast(dropped) if dropped.count() <= MAX_DROPPED else dropped, "raw_id", "left_anti")


_COUNT_SCHEMA = "stream string, batch_no int, path string, type string, feature string, n bigint"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of files, of fields by type per batch, and of features per path and type of a stream, over some files each."""
    read_text = lru_cache(100_000)(features)  # most texts of a field are repeated
    files, fields, values, held = Counter(), Counter(), {}, 0

    def told() -> pa.RecordBatch:
        rows = [(s, b, None, None, None, n) for (s, b), n in files.items()] + [(*key, None, n) for key, n in fields.items()]
        rows += [(s, None, p, k, f, n) for (s, p, k), counter in values.items() for f, n in counter.items()]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _COUNT_SCHEMA.split(", ")])

    for batch in batches:
        for stream, number, payload in zip(*(batch.column(c).to_pylist() for c in ("stream", "batch_no", "payload"))):
            record = read_record(payload)
            if record is None:
                continue
            files[stream, number] += 1
            for path, value in leaves(record):
                if value is not None:
                    kind = simple_type(value)
                    fields[stream, number, path, kind] += 1
                    counter = values.get((stream, path, kind))
                    if counter is None:
                        counter = values[stream, path, kind] = Counter()
                    held += 1
                    for feature in read_text(value) if kind == "string" else features(value):
                        counter[feature] += 1
        if held > COUNTED_VALUES:
            yield told()
            files, fields, values, held = Counter(), Counter(), {}, 0
    yield told()


def field_counts(raw: DataFrame) -> DataFrame:
    """Counts of files, of fields by type per batch, and of features per path and type of a stream; combined before they are shuffled."""
    files = one_delivery(raw).select("stream", F.col("batch_no").cast("int").alias("batch_no"), "payload")
    # Files of a stream lie together in most tables, so a task's counts are few.
    counted = files.mapInArrow(_count_batches, _COUNT_SCHEMA)
    return counted.groupBy("stream", "batch_no", "path", "type", "feature").agg(F.sum("n").alias("n"))


def batch_fields(counts: DataFrame) -> DataFrame:
    """`stream, batch_no, path, type` of every field that a batch has."""
    totals = counts.where("path is null").select("stream", "batch_no", F.col("n").alias("files"))
    by_path = counts.where("path is not null and feature is null").groupBy("stream", "batch_no", "path").agg(
        F.sum("n").alias("holding"), F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type")
    )
    keys = by_path["stream"].eqNullSafe(totals["stream"]) & by_path["batch_no"].eqNullSafe(totals["batch_no"])
    return by_path.join(totals, keys).where(F.col("holding") * SHARE >= F.col("files")).select(by_path["stream"], by_path["batch_no"], "path", "type")


def _sides(counts: DataFrame) -> DataFrame:
    """`stream, batch_no, path, old_type, new_type`: the fields of every batch beside those of the batch before."""
    fields = batch_fields(counts)
    order = Window.partitionBy("stream").orderBy("batch_no")
    batches = counts.where("path is null").select("stream", "batch_no").withColumn("before", F.lag("batch_no").over(order)).where("before is not null")
    now = fields.join(batches.select("stream", "batch_no"), ["stream", "batch_no"]).withColumnRenamed("type", "new_type")
    then = fields.select("stream", F.col("batch_no").alias("before"), "path", F.col("type").alias("old_type")).join(batches, ["stream", "before"]).drop("before")
    return now.join(then, ["stream", "batch_no", "path"], "full")


def value_likeness(counts: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """`stream, batch_no, old, new, likeness`: how the feature histograms of a vanished and a new field of a batch overlap, by
    family; of each field the values of the type that it has in its batch. Pairs whose values have no telling feature in common have none."""
    seen = counts.where("feature is not null").select("stream", "path", "type", F.substring_index("feature", ":", 1).alias("family"), "feature", "n")
    shares = seen.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("stream", "path", "type", "family")))
    left = gone.join(shares.withColumnsRenamed({"path": "old", "type": "old_type", "p": "p_old"}).drop("n"), ["stream", "old", "old_type"])
    right = come.join(shares.withColumnsRenamed({"path": "new", "type": "new_type", "p": "p_new"}).drop("n"), ["stream", "new", "new_type"])
    met = left.join(right, ["stream", "batch_no", "family", "feature"])
    pair = ["stream", "batch_no", "old", "old_type", "new", "new_type"]
    by_family = met.groupBy(*pair, "family").agg(F.sum(F.sqrt(F.col("p_old") * F.col("p_new"))).alias("overlap"))
    # A geometric mean over the families that either field has, by how many of its values have them: two quantities of one kind but of
    # other sizes or signs are not alike.
    weights = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    fit = F.log(F.greatest("overlap", F.lit(LEAST_OVERLAP))) - F.log(F.lit(LEAST_OVERLAP))
    telling = F.col("family").isin("mag", "len", "inner", "val", "pair")
    found = by_family.groupBy(*pair).agg(
        F.map_from_entries(F.collect_list(F.struct("family", fit))).alias("fits"), F.bool_or(telling).alias("told")
    )
    held = seen.groupBy("stream", "path", "type", "family").agg(F.sum("n").alias("n"))
    held = held.groupBy("stream", "path", "type").agg(F.map_from_entries(F.collect_list(F.struct("family", "n"))).alias("held"))
    pairs = found.where("told")
    for side in ("old", "new"):
        pairs = pairs.join(held.withColumnsRenamed({"path": side, "type": f"{side}_type", "held": f"_{side}"}), ["stream", side, f"{side}_type"])
    share = lambda side, f: F.least(F.coalesce(F.col(side)[f], F.lit(0)) / F.col(side)["kind"], F.lit(1.0))
    weight = lambda f: weights[f] * (share("_old", f) + share("_new", f))
    families = F.map_keys(weights)
    whole = F.aggregate(families, F.lit(0.0), lambda s, f: s + weight(f))
    fitting = F.aggregate(families, F.lit(0.0), lambda s, f: s + weight(f) * F.coalesce(F.col("fits")[f], F.lit(0.0)))
    return pairs.select("stream", "batch_no", "old", "new", F.exp(fitting / whole + F.log(F.lit(LEAST_OVERLAP))).alias("likeness"))


def name_words(path: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", path).lower()) if w]


def word_likeness(a: str, b: str) -> float:
    """1 for equal words, else the share of the longer one that both begin with."""
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return same / max(len(a), len(b))


def parent_of(path: str) -> str:
    return path.rpartition(".")[0]


def flood(old: dict[str, str], new: dict[str, str], likeness: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Settled scores of the pairs in `likeness`; old and new give each side's fields with their types.

    A pair's score is partly its own likeness and partly what flows in: to a field from its object, its type and its words,
    to an object, a type or a word from the best pairs of what it holds. As at most FLOOD_SHARE of a change is passed on, scores settle.
    """
    own: dict[tuple, float] = {("field", *p): v for p, v in likeness.items()}
    own |= {("field", p, p): 1.0 for p in old.keys() & new.keys()}
    holders: dict[tuple, list[tuple[float, list[tuple]]]] = {}
    held: dict[tuple, dict[str, list[tuple]]] = {}

    def joins(node: tuple, other: tuple, start: float) -> tuple:
        own.setdefault(other, start)
        held.setdefault(other, {}).setdefault(node[1], []).append(node)
        return other

    waiting = list(own)
    while waiting:
        node = waiting.pop()
        kind, a, b = node
        groups = []
        if a and b:
            above = ("object", parent_of(a), parent_of(b))
            if above not in own:
                waiting.append(above)
            groups.append((PARENT_SHARE if kind == "field" else 1.0, [joins(node, above, 1.0 if above[1] == above[2] else 0.0)]))
        if kind == "field":
            s, t = old.get(a), new.get(b)
            groups.append((TYPE_SHARE, [joins(node, ("type", s or "", t or ""), 1.0 if s == t else OTHER_TYPE)]))
            pairs = []
            x, y = name_words(a), name_words(b)
            for u in x:
                v = max(y, key=lambda w: (word_likeness(u, w), w), default=None)
                if v is not None:
                    pairs.append(joins(node, ("word", u, v), word_likeness(u, v)))
            for v in y:
                u = max(x, key=lambda w: (word_likeness(w, v), w), default=None)
                if u is not None:
                    pairs.append(joins(node, ("word", u, v), word_likeness(u, v)))
            groups.append((WORD_SHARE, pairs))
        holders[node] = groups

    score, change = dict(own), 1.0
    while change > SETTLED:
        flowed, change = {}, 0.0
        for node, start in own.items():
            flow, weight = 0.0, 0.0
            for share, others in holders.get(node, ()):
                if others:
                    flow, weight = flow + share * sum(score[q] for q in others) / len(others), weight + share
            if inner := held.get(node):
                best = sum(max(score[q] for q in some) for some in inner.values()) / len(inner)
                flow, weight = flow + best, weight + 1.0
            flowed[node] = (1 - FLOOD_SHARE) * start + FLOOD_SHARE * (flow / weight if weight else start)
            change = max(change, abs(flowed[node] - score[node]))
        score = flowed
    return {p: score["field", *p] for p in likeness}


def _match_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            old = {f["path"]: f["old_type"] for f in r["fields"] if f["old_type"] is not None}
            new = {f["path"]: f["new_type"] for f in r["fields"] if f["new_type"] is not None}
            score = flood(old, new, {(p["old"], p["new"]): p["likeness"] for p in r["pairs"]})
            taken = set()
            for (a, b), s in sorted(score.items(), key=lambda kv: (-kv[1], kv[0])):
                if (0, a) not in taken and (1, b) not in taken:
                    taken |= {(0, a), (1, b)}
                    out.append((r["stream"], r["batch_no"], a, b, s))
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["stream", "batch_no", "old", "new", "score"])


def matched_fields(counts: DataFrame, sides: DataFrame) -> DataFrame:
    """`stream, batch_no, old, new, score`: the best partner of each vanished field among the new ones of its batch, by flooding."""
    widest = sides.groupBy("stream", "batch_no").count().agg(F.max("count")).first()[0]
    if (widest or 0) > MAX_FIELDS:
        raise ValueError(f"a batch has more than {MAX_FIELDS} fields")
    gone = sides.where("new_type is null").select("stream", "batch_no", F.col("path").alias("old"), "old_type")
    come = sides.where("old_type is null").select("stream", "batch_no", F.col("path").alias("new"), "new_type")
    batch = ["stream", "batch_no"]
    pairs = value_likeness(counts, gone, come).groupBy(*batch).agg(F.collect_list(F.struct("old", "new", "likeness")).alias("pairs"))
    fields = sides.groupBy(*batch).agg(F.collect_list(F.struct("path", "old_type", "new_type")).alias("fields"))
    # Few bytes but much work a batch: a set number of partitions, which are not gathered into fewer.
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.join(fields, batch).repartition(tasks, F.xxhash64(*batch))
    return rows.mapInArrow(_match_batches, "stream string, batch_no int, old string, new string, score double")


def schema_changes(raw: DataFrame) -> DataFrame:
    """`stream, batch_no, change_kind, field_name, new_name` of every batch against the batch before."""
    return _changes(checkpointed(field_counts(raw)))


def _changes(counts: DataFrame) -> DataFrame:
    # Counts and fields are small beside the records; written once, they aren't counted anew for each use.
    sides = checkpointed(_sides(counts))
    renamed = checkpointed(matched_fields(counts, sides).where(F.col("score") >= ACCEPT))
    ends = renamed.select("stream", "batch_no", F.explode(F.array("old", "new")).alias("path"), "old", "new")
    told = sides.where("not old_type <=> new_type").join(ends, ["stream", "batch_no", "path"], "left")
    kind = (
        F.when(F.col("old").isNotNull(), F.when(F.col("path") == F.col("old"), "renamed"))
        .when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .otherwise("retyped")
    )
    return told.select(
        "stream", "batch_no", kind.alias("change_kind"), F.col("path").alias("field_name"), F.coalesce("new", F.lit("")).alias("new_name")
    ).where("change_kind is not null")


def canonical_fields(raw: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """Path -> canonical path, and canonical path -> type, of every path that any file holds.

    Whether a batch has a field only decides changes, renames and usual types; a path below that share in every batch is a
    field of its own. Names of fields, not rows: the number of those of batches is bounded by the width of the schemas and
    checked, and of the others at most the MAX_FIELDS most frequent are taken.
    Paths joined by renames in either direction are one field, named after its most frequent path.
    """
    counts = checkpointed(field_counts(raw))
    had = checkpointed(batch_fields(counts))
    held = had.groupBy("path", "type").count().limit(MAX_FIELDS + 1).collect()
    renames = _changes(counts).where("change_kind = 'renamed'").select("field_name", "new_name").distinct().limit(MAX_FIELDS + 1).collect()
    if max(len(held), len(renames)) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields or renames")
    seen = counts.where("path is not null and feature is null").groupBy("path", "type").agg(F.sum("n").alias("n"))
    usual = seen.groupBy("path").agg(F.sum("n").alias("n"), F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    odd = usual.join(had.select("path").distinct(), "path", "left_anti").orderBy(F.desc("n"), "path").limit(MAX_FIELDS).collect()
    weight, kinds = Counter(), {}
    for r in held:
        weight[r["path"]] += r["count"]
        kinds.setdefault(r["path"], Counter())[r["type"]] += r["count"]
    for r in odd:
        weight[r["path"]] = 0
        kinds[r["path"]] = Counter({r["type"]: 0})
    root = {p: p for p in weight}

    def find(p: str) -> str:
        while root[p] != p:
            p = root[p]
        return p

    for a, b in sorted(map(tuple, renames)):
        x, y = find(a), find(b)
        if x != y:
            keep, drop = sorted((x, y), key=lambda p: (-weight[p], p))
            root[drop] = keep
    canonical = {p: find(p) for p in root}
    merged: dict[str, Counter] = {}
    for p, c in canonical.items():
        merged.setdefault(c, Counter()).update(kinds[p])
    return canonical, {c: min(k, key=lambda t: (-k[t], t)) for c, k in merged.items()}


def _cast(value: object, kind: str) -> object:
    if value is None:
        return None
    if kind == "array":
        value = _plain(value)
        return json.dumps(value if isinstance(value, list) else [value], ensure_ascii=False)
    if kind == "number":
        value = _plain(value)
        try:
            return float(value) if isinstance(value, (bool, int, float)) else None
        except OverflowError:
            return None
    if kind == "boolean":
        return {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}.get(str(value).lower())
    if isinstance(value, list):
        return ";".join(map(str, value))
    return str(value) if isinstance(value, str) else json.dumps(value)


def _bare_number(text: str) -> bool:
    """Whether a text that is read as a number says no more, such as a unit or digits beyond a double."""
    try:
        return math.isfinite(float(text)) and len(re.sub(r"[eE].*|\D", "", text).lstrip("0")) <= 15
    except ValueError:
        return False


def _placed(value: object, kind: str) -> tuple[object, bool]:
    """The value as its column's type, and whether that says all that the value says."""
    cast = _cast(value, kind)
    if cast is None:
        return None, False
    if isinstance(cast, str):
        try:
            cast.encode()
        except UnicodeEncodeError:  # half a character pair, which no column can hold
            return None, False
    if isinstance(value, str) and isinstance(_plain(value), float) and kind in ("number", "array"):
        return cast, _bare_number(value)
    if kind == "number":
        # An integer may have more digits than a double.
        return cast, not isinstance(value, bool) and (cast == value or cast != cast)
    if kind == "string" and isinstance(value, list):
        return cast, bool(value) and all(isinstance(v, (str, int, float)) and not isinstance(v, bool) and ";" not in str(v) for v in value)
    return cast, True


def _column_names(paths: list[str], taken: list[str]) -> list[str]:
    """A name for the column of each path, unlike all others whatever their case."""
    used, names = {t.lower() for t in taken}, []
    for path in paths:
        name = base = path.replace(".", "_") or "_"
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name.lower())
        names.append(name)
    return names


REST = "rest"


def unified_records(raw: DataFrame) -> DataFrame:
    """Every readable file once: its keys, one column per canonical field, cast to its usual type, arrays as JSON text, and `rest`.

    `rest` is a JSON object of path -> list of values, as they were read, for what its column can't say: values of another
    type, units or digits that a cast drops, and further values of the same field in one record. It is null where there are none.
    """
    canonical, kinds = canonical_fields(raw)
    order = sorted(kinds)
    spark_types = {"number": T.DoubleType(), "boolean": T.BooleanType()}
    arrow_types = {"number": pa.float64(), "boolean": pa.bool_()}
    keys = ["stream", "batch_no", "file_path", "raw_id"]
    files = one_delivery(raw).select(*keys, "payload")
    fields = [T.StructField(name, spark_types.get(kinds[c], T.StringType())) for name, c in zip(_column_names(order, [*keys, REST]), order)]
    schema = T.StructType([*[files.schema[k] for k in keys], *fields, T.StructField(REST, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [read_record(p) for p in batch.column("payload").to_pylist()]
            kept = [i for i, r in enumerate(records) if r is not None]
            columns: dict[str, list] = {c: [None] * len(kept) for c in order}
            rests: list[str | None] = []
            for row, i in enumerate(kept):
                rest: dict[str, list] = {}
                for path, value in leaves(records[i]):
                    if value is None:
                        continue
                    name = canonical.get(path)
                    whole = False
                    if name is not None and columns[name][row] is None:
                        columns[name][row], whole = _placed(value, kinds[name])
                    if not whole:
                        rest.setdefault(path, []).append(value)
                rests.append(json.dumps(rest) if rest else None)
            few = batch.take(pa.array(kept, pa.int32()))
            arrays = [few.column(k) for k in keys] + [pa.array(columns[c], arrow_types.get(kinds[c], pa.string())) for c in order]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(rests, pa.string())], schema.names)

    return files.mapInArrow(run, schema)


def unified_table(raw: DataFrame) -> DataFrame:
    """`unified_records` without `rest`: the keys and the typed columns alone."""
    return unified_records(raw).drop(REST)
