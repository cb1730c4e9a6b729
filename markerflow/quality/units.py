"""Bringing quantities recorded in different units to a common one.

Method: unit conversions are edges of a graph, each an affine function (factor, offset). The
shortest composition from every unit to the canonical one is precomputed and every cycle is
checked to return where it began; records are then converted by an equi-join on their source unit and the canonical target.

Which unit a record truly is in comes from the same join: a record meets the conversion of every unit that it may be in, and the
one is taken that brings it closest to what two witnesses say: what the unit column or the note says,
and how the body's known heights look in the numbers. Units lie at least a factor 2.5 apart and
people differ by far less, so measurements decide where there are any, and words where there are
none; a record with neither is taken as canonical.

Defined cases: null, NaN and all-zero readings are missing and stay null; a record whose unit is
unknown and which has no usable reading is left as it is; repeated rows are kept once where a
record is reported and as they are where values are converted; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.functions.points import available
from markerflow.session import checkpointed, first_by

METRE = "m"
#: Conversion edges: (from, to, factor, offset) with to = factor * from + offset.
LENGTH_EDGES = [
    ("mm", "cm", 0.1, 0.0),
    ("cm", "m", 0.01, 0.0),
    ("in", "cm", 2.54, 0.0),
    ("ft", "in", 12.0, 0.0),
    ("m", "mm", 1000.0, 0.0),
    ("ft", "m", 0.3048, 0.0),
]
#: How units are written.
SPELLINGS = {
    "mm": ["mm", "mm.", "milimeter", "millimeter", "millimeters", "millimetre", "millimetres", "milimeters"],
    "cm": ["cm", "cm.", "centimeter", "centimeters", "centimetre", "centimetres", "zentimeter"],
    "in": ["in", "in.", "inch", "inches", "zoll", '"'],
    "ft": ["ft", "ft.", "foot", "feet", "fuss", "fuß", "'"],
    "m": ["m", "m.", "meter", "meters", "metre", "metres", "mtr"],
}
#: Height above the floor of parts of a standing adult with the arms held out, in metres.
BODY_HEIGHTS = {
    "crown": 1.76, "brow": 1.66, "temple": 1.63, "nape": 1.56, "stern_up": 1.43, "stern_low": 1.29, "spine_up": 1.42,
    "spine_mid": 1.26, "navel": 1.12, "sacrum": 1.02, "shoulder": 1.43, "uparm": 1.41, "elbow": 1.37, "forearm": 1.35, "wrist": 1.34,
    "knuckle": 1.33, "rib": 1.21, "hip": 1.02, "thigh": 0.74, "knee": 0.51, "shin": 0.34, "calf": 0.36, "ankle": 0.10,
    "heel": 0.062, "toe": 0.043,
}
#: Parts below this height say little: the floor level and the sole weigh too much.
CLEAR_HEIGHT = 0.3
#: Letters with accents, of full width and of other alphabets, and the plain ones they stand for.
LOOKALIKES = (
    "äöüáéíóúàèòâêôаеорсукмнтвхі0134" + "".join(chr(0xFF41 + i) for i in range(26)) + "＿",
    "aouaeiouaeoaeoaeopcykmhtbxioiea" + "".join(chr(0x61 + i) for i in range(26)) + "_",
)
PELVIS_HEIGHT = 0.94
#: How far, as a factor, people and poses lie from these heights in most records.
BODY_SPREAD = math.log(1.25)
#: Evidence of a declared unit in units of half a squared spread.
DECLARED_WEIGHT = 1.5
#: Records whose conversions are broadcast: at about 40 bytes each, some 20 MB.
MAX_BROADCAST = 500_000
SALTS = 64


def compositions(edges: list[tuple[str, str, float, float]], target: str = METRE) -> dict[str, tuple[float, float]]:
    """`(factor, offset)` to `target` for every unit that reaches it, by the fewest conversions.

    Raises if two ways between the same units disagree: going round a cycle must change nothing.
    """
    near: dict[str, list[tuple[str, float, float]]] = {}
    for a, b, factor, offset in edges:
        if not factor:
            raise ValueError(f"{a} -> {b} cannot be inverted")
        near.setdefault(a, []).append((b, factor, offset))
        near.setdefault(b, []).append((a, 1 / factor, -offset / factor))
    # found[u] maps a value in the target unit back to u's own: searched outwards from the target.
    found, queue = {target: (1.0, 0.0)}, deque([target])
    while queue:
        unit = queue.popleft()
        f0, o0 = found[unit]
        for other, factor, offset in near.get(unit, []):
            if other not in found:
                # unit = (other - offset) / factor, and target = f0 * unit + o0.
                found[other] = (f0 / factor, o0 - f0 * offset / factor)
                queue.append(other)
    for a, b, factor, offset in edges:
        if a in found and b in found:
            fa, oa = found[a]
            fb, ob = found[b]
            if not (math.isclose(fa, fb * factor, rel_tol=1e-9) and math.isclose(oa, fb * offset + ob, rel_tol=1e-9, abs_tol=1e-9)):
                raise ValueError(f"conversions disagree on a cycle through {a} -> {b}")
    return found


def conversion_table(spark: SparkSession, edges=None, target: str = METRE) -> DataFrame:
    """`unit, target, factor, shift`: one row per unit; as small as the list of units."""
    rows = [(u, target, f, o) for u, (f, o) in sorted(compositions(edges or LENGTH_EDGES, target).items())]
    return spark.createDataFrame(rows, "unit string, target string, factor double, shift double")


def spelled_unit(text: Column) -> Column:
    """The unit that a whole text spells, else null."""
    plain = F.lower(F.trim(text))
    known = {s: u for u, spellings in SPELLINGS.items() for s in spellings}
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), plain)


def noted_unit(note: Column, about: str) -> Column:
    """The unit that a note gives for the quantity matching the pattern `about`.

    A note lists remarks between semicolons; only a remark that names the quantity counts, and in
    it the last word that spells a unit, so that lengths of other things don't.
    """
    remarks = F.filter(F.split(F.lower(note), ";"), lambda r: r.rlike(about) & ~r.rlike(r"\d\s*(mm|cm|m|in|ft)\b"))
    words = F.flatten(F.transform(remarks, lambda r: F.regexp_extract_all(F.regexp_replace(r, "z up", ""), F.lit(r"([a-zß]+\.?|[\"'])"), F.lit(1))))
    units = F.filter(F.transform(words, spelled_unit), lambda u: u.isNotNull())
    # "points in metres": the word "in" is a unit only where no other follows.
    clear = F.filter(units, lambda u: u != "in")
    return F.coalesce(F.get(F.reverse(clear), F.lit(0)), F.get(units, F.lit(0)))


def body_height(label: Column) -> Column:
    """The expected height of the body part that a hand-typed label names, null if unclear."""
    latin = F.translate(F.lower(F.element_at(F.split(label, ":"), -1)), *LOOKALIKES)
    plain = F.regexp_replace(latin, "[^a-z]+", "_")
    pick = F.lit(None).cast("double")
    for part, height in reversed(BODY_HEIGHTS.items()):
        pick = F.when(F.contains(plain, F.lit(part)), F.lit(height)).otherwise(pick)
    return pick


def true_units(records: DataFrame, edges=None, target: str = METRE) -> DataFrame:
    """`seq_id, unit, factor, shift` and further columns: the likeliest unit of each of `seq_id, log_scale, declared`, with its conversion to `target`.

    `log_scale` is the median log(reading / expected length in the target unit), null where nothing can be measured. Each record meets the
    conversions of the units that it may be in by an equi-join on unit and target; of equal fits the target unit counts, then the last by name.
    """
    may_be = F.array(*[F.lit(u) for u in sorted(compositions(edges or LENGTH_EDGES, target))])
    kept = [c for c in records.columns if c not in ("seq_id", "log_scale", "declared")]
    asked = records.select("seq_id", "log_scale", "declared", *kept, F.explode(may_be).alias("unit"), F.lit(target).alias("target"))
    # One row a unit: as small as the list of edges.
    met = asked.join(F.broadcast(conversion_table(records.sparkSession, edges, target)), ["unit", "target"])
    off = (F.col("log_scale") + F.log("factor")) / BODY_SPREAD
    fit = F.coalesce(-off * off / 2, F.lit(0.0)) + F.when(F.col("declared") == F.col("unit"), F.lit(DECLARED_WEIGHT)).otherwise(F.lit(0.0))
    rank = F.struct(fit.alias("fit"), (F.col("unit") == F.col("target")).alias("usual"), F.col("unit"))
    best = met.groupBy("seq_id").agg(F.max_by(F.struct("unit", "factor", "shift"), rank).alias("b"), *[F.max(c).alias(c) for c in kept])
    return best.select("seq_id", "b.unit", "b.factor", "b.shift", *kept)


def marker_units(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """`seq_id, unit, factor, shift, recorded, first_frame, last_frame` of the marker positions of every take; `recorded` tells
    whether it has points.

    Heights are folded to one median per marker before anything is joined, so a long take costs no more at the
    join than a short one.
    """
    height = F.when(available("x", "y", "z") & (F.col("z") > 0), F.col("z"))
    per_marker = points.where("seq_id is not null").groupBy("seq_id", "marker_idx").agg(
        F.percentile_approx(height, 0.5, 200).alias("z"), F.max(F.when(height.isNotNull(), F.col("label"))).alias("label"),
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
    )
    scaled = per_marker.withColumn("expected", body_height(F.col("label"))).withColumn("off", F.log(F.col("z") / F.col("expected")))
    per_take = scaled.groupBy("seq_id").agg(
        F.coalesce(
            F.median(F.when(F.col("expected") >= CLEAR_HEIGHT, F.col("off"))), F.max_by("off", F.when(F.col("off").isNotNull(), F.col("expected"))), F.log(F.max("z") / 1.4)
        ).alias("log_scale"),
        F.lit(True).alias("recorded"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
    )
    said = sessions.groupBy("seq_id").agg(F.max("unit").alias("unit_text"), F.max("note").alias("note"))
    declared = F.coalesce(spelled_unit(F.col("unit_text")), noted_unit(F.col("note"), r"marker|point|coordinate"))
    return true_units(per_take.join(said, "seq_id", "full").withColumn("declared", declared).drop("unit_text", "note"))


def translation_units(poses: DataFrame, samples: DataFrame) -> DataFrame:
    """`seq_id, unit, factor, shift, recorded` of the root translations of every sample."""
    z = F.get("trans", F.lit(2))
    per_take = poses.where("seq_id is not null").groupBy("seq_id").agg(
        F.log(F.percentile_approx(F.when(z > 0, z), 0.5, 200) / PELVIS_HEIGHT).alias("log_scale"), F.bool_or(F.col("trans").isNotNull()).alias("recorded")
    )
    said = samples.groupBy("seq_id").agg(F.max("trans_unit").alias("unit_text"), F.max("note").alias("note"))
    declared = F.coalesce(spelled_unit(F.col("unit_text")), noted_unit(F.col("note"), r"trans|root"))
    return true_units(per_take.join(said, "seq_id", "full").withColumn("declared", declared).drop("unit_text", "note"))


def latent_units(samples: DataFrame) -> DataFrame:
    """`seq_id, unit, factor, shift, recorded` of the latent markers of every sample."""
    rows = samples.where("seq_id is not null")
    marks = rows.select(
        "seq_id", F.explode_outer(F.arrays_zip(F.col("markers_latent").alias("xyz"), F.col("latent_labels").alias("label"))).alias("m")
    ).select("seq_id", F.get("m.xyz", F.lit(2)).alias("z"), F.col("m.label").alias("label"))
    heights = marks.groupBy("seq_id").agg(F.median(F.when(F.col("z") > 0, F.log(F.col("z") / body_height(F.col("label"))))).alias("log_scale"))
    said = rows.groupBy("seq_id").agg(
        F.max("latent_unit").alias("unit_text"), F.max("note").alias("note"), F.bool_or(F.coalesce(F.size("markers_latent") > 0, F.lit(False))).alias("recorded")
    )
    declared = F.coalesce(spelled_unit(F.col("unit_text")), noted_unit(F.col("note"), r"latent|lay-?out"))
    return true_units(heights.join(said, "seq_id").withColumn("declared", declared).drop("unit_text", "note"))


def record_units(points: DataFrame, sessions: DataFrame, poses: DataFrame, samples: DataFrame) -> DataFrame:
    """`field_name, seq_id, unit` of every record with a quantity."""
    parts = {"markers": marker_units(points, sessions), "trans": translation_units(poses, samples), "markers_latent": latent_units(samples)}
    rows = None
    for name, part in parts.items():
        part = part.where("recorded").select(F.lit(name).alias("field_name"), "seq_id", "unit")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def foreign_units(points: DataFrame, sessions: DataFrame, poses: DataFrame, samples: DataFrame) -> DataFrame:
    """The records of `record_units` that are not in metres."""
    return record_units(points, sessions, poses, samples).where(F.col("unit") != METRE)


def convert(df: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with its `columns` (numbers, arrays or arrays of arrays of them) in metres; `units` has one row `seq_id, unit` per record.

    The conversions of the records are broadcast if they are at most MAX_BROADCAST; else rows meet them by record and salt, so
    that a record with a large part of the rows is many tasks' work.
    """
    if "factor" not in units.columns:
        units = units.join(F.broadcast(conversion_table(df.sparkSession)), "unit", "left")
    table = checkpointed(units.select("seq_id", F.col("factor").alias("_factor"), F.col("shift").alias("_shift")).where("seq_id is not null and _factor is not null"))
    if table.count() <= MAX_BROADCAST:
        met = df.join(F.broadcast(table), "seq_id", "left")
    else:
        salts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != "seq_id"]), F.lit(SALTS)).cast("int")).join(salts, ["seq_id", "_salt"], "left").drop("_salt")
    factor, shift = F.coalesce("_factor", F.lit(1.0)), F.coalesce("_shift", F.lit(0.0))

    def one(kind: str, value: Column) -> Column:
        if kind.startswith("array<"):
            return F.transform(value, lambda x: one(kind[6:-1], x))
        return value * factor + shift

    kinds = dict(df.dtypes)
    changed = {c: one(kinds[c], F.col(c)) for c in columns}
    return met.withColumns(changed).drop("_factor", "_shift")


def points_in_metres(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every reading once, in metres; missing readings are null on all axes."""
    ok = available("x", "y", "z")
    once = first_by(points, ["seq_id", "frame", "marker_idx"]).select("seq_id", "frame", "marker_idx", "label", *[F.when(ok, F.col(c)).alias(c) for c in "xyz"])
    return convert(once, marker_units(points, sessions), ["x", "y", "z"])
