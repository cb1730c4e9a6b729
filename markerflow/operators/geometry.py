"""Geometry of points, vertices and meshes as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MAX_FACES = 1_000_000


def lower_median(value: str | Column) -> Column:
    """The lower of the two middle values of an even number."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})") if isinstance(value, str) else F.percentile_approx(value, 0.5, 1_000_000)


def frame_offsets(points: DataFrame) -> DataFrame:
    """`seq_id, frame, ox, oy, oz`: the lower median of each axis over the points of a frame that are not all 0; 0 where there are none."""
    there = (F.col("x") != 0) | (F.col("y") != 0) | (F.col("z") != 0)
    masked = points.withColumns({c: F.when(there & ~F.isnan(c), F.col(c)) for c in "xyz"})
    return masked.groupBy("seq_id", "frame").agg(*[F.coalesce(lower_median(c), F.lit(0.0)).alias(f"o{c}") for c in "xyz"])


def centred(points: DataFrame) -> DataFrame:
    """Points less the offset of their frame."""
    moved = points.join(frame_offsets(points), ["seq_id", "frame"])
    return moved.withColumns({c: F.col(c) - F.col(f"o{c}") for c in "xyz"}).drop("ox", "oy", "oz")


def euler_rotation(x: Column, y: Column, z: Column, degrees: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """A point turned about x, then y, then z, in degrees."""
    import math

    a, b, c = (math.radians(d) for d in degrees)
    y, z = y * math.cos(a) - z * math.sin(a), y * math.sin(a) + z * math.cos(a)
    x, z = x * math.cos(b) + z * math.sin(b), z * math.cos(b) - x * math.sin(b)
    return x * math.cos(c) - y * math.sin(c), x * math.sin(c) + y * math.cos(c), z


def axis_angle_rotation(p: list[Column], r: list[Column]) -> list[Column]:
    """A vector turned by a rotation vector; next to no angle turns nothing."""
    angle = F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2])
    safe = F.greatest(angle, F.lit(1e-12))
    k = [c / safe for c in r]
    cross = [k[1] * p[2] - k[2] * p[1], k[2] * p[0] - k[0] * p[2], k[0] * p[1] - k[1] * p[0]]
    dot = k[0] * p[0] + k[1] * p[1] + k[2] * p[2]
    return [
        F.when(angle < 1e-8, p[i]).otherwise(p[i] * F.cos(angle) + cross[i] * F.sin(angle) + k[i] * dot * (1 - F.cos(angle))) for i in range(3)
    ]


def unit_vector(v: list[Column]) -> list[Column]:
    length = F.greatest(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]), F.lit(1e-12))
    return [c / length for c in v]


def nearest(queries: DataFrame, points: DataFrame, k: int, by: list[str]) -> DataFrame:
    """`by, query_id, point_id, rank, distance`: the k nearest points of each query within its group.

    `queries` and `points` hold an id and `xyz array<double>`. The points of a group, a mesh or a
    layout of bounded size, are one array row; each query meets it by an equi-join on the group and keeps its k best
    inside the row, so distances are never shuffled.
    """
    listed = points.groupBy(*by).agg(F.collect_list(F.struct(F.col("point_id"), F.col("xyz"))).alias("_pts"))

    def measured(p: Column) -> Column:
        squares = F.zip_with(p.getField("xyz"), F.col("_q"), lambda a, b: (a - b) * (a - b))
        return F.struct(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("distance"), p.getField("point_id").alias("point_id"))

    met = queries.select(*by, "query_id", F.col("xyz").alias("_q")).join(listed, by)
    best = met.withColumn("_best", F.slice(F.array_sort(F.transform("_pts", measured)), 1, k))
    return best.select(*by, "query_id", F.posexplode("_best").alias("rank", "b")).select(*by, "query_id", F.col("b.point_id"), "rank", F.col("b.distance"))


def strip_faces(meshes: DataFrame) -> DataFrame:
    """`seq_id, face, v0, v1, v2`: a closed strip of triangles over the vertices of each of `seq_id, n_vertices`; meshes of fewer than three have none."""
    rows = meshes.where("n_vertices >= 3").select("seq_id", "n_vertices", F.explode(F.sequence(F.lit(0), F.col("n_vertices") - 1)).alias("face"))
    return rows.select("seq_id", "face", *[((F.col("face") + k) % F.col("n_vertices")).cast("int").alias(f"v{k}") for k in range(3)])


def mesh_rings(faces: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """`seq_id, seed, vid`: vertices within n edges of each of `seq_id, vid`, itself included, on each mesh by itself; one join a ring."""
    pairs = F.array(*[F.struct(F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b")) for i in range(3) for j in range(3) if i != j])
    edges = faces.select("seq_id", F.explode(pairs).alias("e")).select("seq_id", F.col("e.a").alias("vid"), F.col("e.b").alias("_to")).distinct()
    found = seeds.select("seq_id", F.col("vid").alias("seed"), "vid").distinct()
    for _ in range(n):
        found = found.unionByName(found.join(edges, ["seq_id", "vid"]).select("seq_id", "seed", F.col("_to").alias("vid"))).distinct()
    return found


def composed_rotation(r: list[Column], fixed: tuple[float, float, float]) -> list[Column]:
    """The rotation vector of turning by `r` and then by the fixed rotation vector, through unit quaternions; at most half a turn."""
    import math

    size = math.sqrt(sum(v * v for v in fixed))
    a = math.cos(size / 2)
    b = [v / size * math.sin(size / 2) if size else 0.0 for v in fixed]
    angle = F.sqrt(r[0] * r[0] + r[1] * r[1] + r[2] * r[2])
    half = F.when(angle < 1e-12, F.lit(0.5)).otherwise(F.sin(angle / 2) / F.greatest(angle, F.lit(1e-12)))
    c, d = F.cos(angle / 2), [x * half for x in r]
    w = a * c - b[0] * d[0] - b[1] * d[1] - b[2] * d[2]
    v = [a * d[i] + b[i] * c + b[(i + 1) % 3] * d[(i + 2) % 3] - b[(i + 2) % 3] * d[(i + 1) % 3] for i in range(3)]
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    scale = F.when(length < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(length, w * sign) / F.greatest(length, F.lit(1e-12)))
    return [x * sign * scale for x in v]


def encoded(vec: Column, components: list[list[float]]) -> Column:
    """The weights of a vector on orthonormal components: one product each."""
    products = [F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in components]
    return F.array(*products)


def decoded(weights: Column, components: list[list[float]]) -> Column:
    """The vector that weights on components stand for."""
    out = None
    for k, c in enumerate(components):
        part = F.transform(F.array(*[F.lit(float(x)) for x in c]), lambda x, k=k: x * F.get(weights, F.lit(k)))
        out = part if out is None else F.zip_with(out, part, lambda a, b: a + b)
    return out


def vertex_normals(corners: DataFrame, faces: DataFrame) -> DataFrame:
    """`seq_id, frame, vid, nx, ny, nz`: the unit sum of the normals of all faces of a vertex.

    `corners` has `seq_id, frame, vertices`, flat; `faces` is a dimension of a checked size.
    """
    if faces.count() > MAX_FACES:
        raise ValueError(f"more than {MAX_FACES} faces")
    at = lambda v, k: F.get("vertices", F.col(v) * 3 + k).cast("double")
    met = corners.join(F.broadcast(faces))
    u = [at("v1", k) - at("v0", k) for k in range(3)]
    w = [at("v2", k) - at("v0", k) for k in range(3)]
    normal = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    rows = met.select("seq_id", "frame", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[n.alias(c) for n, c in zip(normal, ("nx", "ny", "nz"))])
    sums = rows.groupBy("seq_id", "frame", "vid").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz")])
    out = unit_vector([F.col(c) for c in ("nx", "ny", "nz")])
    return sums.select("seq_id", "frame", "vid", *[o.alias(c) for o, c in zip(out, ("nx", "ny", "nz"))])


def robust_loss(kind: str, x: Column, scale: float) -> Column:
    """The named robust function of a residual."""
    if kind == "geman_mcclure":
        return x * x * scale * scale / (scale * scale + x * x)
    if kind == "signed_sqrt":
        return F.signum(x) * F.sqrt(F.abs(x))
    if kind == "sigmoid":
        return 1 / (1 + F.exp(-x / scale)) - 0.5
    raise ValueError(f"no robust function is named {kind}")


def descendants(parents: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """`root, child` of a tree `child, parent`: all below each root, down to `depth` levels."""
    front = roots.select(F.col("child").alias("root"), "child")
    found = None
    for _ in range(depth):
        front = front.join(parents.select(F.col("child").alias("_c"), "parent"), F.col("child") == F.col("parent")).select("root", F.col("_c").alias("child"))
        found = front if found is None else found.unionByName(front)
    return found.distinct()


def area_shares(faces: DataFrame) -> DataFrame:
    """`seq_id, face, area, upto`: each face's area and the running share of the whole, for drawing surface points by a number in [0, 1)."""
    order = Window.partitionBy("seq_id").orderBy("face")
    whole = Window.partitionBy("seq_id")
    return faces.withColumn("upto", F.sum("area").over(order) / F.sum("area").over(whole))
