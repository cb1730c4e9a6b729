"""Numeric kernels over groups of bounded size: optimal transport, rigid alignment, mixture priors, attachments.

Each group is a frame or a sequence's few statistics; Spark groups, numpy solves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_FRAMES = 64


def log_sum_exp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def transport(scores: np.ndarray, dustbin: float, rounds: int = 35) -> np.ndarray:
    """Log assignment of rows to columns with a dustbin for each side, by entropic optimal transport in log space.

    `scores` is one matrix or a stack of equally large ones."""
    m, n = scores.shape[-2:]
    wide = np.full((*scores.shape[:-2], m + 1, n + 1), dustbin)
    wide[..., :m, :n] = scores
    norm = -np.log(m + n)
    rows = np.append(np.full(m, norm), np.log(n) + norm)
    columns = np.append(np.full(n, norm), np.log(m) + norm)
    u, v = np.zeros(wide.shape[:-1]), np.zeros((*wide.shape[:-2], n + 1))
    for _ in range(rounds):
        u = rows - log_sum_exp(wide + v[..., None, :], -1)
        v = columns - log_sum_exp(wide + u[..., :, None], -2)
    return wide + u[..., :, None] + v[..., None, :] - norm


def transported(left: DataFrame, right: DataFrame, dustbin: float = -5.0, rounds: int = 35) -> DataFrame:
    """`seq_id, frame, left_idx, right_idx, log_p`: the likeliest partner on the right of each left point of a frame, -1 for none.

    Both sides have `seq_id, frame, idx, x, y, z` and may differ in number; a frame without a right side has no partners. A group is `GROUP_FRAMES` frames."""

    def frames(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = rows.sort_by([("frame", "ascending"), ("idx", "ascending")])
        frame, idx = rows.column("frame").to_numpy(), rows.column("idx").to_numpy()
        at = np.column_stack([rows.column(c).to_numpy() for c in "xyz"])
        starts = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)) if len(frame) else []
        return {int(frame[i]): (idx[i:j], at[i:j]) for i, j in zip(starts, [*starts[1:], len(frame)])}

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        lefts, rights, out = frames(a), frames(b), []
        alike: dict[tuple[int, int], list[int]] = {}
        for f, (idx, _) in lefts.items():
            alike.setdefault((len(idx), len(rights[f][0]) if f in rights else 0), []).append(f)
        for (m, n), same in alike.items():
            own = np.stack([lefts[f][0] for f in same])
            if not n:
                best, weight = np.full((len(same), m), -1), np.zeros((len(same), m))
            else:
                p, q = np.stack([lefts[f][1] for f in same]), np.stack([rights[f][1] for f in same])
                off = np.sqrt(((p[:, :, None] - q[:, None]) ** 2).sum(axis=3))
                scale = np.median(np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=2)), axis=1)
                log_p = transport(-20.0 * off / np.where(scale > 0, scale, 1.0)[:, None, None], dustbin, rounds)[:, :-1]
                at = log_p.argmax(axis=2)
                named = np.concatenate([np.stack([rights[f][0] for f in same]), np.full((len(same), 1), -1)], axis=1)
                best, weight = np.take_along_axis(named, at, axis=1), np.take_along_axis(log_p, at[..., None], axis=2)[..., 0]
            out.append((np.repeat(same, m), own.ravel(), best.ravel(), np.round(weight.ravel(), 5)))
        frame, own, best, weight = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [], [])
        columns = [[key[0].as_py()] * len(frame), frame, own, best, weight]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["seq_id", "frame", "left_idx", "right_idx", "log_p"])

    # Few bytes but much arithmetic a group: a set number of partitions is not gathered into fewer.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Columns are named anew, for both sides may come from one table.
    sides = [df.select(*[F.col(c).alias(c) for c in ("seq_id", "frame", "idx", "x", "y", "z")], F.floor(F.col("frame") / GROUP_FRAMES).alias("block")).repartition(tasks, "seq_id", "block").groupBy("seq_id", "block") for df in (left, right)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, "seq_id string, frame int, left_idx int, right_idx int, log_p double")


def rigid_fit(covariance: np.ndarray, mean_a: np.ndarray, mean_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotations and translations that bring a to b best, from covariances of a with b; reflections are turned back. One matrix or a stack."""
    u, _, vt = np.linalg.svd(covariance)
    v, ut = np.swapaxes(vt, -1, -2), np.swapaxes(u, -1, -2)
    sign = np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)
    fix = np.ones(v.shape[:-1])
    fix[..., 2] = sign
    rotation = (v * fix[..., None, :]) @ ut
    return rotation, mean_b - np.einsum("...ij,...j->...i", rotation, mean_a)


def rotation_vector(rotation: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.clip((np.trace(rotation) - 1) / 2, -1, 1))
    if angle < 1e-9:
        return np.zeros(3)
    axis = np.array([rotation[2, 1] - rotation[1, 2], rotation[0, 2] - rotation[2, 0], rotation[1, 0] - rotation[0, 1]])
    size = np.linalg.norm(axis)
    if size < 1e-9:  # half a turn: the axis is in the symmetric part
        axis = np.linalg.eigh((rotation + np.eye(3)) / 2)[1][:, -1]
        size = 1.0
    return axis / size * angle


def rigid_alignments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, n, rx, ry, rz, tx, ty, tz, error`: the motion that brings points a to b of every group.

    `pairs` has ax..az and bx..bz; rows with a null on a side do not count. Sums are aggregated by Spark, whatever
    the size of a group; only the 3x3 decomposition of each group is done in numpy.
    """
    axes = "xyz"
    whole = pairs.dropna(subset=[f"{s}{c}" for s in "ab" for c in axes])
    sums = whole.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.avg(f"{s}{c}").alias(f"m{s}{c}") for s in "ab" for c in axes],
        *[F.covar_pop(f"a{c}", f"b{d}").alias(f"c{c}{d}") for c in axes for d in axes],
        *[F.var_pop(f"{s}{c}").alias(f"v{s}{c}") for s in "ab" for c in axes],
    )
    schema = sums.select(*keys, "n").schema
    for name in ("rx", "ry", "rz", "tx", "ty", "tz", "error"):
        schema = schema.add(name, "double")

    def run(batches):
        for rows in batches:
            cov = np.stack([rows[f"c{c}{d}"].to_numpy(float) for c in axes for d in axes], axis=1).reshape(-1, 3, 3)
            mean_a, mean_b = (np.stack([rows[f"m{s}{c}"].to_numpy(float) for c in axes], axis=1) for s in "ab")
            rotation, shift = rigid_fit(cov, mean_a, mean_b)
            spread = sum(rows[f"v{s}{c}"].to_numpy(float) for s in "ab" for c in axes)
            error = np.sqrt(np.maximum(spread - 2 * np.trace(rotation @ cov, axis1=1, axis2=2), 0.0))
            turn = np.array([rotation_vector(r) for r in rotation]).reshape(-1, 3)
            figures = dict(zip(("rx", "ry", "rz", "tx", "ty", "tz", "error"), [*turn.T, *shift.T, error]))
            yield pd.DataFrame({**{k: rows[k] for k in (*keys, "n")}, **figures}, columns=schema.names)

    return sums.mapInPandas(run, schema)


def mixture_residuals(vectors: DataFrame, means: np.ndarray, precisions: np.ndarray, weights: np.ndarray) -> DataFrame:
    """`seq_id, frame, component, cost`: the cheapest component of a Gaussian mixture and half its squared distance less the log of its weight."""
    chol = np.stack([np.linalg.cholesky(p) for p in precisions])
    const = -np.log(weights) + 0.5 * np.array([-2 * np.log(np.diag(c)).sum() for c in chol])

    def run(batches):
        for rows in batches:
            x = np.stack(rows["vec"].to_list()).astype(float) if len(rows) else np.zeros((0, means.shape[1]))
            off = x[:, None, :] - means[None]
            cost = 0.5 * (np.einsum("nkd,kde->nke", off, chol) ** 2).sum(axis=2) + const[None]
            best = cost.argmin(axis=1)
            yield pd.DataFrame({"seq_id": rows["seq_id"], "frame": rows["frame"], "component": best, "cost": cost[np.arange(len(rows)), best]})

    return vectors.select("seq_id", "frame", "vec").mapInPandas(run, "seq_id string, frame int, component int, cost double")


def attachment(marker: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Coefficients of a marker in the frame of three corners: along the first edge, along what is left of the second, along their normal."""
    return np.linalg.solve(_basis(corners).T, marker - corners[0])


def attached(coefficients: np.ndarray, corners: np.ndarray) -> np.ndarray:
    return corners[0] + coefficients @ _basis(corners)


def _basis(corners: np.ndarray) -> np.ndarray:
    first = corners[1] - corners[0]
    first = first / max(np.linalg.norm(first), 1e-12)
    second = corners[2] - corners[0]
    normal = np.cross(first, second)
    normal = normal / max(np.linalg.norm(normal), 1e-12)
    return np.stack([first, np.cross(normal, first), normal])


def closest_on_triangles(point: np.ndarray, triangles: np.ndarray) -> tuple[int, np.ndarray, float]:
    """The nearest triangle, the nearest place on it and the distance; triangles of shape (n, 3, 3)."""
    a, b, c = triangles[:, 0], triangles[:, 1], triangles[:, 2]
    ab, ac, ap = b - a, c - a, point - a
    d00, d01, d11 = (ab * ab).sum(1), (ab * ac).sum(1), (ac * ac).sum(1)
    d20, d21 = (ap * ab).sum(1), (ap * ac).sum(1)
    den = np.maximum(d00 * d11 - d01 * d01, 1e-30)
    v, w = (d11 * d20 - d01 * d21) / den, (d00 * d21 - d01 * d20) / den
    inside = (v >= 0) & (w >= 0) & (v + w <= 1)
    places = [np.where(inside[:, None], a + v[:, None] * ab + w[:, None] * ac, np.inf)]
    for p, q in ((a, b), (a, c), (b, c)):
        along = q - p
        t = np.clip(((point - p) * along).sum(1) / np.maximum((along * along).sum(1), 1e-30), 0, 1)
        places.append(p + t[:, None] * along)
    all_places = np.stack(places)
    far = np.sqrt(((np.where(np.isinf(all_places), 1e30, all_places) - point) ** 2).sum(axis=2))
    side, face = np.unravel_index(far.argmin(), far.shape)
    return int(face), all_places[side, face], float(far[side, face])


def surface_distances(points: DataFrame, faces: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """`seq_id, frame, point_id, face, distance` from rows of `seq_id, frame, point_id, xyz, vertices`: each row holds its frame's mesh.

    Without `faces` a mesh is a closed strip of triangles over its vertices."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                corners = np.asarray(r.vertices, float).reshape(-1, 3)
                at = np.arange(len(corners))[:, None] + np.arange(3)
                index = at % len(corners) if faces is None else np.asarray(faces)
                face, _, far = closest_on_triangles(np.asarray(r.xyz, float), corners[index])
                out.append((r.seq_id, r.frame, r.point_id, face, far))
            yield pd.DataFrame(out, columns=["seq_id", "frame", "point_id", "face", "distance"])

    return points.select("seq_id", "frame", "point_id", "xyz", "vertices").mapInPandas(run, "seq_id string, frame int, point_id int, face int, distance double")


def attachments(markers: DataFrame) -> DataFrame:
    """`seq_id, label, v0, v1, v2, c0, c1, c2`: the three nearest vertices of each marker that lie on no line, and its coefficients in their frame, from rows of `seq_id, label, xyz,
    vertices`; markers of meshes without such vertices have no row."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                corners, at = np.asarray(r.vertices, float).reshape(-1, 3), np.asarray(r.xyz, float)
                order = np.argsort(((corners - at) ** 2).sum(axis=1), kind="stable")
                if len(order) < 3:
                    continue
                first = corners[order[1]] - corners[order[0]]
                apart = np.linalg.norm(np.cross(first, corners[order[2:]] - corners[order[0]]), axis=1)
                fit = np.flatnonzero(apart > 1e-9)
                if len(fit):
                    three = [int(order[0]), int(order[1]), int(order[2 + fit[0]])]
                    out.append((r.seq_id, r.label, *three, *map(float, attachment(at, corners[three]))))
            yield pd.DataFrame(out, columns=["seq_id", "label", "v0", "v1", "v2", "c0", "c1", "c2"])

    return markers.select("seq_id", "label", "xyz", "vertices").mapInPandas(run, "seq_id string, label string, v0 int, v1 int, v2 int, c0 double, c1 double, c2 double")


def decoded_markers(attached_to: DataFrame, frames: DataFrame) -> DataFrame:
    """`seq_id, frame, label, x, y, z`: where the attached markers are on every frame's vertices."""
    from markerflow.operators.geometry import unit_vector

    at = lambda v: [F.get("vertices", F.col(v) * 3 + k).cast("double") for k in range(3)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    base, one, two = at("v0"), at("v1"), at("v2")
    first = unit_vector([b - a for a, b in zip(base, one)])
    normal = unit_vector(cross(first, [b - a for a, b in zip(base, two)]))
    second = cross(normal, first)
    place = [b + F.col("c0") * u + F.col("c1") * v + F.col("c2") * w for b, u, v, w in zip(base, first, second, normal)]
    return frames.select("seq_id", "frame", "vertices").join(attached_to, "seq_id").select("seq_id", "frame", "label", *[p.alias(c) for p, c in zip(place, "xyz")])
