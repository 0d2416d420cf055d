"""Triangle operators over (tri, ax, ay, az, bx, ..., cz), and rings turned to triangles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def corners() -> tuple[tuple, tuple, tuple]:
    return tuple(tuple(F.col(f"{p}{c}") for c in "xyz") for p in "abc")


def areas(tris: DataFrame) -> DataFrame:
    return tris.withColumn("area", g.triangle_area(*corners()))


def normals(tris: DataFrame) -> DataFrame:
    """tris with their unit normal, up where it is level either way; 0 for degenerate ones."""
    a, b, c = corners()
    n = g.cross(g.minus(b, a), g.minus(c, a))
    t = tris.withColumns({f"_{k}": e for k, e in zip("xyz", n, strict=True)}).withColumn("_l", g.norm((F.col("_x"), F.col("_y"), F.col("_z"))))
    return t.withColumns({f"n{k}": F.when(F.col("_l") > 0, F.col(f"_{k}") / F.col("_l")).otherwise(F.lit(0.0)) for k in "xyz"}).drop("_x", "_y", "_z", "_l")


def crop(tris: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Triangles whose centroid lies in the half-open box, so each is in one box of a grid."""
    cx, cy = (F.col("ax") + F.col("bx") + F.col("cx")) / 3, (F.col("ay") + F.col("by") + F.col("cy")) / 3
    return tris.where((cx >= low[0]) & (cx < high[0]) & (cy >= low[1]) & (cy < high[1]))


def without_webbing(tris: DataFrame, most: float = 5.0) -> DataFrame:
    """Triangles of at most an area: reconstructed meshes span gaps by very large ones."""
    return areas(tris).where(F.col("area") <= most).drop("area")


def webbing_report(tris: DataFrame, most: float = 5.0) -> DataFrame:
    t = areas(tris)
    big = F.col("area") > most
    return t.agg(F.count(F.lit(1)).alias("triangles"), F.sum(big.cast("long")).alias("dropped"), F.coalesce(F.sum(F.when(big, F.col("area"))), F.lit(0.0)).alias("dropped_area"), F.max("area").alias("largest"))


def merge(meshes: DataFrame, counts: DataFrame) -> DataFrame:
    """Faces (chunk, a, b, c) re-indexed into one vertex list: each chunk's numbers go up by the vertices before it."""
    w = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("vertices").over(w), F.lit(0))).select("chunk", "base")  # one row a chunk
    return meshes.join(base, "chunk").select("chunk", *[(F.col(k) + F.col("base")).alias(k) for k in "abc"])


def pick(tris: DataFrame, rays: DataFrame) -> DataFrame:
    """(ray, tri, t): the first triangle that each ray (ray, ox, oy, oz, dx, dy, dz) meets (Moeller-Trumbore).

    rays are few; all triangles are asked in one pass.
    """
    a, b, c = corners()
    d, o = tuple(F.col(f"d{k}") for k in "xyz"), tuple(F.col(f"o{k}") for k in "xyz")
    e1, e2 = g.minus(b, a), g.minus(c, a)
    p = g.cross(d, e2)
    det = g.dot(e1, p)
    inv = F.when(F.abs(det) > 1e-12, 1 / F.when(F.abs(det) > 1e-12, det))
    s = g.minus(o, a)
    u = g.dot(s, p) * inv
    q = g.cross(s, e1)
    w, t = g.dot(d, q) * inv, g.dot(e2, q) * inv
    hit = tris.crossJoin(rays).select("ray", "tri", t.alias("t"), u.alias("u"), w.alias("w")).where("u >= 0 AND w >= 0 AND u + w <= 1 AND t > 1e-9")
    return hit.groupBy("ray").agg(F.min(F.struct("t", "tri")).alias("b")).select("ray", F.col("b.tri").alias("tri"), F.col("b.t").alias("t"))


def ear_clip(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (vertex numbers) of a simple polygon in the plane, by cutting ears; none for degenerate rings."""
    n = len(ring)
    if n > 1 and np.allclose(ring[0], ring[-1]):
        n -= 1
    p = np.asarray(ring[:n], float)
    if n < 3:
        return []
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    area = sum(p[i][0] * p[(i + 1) % n][1] - p[(i + 1) % n][0] * p[i][1] for i in range(n))
    if abs(area) < 1e-12:
        return []
    left = list(range(n)) if area > 0 else list(range(n))[::-1]
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            if turn(p[i], p[j], p[m]) <= 1e-12:
                continue
            inside = any(q not in (i, j, m) and turn(p[i], p[j], p[q]) >= -1e-12 and turn(p[j], p[m], p[q]) >= -1e-12 and turn(p[m], p[i], p[q]) >= -1e-12 and not any(np.allclose(p[q], p[x]) for x in (i, j, m)) for q in left)
            if not inside:
                out.append((i, j, m))
                del left[k]
                break
        else:  # flat corners are left, or the ring crosses itself
            flat = next((k for k in range(len(left)) if abs(turn(p[left[k - 1]], p[left[k]], p[left[(k + 1) % len(left)]])) <= 1e-12), None)
            if flat is None:
                return out
            del left[flat]
    return [*out, tuple(left)] if abs(turn(*[p[i] for i in left])) > 1e-12 else out


def triangulate(rings: DataFrame) -> DataFrame:
    """(ring_id, n, ax, ay, bx, by, cx, cy) of rings (ring_id, ord, px, py): each ring is one small group."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        p = rows[["px", "py"]].to_numpy()
        out = [(rows["ring_id"].iloc[0], n, *p[a], *p[b], *p[c]) for n, (a, b, c) in enumerate(ear_clip(p))]
        return pd.DataFrame(out, columns=["ring_id", "n", "ax", "ay", "bx", "by", "cx", "cy"])

    return rings.groupBy("ring_id").applyInPandas(cut, "ring_id long, n int, ax double, ay double, bx double, by double, cx double, cy double")


def simplify_line(p: np.ndarray, tolerance: float) -> list[int]:
    """Vertices kept by Ramer-Douglas-Peucker."""
    keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        length = np.hypot(*d)
        off = p[a + 1 : b] - p[a]
        dist = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / length if length > 0 else np.hypot(*off.T)
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def simplify(rings: DataFrame, tolerance: float) -> DataFrame:
    """Rings without the vertices that lie within a tolerance of what is left."""

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", ignore_index=True)
        return rows.iloc[simplify_line(rows[["px", "py"]].to_numpy(), tolerance)] if len(rows) > 2 else rows

    return rings.select("ring_id", "ord", "px", "py").groupBy("ring_id").applyInPandas(thin, "ring_id long, ord int, px double, py double")
