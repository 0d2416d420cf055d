"""Column expressions of plane and space geometry; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column, size: float, origin: float | Column = 0.0) -> Column:
    """Index of the half-open cell that holds value, as a long."""
    return F.floor((value - origin) / F.lit(float(size))).cast("long")


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(value, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def triangle_area(a: tuple[Column, ...], b: tuple[Column, ...], c: tuple[Column, ...]) -> Column:
    return norm(cross(minus(b, a), minus(c, a))) / 2


def slope_degrees(nz: Column) -> Column:
    """Angle of a surface to the horizontal, from the z component of its unit normal."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(nz))))


def plane_frame(n: tuple[Column, Column, Column]) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """(u, v): u is horizontal and v points up the plane; where the plane is level, u is the x axis' projection."""
    level = F.abs(n[2]) > 0.95
    ux, uy, uz = F.when(level, 1 - n[0] * n[0]).otherwise(-n[1]), F.when(level, -n[0] * n[1]).otherwise(n[0]), F.when(level, -n[0] * n[2]).otherwise(F.lit(0.0))
    length = norm((ux, uy, uz))
    u = (ux / length, uy / length, uz / length)
    return u, cross(n, u)


def with_eigenvalues(rows: DataFrame, names: tuple[str, ...] = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")) -> DataFrame:
    """rows with l0, l1, l2: eigenvalues of a symmetric 3x3 matrix, largest first and none below 0.

    Trigonometric closed form, in steps that are columns: each is used several times, so the
    optimizer keeps them apart and the generated code stays small.
    """
    xx, xy, xz, yy, yz, zz = (F.col(n) for n in names)
    q, p = F.col("_q"), F.col("_p")
    rows = rows.withColumn("_q", (xx + yy + zz) / 3)
    rows = rows.withColumns({"_a": xx - q, "_b": yy - q, "_c": zz - q, "_o": xy * xy + xz * xz + yz * yz})
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    rows = rows.withColumns({"_p": F.sqrt((a * a + b * b + c * c + 2 * F.col("_o")) / 6), "_d": a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)})
    rows = rows.withColumn("_t", F.acos(F.when(p > 0, clamp(F.col("_d") / (2 * p * p * p), -1.0, 1.0)).otherwise(F.lit(1.0))) / 3)
    rows = rows.withColumns({"_f": q + 2 * p * F.cos("_t"), "_l": q + 2 * p * F.cos(F.col("_t") + F.lit(2.0943951023931953))})
    out = rows.withColumns({"l0": F.greatest(F.col("_f"), F.lit(0.0)), "l1": F.greatest(3 * q - F.col("_f") - F.col("_l"), F.lit(0.0)), "l2": F.greatest(F.col("_l"), F.lit(0.0))})
    return out.drop("_q", "_a", "_b", "_c", "_o", "_p", "_d", "_t", "_f", "_l")


def shape_measures(l0: Column, l1: Column, l2: Column, eps: float = 1e-12) -> dict[str, Column]:
    """Eigenvalue shape measures (Weinmann et al.): how line-, plane- and ball-like a neighbourhood is."""
    d = F.greatest(l0, F.lit(eps))
    return {
        "linearity": (l0 - l1) / d,
        "planarity": (l1 - l2) / d,
        "sphericity": l2 / d,
        "anisotropy": (l0 - l2) / d,
        "curvature": l2 / F.greatest(l0 + l1 + l2, F.lit(eps)),
    }


def box_iou(a: dict[str, Column], b: dict[str, Column], axes: str = "xyz") -> Column:
    """Overlap of two axis-aligned boxes over their union; boxes have min and max for each axis."""
    shared, va, vb = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for k in axes:
        lo, hi = f"min{k}", f"max{k}"
        shared = shared * F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
        va, vb = va * (a[hi] - a[lo]), vb * (b[hi] - b[lo])
    union = va + vb - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def barycentric(p: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """Weights of a, b, c at p; null for a degenerate triangle."""
    d = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    d = F.when(F.abs(d) > 1e-12, d)
    wa = ((b[1] - c[1]) * (p[0] - c[0]) + (c[0] - b[0]) * (p[1] - c[1])) / d
    wb = ((c[1] - a[1]) * (p[0] - c[0]) + (a[0] - c[0]) * (p[1] - c[1])) / d
    return wa, wb, 1 - wa - wb
