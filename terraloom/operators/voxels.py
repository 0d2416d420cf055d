"""Voxel operators: a voxel is a group of points by their three cell indices; its moments merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.storage import written

IJK = ["i", "j", "k"]
MOMENTS = ["n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
SCALES = (0.5, 1.5, 4.0)
DESCRIPTORS = ["linearity", "planarity", "sphericity", "curvature", "verticality", "density", "boundary", "surface_score", "crease_score", "corner_score"]


def assign(points: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """points with the indices i, j, k of their voxel."""
    return points.withColumns({n: g.cell(F.col(c), size, o) for n, c, o in zip(IJK, "xyz", origin, strict=True)})


def from_minimum(points: DataFrame, size: float) -> DataFrame:
    """points with voxel indices counted from one cell below the smallest coordinates (a one-row aggregate)."""
    low = points.agg(*[(F.min(c) - size).alias(f"o{c}") for c in "xyz"])
    met = points.crossJoin(F.broadcast(low))  # one row
    return met.withColumns({n: g.cell(F.col(c), size, F.col(f"o{c}")) for n, c in zip(IJK, "xyz", strict=True)}).drop("ox", "oy", "oz")


def counts(points: DataFrame, size: float) -> DataFrame:
    return assign(points, size).groupBy(*IJK).agg(F.count(F.lit(1)).alias("n"))


def moments(points: DataFrame, size: float) -> DataFrame:
    """Count, sums and sums of products of each voxel; partial sums merge before the shuffle."""
    s = {"sx": "x", "sy": "y", "sz": "z"}
    pairs = {f"s{a}{b}": F.col(a) * F.col(b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return assign(points, size).groupBy(*IJK).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in s.items()], *[F.sum(c).alias(n) for n, c in pairs.items()])


def covariance(m: DataFrame, least: int = 4, floor: float = 1e-9, keys: list[str] = IJK) -> DataFrame:
    """Mean and covariance from moments of voxels, or of what other keys name; those of under `least` points get floor times the identity."""
    few = F.col("n") < least
    out = {f"m{a}": F.col(f"s{a}") / F.col("n") for a in "xyz"}
    for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"):
        value = F.col(f"s{a}{b}") / F.col("n") - (F.col(f"s{a}") / F.col("n")) * (F.col(f"s{b}") / F.col("n"))
        out[f"c{a}{b}"] = F.when(few, F.lit(floor if a == b else 0.0)).otherwise(value)
    return m.select(*keys, "n", *[c.alias(n) for n, c in out.items()])


def shapes(cov: DataFrame) -> DataFrame:
    """Shape measures of each voxel from its covariance."""
    return g.with_eigenvalues(cov).withColumns(g.shape_measures(F.col("l0"), F.col("l1"), F.col("l2")))


def offsets(radius: int = 1) -> Column:
    """The (2 radius + 1)^3 neighbour offsets as an array of structs di, dj, dk."""
    r = range(-radius, radius + 1)
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(c).alias("dk")) for a in r for b in r for c in r])


def neighbour_sums(voxels: DataFrame, values: list[str], radius: int = 1) -> DataFrame:
    """Sums of values over each occupied voxel and its neighbours.

    Each voxel sends its values to its neighbours' keys, they are added up there (partial sums
    first), and keys that are no voxel drop out in the join.
    """
    sent = voxels.select(*IJK, *values, F.explode(offsets(radius)).alias("o"))
    sent = sent.select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), (F.col("k") + F.col("o.dk")).alias("k"), *values)
    sums = sent.groupBy(*IJK).agg(*[F.sum(v).alias(v) for v in values])
    return voxels.select(*IJK).join(sums, IJK)


def lookup(probes: DataFrame, voxels: DataFrame, values: list[str]) -> DataFrame:
    """probes (with i, j, k) and the values of their voxel, null where there is none."""
    return probes.join(voxels.select(*IJK, *values), IJK, "left")


def centers(voxels: DataFrame, size: float) -> DataFrame:
    return voxels.withColumns({f"c{c}": (F.col(n) + 0.5) * size for n, c in zip(IJK, "xyz", strict=True)})


def encode(i: Column, j: Column, k: Column, nx: Column | int, ny: Column | int) -> Column:
    """One key for a voxel within dims nx, ny."""
    return (i + nx * (j + ny * k)).cast("long")


def with_normal_products(rows: DataFrame) -> DataFrame:
    """rows (covariance, eigenvalues) with pxx ... pzz, the products of the surface normal's components.

    (C - l0 I)(C - l1 I) is a multiple of n n^T, so its trace scales it: no eigenvector is needed, and no sign has
    to be chosen. Where no direction is the least one, the x axis stands in.
    """
    get = lambda p, q, l: F.col("c" + "".join(sorted(p + q))) - (F.col(l) if p == q else F.lit(0.0))
    rows = rows.withColumns({f"_{a}{b}": sum((get(a, k, "l0") * get(k, b, "l1") for k in "xyz"), F.lit(0.0)) for a, b in PAIRS})
    rows = rows.withColumn("_t", F.col("_xx") + F.col("_yy") + F.col("_zz"))
    clear = F.abs("_t") > 1e-18
    return rows.withColumns({f"p{a}": F.when(clear, F.col(f"_{a}") / F.col("_t")).otherwise(F.lit(1.0 if a == "xx" else 0.0)) for a in PAIRS}).drop("_t", *[f"_{a}" for a in PAIRS])


def normals(rows: DataFrame) -> DataFrame:
    """rows (pxx ... pzz) with the unit normal nx, ny, nz, turned upward."""
    at = lambda a, b: F.col("p" + "".join(sorted(a + b)))
    largest = F.greatest("pxx", "pyy", "pzz")
    length = F.sqrt(largest)
    pick = lambda c: F.when(F.col("pzz") == largest, at(c, "z")).when(F.col("pyy") == largest, at(c, "y")).otherwise(at(c, "x")) / length
    rows = rows.withColumns({f"n{c}": pick(c) for c in "xyz"})
    up = F.when(F.col("nz") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return rows.withColumns({f"n{c}": F.col(f"n{c}") * up for c in "xyz"})


def _measured(m: DataFrame, size: float) -> DataFrame:
    """Neighbourhoods of the voxels of moments m: shape measures, normal products, verticality, density."""
    s = with_normal_products(shapes(covariance(neighbour_sums(m, MOMENTS))))
    return s.withColumns({"verticality": 1 - F.sqrt(g.clamp(F.col("pzz"), 0.0, 1.0)), "density": F.col("n") / F.lit(27.0 * size**3)})


def descriptors(points: DataFrame, size: float) -> DataFrame:
    """Shape measures of each occupied voxel's 3x3x3 neighbourhood, with density and verticality."""
    return _measured(moments(points, size), size).drop(*[f"p{a}" for a in PAIRS])


def surface_descriptors(m: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Every descriptor of the voxels of moments m (of `size`): shape, normal, and how the surface runs there.

    boundary is the distance from the neighbourhood's mean to the voxel's centre, over 1.5 voxels. The scores are the
    shares of the eigenvalues of the normals' tensor over the neighbourhood, each voxel by its own points: one
    direction is a surface, two a crease (times 3), three a corner (times 6). m is read twice, so write it first if it
    is dear; the neighbourhoods, which both results need, are written here.
    """
    s = normals(_measured(m, size))
    away = [F.col(f"m{c}") - ((F.col(n) + 0.5) * size + o) for n, c, o in zip(IJK, "xyz", origin, strict=True)]
    s = s.withColumn("boundary", g.clamp(g.norm(tuple(away)) / (1.5 * size), 0.0, 1.0))
    s = written(s.select(*IJK, "n", *DESCRIPTORS[:7], "nx", "ny", "nz", *[f"p{a}" for a in PAIRS]), "neighbourhoods")
    own = m.select(*IJK, F.col("n").cast("double").alias("w"))
    products = s.join(own, IJK).select(*IJK, "w", *[(F.col("w") * F.col(f"p{a}")).alias(f"t{a}") for a in PAIRS])
    t = neighbour_sums(products, ["w", *[f"t{a}" for a in PAIRS]])
    t = t.select(*IJK, *[(F.col(f"t{a}") / F.col("w")).alias(f"t{a}") for a in PAIRS])
    t = g.with_eigenvalues(t, tuple(f"t{a}" for a in PAIRS))
    total = F.greatest(F.col("l0") + F.col("l1") + F.col("l2"), F.lit(1e-12))
    scores = {"surface_score": F.col("l0") / total, "crease_score": g.clamp(3 * F.col("l1") / total, 0.0, 1.0), "corner_score": g.clamp(6 * F.col("l2") / total, 0.0, 1.0)}
    return s.drop(*[f"p{a}" for a in PAIRS]).join(t.select(*IJK, *[e.alias(c) for c, e in scores.items()]), IJK)


def pieces(points: DataFrame, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """Moments of the pieces in which the voxels of all scales overlap, keyed i_0, j_0, k_0, i_1, ...

    Points are read and aggregated once for all scales. Where the scales are multiples of the first, a piece is a
    voxel of the first scale.
    """
    keyed = points
    for s, size in enumerate(scales):
        keyed = assign(keyed, size).withColumnsRenamed({c: f"{c}_{s}" for c in IJK})
    sums = {f"s{c}": F.sum(c) for c in "xyz"} | {f"s{a}": F.sum(F.col(a[0]) * F.col(a[1])) for a in PAIRS}
    return keyed.groupBy(*scale_keys(len(scales))).agg(F.count(F.lit(1)).alias("n"), *[e.alias(c) for c, e in sums.items()])


def scale_keys(scales: int) -> list[str]:
    return [f"{c}_{s}" for s in range(scales) for c in IJK]


def multiscale(parts: DataFrame, scales: tuple[float, ...] = SCALES, primary: int = 1) -> DataFrame:
    """parts (of pieces(); written, since each scale reads them) with the descriptors of every scale.

    A name and _s is the descriptor at scale s; without _s it is that of the primary scale, or of the last if there
    are fewer. scale_contrast is coarse planarity less fine planarity, local_detail fine less coarse sphericity plus
    a half, within 0 and 1; both only where there are two scales or more.
    """
    out = parts.select(*scale_keys(len(scales)), F.col("n").alias("points"))
    for s, size in enumerate(scales):
        m = parts.groupBy(*[F.col(f"{c}_{s}").alias(c) for c in IJK]).agg(*[F.sum(c).alias(c) for c in MOMENTS])
        d = surface_descriptors(m, size).select(*[F.col(c).alias(f"{c}_{s}") for c in [*IJK, *DESCRIPTORS, "nx", "ny", "nz"]])
        out = out.join(d, [f"{c}_{s}" for c in IJK])
    base, last = min(primary, len(scales) - 1), len(scales) - 1
    out = out.withColumns({c: F.col(f"{c}_{base}") for c in [*DESCRIPTORS, "nx", "ny", "nz"]})
    if last:
        detail = g.clamp(F.col("sphericity_0") - F.col(f"sphericity_{last}") + 0.5, 0.0, 1.0)
        out = out.withColumns({"scale_contrast": F.col(f"planarity_{last}") - F.col("planarity_0"), "local_detail": detail})
    return out


def described(points: DataFrame, scales: tuple[float, ...] = SCALES, primary: int = 1) -> DataFrame:
    """points with the descriptors of every scale."""
    parts = written(pieces(points, scales), "pieces")
    keyed = points
    for s, size in enumerate(scales):
        keyed = assign(keyed, size).withColumnsRenamed({c: f"{c}_{s}" for c in IJK})
    keys = scale_keys(len(scales))
    return keyed.join(multiscale(parts, scales, primary).drop("points"), keys).drop(*keys)
