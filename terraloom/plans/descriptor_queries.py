"""Queries over all descriptors, at one scale and at several, and the classes and roles told from them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import cascades, voxels
from . import views as v
from .registry import query
from .spatial_queries import COV, MOM, NEAR, NSUM, P, R, _eigen_sql
from .storage import written

_PAIRS = voxels.PAIRS


def _get(a: str, b: str, eigen: str) -> str:
    return f"(c{''.join(sorted(a + b))}{f' - {eigen}' if a == b else ''})"


def _scale_sql(size: float, tag: str) -> list[str]:
    """Views that end in full_<tag>: the descriptors of voxels of one size. The normals' tensor is told by products of normals."""
    name = lambda text: " ".join(text.split("\n"))
    own = {w: f"{w}_{tag}" for w in ("m", "ns", "ncov", "e1", "e2", "e3", "e4", "e5", "shapes")}

    def renamed(view: str) -> str:
        return re.sub(r"\b(" + "|".join(own) + r")\b(?= AS \()|(?<=FROM )\b(" + "|".join(own) + r")\b|(?<=JOIN )\bm\b", lambda x: own[x.group(0)], view)

    mom = MOM.replace("/ 1.5", f"/ {size}")
    cov = COV.replace("cov AS", "ncov AS").replace("FROM m)", "FROM ns)")
    views = [renamed(name(x)) for x in (mom, NSUM, cov, _eigen_sql("ncov"))]
    raw = ", ".join(f"{' + '.join(f'{_get(a, k, "l0")} * {_get(k, b, "l1")}' for k in 'xyz')} AS r{a}{b}" for a, b in _PAIRS)
    views.append(f"raw_{tag} AS (SELECT *, {raw} FROM shapes_{tag})")
    clear = "abs(rxx + ryy + rzz) > 1e-18"
    views.append(f"prod_{tag} AS (SELECT *, {', '.join(f'CASE WHEN {clear} THEN r{a} / (rxx + ryy + rzz) ELSE {1.0 if a == 'xx' else 0.0} END AS p{a}' for a in _PAIRS)} FROM raw_{tag})")
    views.append(f"wt_{tag} AS (SELECT p.i, p.j, p.k, m.n AS w, {', '.join(f'm.n * p{a} AS t{a}' for a in _PAIRS)} FROM prod_{tag} p JOIN m_{tag} m USING (i, j, k))")
    views.append(f"tens_{tag} AS (SELECT a.i, a.j, a.k, {', '.join(f'sum(b.t{a}) / sum(b.w) AS c{a}' for a in _PAIRS)} FROM (SELECT i, j, k, i + di AS bi, j + dj AS bj, k + dk AS bk FROM wt_{tag}, off) a JOIN wt_{tag} b ON b.i = bi AND b.j = bj AND b.k = bk GROUP BY a.i, a.j, a.k)")
    for w in ("e1", "e2", "e3", "e4", "e5", "shapes"):
        own[w] = f"t{w}_{tag}"
    views.append(renamed(name(_eigen_sql(f"tens_{tag}"))))
    away = " + ".join(f"(s{c} / n - ({k} + 0.5) * {size}) * (s{c} / n - ({k} + 0.5) * {size})" for c, k in zip("xyz", "ijk", strict=True))
    views.append(f"""full_{tag} AS (SELECT p.i, p.j, p.k, n, p.linearity, p.planarity, p.sphericity, p.curvature, 1 - sqrt(least(1, greatest(0, pzz))) AS verticality, n / (27 * {size} * {size} * {size}) AS density,
  least(1, b / (1.5 * {size})) AS boundary, t.l0 / s AS surface_score, least(1, 3 * t.l1 / s) AS crease_score, least(1, 6 * t.l2 / s) AS corner_score
  FROM prod_{tag} p JOIN (SELECT i, j, k, sqrt({away}) AS b FROM ns_{tag}) USING (i, j, k) JOIN (SELECT i, j, k, l0, l1, l2, greatest(l0 + l1 + l2, 1e-12) AS s FROM tshapes_{tag}) t USING (i, j, k))""")
    return [x.replace(" AS (", " AS MATERIALIZED (", 1) if x.startswith(("m_", "ns_", "prod_", "wt_", "tens_", "full_")) else x for x in views]


_ONE = (P, NEAR, *_scale_sql(1.5, "a"))


@query("SELECT i, j, k, n, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in voxels.DESCRIPTORS) + " FROM full_a", *_ONE)
def surface_descriptors(spark, sf):
    d = voxels.surface_descriptors(written(voxels.moments(v.points(spark, sf), 1.5), "moments"), 1.5)
    return d.select("i", "j", "k", "n", *[(R(c, 4) + 0.0).alias(c) for c in voxels.DESCRIPTORS])


_EACH = [f"{c}_{s}" for c in ("planarity", "sphericity", "density", "boundary", "crease_score") for s in range(3)]


@query("SELECT a.i, a.j, a.k, m.n AS points, " + ", ".join(f"round({'abc'[int(c[-1])]}.{c[:-2]}, 4) + 0.0 AS {c}" for c in _EACH) + """,
round(b.verticality, 4) + 0.0 AS verticality, round(c.planarity - a.planarity, 4) + 0.0 AS scale_contrast, round(least(1, greatest(0, a.sphericity - c.sphericity + 0.5)), 4) + 0.0 AS local_detail
FROM full_a a JOIN m_a m USING (i, j, k) JOIN full_b b ON b.i = floor(a.i / 3.0) AND b.j = floor(a.j / 3.0) AND b.k = floor(a.k / 3.0) JOIN full_c c ON c.i = floor(a.i / 8.0) AND c.j = floor(a.j / 8.0) AND c.k = floor(a.k / 8.0)""",
       P, NEAR, *_scale_sql(0.5, "a"), *_scale_sql(1.5, "b"), *_scale_sql(4.0, "c"))
def multiscale_descriptors(spark, sf):
    d = voxels.multiscale(written(voxels.pieces(v.points(spark, sf)), "pieces"))
    return d.select(F.col("i_0").alias("i"), F.col("j_0").alias("j"), F.col("k_0").alias("k"), "points", *[(R(c, 4) + 0.0).alias(c) for c in (*_EACH, "verticality", "scale_contrast", "local_detail")])


# Measures of points by arithmetic on their keys, so that every rule of the cascades is met.
_KINDS = ("unclassified", "building", "bridge", "person")
MEASURED = """mp AS (SELECT o_orderkey AS id, (o_orderkey % 41) * 0.25 - 1.0 AS hag, (o_orderkey % 19) / 20.0 AS linearity, (o_orderkey % 23) / 24.0 AS planarity, (o_orderkey % 7) / 32.0 AS sphericity,
  (o_orderkey % 11) / 10.0 AS verticality, (o_orderkey % 29) / 8.0 - 0.03125 AS density, (o_orderkey % 13) / 32.0 AS intensity, CAST(1 + o_orderkey % 3 AS INT) AS num_returns,
  CASE WHEN o_custkey % 10 = 0 THEN ['building', 'bridge', 'person'][CAST(o_orderkey % 3 + 1 AS INT)] END AS label FROM orders)"""


def _measures(spark, sf):
    k = F.col("o_orderkey")
    label = F.when(F.col("o_custkey") % 10 == 0, F.element_at(F.array(*[F.lit(x) for x in _KINDS[1:]]), (k % 3 + 1).cast("int")))
    part = lambda n, d: (k % n) / F.lit(float(d))
    return v.table(spark, sf, "orders").select(
        k.alias("id"), ((k % 41) * 0.25 - 1.0).alias("hag"), part(19, 20).alias("linearity"), part(23, 24).alias("planarity"), part(7, 32).alias("sphericity"), part(11, 10).alias("verticality"),
        (part(29, 8) - 0.03125).alias("density"), part(13, 32).alias("intensity"), (1 + k % 3).cast("int").alias("num_returns"), label.alias("label"),
    )


_GROUND = "hag < 0.25"
_CASES = (
    ("density < 0.05 AND hag > 8", "noise", 0.5), (f"{_GROUND} AND planarity > 0.35 AND intensity < 0.28", "road", 0.55), (_GROUND, "ground", 0.8),
    ("hag > -0.6 AND hag < 0.35 AND intensity < 0.05 AND planarity > 0.5", "water", 0.5),
    ("linearity > 0.65 AND density < 3 AND hag > 4 AND verticality < 0.35", "wire", 0.55), ("linearity > 0.65 AND density < 3 AND hag > 1.5 AND verticality > 0.7", "pole", 0.6),
    ("(verticality > 0.65 AND planarity > 0.45 AND hag > 1.5) OR (verticality < 0.35 AND planarity > 0.5 AND hag > 2.5)", "building", 0.7),
    ("sphericity > 0.13 AND several AND num_returns > 1 AND hag > 2", "vegetation_high", 0.75), ("sphericity > 0.13 AND several AND num_returns > 1 AND hag > 0.35", "vegetation_low", 0.65),
    ("sphericity > 0.13 AND several AND hag > 2.5", "building", 0.45), ("sphericity > 0.13 AND several AND hag > 0.35", "vegetation_low", 0.4),
    ("sphericity > 0.13 AND hag > 2", "vegetation_high", 0.65), ("sphericity > 0.13 AND hag > 0.35", "vegetation_low", 0.6),
    ("vehicles AND hag > 0.3 AND hag < 2.6 AND planarity > 0.3", "vehicle", 0.4), ("hag > 0.3 AND hag < 2.5 AND verticality > 0.6", "fence", 0.4), ("hag < 1.5", "ground", 0.4),
)
_FACTS = "facts AS (SELECT max(num_returns) > 1 AS several, quantile_cont(CASE WHEN hag > 0.3 AND hag < 2.6 THEN density END, 0.9) >= 1 AS vehicles FROM mp)"
_TOLD = f"told AS (SELECT *, CASE {' '.join(f"WHEN {w} THEN '{c}'" for w, c, _ in _CASES)} ELSE 'unclassified' END AS kind, CASE {' '.join(f'WHEN {w} THEN {p}' for w, _, p in _CASES)} ELSE 0.35 END::DOUBLE AS sure FROM mp, facts)"


@query("SELECT id, kind AS semantic, round(sure, 6) AS semantic_confidence FROM told", MEASURED, _FACTS, _TOLD)
def inferred_classes(spark, sf):
    return cascades.infer(_measures(spark, sf).drop("label")).select("id", "semantic", R("semantic_confidence", 6).alias("semantic_confidence"))


_SEEN = "seen AS (SELECT *, coalesce(label, kind) AS semantic, CASE WHEN label IS NULL THEN sure * 0.8 ELSE 0.95 END AS known FROM told)"


@query("SELECT id, semantic, round(known, 6) AS semantic_confidence FROM seen", MEASURED, _FACTS, _TOLD, _SEEN)
def classes_beside_labels(spark, sf):
    return _classes(spark, sf).select("id", "semantic", R("semantic_confidence", 6).alias("semantic_confidence"))


def _classes(spark, sf):
    return cascades.infer(_measures(spark, sf).withColumnRenamed("label", "semantic"))


_BUILT = "semantic IN ('building', 'bridge')"
_LEVEL = f"{_BUILT} AND planarity > 0.35 AND verticality < 0.4"
_ROLE_CASES = (
    (f"{_BUILT} AND corner_score > 0.28", "corner.trihedral", 0.6), (f"{_BUILT} AND crease_score > 0.3 AND verticality > 0.62", "edge.crease.convex", 0.55), (f"{_BUILT} AND crease_score > 0.3", "edge.ridge", 0.5),
    (f"{_BUILT} AND boundary > 0.55 AND verticality < 0.4", "edge.eave", 0.5), (f"{_BUILT} AND boundary > 0.55", "edge.boundary.free", 0.45),
    (f"{_BUILT} AND planarity > 0.35 AND verticality > 0.62 AND hag > 0.8", "surface.wall.vertical", 0.75), (f"{_LEVEL} AND degrees(acos(least(1, abs(nz)))) > 12 AND hag > 2", "surface.roof.pitched", 0.7),
    (f"{_LEVEL} AND hag > 2", "surface.roof.flat", 0.7), (_LEVEL, "surface.slab", 0.5), (_BUILT, "surface.wall.vertical", 0.4),
    *[(f"semantic = '{k}'", r, p) for k, r, p in (
        ("road", "terrain.road", 0.8), ("water", "terrain.water", 0.7), ("ground", "terrain.ground", 0.8), ("vegetation_high", "volume.vegetation.high", 0.7), ("vegetation_low", "volume.vegetation.low", 0.65),
        ("pole", "linear.pole", 0.7), ("wire", "linear.wire", 0.65), ("fence", "linear.fence", 0.6), ("vehicle", "instance.vehicle", 0.6), ("person", "instance.prop", 0.5))],
)
_RUN = "run AS (SELECT *, (id % 31) / 80.0 AS corner_score, (id % 37) / 100.0 AS crease_score, (id % 17) / 24.0 AS boundary, 1 - (id % 5) / 64.0 AS nz FROM seen)"
_ROLES = f"roles AS (SELECT id, CASE {' '.join(f"WHEN {w} THEN '{r}'" for w, r, _ in _ROLE_CASES)} ELSE 'unknown' END AS role, (CASE {' '.join(f'WHEN {w} THEN {p}' for w, _, p in _ROLE_CASES)} ELSE 0.4 END) * (0.5 + 0.5 * known) AS sure FROM run)"


def _classified(spark, sf):
    k = F.col("id")
    run = _classes(spark, sf).withColumns({"corner_score": (k % 31) / 80.0, "crease_score": (k % 37) / 100.0, "boundary": (k % 17) / 24.0, "nz": 1 - (k % 5) / 64.0})
    return cascades.classify(run)


@query("SELECT id, role, round(sure, 6) AS role_confidence FROM roles", MEASURED, _FACTS, _TOLD, _SEEN, _RUN, _ROLES)
def classified_roles(spark, sf):
    return _classified(spark, sf).select("id", "role", R("role_confidence", 6).alias("role_confidence"))


@query("SELECT role, count(*) AS n FROM roles GROUP BY role", MEASURED, _FACTS, _TOLD, _SEEN, _RUN, _ROLES)
def role_histogram(spark, sf):
    return cascades.role_histogram(_classified(spark, sf))
