"""Descriptors against eigenvectors by numpy; classes and roles by hand."""

from __future__ import annotations

import numpy as np
import pytest
from terraloom.operators import cascades, voxels


def _points(spark, p):
    return spark.createDataFrame([tuple(map(float, x)) for x in p], "x double, y double, z double")


def _by_numpy(p: np.ndarray, size: float) -> dict:
    cells: dict = {}
    for x in p:
        cells.setdefault(tuple(np.floor(x / size).astype(int)), []).append(x)
    near = {c: [n for n in np.ndindex(3, 3, 3) if tuple(np.add(c, n) - 1) in cells] for c in cells}
    normal, out = {}, {}
    for c in cells:
        q = np.array([x for n in near[c] for x in cells[tuple(np.add(c, n) - 1)]])
        cov = np.cov(q.T, bias=True) if len(q) >= 4 else 1e-9 * np.eye(3)
        values, vectors = np.linalg.eigh(cov)
        normal[c] = vectors[:, 0]
        away = np.linalg.norm(q.mean(axis=0) - (np.array(c) + 0.5) * size) / (1.5 * size)
        out[c] = [(values[1] - values[0]) / values[2], 1 - abs(normal[c][2]), min(1, away)]
    for c in cells:
        around = [tuple(np.add(c, n) - 1) for n in near[c]]
        t = sum(len(cells[a]) * np.outer(normal[a], normal[a]) for a in around) / sum(len(cells[a]) for a in around)
        v = np.linalg.eigvalsh(t)[::-1]
        out[c] += [v[0] / v.sum(), min(1, 3 * v[1] / v.sum()), min(1, 6 * v[2] / v.sum())]
    return out


def test_descriptors_are_those_of_the_eigenvectors(spark):
    p = np.random.default_rng(9).normal(0, 1, (1500, 3)) * [2.0, 1.5, 0.7]
    want = _by_numpy(p, 0.75)
    got = voxels.surface_descriptors(voxels.moments(_points(spark, p), 0.75), 0.75).collect()
    assert len(got) == len(want)
    for r in got:
        if r.n >= 4:
            assert [r.planarity, r.verticality, r.boundary] == pytest.approx(want[r.i, r.j, r.k][:3], abs=1e-6)
            assert r.nz >= 0 and r.nx**2 + r.ny**2 + r.nz**2 == pytest.approx(1)
    inner = [r for r in got if all((r.i + a, r.j + b, r.k + c) in want for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))]
    assert inner
    for r in inner:
        assert [r.surface_score, r.crease_score, r.corner_score] == pytest.approx(want[r.i, r.j, r.k][3:], abs=1e-5)


def test_where_walls_meet_is_a_crease_and_a_floor_is_a_surface(spark):
    rng = np.random.default_rng(5)
    floor = np.column_stack([rng.uniform(0, 12, 9000), rng.uniform(0, 12, 9000), rng.normal(0.75, 0.005, 9000)])
    wall = np.column_stack([rng.uniform(0, 12, 9000), rng.normal(0.75, 0.005, 9000), rng.uniform(0.75, 8, 9000)])
    d = voxels.surface_descriptors(voxels.moments(_points(spark, np.vstack([floor, wall])), 1.5), 1.5).toPandas()
    inside = d[(d.i > 1) & (d.i < 6)]
    assert inside[(inside.j > 3) & (inside.j < 6)].surface_score.min() > 0.95
    corner = inside[(inside.j == 0) & (inside.k == 0)]
    assert corner.crease_score.min() > 0.3 and corner.corner_score.max() < 0.28


@pytest.mark.parametrize("scales", [(0.5, 0.8), (1.0,)])
def test_scales_together_are_each_scale_alone(spark, scales):
    p = np.random.default_rng(7).uniform(-3, 3, (700, 3))
    points = _points(spark, p)
    got = {(r.x, r.y, r.z): r for r in voxels.described(points, scales).collect()}
    assert len(got) == len(p)
    for s, size in enumerate(scales):
        alone = {(r.i, r.j, r.k): r for r in voxels.surface_descriptors(voxels.moments(points, size), size).collect()}
        for x in p[:50]:
            a, b = got[tuple(x)], alone[tuple(np.floor(x / size).astype(int))]
            assert [a[f"planarity_{s}"], a[f"density_{s}"], a[f"crease_score_{s}"]] == pytest.approx([b.planarity, b.density, b.crease_score], abs=1e-6)
    one = next(iter(got.values()))
    assert ("scale_contrast" in one) == (len(scales) > 1)


def test_descriptors_without_points(spark):
    assert voxels.described(_points(spark, []), (0.5, 1.5)).count() == 0


MEASURES = "hag double, linearity double, planarity double, sphericity double, verticality double, density double, intensity double, num_returns int, semantic string"


def _inferred(spark, rows, **options):
    return [(r.semantic, round(r.semantic_confidence, 6)) for r in cascades.infer(spark.createDataFrame(rows, MEASURES).coalesce(1), **options).collect()]


def test_classes_where_some_are_published(spark):
    roof = (6.0, 0.0, 0.9, 0.0, 0.1, 2.0, 0.5, 1, None)
    labelled = (*roof[:-1], "bridge")
    assert _inferred(spark, [roof, labelled] * 40) == [("building", 0.56), ("bridge", 0.95)] * 40
    assert _inferred(spark, [roof] * 99 + [labelled]) == [("building", 0.7)] * 100  # 1 % is too few
    assert _inferred(spark, [roof, labelled] * 40, overwrite=True) == [("building", 0.7)] * 80
    assert _inferred(spark, [roof] + [labelled] * 9) == [("unclassified", 0.3)] + [("bridge", 0.95)] * 9  # too few are open
    assert _inferred(spark, []) == []


def test_canopy_needs_several_returns_once_any_row_has_them(spark):
    blob = (6.0, 0.0, 0.0, 0.5, 0.5, 2.0, 0.5, 1, None)
    assert _inferred(spark, [blob]) == [("vegetation_high", 0.65)]
    assert _inferred(spark, [blob, (*blob[:7], 2, None)]) == [("building", 0.45), ("vegetation_high", 0.75)]


def test_vehicles_need_density_and_unknown_measures_no_class(spark):
    car = (1.0, 0.0, 0.4, 0.0, 0.3, 2.0, 0.5, 1, None)
    assert _inferred(spark, [car]) == [("vehicle", 0.4)]
    assert _inferred(spark, [(*car[:5], 0.5, 0.5, 1, None)]) == [("ground", 0.4)]
    assert _inferred(spark, [(None,) * 9]) == [("unclassified", 0.35)]


def test_roles_put_edges_before_surfaces(spark):
    fields = "semantic string, hag double, nz double, verticality double, planarity double, boundary double, crease_score double, corner_score double"
    rows = [("building", 5.0, 1.0, 0.1, 0.9, 0.0, 0.0, c) for c in (0.5, 0.0)] + [("building", 5.0, 0.9, 0.1, 0.9, 0.9, 0.0, 0.0), ("building", 5.0, 0.9, 0.1, 0.9, 0.0, 0.0, 0.0), (None, 5.0, 0.9, 0.1, 0.9, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, fields).coalesce(1)
    assert [r.role for r in cascades.classify(df).collect()] == ["corner.trihedral", "surface.roof.flat", "edge.eave", "surface.roof.pitched", "unknown"]
    assert [r.role for r in cascades.classify(df, {"corner": 0.6}).collect()][0] == "surface.roof.flat"
