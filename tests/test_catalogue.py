"""Catalogue names, merged planes, summaries of empty tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from terraloom.operators import catalogue, rasters, records, segmentation, voxels

from .conftest import rows


def test_names_of_known_places(spark):
    df = spark.createDataFrame([(565648.0, 5934179.0, 25497363.0, 6672958.0)], "x double, y double, e double, n double")
    c = F.col
    assert rows(df.select(catalogue.kilometre_code(c("x"), c("y")), catalogue.terrain_file(c("x"), c("y")), catalogue.mesh_code(c("e"), c("n")))) == [("6534", "DGM1_32564_5934_2_FHH.xyz", "672496")]


def test_origins_and_years_are_not_guessed(spark):
    df = spark.createDataFrame([("a/Tile_6672500_25496750_L21.obj", "2020"), ("b/Tile_6672500_496750.obj", "2020-06"), ("6672500/496750/mesh.obj", None)], "name string, epoch string")
    got = df.select(catalogue.subtile_origin(F.col("name")).alias("o"), catalogue.epoch_year(F.col("epoch")).alias("y")).collect()
    assert [(r.o and r.o.east, r.o and r.o.north, r.y) for r in got] == [(27549675, 6672500, 2020), (25496750, 6672500, None), (None, None, None)]


def test_unknown_roles_are_errors(spark):
    layers = spark.createDataFrame([("a", "input")], "id string, role string")
    assert catalogue.layers_for(layers, "input", ("input", "prior")).count() == 1
    with pytest.raises(ValueError, match="unknown role"):
        catalogue.layers_for(layers, "truth", ("input", "prior"))


def test_summaries_of_nothing(spark):
    gaps = spark.createDataFrame([], "gap_type string, area double")
    assert rows(records.gap_summary(gaps)) in ([], [("all", 0, 0, 0, 0.0)])
    programs = spark.createDataFrame([], "kind string, parameters long, residual double")
    assert rows(records.program_summary(programs)) == [(0, 0, [], 0, None, None)]


def test_roads_are_smoothed_and_the_rest_is_not(spark):
    z = {(i, j): float((i * 7 + j * 5) % 11) for i in range(6) for j in range(6) if (i, j) != (2, 3)}
    df = spark.createDataFrame([(i, j, h, int(j == 2)) for (i, j), h in z.items()], "i long, j long, z double, c int")
    mean = lambda a: {(i, j): np.mean([a[p] for p in ((i + x, j + y) for x in (-1, 0, 1) for y in (-1, 0, 1)) if p in a]) for i, j in a}
    want = mean(mean(z))
    for r in rasters.smooth_roads(df).collect():
        assert r.smooth == pytest.approx(want[r.i, r.j] if r.j == 2 else z[r.i, r.j])


def test_pieces_of_one_wall_are_one_plane(spark):
    rng = np.random.default_rng(6)
    # along y, at x 1: three pieces of one wall and one beyond the gap; a floor; a wall of another group
    spans = {1: (0, 4, 1.0, 0), 2: (5, 9, 1.02, 0), 3: (10, 14, 0.98, 0), 4: (20, 24, 1.0, 0), 6: (0, 4, 1.0, 9)}
    pts, normals = {}, {}
    for k, (lo, hi, x, _) in spans.items():
        pts[k] = np.column_stack([rng.normal(x, 0.01, 50 * k), rng.uniform(lo, hi, 50 * k), rng.uniform(0, 3, 50 * k)])
        normals[k] = (-1.0 if k == 3 else 1.0, 0.0, 0.0)
    pts[5] = np.column_stack([rng.uniform(0, 4, 200), rng.uniform(0, 14, 200), rng.normal(0, 0.01, 200)])
    normals[5] = (0.0, 0.0, 1.0)
    data = []
    for k, p in pts.items():
        sums = [float(len(p)), *p.sum(axis=0), *[float((p[:, a] * p[:, b]).sum()) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]]
        data.append((k, spans.get(k, (0, 0, 0, 0))[3], f"r{k}", *normals[k], *map(float, p.min(axis=0)), *map(float, p.max(axis=0)), int(sums[0]), *map(float, sums[1:])))
    fields = "id long, group int, role string, " + ", ".join(f"{c} double" for c in ("nx", "ny", "nz", "minx", "miny", "minz", "maxx", "maxy", "maxz")) + ", n long, " + ", ".join(f"{c} double" for c in voxels.MOMENTS[1:])
    got = {r.patch: r for r in segmentation.merge_coplanar(spark.createDataFrame(data, fields)).collect()}
    assert {k: (r.members, r.role) for k, r in got.items()} == {1: (3, "r3"), 4: (1, "r4"), 5: (1, "r5"), 6: (1, "r6")}
    p = np.vstack([pts[k] for k in (1, 2, 3)])
    values, vectors = np.linalg.eigh(np.cov(p.T, bias=True))
    n = vectors[:, 0] * (-1 if vectors[0, 0] > 0 else 1)  # the largest piece, 3, faces -x
    assert [got[1].nx, got[1].ny, got[1].nz] == pytest.approx(list(n), abs=1e-6)
    assert got[1].rms == pytest.approx(np.sqrt(values[0]), rel=1e-4) and got[1].n == 300 and got[1].maxy == pytest.approx(p[:, 1].max())
    assert got[5].nz == 1.0
