"""Operators against definitions and analytic scenes."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from terraloom.operators import graph, matching, meshes, rasters, segmentation, surfaces, voxels, worldgen

from .conftest import rows


def test_components_of_a_path_a_star_and_pairs(spark):
    e = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(5, 7), (7, 5), (9, 9)]
    got = dict(rows(graph.components(spark.createDataFrame(e, "a long, b long"), "a", "b")))
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[k] for k in range(200, 260)} == {1}
    assert got[7] == got[5] == 5 and 9 not in got


def test_components_without_edges(spark):
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"), "a", "b")) == []


def test_plane_is_planar_and_line_linear(spark):
    rng = np.random.default_rng(3)
    plane = np.column_stack([rng.uniform(0, 4, 4000), rng.uniform(0, 4, 4000), rng.normal(1.25, 0.01, 4000)])
    line = np.column_stack([rng.uniform(20, 24, 1000), rng.normal(2.25, 0.005, 1000), rng.normal(1.25, 0.005, 1000)])
    df = spark.createDataFrame([tuple(map(float, p)) for p in np.vstack([plane, line])], "x double, y double, z double")
    d = voxels.descriptors(df, 0.5).toPandas()
    assert d[d.i < 10].planarity.median() > 0.4 and d[d.i < 10].verticality.median() < 0.1
    assert d[d.i > 30].linearity.median() > 0.85


def test_two_walls_are_two_planes(spark):
    rng = np.random.default_rng(4)
    floor = np.column_stack([rng.uniform(0, 6, 6000), rng.uniform(0, 6, 6000), rng.normal(0.3, 0.005, 6000)])
    wall = np.column_stack([rng.uniform(0, 6, 6000), rng.normal(12.3, 0.005, 6000), rng.uniform(0, 4, 6000)])
    df = spark.createDataFrame([tuple(map(float, p)) for p in np.vstack([floor, wall])], "x double, y double, z double")
    p = segmentation.planes(df, 0.6, least_voxels=20).toPandas().sort_values("nz")
    assert len(p) == 2
    assert abs(p.iloc[0].ny) > 0.99 and p.iloc[1].nz > 0.99
    assert p.rms.max() < 0.05


def test_plane_segments_hold_all_voxels(spark, sf_dir):
    from terraloom.plans import views
    from terraloom.plans.queries import QUERIES

    p = views.points(spark, sf_dir).select("x", "y", "z").toPandas()
    n = np.floor(p / 1.5).astype(int).value_counts()
    got = QUERIES["plane_segments"](spark, sf_dir).toPandas()
    assert got.voxels.sum() == (n >= 3).sum() and got.n.sum() == n[n >= 3].sum()


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 3), (4, 4)):
        c = rng.uniform(-1, 1, (n, m))
        pairs = matching.assignment(c)
        small = min(n, m)
        best = min(sum(c[i, j] for i, j in (zip(range(n), p, strict=True) if n <= m else zip(p, range(m), strict=True))) for p in itertools.permutations(range(max(n, m)), small))
        assert len(pairs) == small and sum(c[i, j] for i, j in pairs) == pytest.approx(best)


def test_assignment_of_sparse_pairs_is_optimal():
    import tracemalloc

    rng = np.random.default_rng(6)
    for trial in range(120):
        n, m = rng.integers(1, 14, 2)
        values = rng.integers(1, 5, (n, m)) / 4 if trial % 2 else rng.uniform(0.01, 1, (n, m))  # with and without ties
        gain = np.where(rng.random((n, m)) < 0.4, values, 0.0)
        row, col = np.nonzero(gain)
        if not len(row):
            continue
        row, col = np.unique(row, return_inverse=True)[1], np.unique(col, return_inverse=True)[1]
        e = matching.sparse_assignment(row, col, gain[gain > 0])
        assert len(set(row[e])) == len(set(col[e])) == len(e)
        assert gain[gain > 0][e].sum() == pytest.approx(sum(gain[i, j] for i, j in matching.assignment(-gain)))
    n = 3000  # a chain: 72 MB as a matrix
    i = np.arange(n)
    tracemalloc.start()
    e = matching.sparse_assignment(np.concatenate([i, i[1:]]), np.concatenate([i, i[:-1]]), np.concatenate([np.full(n, 0.5), np.full(n - 1, 0.75)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6 and len(e) == n - 1


@pytest.mark.parametrize("ring", [[(0, 0), (4, 0), (4, 3), (0, 3)], [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], [(0, 0), (0, 3), (4, 3), (4, 0), (0, 0)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (2, 0), (1, 0.2), (1, 3)]])
def test_ear_clipping_covers_the_area(ring):
    p = np.array(ring, float)
    tri = meshes.ear_clip(p)
    q = p[:-1] if np.allclose(p[0], p[-1]) else p
    area = abs(sum(q[i][0] * q[(i + 1) % len(q)][1] - q[(i + 1) % len(q)][0] * q[i][1] for i in range(len(q)))) / 2
    got = sum(abs((p[b] - p[a])[0] * (p[c] - p[a])[1] - (p[b] - p[a])[1] * (p[c] - p[a])[0]) / 2 for a, b, c in tri)
    assert got == pytest.approx(area)


def test_simplified_lines_stay_near():
    rng = np.random.default_rng(2)
    p = np.column_stack([np.linspace(0, 10, 60), rng.uniform(0, 0.4, 60)])
    keep = meshes.simplify_line(p, 0.5)
    assert keep == [0, 59]
    keep = meshes.simplify_line(p, 0.05)
    for a, b in zip(keep, keep[1:], strict=False):
        d = p[b] - p[a]
        off = p[a : b + 1] - p[a]
        assert (np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / np.hypot(*d)).max() <= 0.05 + 1e-9


def test_rectangles_cover_exactly(spark):
    rng = np.random.default_rng(5)
    cells = {(0, int(u), int(v)): int(rng.integers(2)) for u, v in rng.integers(0, 9, (50, 2))}
    df = spark.createDataFrame([(*c, k) for c, k in cells.items()], "patch long, u int, v int, key long")
    for found in (surfaces.rectangles(df), surfaces.greedy_rectangles(df)):
        seen = {}
        for r in found.collect():
            for u in range(r.u0, r.u1 + 1):
                for v in range(r.v0, r.v1 + 1):
                    assert (0, u, v) not in seen
                    seen[0, u, v] = r.key
        assert seen == cells


def test_holes_are_windows_or_doors(spark):
    full = [(1, u, v) for u in range(20) for v in range(14)]
    cut = {(1, u, v) for u in range(4, 8) for v in range(4, 10)} | {(1, u, v) for u in range(12, 15) for v in range(1, 10)}
    df = spark.createDataFrame([c for c in full if c not in cut], "patch long, u int, v int")
    got = {(r.u0, r.u1, r.v0, r.v1): r.kind for r in surfaces.holes(df, 0.25).collect()}
    assert got == {(4, 7, 4, 9): "window", (12, 14, 1, 9): "door"}


def test_distances_agree(spark):
    cells = [(i, j) for i in range(12) for j in range(9) if (i, j) != (5, 5)]
    df = spark.createDataFrame(cells, "i long, j long")
    assert rows(rasters.distance_to_false(df, 5).select("i", "j", "d")) == rows(rasters.distance_by_windows(df, 5).select("i", "j", "d"))


def test_holes_in_rasters_are_filled(spark):
    cells = [(i, j, float(i)) for i in range(8) for j in range(8) if (i, j) not in {(3, 3), (3, 4)}]
    spec = spark.createDataFrame([(8, 8)], "ni int, nj int")
    got = {(r.i, r.j): r.z for r in rasters.fill_holes(spark.createDataFrame(cells, "i long, j long, z double"), "z", spec).collect()}
    assert len(got) == 64 and got[3, 3] == pytest.approx(3.0, abs=0.05)


def test_draws_repeat(spark):
    f = spark.range(200)
    a = rows(f.select("id", worldgen.draw(f["id"])))
    assert a == rows(f.select("id", worldgen.draw(f["id"]))) and 0.3 < np.mean([x for _, x in a]) < 0.7


def test_stencils_over_tiles_and_holes(spark, monkeypatch):
    """Against a loop over all pairs of cells: sparse rasters, negative cells, null values, tiles smaller than the raster."""
    import random

    from terraloom.operators import rasters

    r = random.Random(3)
    cells = {(i, j): (None if r.random() < 0.05 else float(r.randint(0, 50))) for i in range(-14, 15) for j in range(-9, 12) if r.random() < 0.4} | {(0, 0): 1.0, (1, 1): 5.0, (90, -70): 3.0}
    df = spark.createDataFrame([(i, j, z, "x") for (i, j), z in cells.items()], "i long, j long, z double, ground string")

    def around(of, radius, f):
        near = lambda i, j: [v for (a, b), v in of.items() if v is not None and abs(a - i) <= radius and abs(b - j) <= radius]
        return {c: None if v is None else f(near(*c)) for c, v in of.items()}

    monkeypatch.setattr(rasters, "TILE", 8)
    for radius in (1, 3):
        low = around(cells, radius, min)
        for got, want in (
            (rasters.erode(df, "z", radius), low),
            (rasters.dilate(df, "z", radius), around(cells, radius, max)),
            (rasters.opened(df, "z", radius), around(low, radius, max)),
        ):
            assert got.columns == df.columns and {(x.i, x.j): x.z for x in got.collect()} == want
    mean = {(x.i, x.j): x.z for x in rasters.box_mean(df, "z", 2).collect()}
    for c, v in around(cells, 2, lambda x: sum(x) / len(x)).items():
        assert v is None or abs(mean[c] - v) < 1e-9, c
    monkeypatch.setattr(rasters, "TILE", 64)
    surface, ground, radius = cells, {c: None if v is None else True for c, v in cells.items()}, 1
    while radius <= 8:
        opened = around(around(surface, radius, min), radius, max)
        allowed = min(0.35 + 0.25 * 2 * radius, 4.0)
        ground = {c: g if g is None else g and surface[c] - opened[c] <= allowed for c, g in ground.items()}
        surface, radius = opened, radius * 2
    got = rasters.ground_mask(df, 1.0, "z", max_window=8.0)
    assert {(x.i, x.j): x.ground for x in got.collect()} == ground
    assert rasters.erode(df.where("false"), "z", 1).count() == 0


def test_png_reads_back():
    import struct
    import zlib

    import numpy as np
    from terraloom.sources import sinks

    for shape in ((3, 5), (4, 2, 3), (2, 2, 4), (1, 1)):
        image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
        blob, at, chunks = sinks.png(image), 8, {}
        while at < len(blob):
            (n,) = struct.unpack(">I", blob[at : at + 4])
            name, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
            assert struct.unpack(">I", blob[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + body)
            chunks[name], at = body, at + 12 + n
        h, w = shape[:2]
        rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(h, -1)
        assert (rows[:, 0] == 2).all() and np.array_equal(np.cumsum(rows[:, 1:], axis=0, dtype=np.uint8).ravel(), image.ravel())
        assert struct.unpack(">II", chunks[b"IHDR"][:8]) == (w, h)
