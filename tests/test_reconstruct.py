"""A small scene from points to tables."""

from __future__ import annotations

import numpy as np
import pytest
from terraloom.__main__ import parser
from terraloom.plans.reconstruct import Config, reconstruct


def scene(seed=11):
    r = np.random.default_rng(seed)
    flat = lambda n, x, y, z: np.column_stack([r.uniform(*x, n), r.uniform(*y, n), r.normal(z, 0.01, n)])
    ground = flat(9000, (0, 24), (0, 24), 0.0)
    roof = flat(6000, (8, 16), (8, 16), 6.0)
    wall = np.column_stack([r.uniform(8, 16, 6000), r.normal(8.0, 0.01, 6000), r.uniform(0.2, 6, 6000)])
    return np.vstack([ground[~((ground[:, 0] > 8) & (ground[:, 0] < 16) & (ground[:, 1] > 8) & (ground[:, 1] < 16))], roof, wall])


def test_reconstruct(spark):
    p = spark.createDataFrame([(*map(float, x), 0.5) for x in scene()], "x double, y double, z double, intensity double")
    w = reconstruct(p, Config(plane_least_voxels=12))
    t = w["terrain"].toPandas()
    assert abs(t[(t.i < 7) & (t.j < 7)].ground).max() < 0.2
    planes = w["planes"].toPandas()
    assert ((planes.nz > 0.99) & (abs(planes.mz - 6) < 0.3)).any()
    assert ((abs(planes.ny) > 0.99) & (abs(planes.my - 8) < 0.3)).any()
    classes = set(w["notes"].toPandas()["class"])
    assert {"ground", "building"} <= classes
    with pytest.raises(ValueError):
        reconstruct(p.drop("z"))


@pytest.mark.parametrize("command", [["inspect", "p"], ["tiles", "p", "--area", "1,2,3"], ["adapters"], ["explain", "structure.wall", "edge"], ["queries"], ["run", "q", "d"], ["reconstruct", "p", "o"]])
def test_commands(command):
    assert parser().parse_args(command).command == command[0]
