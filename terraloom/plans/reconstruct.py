"""From points to a world of tables: ground, classes, planes, their relations and structures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cascades, frames, graph, matching, rasters, segmentation, voxels
from .storage import written


@dataclass(frozen=True)
class Config:
    """Cell sizes in metres, and the thresholds of segmentation."""

    terrain: float = 1.0
    scale: float = 1.5
    plane_voxel: float = 0.6
    plane_angle: float = 18.0
    plane_distance: float = 0.32
    plane_least_voxels: int = 8
    contact: float = 0.8


def heights_above_ground(points: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(points with hag, terrain (i, j, ground)): the lowest returns, filtered, averaged over what is left around each cell."""
    low = rasters.accumulate(points, config.terrain)
    kept = rasters.ground_mask(low, config.terrain)
    near = rasters.sent(kept.where("ground").select("i", "j", "lo"), ["lo"], 2).groupBy("i", "j").agg((F.sum("lo") / F.count("lo")).alias("near"))
    terrain = kept.join(near, rasters.IJ, "left").select("i", "j", F.when(F.col("ground"), F.col("lo")).otherwise(F.coalesce("near", "lo")).alias("ground"))
    terrain = written(terrain, "terrain")
    sampled = rasters.sample_bilinear(points, terrain, "ground", config.terrain)
    return sampled.withColumn("hag", F.col("z") - F.coalesce("sample", "z")).drop("sample"), terrain


def reconstruct(points: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """Tables of a world from points (x, y, z, intensity): terrain, voxels (class and role of each), planes with frames,
    relations, structures, and notes.

    Every table is the plan of one stage over those before it; what several stages read is written.
    """
    config = config or Config()
    for c in ("x", "y", "z"):
        if c not in points.columns:
            raise ValueError(f"points need {c}")
    if "intensity" not in points.columns:
        points = points.withColumn("intensity", F.lit(None).cast("double"))
    high, terrain = heights_above_ground(points, config)
    high = written(high, "points")
    at = voxels.assign(high, config.scale).groupBy(*voxels.IJK).agg(F.avg("hag").alias("hag"), F.avg("intensity").alias("intensity"))
    d = voxels.descriptors(high, config.scale).select(*voxels.IJK, "n", "linearity", "planarity", "verticality", "density").join(at, voxels.IJK)
    classed = cascades.first_match(d, cascades.surface_classes(), "class", ("unclassified", 0.1))
    classed = classed.withColumn("slope", F.degrees(F.acos(F.least(F.lit(1.0), 1 - F.col("verticality")))))
    roles = written(cascades.first_match(classed, cascades.point_roles(), "role", ("unknown", 0.1), 0.5 + 0.5 * F.col("class_confidence")), "voxels")
    built = voxels.assign(high, config.scale).join(roles.where("class = 'building'").select(*voxels.IJK), voxels.IJK, "left_semi").select("x", "y", "z")
    found = segmentation.planes(built, config.plane_voxel, config.plane_angle, config.plane_distance, least_voxels=config.plane_least_voxels)
    found = written(frames.framed(found), "planes")
    half = F.sqrt(F.col("n") / 50.0)
    boxes = found.select(F.col("plane").alias("id"), *[(F.col(f"m{c}") + s * half * F.sqrt(1 - F.col(f"n{c}") * F.col(f"n{c}"))).alias(f"{m}{c}") for m, s in (("min", -1), ("max", 1)) for c in "xyz"], "nx", "ny", "nz")
    relations = written(matching.plane_relations(boxes, 8.0, config.contact).withColumn("confidence", F.lit(0.5)), "relations")
    structures = graph.structures(found.select(F.col("plane").alias("id")), relations, ("perpendicular", "adjacent"))
    planes = found.withColumn("slope", g.slope_degrees(F.col("nz"))).join(structures.withColumnRenamed("id", "plane"), "plane")
    notes = roles.groupBy("class", "role").agg(F.count(F.lit(1)).alias("voxels"), F.sum("n").alias("points"))
    return {"terrain": terrain, "voxels": roles, "planes": planes, "relations": relations, "notes": notes}
