"""Forward validation: scans cast again into what was reconstructed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import voxels


def scene(samples: DataFrame, size: float) -> DataFrame:
    """(i, j, k, node): occupied voxels of surface samples (node, seq, x, y, z); the last sample owns a voxel."""
    return voxels.assign(samples, size).groupBy(*voxels.IJK).agg(F.max_by("node", "seq").alias("node"))


def sample_triangles(tris: DataFrame, step: float) -> DataFrame:
    """(node, seq, x, y, z): points of a barycentric grid over each triangle (tri, node, ax ... cz), about step apart."""
    a, b, c = (tuple(F.col(f"{p}{k}") for k in "xyz") for p in "abc")
    longest = F.greatest(g.norm(g.minus(b, a)), g.norm(g.minus(c, a)), g.norm(g.minus(c, b)))
    n = F.greatest(F.lit(1), F.ceil(longest / step).cast("int"))
    t = tris.withColumn("_n", n).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_p"))))
    u, w = F.col("_p") / F.col("_n"), F.col("_q") / F.col("_n")
    place = {k: F.col(f"a{k}") + u * (F.col(f"b{k}") - F.col(f"a{k}")) + w * (F.col(f"c{k}") - F.col(f"a{k}")) for k in "xyz"}
    return t.select("node", F.struct("tri", "_p", "_q").alias("seq"), *[e.alias(k) for k, e in place.items()])


def march(rays: DataFrame, occupied: DataFrame, size: float, reach: float, near: float = 0.6) -> DataFrame:
    """(ray, node, t): the first occupied voxel along each ray (ray, ox, oy, oz, dx, dy, dz, unit directions).

    Steps of half a voxel from near to reach are rows, different voxels are kept once with their
    first distance, and meet the scene by an equi-join; the aggregate keeps the nearest. Spark sizes
    the steps by the rays they come from and would broadcast them, so both sides are sorted.
    """
    steps = int(max(0, (reach - near) / (size / 2))) + 1
    along = rays.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda s: F.lit(near) + s * (size / 2))))
    at = along.select("ray", "t", *[g.cell(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}"), size).alias(n) for n, c in zip(voxels.IJK, "xyz", strict=True)])
    first = at.groupBy("ray", *voxels.IJK).agg(F.min("t").alias("t"))
    return first.join(occupied.hint("merge"), voxels.IJK).groupBy("ray").agg(F.min(F.struct("t", "node")).alias("b")).select("ray", F.col("b.node").alias("node"), F.col("b.t").alias("t"))


def judge(rays: DataFrame, hits: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """rays (ray, range) with node and verdict: explained, early (something stands before it), late, or missing."""
    met = rays.join(hits.hint("merge"), "ray", "left").withColumn("error", F.col("t") - F.col("range"))
    verdict = F.when(F.col("t").isNull(), "missing").when(F.abs(F.col("error")) <= tolerance, "explained").when(F.col("error") < 0, "early").otherwise("late")
    return met.withColumn("verdict", verdict)


def by_node(judged: DataFrame, least: int = 4) -> DataFrame:
    """(node, rays, explained, bias, rmse) of nodes with enough rays, least consistent first by what they explain."""
    ok = F.col("verdict") == "explained"
    s = judged.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("rays"), F.sum(ok.cast("long")).alias("explained"), F.median("error").alias("bias"), F.sqrt(F.avg(F.when(ok, F.col("error") * F.col("error")))).alias("rmse"))
    return s.where(F.col("rays") >= least)


def report(judged: DataFrame) -> DataFrame:
    """One row: rays and how many of each verdict."""
    return judged.agg(F.count(F.lit(1)).alias("rays"), *[F.sum((F.col("verdict") == x).cast("long")).alias(x) for x in ("explained", "early", "late", "missing")])
