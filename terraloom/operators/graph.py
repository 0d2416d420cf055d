"""Connected components over DataFrames, and the grids and groups that are components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import delete, written
from . import rasters, voxels


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the edges: component is the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al. 2014), each an aggregate and an equi-join,
    both of which Spark can split when one node has many edges, until nothing changes. Every
    round is a written table, so the lineage stays short. Nodes are longs; null ends are not
    allowed; loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = written(e, "edges")
    before = _signature(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        nxt = written(small.where("u > v").distinct(), "edges")
        after = _signature(nxt)
        delete(e)
        e = nxt
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def label(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """nodes with component, their own number where they have no edge."""
    found = components(edges, "a", "b")
    return nodes.join(found, nodes[node] == found["node"], "left").select(nodes["*"], F.coalesce(found["component"], nodes[node]).alias("component"))


def _key(columns: list[Column], bits: int) -> Column:
    """Cell indices as one long; they must be within +-2^(bits-1)."""
    out = F.lit(0).cast("long")
    for c in columns:
        out = F.shiftleft(out, bits).bitwiseOR((c + (1 << (bits - 1))).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    return out


def raster_components(mask: DataFrame) -> DataFrame:
    """mask's cells (i, j) with the number of their 4-connected component."""
    key = _key([F.col("i"), F.col("j")], 31)
    cells = mask.select("i", "j").distinct().withColumn("node", key)
    right = [cells.select(F.col("node").alias("a"), _key([F.col("i") + di, F.col("j") + dj], 31).alias("b")) for di, dj in ((1, 0), (0, 1))]
    edges = right[0].union(right[1]).join(cells.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    return label(cells, edges).drop("node")


def voxel_components(occupied: DataFrame) -> DataFrame:
    """Voxels (i, j, k) with the number of their 26-connected component: half of the offsets give each edge once."""
    key = lambda i, j, k: _key([i, j, k], 21)
    cells = occupied.select("i", "j", "k").distinct().withColumn("node", key(F.col("i"), F.col("j"), F.col("k")))
    half = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    ahead = F.explode(F.array(*[key(F.col("i") + a, F.col("j") + b, F.col("k") + c) for a, b, c in half]))
    edges = cells.select(F.col("node").alias("a"), ahead.alias("b")).join(cells.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    return label(cells, edges).drop("node")


def structures(nodes: DataFrame, relations: DataFrame, kinds: tuple[str, ...] = ("perpendicular", "adjacent", "coplanar"), least: float = 0.3) -> DataFrame:
    """nodes (id) with structure: components over relations (a, b, kind, confidence) of the given kinds above a confidence."""
    edges = relations.where(F.col("kind").isin(*kinds) & (F.col("confidence") > least)).select("a", "b")
    return label(nodes, edges, "id").withColumnRenamed("component", "structure")


def neighbours(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(node, neighbour, relation) both ways."""
    e = edges.where(F.col("relation") == relation) if relation else edges
    return e.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "relation").union(e.select("b", "a", "relation"))


def violations(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """(rule, subject): repeated ids, missing parents, edges whose ends or relation don't exist, as anti-joins."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    repeated = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated id").alias("rule"), F.col("id").cast("string").alias("subject"))
    orphan = nodes.where("parent IS NOT NULL").join(ids, F.col("parent") == F.col("_id"), "left_anti").select(F.lit("missing parent"), F.col("id").cast("string"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("end")).distinct().join(ids, F.col("end") == F.col("_id"), "left_anti").select(F.lit("missing end"), F.col("end").cast("string"))
    kind = edges.where(~F.col("relation").isin(*relations)).select(F.lit("unknown relation"), F.col("relation")).distinct()
    return repeated.union(orphan).union(ends).union(kind)


def clusters(points: DataFrame, size: float, least_points: int = 24, least_voxels: int = 3) -> DataFrame:
    """(component, n, voxels, box): 26-connected clusters of points by voxels of a size; small ones are dropped."""
    at = voxels.assign(points, size)
    found = voxel_components(at)
    groups = at.join(found, voxels.IJK).groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("i", "j", "k").alias("voxels"),
        *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )
    return groups.where((F.col("n") >= least_points) & (F.col("voxels") >= least_voxels)).withColumn("confidence", 0.3 + 0.5 * F.least(F.lit(1.0), F.col("n") / 250))


def gaps(covered: DataFrame, domain: DataFrame, regions: DataFrame, cell: float, least_cells: int = 2, most_area: float = 30.0) -> DataFrame:
    """(component, cells, area, kind) of the cells of domain (i, j, border) that aren't covered.

    kind: the region most of the gap lies in (regions: i, j, region; of equal ones the first by
    name), else 'border' if it touches the border, else 'occlusion' up to an area, else 'void'.
    """
    open_ = domain.join(covered.select("i", "j"), rasters.IJ, "left_anti")
    parts = open_.join(raster_components(open_), rasters.IJ)
    sized = parts.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.max("border").alias("border")).where(F.col("cells") >= least_cells)
    inside = parts.join(regions, rasters.IJ).groupBy("component", "region").agg(F.count(F.lit(1)).alias("n"))
    best = inside.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "region")).alias("b")).select("component", (-F.col("b.n")).alias("in_region"), F.col("b.region").alias("region"))
    out = sized.join(best, "component", "left").withColumn("area", F.col("cells") * cell * cell)
    kind = F.when(F.col("in_region") * 2 > F.col("cells"), F.col("region")).when(F.col("border"), "border").when(F.col("area") <= most_area, "occlusion").otherwise("void")
    return out.select("component", "cells", "area", kind.alias("kind"))
