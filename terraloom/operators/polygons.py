"""Polygon operators over ring vertices (ring_id, ord, px, py): rings are closed, first vertex = last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def edges(rings: DataFrame) -> DataFrame:
    """(ring_id, ord, x1, y1, x2, y2): consecutive vertices."""
    w = Window.partitionBy("ring_id").orderBy("ord")
    out = rings.select("ring_id", "ord", F.col("px").alias("x1"), F.col("py").alias("y1"), F.lead("px").over(w).alias("x2"), F.lead("py").over(w).alias("y2"))
    return out.where("x2 IS NOT NULL")


def bounds(rings: DataFrame) -> DataFrame:
    return rings.groupBy("ring_id").agg(F.min("px").alias("minx"), F.min("py").alias("miny"), F.max("px").alias("maxx"), F.max("py").alias("maxy"))


def areas(rings: DataFrame) -> DataFrame:
    """(ring_id, area, clockwise): shoelace over the edges; the sign tells the orientation."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    return edges(rings).groupBy("ring_id").agg(twice.alias("t")).select("ring_id", (F.abs(F.col("t")) / 2).alias("area"), (F.col("t") < 0).alias("clockwise"))


def newell(rings: DataFrame) -> DataFrame:
    """(ring_id, nx, ny, nz, area) of rings in space (px, py, pz): Newell's normal over the edges."""
    w = Window.partitionBy("ring_id").orderBy("ord")
    nxt = {c: F.lead(f"p{c}").over(w).alias(f"{c}2") for c in "xyz"}
    e = rings.select("ring_id", *[F.col(f"p{c}").alias(f"{c}1") for c in "xyz"], *nxt.values()).where("x2 IS NOT NULL")
    term = lambda a, b: F.sum((F.col(f"{a}1") - F.col(f"{a}2")) * (F.col(f"{b}1") + F.col(f"{b}2")))
    s = e.groupBy("ring_id").agg(term("y", "z").alias("nx"), term("z", "x").alias("ny"), term("x", "y").alias("nz"))
    length = g.norm((F.col("nx"), F.col("ny"), F.col("nz")))
    return s.withColumn("_l", length).select("ring_id", *[F.when(F.col("_l") > 0, F.col(n) / F.col("_l")).otherwise(F.lit(0.0)).alias(n) for n in ("nx", "ny", "nz")], (F.col("_l") / 2).alias("area"))


def buckets(rings: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """(bi, bj, ring_id, bounds): the coarse cells that each ring's padded box meets, for equi-joins."""
    b = bounds(rings).select("ring_id", *[(F.col(c) + (pad if c.startswith("max") else -pad)).alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    span = lambda a, z: F.sequence(g.cell(F.col(a), cell), g.cell(F.col(z), cell))
    return b.withColumn("bi", F.explode(span("minx", "maxx"))).withColumn("bj", F.explode(span("miny", "maxy")))


def containing(points: DataFrame, rings: DataFrame, key: str, cell: float = 10.0, pad: float = 0.0) -> DataFrame:
    """(key, ring_id): the rings that each point (key, x, y) lies in, by the even-odd rule.

    Points and rings meet in coarse cells (an equi-join), the padded box is tested, and crossings
    are counted over the edges of what is left. key must be unique.
    """
    at = points.select(key, "x", "y", g.cell(F.col("x"), cell).alias("bi"), g.cell(F.col("y"), cell).alias("bj"))
    near = at.join(buckets(rings, cell, pad), ["bi", "bj"]).where("x >= minx AND x <= maxx AND y >= miny AND y <= maxy").select(key, "ring_id", "x", "y")
    crosses = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at_x = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")
    hits = near.join(edges(rings), "ring_id").where(crosses & (F.col("x") < at_x))
    return hits.groupBy(key, "ring_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, "ring_id")


def inside_any(points: DataFrame, rings: DataFrame, key: str, cell: float = 10.0) -> DataFrame:
    """points with `inside`: whether any ring holds them."""
    hit = containing(points, rings, key, cell).select(F.col(key)).distinct().withColumn("inside", F.lit(True))
    return points.join(hit, key, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def first_containing(points: DataFrame, rings: DataFrame, key: str, cell: float = 10.0) -> DataFrame:
    """points with the smallest ring_id that holds them, or null."""
    hit = containing(points, rings, key, cell).groupBy(key).agg(F.min("ring_id").alias("ring_id"))
    return points.join(hit, key, "left")


def rasterise(rings: DataFrame, cell: float) -> DataFrame:
    """(i, j, ring_id): cells whose centre lies in a ring; where rings overlap, the largest ring_id."""
    b = bounds(rings)
    span = lambda a, z: F.sequence(g.cell(F.col(a), cell), g.cell(F.col(z), cell))
    cells = b.withColumn("i", F.explode(span("minx", "maxx"))).withColumn("j", F.explode(span("miny", "maxy"))).select("i", "j").distinct()
    centres = cells.withColumns({"x": (F.col("i") + 0.5) * cell, "y": (F.col("j") + 0.5) * cell, "c": F.struct("i", "j")})
    return containing(centres, rings, "c", cell * 8).groupBy("c.i", "c.j").agg(F.max("ring_id").alias("ring_id"))


def segments(lines: DataFrame) -> DataFrame:
    """(line_id, ord, x1, y1, x2, y2, length) of polylines (line_id, ord, px, py)."""
    e = edges(lines.withColumnRenamed("line_id", "ring_id")).withColumnRenamed("ring_id", "line_id")
    return e.withColumn("length", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))


def along(segs: DataFrame, step: float) -> DataFrame:
    """Points (line_id, x, y) every step along each segment, both ends included."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / step).cast("int"))
    t = segs.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n")))).withColumn("_t", F.col("_t") / F.col("_n"))
    return t.select("line_id", (F.col("x1") + F.col("_t") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("_t") * (F.col("y2") - F.col("y1"))).alias("y"))


def walls(rings: DataFrame, heights: DataFrame, shortest: float = 1.0, most: int = 64, lowest: float = 2.0) -> DataFrame:
    """(ring_id, wall, x1, y1, x2, y2, width, base_z, top_z, nx, ny): a wall for each long enough edge.

    heights has ring_id, base_z, top_z; lower than `lowest` gives no wall, nor do rings of more
    than `most` edges. The normal points out of the ring, whatever its orientation.
    """
    e = edges(rings).withColumn("width", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    size = edges(rings).groupBy("ring_id").agg(F.count(F.lit(1)).alias("_e"))
    e = e.join(size, "ring_id").where((F.col("_e") <= most) & (F.col("width") >= shortest)).join(areas(rings), "ring_id").join(heights, "ring_id").where(F.col("top_z") - F.col("base_z") >= lowest)
    sign = F.when(F.col("clockwise"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return e.select("ring_id", F.col("ord").alias("wall"), "x1", "y1", "x2", "y2", "width", "base_z", "top_z", (sign * (F.col("y2") - F.col("y1")) / F.col("width")).alias("nx"), (sign * (F.col("x1") - F.col("x2")) / F.col("width")).alias("ny"))
