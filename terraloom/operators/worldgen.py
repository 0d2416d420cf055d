"""Worlds from seeds: facades laid out from a few measures, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def family(key: Column, weights: dict[str, float]) -> Column:
    """A kind drawn by weights, in their order."""
    total, upto, out = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        upto += weights[name] / total
        hit = draw(key, F.lit("family")) < upto
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(names[0]) if out is None else out.otherwise(names[-1])


def bands(walls: DataFrame, extent: str, spacing: float, size: float, name: str) -> DataFrame:
    """walls with one row for each opening band along extent: as many as fit at the spacing, centred; name_0, name_1 are its ends."""
    n = F.floor((F.col(extent) - size) / spacing + 1).cast("int")
    pad = (F.col(extent) - ((F.col("_n") - 1) * spacing + size)) / 2
    w = walls.withColumn("_n", n).where("_n >= 1").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return w.withColumns({f"{name}_0": pad + F.col(name) * spacing, f"{name}_1": pad + F.col(name) * spacing + size}).drop("_n")


def openings(walls: DataFrame, bay: float, storey: float, width: float, height: float) -> DataFrame:
    """(wall, column, row, column_0, column_1, row_0, row_1) of the openings of walls (wall, width, height)."""
    return bands(bands(walls, "width", bay, width, "column"), "height", storey, height, "row").select("wall", "column", "row", "column_0", "column_1", "row_0", "row_1")


def punched(walls: DataFrame, opens: DataFrame) -> DataFrame:
    """(wall, x0, x1, y0, y1, open): a wall cut along the sides of its openings; cells cover it exactly once."""

    def cuts(extent: str, axis: str) -> DataFrame:
        ends = walls.select("wall", F.explode(F.array(F.lit(0.0), F.col(extent))).alias("c"))
        sides = opens.select("wall", F.explode(F.array(f"{axis}_0", f"{axis}_1")).alias("c"))
        c = ends.union(sides).distinct().withColumn("n", F.lead("c").over(Window.partitionBy("wall").orderBy("c")))
        return c.where("n IS NOT NULL")

    x = cuts("width", "column").select("wall", F.col("c").alias("x0"), F.col("n").alias("x1"))
    y = cuts("height", "row").select("wall", F.col("c").alias("y0"), F.col("n").alias("y1"))
    cells = x.join(y, "wall")
    hit = opens.select("wall", F.col("column_0").alias("x0"), F.col("row_0").alias("y0"), F.lit(True).alias("open"))
    return cells.join(hit, ["wall", "x0", "y0"], "left").withColumn("open", F.coalesce("open", F.lit(False)))


def cost(params: Column) -> Column:
    """How many numbers a program of rings and scalars (ring: array of points, others: map) has."""
    return F.size(params["ring"]) * 2 + F.size(F.map_keys(params["others"]))
