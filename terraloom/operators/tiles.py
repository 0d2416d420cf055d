"""Tiles: boxes with a count of points, and areas asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def intersects(box: Box) -> Column:
    """Whether a tile's box meets another one; shared edges count."""
    x0, y0, x1, y1 = box
    return (F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0)


def density(tiles: DataFrame) -> DataFrame:
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return tiles.withColumn("density", F.when(area > 0, F.col("points") / area).otherwise(F.lit(0.0)))


def query(tiles: DataFrame, box: Box) -> DataFrame:
    """Tiles that meet the box with their rank, densest first."""
    from pyspark.sql import Window

    hit = density(tiles.where(intersects(box)))
    return hit.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("density"), "tile_id")))


def around(tiles: DataFrame, x: float, y: float, size: float) -> DataFrame:
    return query(tiles, (x - size / 2, y - size / 2, x + size / 2, y + size / 2))


def summary(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.count(F.lit(1)).alias("tiles"), F.sum("points").alias("points"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def coverage(tiles: DataFrame, box: Box, samples: int = 64) -> DataFrame:
    """One row, coverage: the share of a grid of samples by samples points over the box, its edges included, that some tile holds."""
    x0, y0, x1, y1 = box
    n = samples - 1
    spark = tiles.sparkSession
    ids = F.col("id")
    grid = spark.range(samples * samples).select(ids.alias("s"), (F.lit(x0) + F.floor(ids / samples) * ((x1 - x0) / n)).alias("x"), (F.lit(y0) + F.pmod(ids, F.lit(samples)) * ((y1 - y0) / n)).alias("y"))
    near = tiles.where(intersects(box)).select("minx", "miny", "maxx", "maxy")
    hit = grid.join(near, (F.col("x") >= F.col("minx")) & (F.col("x") <= F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") <= F.col("maxy")), "left_semi")
    return hit.agg((F.count(F.lit(1)) / (samples * samples)).alias("coverage"))


def nearest_first(tiles: DataFrame, x: float, y: float) -> DataFrame:
    """Tiles with the distance of their centre and their rank by it."""
    from pyspark.sql import Window

    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    d = tiles.withColumn("distance", F.sqrt((cx - x) ** 2 + (cy - y) ** 2))
    return d.withColumn("rank", F.row_number().over(Window.orderBy("distance", "tile_id")))


def parse_area(text: Column) -> dict[str, Column]:
    """'x,y,size' as a centred box; null where it isn't three numbers."""
    p = F.split(text, ",")
    x, y, s = (F.try_element_at(p, F.lit(i)).try_cast("double") for i in (1, 2, 3))
    return {"minx": x - s / 2, "miny": y - s / 2, "maxx": x + s / 2, "maxy": y + s / 2}


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes (path) of a level-of-detail tree that no other path continues: all proper prefixes are cut and joined away."""
    inner = nodes.select(F.explode(F.expr("transform(sequence(1, greatest(length(path) - 1, 1)), n -> substring(path, 1, n))")).alias("p"), "path").where("p <> path").select("p").distinct()
    return nodes.join(inner, nodes["path"] == inner["p"], "left_anti")
