"""Facade imagery over pixels (image, r, c, value): blurs, profiles, phases, tiles and what doesn't repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import robust_centre


def box_mean(pixels: DataFrame, value: str, radius: int) -> DataFrame:
    """pixels with mean: the mean of the pixels that exist within radius, rows then columns."""
    rows = Window.partitionBy("image", "c").orderBy("r").rangeBetween(-radius, radius)
    cols = Window.partitionBy("image", "r").orderBy("c").rangeBetween(-radius, radius)
    p = pixels.withColumns({"_s": F.sum(value).over(rows), "_n": F.count(value).over(rows)})
    # a pixel that is missing has no row of its own, so sums of a column may lack it: columns are summed over rows that exist
    if radius:
        near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)])
        told = pixels.select("image", F.explode(near).alias("o"), "r", "c", F.col(value).alias("_v"))
        told = told.groupBy("image", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c")).agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
        return pixels.join(told, ["image", "r", "c"]).withColumn("mean", F.col("_s") / F.col("_n")).drop("_s", "_n")
    return p.withColumn("mean", F.sum("_s").over(cols) / F.sum("_n").over(cols)).drop("_s", "_n")


def delight(pixels: DataFrame, value: str, radius: int) -> DataFrame:
    """pixels with slow changes of light divided out: value times the image's mean over the local mean."""
    whole = pixels.groupBy("image").agg((F.sum(value) / F.count(value)).alias("_g"))
    p = box_mean(pixels, value, radius).join(whole, "image")
    return p.withColumn(value, F.col(value) * F.col("_g") / F.greatest(F.col("mean"), F.lit(1e-6))).drop("_g", "mean")


def profile(pixels: DataFrame, axis: str, value: str) -> DataFrame:
    """(image, axis, mean): the mean of value along one axis."""
    return pixels.groupBy("image", axis).agg((F.sum(value) / F.count(value)).alias("mean"))


def phase(pixels: DataFrame, axis: str, value: str, period: int) -> DataFrame:
    """(image, phase, mean): where in a period the mean is highest; of equal ones the first."""
    m = pixels.groupBy("image", F.pmod(F.col(axis), F.lit(period)).cast("long").alias("phase")).agg((F.sum(value) / F.count(value)).alias("mean"))
    best = m.groupBy("image").agg(F.min(F.struct((-F.round("mean", 9)).alias("k"), "phase", "mean")).alias("b"))
    return best.select("image", F.col("b.phase").alias("phase"), F.col("b.mean").alias("mean"))


def tile(pixels: DataFrame, height: int, width: int, rows: int, columns: int) -> DataFrame:
    """An image of rows by columns filled with copies of pixels' height by width."""
    spots = lambda at, size, total: F.filter(F.transform(F.sequence(F.lit(0), F.lit(-(-total // size) - 1)), lambda k: F.col(at) + k * size), lambda x: x < total)
    p = pixels.withColumn("_r", F.explode(spots("r", height, rows))).withColumn("_c", F.explode(spots("c", width, columns)))
    return p.select("image", F.col("_r").cast("long").alias("r"), F.col("_c").cast("long").alias("c"), "value")


def damaged(pixels: DataFrame, value: str, height: int, width: int, sigma: float) -> DataFrame:
    """pixels that differ from the same place of the other cells of a grid by over sigma robust deviations."""
    p = pixels.withColumns({"_cr": F.pmod(F.col("r"), F.lit(height)), "_cc": F.pmod(F.col("c"), F.lit(width))})
    usual = robust_centre(p, ["_cr", "_cc"], value)
    met = p.join(usual, ["_cr", "_cc"])
    return met.where(F.abs(F.col(value) - F.col("centre")) > sigma * F.greatest(F.col("spread"), F.lit(1e-6))).drop("_cr", "_cc", "centre", "spread")
