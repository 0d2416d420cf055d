"""Ordered analytics: runs, periods, sliding sums, thinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def longest_run(rows: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """(group, first, last, length) of the longest run of consecutive orders whose flag holds; the first of equal ones."""
    on = rows.where(F.col(flag)).withColumn("_r", F.col(order) - F.row_number().over(Window.partitionBy(group).orderBy(order)))
    runs = on.groupBy(group, "_r").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))
    best = runs.groupBy(group).agg(F.min(F.struct((-F.col("length")).alias("l"), "first", "last")).alias("b"))
    return best.select(group, F.col("b.first").alias("first"), F.col("b.last").alias("last"), (-F.col("b.l")).alias("length"))


def period(rows: DataFrame, group: str, order: str, value: str, low: int, high: int) -> DataFrame:
    """(group, lag, strength): the lag in [low, high) at which the differenced signal agrees most with itself."""
    w = Window.partitionBy(group).orderBy(order)
    d = rows.select(group, order, (F.col(value) - F.lag(value).over(w)).alias("d")).where("d IS NOT NULL")
    energy = d.groupBy(group).agg(F.sum(F.col("d") * F.col("d")).alias("e"))
    shifted = d.select(group, F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("lag"), F.col(order).alias("_o"), F.col("d").alias("d2")).withColumn(order, F.col("_o") - F.col("lag")).drop("_o")
    prod = d.join(shifted, [group, order]).groupBy(group, "lag").agg(F.sum(F.col("d") * F.col("d2")).alias("p")).join(energy, group)
    r = prod.withColumn("strength", F.round(F.when(F.col("e") > 0, F.col("p") / F.col("e")).otherwise(F.lit(0.0)), 9))
    best = r.groupBy(group).agg(F.min(F.struct((-F.col("strength")).alias("s"), "lag")).alias("b"))
    return best.select(group, F.col("b.lag").alias("lag"), (-F.col("b.s")).alias("strength"))


def best_window(rows: DataFrame, group: str, at: str, value: str, width: float) -> DataFrame:
    """(group, start, total): the start of the window [start, start + width] with the largest sum of value."""
    w = Window.partitionBy(group).orderBy(at).rangeBetween(0, width)
    s = rows.select(group, at, F.sum(value).over(w).alias("t"))
    best = s.groupBy(group).agg(F.min(F.struct((-F.col("t")).alias("t"), F.col(at).alias("start"))).alias("b"))
    return best.select(group, F.col("b.start").alias("start"), (-F.col("b.t")).alias("total"))


def every_nth(rows: DataFrame, order: list[str], n: int, group: str | None = None) -> DataFrame:
    """Each nth row in a stable order, the first one included. With a group the order runs within it, in parallel."""
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % n == 0).drop("_n")


def robust_centre(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, centre, spread): median and 1.4826 times the median absolute deviation of each group."""
    m = rows.groupBy(*keys).agg(F.median(value).alias("centre"))
    off = rows.join(m, keys).groupBy(*keys, "centre").agg((F.median(F.abs(F.col(value) - F.col("centre"))) * 1.4826).alias("spread"))
    return off


def smooth_mean(rows: DataFrame, group: str, order: str, value: str, radius: int) -> DataFrame:
    """rows with smooth: the mean over the rows within radius of each row's order."""
    w = Window.partitionBy(group).orderBy(order).rangeBetween(-radius, radius)
    return rows.withColumn("smooth", F.sum(value).over(w) / F.count(value).over(w))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n): events of a key without a gap as long as `gap`."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
