"""Raster operators over sparse relations (i, j, value): stencils run on dense tiles with a halo, or are joins by cell."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

IJ = ["i", "j"]


def accumulate(points: DataFrame, cell: float, value: str = "z") -> DataFrame:
    """min, max, mean and count of value in each occupied cell."""
    at = points.select(g.cell(F.col("x"), cell).alias("i"), g.cell(F.col("y"), cell).alias("j"), F.col(value).alias("v"))
    return at.groupBy(*IJ).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (F.sum("v") / F.count("v")).alias("mean"), F.count("v").alias("n"))


def to_cell(points: DataFrame, cell: float, ni: int, nj: int) -> DataFrame:
    """points with i, j clamped into a raster of ni by nj cells."""
    return points.withColumns({"i": g.clamp(g.cell(F.col("x"), cell), F.lit(0), F.lit(ni - 1)), "j": g.clamp(g.cell(F.col("y"), cell), F.lit(0), F.lit(nj - 1))})


#: Cells along the side of a tile.
TILE = 256


def tiled(raster: DataFrame, columns: list[str], halo: int, results: dict[str, str], f) -> DataFrame:
    """raster with results (name -> type), computed by f on dense tiles: one shuffle, whatever f's stencil.

    Each cell goes to its tile, and to the tiles next to it that have it in their halo. f takes the
    columns as arrays over the tile and its halo, NaN where there is no cell or no value, and gives
    an array for each result; only the tile's own cells are returned. So f must not look farther than halo.
    """
    if not 0 <= halo <= TILE:
        raise ValueError(f"a halo of {halo} cells is wider than a tile")
    kept = [c for c in raster.columns if c not in results]
    types = {n: t for n, t in raster.dtypes if n in kept}
    side = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    at = raster.select("*", F.floor(F.col("i") / TILE).cast("long").alias("_ti"), F.floor(F.col("j") / TILE).cast("long").alias("_tj"))
    sent = at.select("*", F.explode(side).alias("_o"))
    for axis, tile, off in (("i", "_ti", "_o.a"), ("j", "_tj", "_o.b")):
        inside = F.col(axis) - F.col(tile) * TILE
        sent = sent.where((F.col(off) == 0) | ((F.col(off) < 0) & (inside < halo)) | ((F.col(off) > 0) & (inside >= TILE - halo)))
    sent = sent.select(*raster.columns, (F.col("_ti") + F.col("_o.a")).alias("_ti"), (F.col("_tj") + F.col("_o.b")).alias("_tj"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low_i, low_j = int(rows["_ti"].iloc[0]) * TILE - halo, int(rows["_tj"].iloc[0]) * TILE - halo
        i, j = rows["i"].to_numpy(np.int64) - low_i, rows["j"].to_numpy(np.int64) - low_j
        dense = []
        for c in columns:
            a = np.full((TILE + 2 * halo, TILE + 2 * halo), np.nan)
            a[i, j] = rows[c].to_numpy(float, na_value=np.nan)
            dense.append(a)
        own = (i >= halo) & (i < halo + TILE) & (j >= halo) & (j < halo + TILE)
        out = rows.loc[own, kept]
        if len(out):
            for name, a in zip(results, f(*dense), strict=True):
                value = a[i[own], j[own]]
                out[name] = pd.array(value != 0, "boolean").copy() if results[name] == "boolean" else value
                out.loc[np.isnan(value), name] = None
        return out if len(out) else out.assign(**dict.fromkeys(results))

    schema = ", ".join(f"`{n}` {t}" for n, t in (types | results).items())
    done = sent.groupBy("_ti", "_tj").applyInPandas(run, schema)
    return done.select(*raster.columns, *[n for n in results if n not in raster.columns])


def slide(a: np.ndarray, radius: int, f=np.fmin) -> np.ndarray:
    """f over the square of radius around each cell of a; f is np.fmin or np.fmax, which pass over NaN."""
    for axis in (0, 1):
        m = np.pad(a, [(radius, radius) if x == axis else (0, 0) for x in (0, 1)], constant_values=np.nan)
        m, width = np.moveaxis(m, axis, 0), 1
        while width < 2 * radius + 1:
            step = min(width, 2 * radius + 1 - width)
            m, width = f(m[:-step], m[step:]), width + step
        a = np.moveaxis(m, 0, axis)
    return a


def _where(there: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(there), np.nan, a)


def erode(raster: DataFrame, column: str, radius: int) -> DataFrame:
    """Grey erosion by a square: smallest value within radius. Missing cells and values don't count, and stay missing."""
    return tiled(raster, [column], radius, {column: "double"}, lambda a: [_where(a, slide(a, radius))])


def dilate(raster: DataFrame, column: str, radius: int) -> DataFrame:
    """Grey dilation by a square: largest value within radius."""
    return tiled(raster, [column], radius, {column: "double"}, lambda a: [_where(a, slide(a, radius, np.fmax))])


def opened(raster: DataFrame, column: str, radius: int) -> DataFrame:
    """Erosion, then dilation of the cells there are."""
    return tiled(raster, [column], 2 * radius, {column: "double"}, lambda a: [_where(a, slide(_where(a, slide(a, radius)), radius, np.fmax))])


def ground_mask(raster: DataFrame, cell: float, column: str = "lo", max_window: float = 24.0, slope: float = 0.25, initial: float = 0.35, most: float = 4.0) -> DataFrame:
    """raster with ground: cells that no opening by a growing window lowers by more than the window allows.

    The progressive morphological filter (Zhang et al. 2003); windows double up to max_window, and
    all of them run on a tile whose halo is twice their sum.
    """
    radii = []
    while (2 ** len(radii)) * cell <= max_window:
        radii.append(2 ** len(radii))

    def run(a: np.ndarray) -> list[np.ndarray]:
        surface, ground = a, np.ones(a.shape, bool)
        for radius in radii:
            low = _where(a, slide(_where(a, slide(surface, radius)), radius, np.fmax))
            ground &= ~(surface - low > min(initial + slope * 2 * radius * cell, most))
            surface = low
        return [_where(a, ground.astype(float))]

    return tiled(raster, [column], 2 * sum(radii), {"ground": "boolean"}, run)


def box_mean(raster: DataFrame, column: str, radius: int = 1) -> DataFrame:
    """Mean over the cells that exist within radius."""

    def run(a: np.ndarray) -> list[np.ndarray]:
        there = ~np.isnan(a)
        total, n = np.where(there, a, 0.0), there.astype(float)
        for axis in (0, 1):
            total, n = (sum(np.roll(x, k, axis) for k in range(-radius, radius + 1)) for x in (total, n))
        with np.errstate(invalid="ignore"):
            return [np.where(n > 0, total / n, np.nan)]

    return tiled(raster, [column], 2 * radius, {column: "double"}, run)


def _around(radius: int, kind: str = "square") -> Column:
    r = range(-radius, radius + 1)
    keep = {"square": lambda a, b: True, "cross": lambda a, b: abs(a) + abs(b) <= radius, "disc": lambda a, b: a * a + b * b <= radius * radius}[kind]
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in r for b in r if keep(a, b)])


def sent(raster: DataFrame, columns: list[str], radius: int = 1, kind: str = "square") -> DataFrame:
    """Each cell's columns at each of its neighbours (and itself), with the offset it came over."""
    out = raster.select(*IJ, *columns, F.explode(_around(radius, kind)).alias("o"))
    return out.select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "o.di", "o.dj", *columns)


def majority(raster: DataFrame, column: str = "c", void: int = 255) -> DataFrame:
    """The commonest class of the 3x3 cells around each cell; of equal ones the smallest; void stays and doesn't vote."""
    votes = sent(raster.where(F.col(column) != void), [column]).groupBy(*IJ, column).agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy(*IJ).agg(F.min(F.struct((-F.col("v")).alias("v"), F.col(column).alias("c"))).alias("b")).select(*IJ, F.col("b.c").alias("_m"))
    return raster.join(best, IJ, "left").withColumn(column, F.when(F.col(column) == void, F.lit(void)).otherwise(F.coalesce("_m", column))).drop("_m")


def fill_voids(raster: DataFrame, column: str = "c", void: int = 255, least: int = 3, rounds: int = 2) -> DataFrame:
    """Void cells with at least `least` of 4 neighbours of a class take the highest of them; no wrap at the border."""
    for _ in range(rounds):
        near = sent(raster.where(F.col(column) != void), [column], 1, "cross").where("di <> 0 OR dj <> 0").groupBy(*IJ).agg(F.count(F.lit(1)).alias("_n"), F.max(column).alias("_c"))
        raster = raster.join(near, IJ, "left").withColumn(column, F.when((F.col(column) == void) & (F.col("_n") >= least), F.col("_c")).otherwise(F.col(column))).drop("_n", "_c")
    return raster


def vote_classes(points: DataFrame, cell: float, kinds: dict[str, int], least: int = 2, void: int = 255) -> DataFrame:
    """(i, j, c): the class of most points of each cell, in the order of kinds where equal, void under `least` votes.
    points has x, y and a column `kind`; kinds maps what counts to its code, first wins."""
    at = points.select(g.cell(F.col("x"), cell).alias("i"), g.cell(F.col("y"), cell).alias("j"), "kind")
    sums = at.groupBy(*IJ).agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"_{k}") for k in kinds])
    top = F.greatest(*[F.col(f"_{k}") for k in kinds]) if len(kinds) > 1 else F.col(f"_{next(iter(kinds))}")
    pick = reduce(lambda acc, k: acc.when(F.col(f"_{k}") == top, F.lit(kinds[k])), kinds, F.when(top < least, F.lit(void)))
    return sums.select(*IJ, pick.cast("int").alias("c"))


def distance_to_false(mask: DataFrame, limit: int = 15) -> DataFrame:
    """Chebyshev distance of each true cell to the nearest cell that is not in mask, at most limit.

    The distance is how often the cell survives erosion: one more for each radius whose square is full.
    """
    out = mask.select(*IJ).withColumn("_full", F.lit(1).cast("long")).withColumn("d", F.lit(1))
    for _ in range(limit - 1):
        # one more erosion: a cell survives if all nine around it are alive
        alive = out.where("_full = 1").select(*IJ)
        near = sent(alive, []).groupBy(*IJ).agg(F.count(F.lit(1)).alias("_k"))
        out = out.join(near, IJ, "left").withColumn("_full", ((F.col("_full") == 1) & (F.coalesce("_k", F.lit(0)) == 9)).cast("long")).withColumn("d", F.col("d") + F.col("_full").cast("int")).drop("_k")
    return out.drop("_full")


def distance_by_windows(mask: DataFrame, limit: int = 15) -> DataFrame:
    """The same as distance_to_false in one join: each missing cell next to mask tells its distance to all within limit."""
    border = sent(mask, []).select(*IJ).distinct().join(mask.select(*IJ), IJ, "left_anti")
    r = range(-limit, limit + 1)
    told = border.select(F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(max(abs(a), abs(b))).alias("d")) for a in r for b in r if a or b])).alias("o"), *IJ)
    least = told.select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), F.col("o.d").alias("d")).groupBy(*IJ).agg(F.min("d").alias("d"))
    return mask.select(*IJ).join(least, IJ, "left").withColumn("d", F.coalesce("d", F.lit(limit)))


def sample_bilinear(points: DataFrame, raster: DataFrame, column: str, cell: float) -> DataFrame:
    """points with `sample`: the four cells around each, weighted by nearness; missing cells have no weight."""
    fx, fy = F.col("x") / cell - 0.5, F.col("y") / cell - 0.5
    base = points.withColumns({"_i": F.floor(fx).cast("long"), "_j": F.floor(fy).cast("long")}).withColumns({"_u": fx - F.col("_i"), "_v": fy - F.col("_j")})
    for a in (0, 1):
        for b in (0, 1):
            r = raster.select((F.col("i") - a).alias("_i"), (F.col("j") - b).alias("_j"), F.col(column).cast("double").alias(f"_f{a}{b}"))
            base = base.join(r, ["_i", "_j"], "left")
    w = {f"{a}{b}": (F.col("_u") if a else 1 - F.col("_u")) * (F.col("_v") if b else 1 - F.col("_v")) for a in (0, 1) for b in (0, 1)}
    some = sum((F.when(F.col(f"_f{k}").isNotNull(), x).otherwise(F.lit(0.0)) for k, x in w.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(f"_f{k}") * x, F.lit(0.0)) for k, x in w.items()), F.lit(0.0))
    out = base.withColumn("sample", F.when(some >= 1e-6, value / some))
    return out.drop("_i", "_j", "_u", "_v", *[f"_f{k}" for k in w])


def corner_heights(raster: DataFrame, column: str) -> DataFrame:
    """Mean of the up to four cells that meet at each corner (i, j is the corner below cell i, j)."""
    told = raster.select(F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (0, 1) for b in (0, 1)])).alias("c"), F.col(column).alias("v"))
    return told.groupBy(F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg((F.sum("v") / F.count("v")).alias("height"))


def terrain_flags(raster: DataFrame, cell: float, steep: float = 0.35, edge_bit: int = 1, steep_bit: int = 2) -> DataFrame:
    """(i, j, ctx) of a raster (i, j, c, z): bits where a 4-neighbour has another class, and where the slope is steep."""
    near = sent(raster, ["c", "z"], 1, "cross").where("di <> 0 OR dj <> 0")
    met = raster.alias("a").join(near.select(*IJ, F.col("c").alias("nc"), F.col("z").alias("nz")), IJ)
    grown = met.groupBy(*IJ).agg(F.bit_or(F.when(F.col("c") != F.col("nc"), F.lit(edge_bit)).otherwise(F.lit(0)).bitwiseOR(F.when(F.abs(F.col("z") - F.col("nz")) / cell > steep, F.lit(steep_bit)).otherwise(F.lit(0)))).alias("ctx"))
    return raster.select(*IJ).join(grown, IJ, "left").withColumn("ctx", F.coalesce("ctx", F.lit(0)))


def block_mean(raster: DataFrame, column: str, factor: int) -> DataFrame:
    """Mean of each block of factor by factor cells, over the cells that exist."""
    at = {c: F.floor(F.col(c) / factor).cast("long") for c in IJ}
    return raster.groupBy(*[v.alias(k) for k, v in at.items()]).agg((F.sum(column) / F.count(column)).alias(column))


def inverse_distance(cells: DataFrame, anchors: DataFrame, value: str = "z") -> DataFrame:
    """cells (x, y) with the mean of the anchors' value, weighted by 1 / max(d^2, 1). anchors is a small table."""
    a = anchors.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(value).alias("_z"))
    w = 1 / F.greatest((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2, F.lit(1.0))
    return cells.crossJoin(a).groupBy("x", "y").agg((F.sum(w * F.col("_z")) / F.sum(w)).alias(value))


def fill_holes(raster: DataFrame, column: str, spec: DataFrame, sweeps: int = 64) -> DataFrame:
    """The dense raster of spec (one row: ni, nj) with missing cells relaxed from the mean by 4-neighbour sweeps.

    A raster is a few million cells at most; it is relaxed as one array by one Arrow function.
    """
    import numpy as np
    import pandas as pd

    sized = raster.select(*IJ, column).crossJoin(spec)

    def relax(rows: pd.DataFrame) -> pd.DataFrame:
        ni, nj = int(rows["ni"].iloc[0]), int(rows["nj"].iloc[0])
        field = np.full((ni, nj), np.nan)
        inside = rows["i"].between(0, ni - 1) & rows["j"].between(0, nj - 1)
        field[rows["i"][inside], rows["j"][inside]] = rows[column][inside]
        hole = np.isnan(field)
        field[hole] = np.nanmean(field) if not hole.all() else np.nan
        for _ in range(sweeps if hole.any() else 0):
            p = np.pad(field, 1, mode="edge")
            field = np.where(hole, (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4, field)
        i, j = np.indices(field.shape)
        return pd.DataFrame({"i": i.ravel().astype("int64"), "j": j.ravel().astype("int64"), column: field.ravel()})

    return sized.groupBy("ni", "nj").applyInPandas(relax, f"i long, j long, `{column}` double")


def disc_cells(samples: DataFrame, cell: float, radius: float) -> DataFrame:
    """(i, j) of the cells whose centre lies within radius of a sample (x, y): the stamp of a round brush."""
    reach = int(radius // cell) + 1
    at = samples.select("x", "y", g.cell(F.col("x"), cell).alias("_i"), g.cell(F.col("y"), cell).alias("_j"), F.explode(_around(reach)).alias("o"))
    at = at.select("x", "y", (F.col("_i") + F.col("o.di")).alias("i"), (F.col("_j") + F.col("o.dj")).alias("j"))
    return at.where(((F.col("i") + 0.5) * cell - F.col("x")) ** 2 + ((F.col("j") + 0.5) * cell - F.col("y")) ** 2 <= radius * radius).select(*IJ).distinct()


def promote(raster: DataFrame, mask: DataFrame, column: str = "c", of: int = 0, to: int = 1) -> DataFrame:
    """raster with cells of mask promoted from class `of` to `to`; other classes and void stay."""
    hit = mask.select(*IJ).distinct().withColumn("_hit", F.lit(True))
    return raster.join(hit, IJ, "left").withColumn(column, F.when(F.col("_hit") & (F.col(column) == of), F.lit(to)).otherwise(F.col(column))).drop("_hit")


def smooth_roads(raster: DataFrame, column: str = "z", kind: str = "c", road: int = 1, passes: int = 2) -> DataFrame:
    """raster (i, j, column, kind) with `smooth`: on roads the mean of means (3x3, `passes` times) of the heights around, elsewhere
    the height. Cells that are missing have no part in a mean."""
    blurred = raster.select("i", "j", F.col(column).alias("_h"))
    for _ in range(passes):
        blurred = box_mean(blurred, "_h").select("i", "j", "_h")
    on = F.col(kind) == road
    return raster.join(blurred, ["i", "j"], "left").withColumn("smooth", F.when(on, F.col("_h")).otherwise(F.col(column))).drop("_h")


def centres(raster: DataFrame, cell: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """raster with cx, cy, the middle of each cell."""
    return raster.withColumns({f"c{c}": (F.col(n) + 0.5) * cell + o for c, n, o in zip("xy", "ij", origin, strict=True)})
