"""Catalogues: names of published tiles, layers and who may read them, and what features and acquisitions hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def _digits(value: Column, n: int) -> Column:
    return F.lpad(F.pmod(value, F.lit(10**n)).cast("string"), n, "0")


def kilometre_code(x: Column, y: Column) -> Column:
    """The last two digits of the kilometre eastward and northward: 565648, 5934179 is '6534'."""
    return F.concat(_digits(g.cell(x, 1000.0), 2), _digits(g.cell(y, 1000.0), 2))


def terrain_file(x: Column, y: Column, zone: int = 32, size: int = 2000) -> Column:
    """Name of the terrain file that covers a point, by the kilometre of its tile's corner; the name's form is a fixed value."""
    east, north = (g.cell(c, float(size)) * (size // 1000) for c in (x, y))
    return F.concat(F.lit(f"DGM1_{zone}"), east.cast("string"), F.lit("_"), north.cast("string"), F.lit("_2_FHH.xyz"))


#: fixed value: what eastings of the mesh tiles' coordinate system start with
EASTING_PREFIX = 25_000_000


def mesh_code(x: Column, y: Column) -> Column:
    """Code of the 2 km mesh tile that covers a point: three digits of the kilometre northward, then eastward."""
    east = F.floor(F.when(x > EASTING_PREFIX, x - EASTING_PREFIX).otherwise(x))
    return F.concat(*[_digits(g.cell(c, 2000.0) * 2, 3) for c in (y, east)])


def subtile_origin(path: Column) -> Column:
    """(east, north) of a subtile's corner, from the first two numbers of 6 or 7 digits in its file name; null without two."""
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\.[^.]*$", "")
    found = F.regexp_extract_all(stem, F.lit(r"(\d{6,7})"), F.lit(1))
    north, east = (F.element_at(found, k).cast("long") for k in (1, 2))
    return F.when(F.size(found) >= 2, F.struct(F.when(east < EASTING_PREFIX, east + EASTING_PREFIX).otherwise(east).alias("east"), north.alias("north")))


def epoch_year(value: Column) -> Column:
    """A year that is nothing but digits; null for any other epoch."""
    return F.when(value.rlike(r"^\d+$"), value.try_cast("int"))


def routed(layers: DataFrame, directories: dict[str, str], withheld: tuple[str, ...] = ("truth", "hidden_truth"), least: int = 2) -> DataFrame:
    """layers (role, epoch, independence, perhaps admitted) with year, withheld, directory and validator.

    What must not reach a scored run goes to 'truth', whatever its role: roles that are `withheld`, and layers that
    are not admitted. A validator is a layer made from other measurements, of independence `least` or more. A role
    without a directory has null.
    """
    names = F.create_map(*[F.lit(x) for item in directories.items() for x in item])
    hidden = F.col("role").isin(*withheld)
    if "admitted" in layers.columns:
        hidden = hidden | ~F.coalesce("admitted", F.lit(False))
    out = layers.withColumns({"year": epoch_year(F.col("epoch")), "withheld": F.coalesce(hidden, F.lit(False)), "validator": F.coalesce(F.col("independence") >= least, F.lit(False))})
    return out.withColumn("directory", F.when(F.col("withheld"), "truth").otherwise(F.try_element_at(names, F.col("role"))))


def layers_for(layers: DataFrame, role: str, roles: tuple[str, ...]) -> DataFrame:
    if role not in roles:
        raise ValueError(f"unknown role {role!r}; known: {', '.join(roles)}")
    return layers.where(F.col("role") == role)


def contents(features: DataFrame) -> DataFrame:
    """(what, name, n) of features (geometry_type, properties as a map): how many have each geometry ('null': none) and each property."""
    kinds = features.select(F.lit("geometry").alias("what"), F.coalesce("geometry_type", F.lit("null")).alias("name"))
    fields = features.select(F.lit("property").alias("what"), F.explode(F.map_keys("properties")).alias("name"))
    return kinds.union(fields).groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


def acquisitions(tiles: DataFrame) -> DataFrame:
    """One row of tiles (acquisition, minx, miny, maxx, maxy): how many, of which acquisitions (a catalogue has few), and their bounds."""
    return tiles.agg(F.count(F.lit(1)).alias("tiles"), F.array_sort(F.collect_set("acquisition")).alias("acquisitions"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def first_number(attributes: Column, *keys: str) -> Column:
    """The first of the keys' values in a map of strings that is a number."""
    return F.coalesce(*[F.try_element_at(attributes, F.lit(k)).try_cast("double") for k in keys])
