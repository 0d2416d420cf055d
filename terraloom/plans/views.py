"""Points, rings, tiles and planes derived from the driver's tables, as DataFrames and as the same SQL.

Coordinates are multiples of a power of two, so sums of them are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without a key, one for each line item."""
    li = table(spark, sf_dir, "lineitem")
    c = F.col
    semantic = F.when((c("l_returnflag") == "A") & (c("l_linestatus") == "F"), 1).when(c("l_returnflag") == "N", 3).when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), 5).otherwise(0)
    return li.select(
        ((c("l_partkey") % 200).cast("double") * 0.25).alias("x"), ((c("l_suppkey") % 100).cast("double") * 0.5).alias("y"), (c("l_quantity") * 0.25).alias("z"),
        (c("l_discount") + 0.0).alias("intensity"), c("l_linenumber").cast("int").alias("num_returns"), semantic.alias("semantic"),
    )


POINTS = """points AS (SELECT CAST(l_partkey % 200 AS DOUBLE) * 0.25 AS x, CAST(l_suppkey % 100 AS DOUBLE) * 0.5 AS y, l_quantity * 0.25 AS z,
  l_discount + 0.0 AS intensity, CAST(l_linenumber AS INT) AS num_returns,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 WHEN l_returnflag = 'N' THEN 3 WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 5 ELSE 0 END AS semantic FROM lineitem)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a key, one for each order."""
    o = table(spark, sf_dir, "orders")
    c = F.col
    return o.select(
        c("o_orderkey").alias("id"), ((c("o_custkey") % 160).cast("double") * 0.25).alias("x"), ((c("o_orderkey") % 97).cast("double") * 0.5).alias("y"),
        (F.floor(c("o_totalprice") / 1000).cast("double") * 0.25).alias("z"), c("o_orderpriority").alias("kind"),
    )


SITES = """sites AS (SELECT o_orderkey AS id, CAST(o_custkey % 160 AS DOUBLE) * 0.25 AS x, CAST(o_orderkey % 97 AS DOUBLE) * 0.5 AS y,
  floor(o_totalprice / 1000) * 0.25 AS z, o_orderpriority AS kind FROM orders)"""

_CORNERS = ((0, 1.0, 1.0), (1, 7.0, 1.5), (2, 5.0, 6.5), (3, 2.0, 5.0), (4, 1.0, 1.0))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed ring of four corners for each nation, on a grid of 8 m cells; every third one runs clockwise."""
    n = table(spark, sf_dir, "nation")
    corners = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(x).alias("x"), F.lit(y).alias("y")) for o, x, y in _CORNERS])).alias("c")
    k = F.col("n_nationkey").cast("long")
    r = n.select(k.alias("ring_id"), corners)
    order = F.when(F.col("ring_id") % 3 == 0, 4 - F.col("c.o")).otherwise(F.col("c.o"))
    return r.select("ring_id", order.cast("int").alias("ord"), ((F.col("ring_id") % 5) * 8.0 + F.col("c.x")).alias("px"), (F.floor(F.col("ring_id") / 5) * 8.0 + F.col("c.y")).alias("py"))


RINGS = f"""rings AS (SELECT CAST(n_nationkey AS BIGINT) AS ring_id, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 4 - o ELSE o END AS INT) AS ord,
  (n_nationkey % 5) * 8.0::DOUBLE + cx AS px, floor(n_nationkey / 5.0) * 8.0::DOUBLE + cy AS py
  FROM nation, (VALUES {", ".join(f"({o}, {x}::DOUBLE, {y}::DOUBLE)" for o, x, y in _CORNERS)}) corners(o, cx, cy))"""
EDGES = """edges AS (SELECT * FROM (SELECT ring_id, ord, px AS x1, py AS y1, lead(px) OVER w AS x2, lead(py) OVER w AS y2 FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY ord)) WHERE x2 IS NOT NULL)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the sites, by blocks of 500 order keys."""
    s = sites(spark, sf_dir).withColumn("tile_id", F.floor(F.col("id") / 500).cast("long"))
    return s.groupBy("tile_id").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"), F.count(F.lit(1)).alias("points"))


TILES = """tiles AS (SELECT CAST(floor(id / 500.0) AS BIGINT) AS tile_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, count(*) AS points
  FROM sites GROUP BY 1)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned plates with a unit normal, one for each supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    axis = k % 3
    x, y, z = ((k * 7) % 61).cast("double"), ((k * 13) % 47).cast("double"), ((k * 5) % 11).cast("double")
    wide = lambda a, w: F.when(axis == a, F.lit(0.25)).otherwise(F.lit(w))
    return s.select(
        k.cast("long").alias("id"), x.alias("minx"), y.alias("miny"), z.alias("minz"), (x + wide(0, 4.0)).alias("maxx"), (y + wide(1, 5.0)).alias("maxy"), (z + wide(2, 3.0)).alias("maxz"),
        *[F.when(axis == a, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"n{c}") for a, c in enumerate("xyz")],
    )


PLANES = """planes AS (SELECT CAST(k AS BIGINT) AS id, x AS minx, y AS miny, z AS minz,
  x + CASE WHEN k % 3 = 0 THEN 0.25 ELSE 4.0 END::DOUBLE AS maxx, y + CASE WHEN k % 3 = 1 THEN 0.25 ELSE 5.0 END::DOUBLE AS maxy, z + CASE WHEN k % 3 = 2 THEN 0.25 ELSE 3.0 END::DOUBLE AS maxz,
  CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS nx, CASE WHEN k % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS ny, CASE WHEN k % 3 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS nz
  FROM (SELECT s_suppkey AS k, ((s_suppkey * 7) % 61)::DOUBLE AS x, ((s_suppkey * 13) % 47)::DOUBLE AS y, ((s_suppkey * 5) % 11)::DOUBLE AS z FROM supplier))"""

FLAGS = ("edge", "corner", "ground", "eave", "street", "sheltered", "window_near", "measured")
_RULES = (
    # ordinal, role, all, any, none, semantic, priority, material
    (0, "*", 0, 0, 0, None, 0, "render"),
    (1, "structure.wall", 0, 0, 0, None, 0, "brick"),
    (2, "structure.wall", 1, 0, 0, None, 0, "stone"),
    (3, "structure.wall", 0, 6, 8, None, 0, "plinth"),
    (4, "structure", 16, 0, 0, None, 1, "ashlar"),
    (5, "structure.roof", 0, 0, 0, None, 0, "slate"),
    (6, "structure.roof.flat", 0, 0, 4, None, 0, "bitumen"),
    (7, "ground", 0, 0, 0, "Brand#11", 0, "gravel"),
    (8, "ground.road", 0, 3, 0, None, 0, "asphalt"),
    (9, "ground.road", 0, 0, 0, None, -1, "cobble"),
)
MATERIALS = ("render", "brick", "stone", "plinth", "ashlar", "slate", "bitumen", "gravel", "asphalt", "cobble")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_RULES), "ordinal int, role string, mask_all long, mask_any long, mask_none long, semantic string, priority int, material string")


def _literal(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


RULES = "rules(ordinal, role, mask_all, mask_any, mask_none, semantic, priority, material) AS (VALUES " + ", ".join(f"({', '.join(map(_literal, r))})" for r in _RULES) + ")"


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i) for i, m in enumerate(MATERIALS)], "id string, index int")


ROLES = ("structure.wall", "structure.roof.flat", "structure.roof.pitched", "ground.road", "ground", "vegetation.canopy")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface for each part: its role, flags and class."""
    p = table(spark, sf_dir, "part")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("p_partkey") % len(ROLES) + 1).cast("int"))
    return p.select(F.col("p_partkey").cast("long").alias("id"), role.alias("role"), ((F.col("p_partkey") * 37) % 256).cast("long").alias("ctx"), F.col("p_brand").alias("semantic"))


REQUESTS = "requests AS (SELECT CAST(p_partkey AS BIGINT) AS id, [" + ", ".join(f"'{r}'" for r in ROLES) + f"][CAST(p_partkey % {len(ROLES)} + 1 AS INT)] AS role, CAST((p_partkey * 37) % 256 AS BIGINT) AS ctx, p_brand AS semantic FROM part)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of the lowest points on cells of 1 m, with a class by the cell."""
    p = points(spark, sf_dir)
    r = p.groupBy(F.floor("x").cast("long").alias("i"), F.floor("y").cast("long").alias("j")).agg(F.min("z").alias("z"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("c", F.when((F.col("i") * 7 + F.col("j") * 3) % 11 < 2, 255).otherwise((F.col("n") % 3).cast("int")).cast("int"))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest sites on cells of 0.2 m: finer than the sites lie, so that most cells are missing."""
    s = sites(spark, sf_dir)
    return s.groupBy(F.floor(F.col("x") / 0.2 - 100).cast("long").alias("i"), F.floor(F.col("y") / 0.2 - 100).cast("long").alias("j")).agg(F.min("z").alias("z"))


HOLED = """holed AS (SELECT CAST(floor(x / 0.2::DOUBLE - 100) AS BIGINT) AS i, CAST(floor(y / 0.2::DOUBLE - 100) AS BIGINT) AS j, min(z) AS z FROM sites GROUP BY 1, 2)"""


RASTER = """raster AS (SELECT *, CAST(CASE WHEN (i * 7 + j * 3) % 11 < 2 THEN 255 ELSE n % 3 END AS INT) AS c FROM
  (SELECT CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, min(z) AS z, count(*) AS n FROM points GROUP BY 1, 2))"""
