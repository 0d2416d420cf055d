"""Queries over points, rasters, polygons, rules and tiles, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import polygons, rasters, rules, tiles, voxels
from . import views as v
from .registry import query

R = F.round
P, S, RG, ED, T, PL, RU, RQ, RA = v.POINTS, v.SITES, v.RINGS, v.EDGES, v.TILES, v.PLANES, v.RULES, v.REQUESTS, v.RASTER


# --- voxels ---------------------------------------------------------------------------------

VOX = "CAST(floor(x / 1.5) AS BIGINT) AS i, CAST(floor(y / 1.5) AS BIGINT) AS j, CAST(floor(z / 1.5) AS BIGINT) AS k"
MOM = f"m AS (SELECT {VOX}, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(x*z) AS sxz, sum(y*y) AS syy, sum(y*z) AS syz, sum(z*z) AS szz FROM points GROUP BY 1, 2, 3)"


@query("SELECT i, j, k, n, round(sx / n, 6) AS mx, round(sy / n, 6) AS my, round(sz / n, 6) AS mz, round(szz / n - (sz / n) * (sz / n), 6) AS vz FROM m WHERE n >= 4", P, MOM)
def voxel_moments(spark, sf):
    m = voxels.moments(v.points(spark, sf), 1.5).where("n >= 4")
    mean = {f"m{c}": R(F.col(f"s{c}") / F.col("n"), 6) for c in "xyz"}
    return m.select("i", "j", "k", "n", *[e.alias(n) for n, e in mean.items()], R(F.col("szz") / F.col("n") - (F.col("sz") / F.col("n")) * (F.col("sz") / F.col("n")), 6).alias("vz"))


@query(f"SELECT {VOX}, count(*) AS n FROM points GROUP BY 1, 2, 3", P)
def voxel_counts(spark, sf):
    return voxels.counts(v.points(spark, sf), 1.5)


@query("WITH o AS (SELECT min(x) - 2 AS ox, min(y) - 2 AS oy, min(z) - 2 AS oz FROM points) SELECT CAST(floor((x - ox) / 2) AS BIGINT) AS i, CAST(floor((y - oy) / 2) AS BIGINT) AS j, CAST(floor((z - oz) / 2) AS BIGINT) AS k, count(*) AS n FROM points, o GROUP BY 1, 2, 3", P)
def voxel_counts_from_minimum(spark, sf):
    return voxels.from_minimum(v.points(spark, sf), 2.0).groupBy(*voxels.IJK).agg(F.count(F.lit(1)).alias("n"))


COV = "cov AS (SELECT i, j, k, n, " + ", ".join(f"CASE WHEN n < 4 THEN {'1e-9' if a == b else '0.0'} ELSE s{a}{b} / n - (s{a} / n) * (s{b} / n) END AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM m)"


@query("SELECT i, j, k, n, " + ", ".join(f"round(c{ab}, 6) + 0.0 AS c{ab}" for ab in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM cov", P, MOM, COV)
def voxel_covariance(spark, sf):
    c = voxels.covariance(voxels.moments(v.points(spark, sf), 1.5))
    return c.select("i", "j", "k", "n", *[(R(f"c{ab}", 6) + 0.0).alias(f"c{ab}") for ab in ("xx", "xy", "xz", "yy", "yz", "zz")])


def _eigen_sql(source: str) -> str:
    """Views that end in `shapes`, by the characteristic polynomial's trigonometric roots."""
    return f"""e1 AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM {source}),
e2 AS (SELECT *, sqrt(((cxx - q)*(cxx - q) + (cyy - q)*(cyy - q) + (czz - q)*(czz - q) + 2*(cxy*cxy + cxz*cxz + cyz*cyz)) / 6) AS p FROM e1),
e3 AS (SELECT *, CASE WHEN p > 0 THEN least(1.0, greatest(-1.0, ((cxx-q)*((cyy-q)*(czz-q) - cyz*cyz) - cxy*(cxy*(czz-q) - cyz*cxz) + cxz*(cxy*cyz - (cyy-q)*cxz)) / (2*p*p*p))) ELSE 1.0 END AS h FROM e2),
e4 AS (SELECT *, q + 2*p*cos(acos(h) / 3) AS a0, q + 2*p*cos(acos(h) / 3 + 2.0943951023931953) AS a2 FROM e3),
e5 AS (SELECT *, greatest(a0, 0) AS l0, greatest(3*q - a0 - a2, 0) AS l1, greatest(a2, 0) AS l2 FROM e4),
shapes AS (SELECT *, (l0 - l1) / greatest(l0, 1e-12) AS linearity, (l1 - l2) / greatest(l0, 1e-12) AS planarity, l2 / greatest(l0, 1e-12) AS sphericity, (l0 - l2) / greatest(l0, 1e-12) AS anisotropy, l2 / greatest(l0 + l1 + l2, 1e-12) AS curvature FROM e5)"""


SHAPE = ("linearity", "planarity", "sphericity", "anisotropy", "curvature")


@query("SELECT i, j, k, n, " + ", ".join(f"round({s}, 5) + 0.0 AS {s}" for s in SHAPE) + " FROM shapes", P, MOM, COV, _eigen_sql("cov"))
def voxel_shapes(spark, sf):
    s = voxels.shapes(voxels.covariance(voxels.moments(v.points(spark, sf), 1.5)))
    return s.select("i", "j", "k", "n", *[(R(x, 5) + 0.0).alias(x) for x in SHAPE])


NEAR = "off AS (SELECT a.d AS di, b.d AS dj, c.d AS dk FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d))"
NSUM = "ns AS (SELECT a.i, a.j, a.k, " + ", ".join(f"{'CAST(sum(b.n) AS BIGINT)' if c == 'n' else f'sum(b.{c})'} AS {c}" for c in voxels.MOMENTS) + " FROM (SELECT i, j, k, i + di AS bi, j + dj AS bj, k + dk AS bk FROM m, off) a JOIN m b ON b.i = bi AND b.j = bj AND b.k = bk GROUP BY a.i, a.j, a.k)"


@query("SELECT i, j, k, n, sz FROM ns", P, MOM, NEAR, NSUM)
def voxel_neighbour_sums(spark, sf):
    return voxels.neighbour_sums(voxels.moments(v.points(spark, sf), 1.5), ["n", "sz"])


NCOV = COV.replace("cov AS", "ncov AS").replace("FROM m)", "FROM ns)")


@query("SELECT i, j, k, n, round(n / (27 * 1.5 * 1.5 * 1.5), 6) AS density, round(linearity, 5) + 0.0 AS linearity, round(planarity, 5) + 0.0 AS planarity FROM shapes", P, MOM, NEAR, NSUM, NCOV, _eigen_sql("ncov"))
def neighbourhood_descriptors(spark, sf):
    d = voxels.descriptors(v.points(spark, sf), 1.5)
    return d.select("i", "j", "k", "n", R("density", 6).alias("density"), (R("linearity", 5) + 0.0).alias("linearity"), (R("planarity", 5) + 0.0).alias("planarity"))


@query("SELECT id, n FROM (SELECT id, " + VOX + " FROM sites) s LEFT JOIN m USING (i, j, k)", P, S, MOM)
def voxel_lookup(spark, sf):
    probes = voxels.assign(v.sites(spark, sf).select("id", "x", "y", "z"), 1.5)
    return voxels.lookup(probes, voxels.counts(v.points(spark, sf), 1.5), ["n"]).select("id", "n")


@query("SELECT i, j, k, (i + 0.5) * 1.5 AS cx, (j + 0.5) * 1.5 AS cy, (k + 0.5) * 1.5 AS cz, CAST(i + 40 * (j + 40 * k) AS BIGINT) AS code FROM m", P, MOM)
def voxel_centres_and_codes(spark, sf):
    c = voxels.centers(voxels.counts(v.points(spark, sf), 1.5), 1.5)
    return c.select("i", "j", "k", "cx", "cy", "cz", voxels.encode(F.col("i"), F.col("j"), F.col("k"), 40, 40).alias("code"))


@query("SELECT di, dj, dk FROM off", NEAR)
def neighbour_offsets(spark, sf):
    return spark.range(1).select(F.explode(voxels.offsets(1)).alias("o")).select("o.*")


# --- rasters --------------------------------------------------------------------------------


@query("SELECT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, min(z) AS lo, max(z) AS hi, round(sum(z) / count(z), 6) AS mean, count(z) AS n FROM points GROUP BY 1, 2", P)
def raster_accumulate(spark, sf):
    return rasters.accumulate(v.points(spark, sf), 2.0).withColumn("mean", R("mean", 6))


@query("SELECT i, j, max(p.z) - min(r.z) AS height FROM points p JOIN raster r ON r.i = CAST(floor(p.x) AS BIGINT) AND r.j = CAST(floor(p.y) AS BIGINT) GROUP BY i, j", P, RA)
def canopy_height(spark, sf):
    return rasters.accumulate(v.points(spark, sf), 1.0).select("i", "j", (F.col("hi") - F.col("lo")).alias("height"))


@query("SELECT semantic, count(*) AS n FROM points GROUP BY 1", P)
def class_histogram(spark, sf):
    return v.points(spark, sf).groupBy("semantic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, least(greatest(CAST(floor(x / 3) AS BIGINT), 0), 9) AS i, least(greatest(CAST(floor(y / 3) AS BIGINT), 0), 12) AS j FROM sites", S)
def raster_cells_clamped(spark, sf):
    return rasters.to_cell(v.sites(spark, sf), 3.0, 10, 13).select("id", F.col("i").cast("long"), F.col("j").cast("long"))


def _square(f: str, radius: int, source: str) -> str:
    """f of z over the cells of source within radius of each: every pair of cells is looked at."""
    around = f"(SELECT unnest(generate_series(-{radius}, {radius})) AS d)"
    return f"(SELECT a.i, a.j, {f}(b.z) AS z FROM (SELECT i, j, i + p.d AS ni, j + q.d AS nj FROM {source}, {around} p, {around} q) a JOIN {source} b ON b.i = a.ni AND b.j = a.nj GROUP BY a.i, a.j)"


@query(f"SELECT i, j, z FROM {_square('min', 3, 'holed')}", S, v.HOLED)
def raster_erode(spark, sf):
    return rasters.erode(v.holed(spark, sf), "z", 3).select("i", "j", "z")


@query(f"SELECT i, j, z FROM {_square('max', 3, 'holed')}", S, v.HOLED)
def raster_dilate(spark, sf):
    return rasters.dilate(v.holed(spark, sf), "z", 3).select("i", "j", "z")


def _pmf() -> str:
    out, source, n, radius, ground = [], "holed", 0, 1, []
    while radius * 2.0 <= 24:
        n += 1
        out += [f"e{n} AS MATERIALIZED {_square('min', radius, source)}", f"o{n} AS MATERIALIZED {_square('max', radius, f'e{n}')}"]
        ground.append(f"({source}.z - o{n}.z <= {min(0.35 + 0.25 * 2 * radius * 2.0, 4.0)})")
        source, radius = f"o{n}", radius * 2
    joins = " ".join(f"JOIN o{k} USING (i, j)" for k in range(1, n + 1))
    return f"WITH {', '.join(out)} SELECT i, j, holed.z AS z, {' AND '.join(ground)} AS ground FROM holed {joins}"


@query(_pmf(), S, v.HOLED)
def ground_filter(spark, sf):
    return rasters.ground_mask(v.holed(spark, sf), 2.0, "z").select("i", "j", "z", "ground")


@query(f"SELECT i, j, round(z, 6) AS z FROM {_square('avg', 2, 'holed')}", S, v.HOLED)
def raster_box_mean(spark, sf):
    return rasters.box_mean(v.holed(spark, sf), "z", 2).select("i", "j", R("z", 6).alias("z"))


@query("""WITH votes AS (SELECT a.i, a.j, b.c, count(*) AS n FROM raster a JOIN raster b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 WHERE b.c <> 255 GROUP BY ALL),
best AS (SELECT i, j, c AS m FROM votes QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY n DESC, c) = 1)
SELECT i, j, CASE WHEN c = 255 THEN 255 ELSE coalesce(m, c) END AS c FROM raster LEFT JOIN best USING (i, j)""", P, RA)
def raster_majority(spark, sf):
    return rasters.majority(v.raster(spark, sf)).select("i", "j", "c")


def _fill(source: str) -> str:
    return f"(SELECT a.i, a.j, CASE WHEN a.c = 255 AND b.n >= 3 THEN b.top ELSE a.c END AS c FROM {source} a LEFT JOIN (SELECT p.i, p.j, count(*) AS n, max(q.c) AS top FROM {source} p JOIN {source} q ON abs(p.i - q.i) + abs(p.j - q.j) = 1 WHERE q.c <> 255 GROUP BY p.i, p.j) b USING (i, j))"


@query(f"WITH f1 AS {_fill('raster')} SELECT i, j, c FROM {_fill('f1')}", P, RA)
def raster_fill_voids(spark, sf):
    return rasters.fill_voids(v.raster(spark, sf)).select("i", "j", "c")


@query("""WITH s AS (SELECT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, sum((semantic = 1)::INT) AS g, sum((semantic = 3)::INT) AS r, sum((semantic = 5)::INT) AS w FROM points GROUP BY 1, 2)
SELECT i, j, CASE WHEN greatest(g, r, w) < 2 THEN 255 WHEN g = greatest(g, r, w) THEN 0 WHEN r = greatest(g, r, w) THEN 1 ELSE 2 END AS c FROM s""", P)
def terrain_votes(spark, sf):
    kind = F.when(F.col("semantic") == 1, "ground").when(F.col("semantic") == 3, "road").when(F.col("semantic") == 5, "water")
    return rasters.vote_classes(v.points(spark, sf).withColumn("kind", kind), 2.0, {"ground": 0, "road": 1, "water": 2})


MASK = "mask AS (SELECT i, j FROM raster WHERE c <> 255)"


@query("""WITH ring AS (SELECT DISTINCT m.i + a.d AS i, m.j + b.d AS j FROM mask m, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)),
out AS (SELECT * FROM ring ANTI JOIN mask USING (i, j))
SELECT m.i, m.j, CAST(coalesce(min(greatest(abs(m.i - o.i), abs(m.j - o.j))), 6) AS INT) AS d FROM mask m LEFT JOIN out o ON abs(m.i - o.i) <= 6 AND abs(m.j - o.j) <= 6 GROUP BY m.i, m.j""", P, RA, MASK)
def distance_to_outside(spark, sf):
    return rasters.distance_by_windows(v.raster(spark, sf).where("c <> 255"), 6).withColumn("d", F.col("d").cast("int"))


@query("""WITH q AS (SELECT id, x / 2 - 0.5 AS fx, y / 2 - 0.5 AS fy FROM sites), f AS (SELECT id, CAST(floor(fx) AS BIGINT) AS bi, CAST(floor(fy) AS BIGINT) AS bj, fx - floor(fx) AS u, fy - floor(fy) AS t FROM q),
low AS (SELECT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, min(z) AS lo FROM points GROUP BY 1, 2),
w AS (SELECT id, CASE WHEN a.d = 1 THEN u ELSE 1 - u END * CASE WHEN b.d = 1 THEN t ELSE 1 - t END AS w, lo FROM f, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d), low WHERE low.i = bi + a.d AND low.j = bj + b.d)
SELECT s.id, round(x.z, 5) AS z FROM sites s LEFT JOIN (SELECT id, CASE WHEN sum(w) >= 1e-6 THEN sum(w * lo) / sum(w) END AS z FROM w GROUP BY id) x USING (id)""", P, S)
def bilinear_sample(spark, sf):
    low = rasters.accumulate(v.points(spark, sf), 2.0)
    return rasters.sample_bilinear(v.sites(spark, sf).select("id", "x", "y"), low, "lo", 2.0).select("id", R("sample", 5).alias("z"))


@query("SELECT r.i + a.d AS i, r.j + b.d AS j, round(sum(z) / count(z), 6) AS height FROM raster r, (VALUES (0), (1)) a(d), (VALUES (0), (1)) b(d) GROUP BY 1, 2", P, RA)
def corner_heights(spark, sf):
    return rasters.corner_heights(v.raster(spark, sf), "z").withColumn("height", R("height", 6))


@query("""SELECT a.i, a.j, CAST(coalesce(bit_or(CASE WHEN a.c <> b.c THEN 1 ELSE 0 END | CASE WHEN abs(a.z - b.z) / 1.0 > 0.35 THEN 2 ELSE 0 END), 0) AS INT) AS ctx
FROM raster a LEFT JOIN raster b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j""", P, RA)
def terrain_flags(spark, sf):
    return rasters.terrain_flags(v.raster(spark, sf), 1.0)


@query("SELECT CAST(floor(i / 4.0) AS BIGINT) AS i, CAST(floor(j / 4.0) AS BIGINT) AS j, round(sum(z) / count(z), 6) AS z FROM raster GROUP BY 1, 2", P, RA)
def block_mean(spark, sf):
    return rasters.block_mean(v.raster(spark, sf), "z", 4).withColumn("z", R("z", 6))


@query("""WITH a AS (SELECT ring_id, avg(px) AS ax, avg(py) AS ay, CAST(ring_id AS DOUBLE) AS az FROM rings GROUP BY ring_id)
SELECT i, j, round(sum(az / greatest((i + 0.5 - ax) * (i + 0.5 - ax) + (j + 0.5 - ay) * (j + 0.5 - ay), 1.0)) / sum(1 / greatest((i + 0.5 - ax) * (i + 0.5 - ax) + (j + 0.5 - ay) * (j + 0.5 - ay), 1.0)), 5) AS z FROM raster, a GROUP BY i, j""", P, RA, RG)
def terrain_from_bases(spark, sf):
    anchors = v.rings(spark, sf).groupBy("ring_id").agg(F.avg("px").alias("x"), F.avg("py").alias("y"), F.max(F.col("ring_id").cast("double")).alias("z"))
    cells = v.raster(spark, sf).select((F.col("i") + 0.5).alias("x"), (F.col("j") + 0.5).alias("y"))
    out = rasters.inverse_distance(cells, anchors)
    return out.select(F.floor("x").cast("long").alias("i"), F.floor("y").cast("long").alias("j"), R("z", 5).alias("z"))


LINES = "lines AS (SELECT CAST(o_custkey AS BIGINT) AS line_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS ord, CAST(o_orderkey % 80 AS DOUBLE) * 0.5 AS px, CAST(o_orderkey % 37 AS DOUBLE) AS py FROM orders)"


def _lines(spark, sf):
    from pyspark.sql import Window

    o = v.table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_custkey").cast("long").alias("line_id"), F.row_number().over(w).alias("ord"), ((F.col("o_orderkey") % 80).cast("double") * 0.5).alias("px"), (F.col("o_orderkey") % 37).cast("double").alias("py"))


SEGS = "segs AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS length FROM (SELECT line_id, ord, px AS x1, py AS y1, lead(px) OVER w AS x2, lead(py) OVER w AS y2 FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY ord)) WHERE x2 IS NOT NULL)"


@query("SELECT line_id, ord, x1, y1, x2, y2, round(length, 6) AS length FROM segs", LINES, SEGS)
def polyline_segments(spark, sf):
    return polygons.segments(_lines(spark, sf)).withColumn("length", R("length", 6))


STAMP = """along AS (SELECT line_id, x1 + (t / n) * (x2 - x1) AS x, y1 + (t / n) * (y2 - y1) AS y FROM (SELECT *, unnest(generate_series(0, CAST(n AS BIGINT))) AS t FROM (SELECT *, greatest(1, ceil(length / 0.5)) AS n FROM segs))),
near AS (SELECT DISTINCT line_id, x, y, CAST(floor(x) AS BIGINT) + a.d AS i, CAST(floor(y) AS BIGINT) + b.d AS j FROM along, (SELECT unnest(generate_series(-3, 3)) AS d) a, (SELECT unnest(generate_series(-3, 3)) AS d) b),
street AS (SELECT DISTINCT i, j FROM near WHERE (i + 0.5 - x) * (i + 0.5 - x) + (j + 0.5 - y) * (j + 0.5 - y) <= 4.0)"""


@query("SELECT i, j FROM street", LINES, SEGS, STAMP)
def street_cells(spark, sf):
    return rasters.disc_cells(polygons.along(polygons.segments(_lines(spark, sf)), 0.5), 1.0, 2.0)


@query("SELECT i, j, CASE WHEN c = 0 AND s.i IS NOT NULL THEN 1 ELSE c END AS c FROM raster LEFT JOIN (SELECT i, j FROM street) s USING (i, j)".replace("s.i IS NOT NULL", "hit"). replace("(SELECT i, j FROM street)", "(SELECT i, j, true AS hit FROM street)"), P, RA, LINES, SEGS, STAMP)
def street_promotion(spark, sf):
    mask = rasters.disc_cells(polygons.along(polygons.segments(_lines(spark, sf)), 0.5), 1.0, 2.0)
    return rasters.promote(v.raster(spark, sf), mask).select("i", "j", "c")


# --- polygons -------------------------------------------------------------------------------

INSIDE = """inside AS (SELECT id, ring_id FROM sites JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, ring_id HAVING count(*) % 2 = 1)"""


@query("SELECT id, ring_id FROM inside", S, RG, ED, INSIDE)
def points_in_polygons(spark, sf):
    return polygons.containing(v.sites(spark, sf), v.rings(spark, sf), "id")


@query("SELECT s.id, i.id IS NOT NULL AS inside FROM sites s LEFT JOIN (SELECT DISTINCT id FROM inside) i ON i.id = s.id", S, RG, ED, INSIDE)
def inside_any_polygon(spark, sf):
    return polygons.inside_any(v.sites(spark, sf), v.rings(spark, sf), "id").select("id", "inside")


@query("SELECT s.id, r.ring_id FROM sites s LEFT JOIN (SELECT id, min(ring_id) AS ring_id FROM inside GROUP BY id) r USING (id)", S, RG, ED, INSIDE)
def first_footprint(spark, sf):
    return polygons.first_containing(v.sites(spark, sf), v.rings(spark, sf), "id").select("id", "ring_id")


@query("SELECT ring_id, abs(sum(x1*y2 - x2*y1)) / 2 AS area, sum(x1*y2 - x2*y1) < 0 AS clockwise FROM edges GROUP BY ring_id", RG, ED)
def ring_areas(spark, sf):
    return polygons.areas(v.rings(spark, sf))


@query("SELECT ring_id, min(px) AS minx, min(py) AS miny, max(px) AS maxx, max(py) AS maxy FROM rings GROUP BY ring_id", RG)
def ring_bounds(spark, sf):
    return polygons.bounds(v.rings(spark, sf))


@query("""WITH e AS (SELECT *, 0.5 * x1 AS z1, 0.5 * x2 AS z2 FROM edges), s AS (SELECT ring_id, sum((y1-y2)*(z1+z2)) AS a, sum((z1-z2)*(x1+x2)) AS b, sum((x1-x2)*(y1+y2)) AS c FROM e GROUP BY ring_id)
SELECT ring_id, round(a / sqrt(a*a+b*b+c*c), 6) + 0.0 AS nx, round(b / sqrt(a*a+b*b+c*c), 6) + 0.0 AS ny, round(c / sqrt(a*a+b*b+c*c), 6) + 0.0 AS nz, round(sqrt(a*a+b*b+c*c) / 2, 6) AS area FROM s""", RG, ED)
def ring_normals(spark, sf):
    n = polygons.newell(v.rings(spark, sf).withColumn("pz", F.col("px") * 0.5))
    return n.select("ring_id", *[(R(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")], R("area", 6).alias("area"))


@query("""WITH c AS (SELECT i, j, i + 0.5 AS x, j + 0.5 AS y FROM (SELECT unnest(generate_series(0, 40)) AS i) a, (SELECT unnest(generate_series(0, 40)) AS j) b)
SELECT i, j, max(ring_id) AS ring_id FROM (SELECT i, j, ring_id FROM c JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY i, j, ring_id HAVING count(*) % 2 = 1) GROUP BY i, j""", RG, ED)
def footprint_raster(spark, sf):
    return polygons.rasterise(v.rings(spark, sf), 1.0)


@query("""WITH a AS (SELECT ring_id, sum(x1*y2 - x2*y1) < 0 AS cw FROM edges GROUP BY ring_id), w AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS width FROM edges JOIN a USING (ring_id))
SELECT ring_id, ord AS wall, x1, y1, x2, y2, round(width, 6) AS width, 0.5::DOUBLE AS base_z, 1.0 + ring_id % 9 AS top_z, round(CASE WHEN cw THEN -1 ELSE 1 END * (y2 - y1) / width, 6) + 0.0 AS nx, round(CASE WHEN cw THEN -1 ELSE 1 END * (x1 - x2) / width, 6) + 0.0 AS ny
FROM w WHERE width >= 1 AND 0.5 + ring_id % 9 >= 2""", RG, ED)
def footprint_walls(spark, sf):
    r = v.rings(spark, sf)
    heights = r.select("ring_id").distinct().select("ring_id", F.lit(0.5).alias("base_z"), (1.0 + F.col("ring_id") % 9).alias("top_z"))
    w = polygons.walls(r, heights)
    return w.withColumns({"width": R("width", 6), "nx": R("nx", 6) + 0.0, "ny": R("ny", 6) + 0.0})


# --- rules, flags, roles ----------------------------------------------------------------------


@query("SELECT r.id, p.pattern FROM requests r, (VALUES ('*'), ('structure'), ('structure.roof'), ('ground.road'), ('struct')) p(pattern) WHERE p.pattern = '*' OR r.role = p.pattern OR starts_with(r.role, p.pattern || '.')", RQ)
def role_matching(spark, sf):
    patterns = spark.createDataFrame([(p,) for p in ("*", "structure", "structure.roof", "ground.road", "struct")], "pattern string")
    return v.requests(spark, sf).join(F.broadcast(patterns), rules.role_matches(F.col("role"), F.col("pattern"))).select("id", "pattern")


@query("SELECT id, unnest(list_filter([" + ", ".join(f"CASE WHEN ctx & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(v.FLAGS)) + "], lambda x: x IS NOT NULL)) AS flag FROM requests", RQ)
def decoded_flags(spark, sf):
    return v.requests(spark, sf).select("id", F.explode(bits.decode(F.col("ctx"), v.FLAGS)).alias("flag"))


@query("SELECT id, CAST(ctx & 165 AS BIGINT) AS ctx FROM requests", RQ)
def encoded_flags(spark, sf):
    names = F.filter(bits.decode(F.col("ctx"), v.FLAGS), lambda n: n.isin("edge", "ground", "sheltered", "measured"))
    return v.requests(spark, sf).select("id", bits.encode(names, v.FLAGS).alias("ctx"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS flag, CAST(sum((ctx & {1 << i} <> 0)::INT) AS BIGINT) AS n FROM requests" for i, n in enumerate(v.FLAGS)), RQ)
def flag_histogram(spark, sf):
    return bits.flag_counts(v.requests(spark, sf), "ctx", v.FLAGS)


SPEC = """spec AS (SELECT *, CAST(2 * bit_count(mask_all) + bit_count(mask_any) + bit_count(mask_none) + CASE WHEN role IN ('*', '') THEN 0 ELSE 2 + len(role) - len(replace(role, '.', '')) END AS INT) AS specificity FROM rules)"""


@query("SELECT ordinal, specificity FROM spec", RU, SPEC)
def rule_specificity(spark, sf):
    return rules.specificity(v.rules(spark)).select("ordinal", "specificity")


@query("""WITH hit AS (SELECT r.id, s.ordinal, s.material, row_number() OVER (PARTITION BY r.id ORDER BY s.priority DESC, s.specificity DESC, s.ordinal) AS n FROM requests r JOIN spec s
  ON (s.role IN ('*', '') OR r.role = s.role OR starts_with(r.role, s.role || '.')) AND (r.ctx & s.mask_all) = s.mask_all AND (s.mask_any = 0 OR (r.ctx & s.mask_any) <> 0) AND (r.ctx & s.mask_none) = 0 AND (s.semantic IS NULL OR s.semantic = r.semantic))
SELECT r.id, coalesce(h.material, 'none') AS material, h.ordinal AS rule FROM requests r LEFT JOIN hit h ON h.id = r.id AND h.n = 1""", RU, SPEC, RQ)
def resolved_materials(spark, sf):
    return rules.resolve(v.requests(spark, sf), v.rules(spark), "none").select("id", "material", "rule")


@query("SELECT ordinal, material, CAST(row_number() OVER (ORDER BY priority DESC, specificity DESC, ordinal) - 1 AS INT) AS place FROM spec", RU, SPEC)
def rule_table(spark, sf):
    return rules.runtime_table(v.rules(spark), v.materials(spark)).select("ordinal", "material", F.col("place").cast("int"))


@query("SELECT ordinal, 'unknown material: ' || material AS fault FROM rules WHERE material NOT IN ('render', 'brick') UNION ALL SELECT -1, 'unknown fallback: none'", RU)
def rule_faults(spark, sf):
    return rules.faults(v.rules(spark), v.materials(spark).where("id IN ('render', 'brick')"), "none", len(v.FLAGS))


@query("SELECT id, CASE WHEN starts_with(role, 'structure.roof') THEN 'RoofSurface' WHEN starts_with(role, 'structure') THEN 'WallSurface' WHEN starts_with(role, 'ground') THEN 'GroundSurface' ELSE 'Generic' END AS value FROM requests", RQ)
def surface_types(spark, sf):
    t = spark.createDataFrame([("structure", "WallSurface"), ("structure.roof", "RoofSurface"), ("ground", "GroundSurface")], "prefix string, value string")
    return rules.longest_prefix(v.requests(spark, sf), "role", t, "Generic").select("id", "value")


# --- tiles ----------------------------------------------------------------------------------

DENS = "dens AS (SELECT *, CASE WHEN (maxx-minx)*(maxy-miny) > 0 THEN points / ((maxx-minx)*(maxy-miny)) ELSE 0 END AS density FROM tiles)"


@query("SELECT tile_id, points, round(density, 6) AS density, CAST(row_number() OVER (ORDER BY density DESC, tile_id) AS INT) AS rank FROM dens WHERE minx <= 30 AND maxx >= 10 AND miny <= 20 AND maxy >= 5", S, T, DENS)
def tiles_in_box(spark, sf):
    return tiles.query(v.tiles(spark, sf), (10, 5, 30, 20)).select("tile_id", "points", R("density", 6).alias("density"), "rank")


@query("SELECT count(*) AS tiles, CAST(sum(points) AS BIGINT) AS points, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM tiles", S, T)
def tile_summary(spark, sf):
    return tiles.summary(v.tiles(spark, sf))


SUP = "sup AS (SELECT id AS tile_id, minx, miny, maxx, maxy, 1 AS points FROM planes)"


@query("""WITH grid AS (SELECT 0 + a.s * (60.0 / 63) AS x, 0 + b.s * (50.0 / 63) AS y FROM (SELECT unnest(generate_series(0, 63)) AS s) a, (SELECT unnest(generate_series(0, 63)) AS s) b)
SELECT round(count(*) / 4096.0, 6) AS coverage FROM grid WHERE EXISTS (SELECT 1 FROM sup WHERE x >= minx AND x <= maxx AND y >= miny AND y <= maxy)""", PL, SUP)
def tile_coverage(spark, sf):
    t = v.planes(spark, sf).withColumnRenamed("id", "tile_id").withColumn("points", F.lit(1))
    return tiles.coverage(t, (0.0, 0.0, 60.0, 50.0)).select(R("coverage", 6).alias("coverage"))


@query("SELECT id AS tile_id, round(sqrt(((minx+maxx)/2 - 30)*((minx+maxx)/2 - 30) + ((miny+maxy)/2 - 20)*((miny+maxy)/2 - 20)), 6) AS distance FROM planes", PL)
def tiles_by_distance(spark, sf):
    return tiles.nearest_first(v.planes(spark, sf).withColumnRenamed("id", "tile_id"), 30, 20).select("tile_id", R("distance", 6).alias("distance"))


@query("SELECT page_id, split_part(url, '/', 4) AS area, try_cast(split_part(url, '/', 5) AS DOUBLE) AS size FROM pages")
def page_areas(spark, sf):
    p = v.table(spark, sf, "pages")
    parts = F.split("url", "/")
    return p.select("page_id", F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")).alias("area"), F.try_element_at(parts, F.lit(5)).try_cast("double").alias("size"))


QT = "qt AS (SELECT DISTINCT rtrim(conv, '3') AS path FROM (SELECT '0' || replace(replace(replace(CAST(o_custkey % 4096 AS VARCHAR), '9', '1'), '8', '0'), '7', '2') AS conv FROM orders))"


@query("SELECT path FROM qt a WHERE NOT EXISTS (SELECT 1 FROM qt b WHERE b.path <> a.path AND starts_with(b.path, a.path))", QT)
def leaf_nodes(spark, sf):
    o = v.table(spark, sf, "orders")
    text = F.replace(F.replace(F.replace((F.col("o_custkey") % 4096).cast("string"), F.lit("9"), F.lit("1")), F.lit("8"), F.lit("0")), F.lit("7"), F.lit("2"))
    return tiles.leaves(o.select(F.rtrim(F.concat(F.lit("0"), text), F.lit("3")).alias("path")).distinct())
