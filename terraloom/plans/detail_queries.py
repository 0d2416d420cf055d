"""Queries over frames, heights, flags and catalogues, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import frames, matching, rasters, rules
from . import views as v
from .analysis_queries import REL
from .registry import query
from .spatial_queries import P, PL, RA, RQ, RU, S, SPEC, R
from .world_queries import SOLID, WALL, _walls

FRAME = """nrm AS (SELECT p_partkey AS id, a / l AS nx, b / l AS ny, c / l AS nz FROM (SELECT *, sqrt(a*a + b*b + c*c) AS l FROM (SELECT p_partkey, (p_size % 7 - 3)::DOUBLE AS a, (p_partkey % 5 - 2)::DOUBLE AS b, 1.0 + p_partkey % 4 AS c FROM part))),
fr AS (SELECT *, ny*uz*0 + ux AS ux_, uy AS uy_, uz AS uz_ FROM (SELECT *, sx / l AS ux, sy / l AS uy, sz / l AS uz FROM (SELECT *, sqrt(sx*sx + sy*sy + sz*sz) AS l FROM (SELECT *, CASE WHEN abs(nz) > 0.95 THEN 1 - nx*nx ELSE -ny END AS sx, CASE WHEN abs(nz) > 0.95 THEN -nx*ny ELSE nx END AS sy, CASE WHEN abs(nz) > 0.95 THEN -nx*nz ELSE 0 END AS sz FROM nrm))))"""


def _normals(spark, sf):
    p = v.table(spark, sf, "part")
    a, b, c = (F.col("p_size") % 7 - 3).cast("double"), (F.col("p_partkey") % 5 - 2).cast("double"), 1.0 + F.col("p_partkey") % 4
    n = p.select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"), c.alias("c"))
    return n.withColumn("l", g.norm((F.col("a"), F.col("b"), F.col("c")))).select("id", *[(F.col(k) / F.col("l")).alias(f"n{x}") for k, x in zip("abc", "xyz", strict=True)])


@query("SELECT id, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy, round(uz, 6) + 0.0 AS uz, round(ny*uz - nz*uy, 6) + 0.0 AS vx, round(nz*ux - nx*uz, 6) + 0.0 AS vy, round(nx*uy - ny*ux, 6) + 0.0 AS vz FROM fr", FRAME)
def plane_frames(spark, sf):
    return frames.framed(_normals(spark, sf)).select("id", *[(R(f"{k}{c}", 6) + 0.0).alias(f"{k}{c}") for k in "uv" for c in "xyz"])


@query("SELECT id, round(degrees(acos(least(1, abs(nz)))), 5) AS slope FROM nrm", FRAME)
def slopes(spark, sf):
    return _normals(spark, sf).select("id", R(g.slope_degrees(F.col("nz")), 5).alias("slope"))


@query("""SELECT id, round(px, 5) + 0.0 AS px, round(py, 5) + 0.0 AS py, round(pz, 5) + 0.0 AS pz, round(d, 5) + 0.0 AS d FROM (SELECT s.id, s.x - d*nx AS px, s.y - d*ny AS py, s.z - d*nz AS pz, d FROM (SELECT sites.*, nx, ny, nz, (x-5)*nx + (y-6)*ny + (z-7)*nz AS d FROM sites JOIN nrm ON nrm.id = sites.id) s)""", S, FRAME)
def projected_points(spark, sf):
    f = frames.framed(_normals(spark, sf)).withColumns({"ox": F.lit(5.0), "oy": F.lit(6.0), "oz": F.lit(7.0)})
    p = frames.unproject(frames.project(v.sites(spark, sf).select("id", "x", "y", "z").join(f, "id")))
    return p.select("id", *[(R(c, 5) + 0.0).alias(c) for c in ("px", "py", "pz", "d")])


@query("SELECT id, CASE WHEN slope > 55 THEN 'structure.wall' WHEN hag < 1 THEN 'structure.slab' WHEN slope > 12 THEN 'structure.roof.pitched' WHEN hag > 2 THEN 'structure.roof.flat' ELSE 'structure.slab' END AS role FROM (SELECT p_partkey AS id, p_partkey % 90 AS slope, p_size % 5 AS hag FROM part)")
def patch_roles(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), frames.patch_role(F.col("p_partkey") % 90, F.col("p_size") % 5).alias("role"))


@query("SELECT p_partkey AS id, round(CASE WHEN m > 2 AND m < 700 THEN m END, 6) AS height FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_size * 3) * 0.3048::DOUBLE END AS m FROM part)")
def published_heights(spark, sf):
    raw = F.when(F.col("p_partkey") % 7 == 0, F.lit("n/a")).otherwise((F.col("p_size") * 3).cast("string"))
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), R(frames.published_height(raw), 6).alias("height"))


@query("SELECT p_partkey AS id, CASE WHEN contains(upper(p_name), 'MOTORWAY') THEN 10.0 WHEN contains(upper(p_name), '11') THEN 4.0 WHEN contains(upper(p_name), '1') THEN 3.0 ELSE 5.5 END::DOUBLE AS half FROM part")
def road_half_widths(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), frames.road_half_width(F.col("p_name"), {"1": 6.0, "11": 8.0, "motorway": 20.0}).alias("half"))


@query("""WITH per AS (SELECT l_suppkey AS building, median(l_quantity - l_linenumber * 4) AS r FROM lineitem GROUP BY 1 HAVING count(*) >= 8)
SELECT count(*) AS buildings, """ + ", ".join(f"round(quantile_cont(r, {q / 100}), 6) AS p{q}" for q in (50, 75, 90, 95, 99)) + ", round(avg((abs(r) <= 2)::INT), 6) AS within_2, round(avg((abs(r) <= 5)::INT), 6) AS within_5 FROM per")
def height_agreement(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("building"), F.col("l_quantity").alias("measured"), (F.col("l_linenumber") * 4).alias("record"))
    a = frames.agreement(rows)
    return a.withColumns({c: R(c, 6) for c in a.columns if c != "buildings"})


@query("SELECT kind, min(x) AS minx, min(y) AS miny, min(z) AS minz, max(x) AS maxx, max(y) AS maxy, max(z) AS maxz, count(*) AS n FROM sites GROUP BY kind", S)
def bounds_by_kind(spark, sf):
    return frames.bounds_by(v.sites(spark, sf), "kind")


@query("SELECT n_nationkey AS id, CAST(CASE WHEN n_regionkey = 0 THEN 0 ELSE row_number() OVER (PARTITION BY n_regionkey <> 0 ORDER BY n_nationkey) END AS INT) AS slot FROM nation")
def mesh_slots(spark, sf):
    n = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, "terrain").otherwise("patch").alias("kind"))
    return frames.slots(n).select("id", F.col("slot").cast("int"))


@query("""SELECT CAST(sum(n) AS BIGINT) AS points, count(*) AS cells, round(sum(n) / count(*), 6) AS density, CAST(greatest(6, floor(0.6 * 8 * (sum(n) / count(*)))) AS INT) AS least FROM (SELECT count(*) AS n FROM points GROUP BY floor(x), floor(y))""", P)
def points_per_area(spark, sf):
    return frames.points_per_area(v.points(spark, sf)).withColumn("density", R("density", 6))


FLAGGED = "pc AS (SELECT patch, u, v, ctx, 2.0 * (patch % 40) + u * 0.5 AS x, (patch % 30) * 1.0 + v * 0.25 AS y, v * 0.5 AS z FROM solid), nb AS (SELECT a.patch AS a, b.patch AS b, CASE WHEN a.patch % 2 = 0 THEN 'perpendicular' ELSE 'parallel' END AS kind FROM wall a JOIN wall b ON b.patch = a.patch + 1)"


@query("""WITH both_ AS (SELECT a AS patch, b AS other, kind FROM nb UNION ALL SELECT b, a, kind FROM nb),
hit AS (SELECT p.patch, p.u, p.v, bit_or(CASE t.kind WHEN 'perpendicular' THEN 256 ELSE 512 END) AS b FROM pc p JOIN both_ t ON t.patch = p.patch JOIN pc q ON q.patch = t.other AND (p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z) <= 1.5625 GROUP BY 1, 2, 3)
SELECT patch, u, v, CAST(ctx | coalesce(b, 0) AS BIGINT) AS ctx FROM pc LEFT JOIN hit USING (patch, u, v)""", WALL, SOLID, FLAGGED)
def cross_patch_flags(spark, sf):
    from ..operators import surfaces

    w = _walls(spark, sf)
    c = surfaces.solid(w, 0.5).withColumns({"x": 2.0 * (F.col("patch") % 40) + F.col("u") * 0.5, "y": (F.col("patch") % 30) * 1.0 + F.col("v") * 0.25, "z": F.col("v") * 0.5})
    r = w.select(F.col("patch").alias("a")).join(w.select(F.col("patch").alias("b")).hint("merge"), F.col("b") == F.col("a") + 1)
    r = r.withColumn("kind", F.when(F.col("a") % 2 == 0, "perpendicular").otherwise("parallel"))
    return frames.tell_across(c, r, {"perpendicular": 256, "parallel": 512}, 1.25).select("patch", "u", "v", "ctx")


@query("""WITH st AS (SELECT DISTINCT CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j FROM sites WHERE id % 13 = 0), p AS (SELECT id, minx AS x, miny AS y, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END AS nx, CASE WHEN id % 2 = 0 THEN 0.0 ELSE 1.0 END AS ny FROM planes),
t(n, s, d) AS (VALUES (0, 1, 2.0), (1, -1, -2.0), (2, 1, 3.0), (3, -1, -3.0), (4, 1, 6.0), (5, -1, -6.0)), h AS (SELECT id, arg_min(s, n) AS side FROM p, t, st WHERE i = CAST(floor(x + d * nx) AS BIGINT) AND j = CAST(floor(y + d * ny) AS BIGINT) GROUP BY id)
SELECT id AS patch, side FROM p LEFT JOIN h USING (id)""", S, PL)
def street_facing(spark, sf):
    st = v.sites(spark, sf).where("id % 13 = 0").select(g.cell(F.col("x"), 1.0).alias("i"), g.cell(F.col("y"), 1.0).alias("j"))
    even = F.col("id") % 2 == 0
    p = v.planes(spark, sf).select(F.col("id").alias("patch"), F.col("minx").alias("x"), F.col("miny").alias("y"), F.when(even, 1.0).otherwise(0.0).alias("nx"), F.when(even, 0.0).otherwise(1.0).alias("ny"))
    return frames.street_facing(p, st, 1.0).select("patch", "side")


@query("""SELECT r.id, s.ordinal AS rule, s.material, s.specificity FROM requests r JOIN spec s ON (s.role IN ('*', '') OR r.role = s.role OR starts_with(r.role, s.role || '.')) AND (r.ctx & s.mask_all) = s.mask_all AND (s.mask_any = 0 OR (r.ctx & s.mask_any) <> 0) AND (r.ctx & s.mask_none) = 0 AND (s.semantic IS NULL OR s.semantic = r.semantic)""", RU, SPEC, RQ)
def explained_rules(spark, sf):
    m = rules.matches(v.requests(spark, sf), v.rules(spark))
    return m.select("id", F.col("r_ordinal").alias("rule"), F.col("r_material").alias("material"), F.col("r_specificity").alias("specificity"))


@query("SELECT role, ctx, count(*) AS n FROM requests GROUP BY role, ctx", RQ)
def distinct_requests(spark, sf):
    return v.requests(spark, sf).groupBy("role", "ctx").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i, j, c FROM raster WHERE c = 1", P, RA)
def road_mask(spark, sf):
    return v.raster(spark, sf).where("c = 1").select("i", "j", "c")


@query("""WITH p AS (SELECT a.id AS a, b.id AS b, (a.minx + a.maxx) / 2 AS x, (a.miny + a.maxy) / 2 AS y, a.maxx - a.minx AS ex FROM planes a JOIN moved b ON b.id = a.id + 1000000)
SELECT count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(ex), 6) AS ex FROM p""", PL, "moved AS (SELECT id + 1000000 AS id FROM planes WHERE id % 5 <> 0)")
def box_centres(spark, sf):
    p = v.planes(spark, sf).where("id % 5 <> 0")
    return p.agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("minx") + F.col("maxx")) / 2), 6).alias("x"), R(F.avg((F.col("miny") + F.col("maxy")) / 2), 6).alias("y"), R(F.avg(F.col("maxx") - F.col("minx")), 6).alias("ex"))


@query("""SELECT s.id, round(wa, 6) + 0.0 AS wa, round(wb, 6) + 0.0 AS wb FROM (SELECT id, ((20.0 - 40.0) * (x - 30.0) + (30.0 - 40.0) * (y - 40.0)) / d AS wa, ((40.0 - 0.0) * (x - 30.0) + (0.0 - 30.0) * (y - 40.0)) / d AS wb FROM (SELECT *, (20.0 - 40.0) * (0.0 - 30.0) + (30.0 - 40.0) * (0.0 - 40.0) AS d FROM sites)) s""", S)
def barycentric_weights(spark, sf):
    lit = lambda x, y: (F.lit(x), F.lit(y))
    wa, wb, _ = g.barycentric((F.col("x"), F.col("y")), lit(0.0, 0.0), lit(40.0, 20.0), lit(30.0, 40.0))
    return v.sites(spark, sf).select("id", (R(wa, 6) + 0.0).alias("wa"), (R(wb, 6) + 0.0).alias("wb"))


@query("""SELECT id, round(CASE WHEN i + 0.5 > 0 THEN z END, 4) AS z FROM (SELECT id, z, CAST(floor(x) AS BIGINT) AS i FROM sites WHERE x BETWEEN 5 AND 25 AND y BETWEEN 5 AND 25)""", S)
def cropped_points(spark, sf):
    return v.sites(spark, sf).where(F.col("x").between(5, 25) & F.col("y").between(5, 25)).select("id", R("z", 4).alias("z"))


@query("SELECT a, b, kind FROM rel WHERE kind = 'parallel'", PL, REL)
def parallel_planes(spark, sf):
    return matching.plane_relations(v.planes(spark, sf), 8.0).where("kind = 'parallel'")


@query("SELECT 'i' AS axis, count(DISTINCT i) AS n FROM raster UNION ALL SELECT 'j', count(DISTINCT j) FROM raster", P, RA)
def raster_extent(spark, sf):
    r = v.raster(spark, sf).agg(F.countDistinct("i").alias("i"), F.countDistinct("j").alias("j"))
    return r.unpivot([], ["i", "j"], "axis", "n")


@query("SELECT patch, count(*) AS n, CAST(bit_or(ctx) AS INT) AS seen FROM solid GROUP BY patch", WALL, SOLID)
def patch_flags(spark, sf):
    from ..operators import surfaces

    return surfaces.solid(_walls(spark, sf), 0.5).groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.bit_or("ctx").alias("seen"))


@query("SELECT i, j, CAST(d AS INT) AS d FROM (SELECT m.i, m.j, coalesce(min(greatest(abs(m.i - o.i), abs(m.j - o.j))), 3) AS d FROM (SELECT i, j FROM raster WHERE c = 0) m LEFT JOIN (SELECT DISTINCT r.i + a.x AS i, r.j + b.x AS j FROM raster r, (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x) WHERE r.c = 0) q ON false LEFT JOIN (SELECT * FROM (SELECT DISTINCT r.i + a.x AS i, r.j + b.x AS j FROM raster r, (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x) WHERE r.c = 0) ANTI JOIN (SELECT i, j FROM raster WHERE c = 0) USING (i, j)) o ON abs(m.i - o.i) <= 3 AND abs(m.j - o.j) <= 3 GROUP BY m.i, m.j)", P, RA)
def eroded_depth(spark, sf):
    return rasters.distance_to_false(v.raster(spark, sf).where("c = 0"), 3).select("i", "j", F.col("d").cast("int"))
