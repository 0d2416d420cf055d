"""Queries over surfaces, meshes, rays and generated worlds, each with the same in DuckDB SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import imagery, meshes, polygons, rays, segmentation, surfaces, tiles, voxels, worldgen
from . import views as v
from .registry import query
from .spatial_queries import ED, P, PL, RG, S, R

# --- surfaces -------------------------------------------------------------------------------

WALL = "wall AS (SELECT CAST(p_partkey AS BIGINT) AS patch, 2.0 + p_partkey % 9 AS width, 2.5 + p_size % 5 AS height FROM part)"


def _walls(spark, sf):
    p = v.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("long").alias("patch"), (2.0 + F.col("p_partkey") % 9).alias("width"), (2.5 + F.col("p_size") % 5).alias("height"))


SOLID = """grid AS (SELECT patch, nu, nv, u, unnest(generate_series(0, nv - 1)) AS v FROM (SELECT *, unnest(generate_series(0, nu - 1)) AS u FROM (SELECT patch, greatest(1, CAST(ceil(width / 0.5) AS BIGINT)) AS nu, greatest(1, CAST(ceil(height / 0.5) AS BIGINT)) AS nv FROM wall))),
solid AS (SELECT patch, CAST(u AS INT) AS u, CAST(v AS INT) AS v, CAST((CASE WHEN u IN (0, nu - 1) OR v IN (0, nv - 1) THEN 1 ELSE 0 END) | (CASE WHEN u IN (0, nu - 1) THEN 2 ELSE 0 END) | (CASE WHEN v = 0 THEN 4 ELSE 0 END) | (CASE WHEN v = nv - 1 THEN 8 ELSE 0 END) | (CASE WHEN least(u, nu - 1 - u, v, nv - 1 - v) >= 3 THEN 16 ELSE 0 END) AS INT) AS ctx FROM grid)"""


@query("SELECT patch, u, v, ctx FROM solid", WALL, SOLID)
def solid_lattice(spark, sf):
    return surfaces.solid(_walls(spark, sf), 0.5)


WORN = "worn AS (SELECT * FROM solid WHERE NOT (u BETWEEN 1 AND 2 AND v < 3 AND patch % 3 = 0) AND NOT (u BETWEEN 2 AND 3 AND v BETWEEN 2 AND 3 AND patch % 3 = 1))"


def _worn(spark, sf):
    return surfaces.solid(_walls(spark, sf), 0.5).where("NOT (u BETWEEN 1 AND 2 AND v < 3 AND patch % 3 = 0) AND NOT (u BETWEEN 2 AND 3 AND v BETWEEN 2 AND 3 AND patch % 3 = 1)")


@query("SELECT patch, u, min(v) AS v FROM worn GROUP BY patch, u", WALL, SOLID, WORN)
def first_solid_cells(spark, sf):
    return surfaces.first_solid(_worn(spark, sf))


@query("""WITH low AS (SELECT patch, u, min(v) AS v FROM worn GROUP BY patch, u HAVING min(v) >= 3), r AS (SELECT *, u - row_number() OVER (PARTITION BY patch ORDER BY u) AS r FROM low)
SELECT patch, min(u) AS first, max(u) AS last, min(v) AS height FROM r GROUP BY patch, r HAVING max(u) - min(u) + 1 BETWEEN 1 AND 4""", WALL, SOLID, WORN)
def door_notches(spark, sf):
    return surfaces.notches(_worn(spark, sf), 1, 4, 3)


REACH = "reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)"
EMPTY = """box AS (SELECT patch, min(u) AS minu, max(u) AS maxu, min(v) AS minv, max(v) AS maxv FROM worn GROUP BY patch),
empty AS (SELECT *, (patch * 1000 + u) * 1000 + v AS id FROM (SELECT *, unnest(generate_series(minv, maxv)) AS v FROM (SELECT *, unnest(generate_series(minu, maxu)) AS u FROM box)) ANTI JOIN worn USING (patch, u, v)),
link AS (SELECT p.id AS a, q.id AS b FROM empty p JOIN empty q ON p.patch = q.patch AND abs(p.u - q.u) + abs(p.v - q.v) = 1)"""


@query("""WITH h AS (SELECT patch, hole, count(*) AS cells, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, max(u = minu OR u = maxu OR v = minv OR v = maxv) AS outside, min(minv) AS minv FROM
  (SELECT e.*, least(id, coalesce(m, id)) AS hole FROM empty e LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = id) GROUP BY patch, hole),
s AS (SELECT *, (u1 - u0 + 1) * 0.5::DOUBLE AS w, (v1 - v0 + 1) * 0.5::DOUBLE AS t, cells * 0.25::DOUBLE AS area FROM h WHERE NOT outside)
SELECT patch, CAST(cells AS INT) AS cells, u0, u1, v0, v1, CASE WHEN (v0 - minv) * 0.5 < 0.5 AND t > 1.4 THEN 'door' WHEN t < 0.5 OR w < 0.35 THEN 'unknown' ELSE 'window' END AS kind
FROM s WHERE area BETWEEN 0.35 AND 14 AND area / (w * t) >= 0.55 AND greatest(w / t, t / w) <= 6""", WALL, SOLID, WORN, EMPTY, REACH, recursive=True)
def lattice_openings(spark, sf):
    return surfaces.holes(_worn(spark, sf), 0.5).drop("hole").withColumn("cells", F.col("cells").cast("int"))


@query("""WITH runs AS (SELECT patch, v, key, min(u) AS u0, max(u) AS u1 FROM (SELECT patch, u, v, ctx & 4 AS key, u - row_number() OVER (PARTITION BY patch, v, ctx & 4 ORDER BY u) AS r FROM worn) GROUP BY patch, v, key, r)
SELECT patch, CAST(key AS INT) AS key, u0, min(v) AS v0, u1, max(v) AS v1 FROM (SELECT *, v - row_number() OVER (PARTITION BY patch, key, u0, u1 ORDER BY v) AS s FROM runs) GROUP BY patch, key, u0, u1, s""", WALL, SOLID, WORN)
def rectangle_cover(spark, sf):
    return surfaces.rectangles(_worn(spark, sf).withColumn("key", F.col("ctx").bitwiseAND(4).cast("int")))


@query("SELECT patch, u, v, CAST(ctx & 4 AS INT) AS key FROM worn", WALL, SOLID, WORN)
def greedy_rectangle_cover(spark, sf):
    r = surfaces.greedy_rectangles(_worn(spark, sf).withColumn("key", F.col("ctx").bitwiseAND(4)))
    cells = r.withColumn("u", F.explode(F.sequence("u0", "u1"))).withColumn("v", F.explode(F.sequence("v0", "v1")))  # each cell as often as rectangles have it
    return cells.select("patch", F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), F.col("key").cast("int").alias("key"))


TOPS = "tops AS (SELECT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, max(z) AS top FROM points GROUP BY 1, 2)"


def _tops(spark, sf):
    return v.points(spark, sf).groupBy(g.cell(F.col("x"), 2.0).alias("i"), g.cell(F.col("y"), 2.0).alias("j")).agg(F.max("z").alias("top"))


@query("SELECT i, j, top FROM tops", P, TOPS)
def column_ceilings(spark, sf):
    return _tops(spark, sf)


@query("SELECT id, coalesce(z > top + 1.5, false) AS conflict FROM sites LEFT JOIN tops ON i = CAST(floor(x / 2) AS BIGINT) AND j = CAST(floor(y / 2) AS BIGINT)", P, S, TOPS)
def free_space_conflicts(spark, sf):
    return surfaces.conflicts(v.sites(spark, sf).select("id", "x", "y", "z"), _tops(spark, sf), 2.0).select("id", "conflict")


@query("""WITH c AS (SELECT id % 50 AS patch, coalesce(z > top + 1.5, false) AS conflict FROM sites LEFT JOIN tops ON i = CAST(floor(x / 2) AS BIGINT) AND j = CAST(floor(y / 2) AS BIGINT))
SELECT patch, count(*) AS n FROM c GROUP BY patch HAVING avg(conflict::INT) <= 0.9""", P, S, TOPS)
def free_space_gate(spark, sf):
    s = v.sites(spark, sf).withColumn("patch", F.col("id") % 50)
    return surfaces.gate(s, _tops(spark, sf), 2.0, most=0.9).groupBy("patch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS id, round(least(greatest(sqrt(0.916290731874155 / p_size), 0.25), 1.0), 6) AS cell FROM part")
def sampling_cells(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), R(surfaces.sampling_cell(F.col("p_size")), 6).alias("cell"))


# --- meshes ---------------------------------------------------------------------------------

TRI = """tris AS (SELECT s_suppkey AS tri, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM supplier
  JOIN sites a ON a.id = s_suppkey * 3 JOIN sites b ON b.id = s_suppkey * 3 + 1 JOIN sites c ON c.id = s_suppkey * 3 + 2)"""


def _tris(spark, sf):
    s, p = v.table(spark, sf, "supplier"), v.sites(spark, sf)
    out = s.select(F.col("s_suppkey").alias("tri"))
    for n, k in enumerate("abc"):
        out = out.join(p.select(F.col("id").alias(f"_{k}"), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), F.col("tri") * 3 + n == F.col(f"_{k}")).drop(f"_{k}")
    return out


NRM = '(("by"-ay)*(cz-az) - (bz-az)*(cy-ay)) AS nx, ((bz-az)*(cx-ax) - (bx-ax)*(cz-az)) AS ny, ((bx-ax)*(cy-ay) - ("by"-ay)*(cx-ax)) AS nz'
AR = f"ar AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) / 2 AS area FROM (SELECT *, {NRM} FROM tris))"


@query("SELECT tri, round(area, 5) AS area FROM ar", S, TRI, AR)
def triangle_areas(spark, sf):
    return meshes.areas(_tris(spark, sf)).select("tri", R("area", 5).alias("area"))


@query("SELECT tri, " + ", ".join(f"round(CASE WHEN area > 0 THEN n{k} / (2 * area) ELSE 0 END, 5) + 0.0 AS n{k}" for k in "xyz") + " FROM ar", S, TRI, AR)
def triangle_normals(spark, sf):
    return meshes.normals(_tris(spark, sf)).select("tri", *[(R(f"n{k}", 5) + 0.0).alias(f"n{k}") for k in "xyz"])


@query('SELECT tri FROM tris WHERE (ax+bx+cx)/3 >= 5 AND (ax+bx+cx)/3 < 25 AND (ay+"by"+cy)/3 >= 5 AND (ay+"by"+cy)/3 < 30', S, TRI)
def mesh_crop(spark, sf):
    return meshes.crop(_tris(spark, sf), (5, 5), (25, 30)).select("tri")


@query("SELECT count(*) AS triangles, CAST(sum((area > 300)::INT) AS BIGINT) AS dropped, round(coalesce(sum(area) FILTER (area > 300), 0), 3) AS dropped_area, round(max(area), 5) AS largest FROM ar", S, TRI, AR)
def webbing_report(spark, sf):
    r = meshes.webbing_report(_tris(spark, sf), 300.0)
    return r.withColumns({"dropped_area": R("dropped_area", 3), "largest": R("largest", 5)})


@query("""WITH n AS (SELECT n_regionkey AS chunk, count(*) AS vertices FROM nation GROUP BY 1), b AS (SELECT chunk, coalesce(sum(vertices) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n)
SELECT chunk, CAST(n_nationkey % 5 + base AS BIGINT) AS a, CAST(n_nationkey % 4 + base AS BIGINT) AS b, CAST(n_nationkey % 3 + base AS BIGINT) AS c FROM nation JOIN b ON chunk = n_regionkey""")
def merged_faces(spark, sf):
    n = v.table(spark, sf, "nation")
    faces = n.select(F.col("n_regionkey").alias("chunk"), *[(F.col("n_nationkey") % m).cast("long").alias(k) for k, m in zip("abc", (5, 4, 3), strict=True)])
    return meshes.merge(faces, n.groupBy(F.col("n_regionkey").alias("chunk")).agg(F.count(F.lit(1)).alias("vertices")))


RAYS = "rays AS (SELECT r_regionkey AS ray, 2.0 + 4 * r_regionkey AS ox, 3.0 + 5 * r_regionkey AS oy, -5.0::DOUBLE AS oz, 0.125 * r_regionkey AS dx, 0.0625::DOUBLE AS dy, 1.0::DOUBLE AS dz FROM region)"


def _rays(spark, sf):
    k = F.col("r_regionkey")
    return v.table(spark, sf, "region").select(k.alias("ray"), (2.0 + 4 * k).alias("ox"), (3.0 + 5 * k).alias("oy"), F.lit(-5.0).alias("oz"), (0.125 * k).alias("dx"), F.lit(0.0625).alias("dy"), F.lit(1.0).alias("dz"))


@query("""WITH e AS (SELECT *, bx-ax AS ux, "by"-ay AS uy, bz-az AS uz, cx-ax AS vx, cy-ay AS vy, cz-az AS vz, ox-ax AS sx, oy-ay AS sy, oz-az AS sz FROM tris, rays),
p AS (SELECT *, dy*vz - dz*vy AS px, dz*vx - dx*vz AS py, dx*vy - dy*vx AS pz, sy*uz - sz*uy AS qx, sz*ux - sx*uz AS qy, sx*uy - sy*ux AS qz FROM e), d AS (SELECT *, ux*px + uy*py + uz*pz AS det FROM p),
h AS (SELECT ray, tri, (sx*px + sy*py + sz*pz) / det AS u, (dx*qx + dy*qy + dz*qz) / det AS w, (vx*qx + vy*qy + vz*qz) / det AS t FROM d WHERE abs(det) > 1e-12)
SELECT ray, tri, round(t, 6) AS t FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1 AND t > 1e-9 QUALIFY row_number() OVER (PARTITION BY ray ORDER BY t, tri) = 1""", S, TRI, RAYS)
def picked_triangles(spark, sf):
    return meshes.pick(_tris(spark, sf), _rays(spark, sf)).withColumn("t", R("t", 6))


@query("SELECT ring_id, 2 AS triangles, round(abs(sum(x1*y2 - x2*y1)) / 2, 6) AS area FROM edges GROUP BY ring_id", RG, ED)
def ring_triangles(spark, sf):
    t = meshes.triangulate(v.rings(spark, sf))
    area = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    return t.groupBy("ring_id").agg(F.count(F.lit(1)).cast("int").alias("triangles"), R(F.sum(area), 6).alias("area"))


@query()
def simplified_rings(spark, sf):
    """Ramer-Douglas-Peucker: held against its definition in the tests."""
    return meshes.simplify(v.rings(spark, sf), 2.0)


# --- segmentation ---------------------------------------------------------------------------


@query()
def plane_segments(spark, sf):
    """Connected planar voxels, refitted: held against analytic scenes in the tests."""
    p = segmentation.planes(v.points(spark, sf), 1.5, angle=45.0, distance=1.0, least_points=3, least_voxels=1, flat=0.0)
    return p.select("plane", "voxels", "n", R("rms", 5).alias("rms"))


CHM = "chm AS (SELECT i, j, z AS height FROM (SELECT CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, max(z) / 8 AS z FROM sites GROUP BY 1, 2))"


def _chm(spark, sf):
    return v.sites(spark, sf).groupBy(g.cell(F.col("x"), 1.0).alias("i"), g.cell(F.col("y"), 1.0).alias("j")).agg((F.max("z") / 8).alias("height"))


@query("""WITH c AS (SELECT i, j, height, power(least(greatest(height * 0.16 + 0.6, 1.2), 7.0), 2) AS r2 FROM chm WHERE height >= 2.5 AND height <= 40)
SELECT (a.i + 0.5) AS sx, (a.j + 0.5) AS sy, a.height FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE (b.i <> a.i OR b.j <> a.j) AND (b.i-a.i)*(b.i-a.i) + (b.j-a.j)*(b.j-a.j) <= b.r2 AND (b.height > a.height OR (b.height = a.height AND (b.i < a.i OR (b.i = a.i AND b.j < a.j)))))""", S, CHM)
def tree_stems(spark, sf):
    return segmentation.stems(_chm(spark, sf), 1.0).select("sx", "sy", "height")


@query("SELECT i, j, round(sum(w * h) / sum(w), 6) AS height FROM (SELECT a.i, a.j, b.height AS h, exp(-((a.i-b.i)*(a.i-b.i) + (a.j-b.j)*(a.j-b.j)) / 1.28) AS w FROM chm a JOIN chm b ON abs(a.i-b.i) <= 2 AND abs(a.j-b.j) <= 2) GROUP BY i, j", S, CHM)
def smoothed_canopy(spark, sf):
    return segmentation.smooth_canopy(_chm(spark, sf)).withColumn("height", R("height", 6))


@query("""WITH st AS (SELECT ring_id AS site, avg(px) AS sx, avg(py) AS sy FROM rings GROUP BY ring_id), n AS (SELECT id, z, site, (x-sx)*(x-sx) + (y-sy)*(y-sy) AS d2 FROM sites, st QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, site) = 1)
SELECT site, count(*) AS n, round(quantile_cont(z, 0.05), 6) AS base, max(z) AS top, round(quantile_cont(sqrt(d2), 0.9), 6) AS spread FROM n GROUP BY site HAVING count(*) >= 20""", S, RG)
def tree_instances(spark, sf):
    st = v.rings(spark, sf).groupBy(F.col("ring_id").alias("site")).agg(F.avg("px").alias("sx"), F.avg("py").alias("sy"))
    t = segmentation.trees(v.sites(spark, sf), st)
    return t.withColumns({"base": R("base", 6), "spread": R("spread", 6)})


@query("SELECT p_partkey AS id, round(least(greatest(p_size * 0.16::DOUBLE + 0.6, 1.2), 7.0), 6) AS radius FROM part")
def crown_radii(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), R(segmentation.crown_radius(F.col("p_size")), 6).alias("radius"))


# --- rays -----------------------------------------------------------------------------------

SCENE = "scene AS (SELECT i, j, k, arg_max(node, id) AS node FROM (SELECT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, CAST(floor(z / 2) AS BIGINT) AS k, id % 40 AS node, id FROM sites) GROUP BY i, j, k)"
BEAM = "beam AS (SELECT c_custkey AS ray, (c_custkey % 40) AS ox, (c_custkey % 48) AS oy, (c_custkey % 90) AS oz, CASE WHEN c_custkey % 2 = 0 THEN 0.6 ELSE 0.8 END AS dx, CASE WHEN c_custkey % 2 = 0 THEN 0.8 ELSE -0.6 END AS dy, 0.0 AS dz, 1.0 + c_custkey % 20 AS range FROM customer)"
HIT = """steps AS (SELECT ray, ox + t * dx AS x, oy + t * dy AS y, oz + t * dz AS z, t FROM (SELECT *, CAST(0.6 AS DOUBLE) + s * CAST(1.0 AS DOUBLE) AS t FROM (SELECT ray, ox::DOUBLE AS ox, oy::DOUBLE AS oy, oz::DOUBLE AS oz, dx::DOUBLE AS dx, dy::DOUBLE AS dy, dz::DOUBLE AS dz, unnest(generate_series(0, 24)) AS s FROM beam))),
hit AS (SELECT ray, arg_min(node, t) AS node, min(t) AS t FROM steps JOIN scene ON i = CAST(floor(x / 2) AS BIGINT) AND j = CAST(floor(y / 2) AS BIGINT) AND k = CAST(floor(z / 2) AS BIGINT) GROUP BY ray),
judged AS (SELECT b.ray, h.node, h.t - b.range AS error, CASE WHEN h.t IS NULL THEN 'missing' WHEN abs(h.t - b.range) <= 0.35 THEN 'explained' WHEN h.t < b.range THEN 'early' ELSE 'late' END AS verdict FROM beam b LEFT JOIN hit h USING (ray))"""


def _judged(spark, sf):
    s = v.sites(spark, sf)
    scene = rays.scene(s.select((F.col("id") % 40).alias("node"), F.col("id").alias("seq"), "x", "y", "z"), 2.0)
    k = F.col("c_custkey")
    beam = v.table(spark, sf, "customer").select(
        k.alias("ray"), (k % 40).cast("double").alias("ox"), (k % 48).cast("double").alias("oy"), (k % 90).cast("double").alias("oz"),
        F.when(k % 2 == 0, 0.6).otherwise(0.8).alias("dx"), F.when(k % 2 == 0, 0.8).otherwise(-0.6).alias("dy"), F.lit(0.0).alias("dz"), (1.0 + k % 20).alias("range"),
    )
    return rays.judge(beam, rays.march(beam, scene, 2.0, 24.6))


@query("SELECT ray, node, verdict FROM judged", S, SCENE, BEAM, HIT)
def ray_verdicts(spark, sf):
    return _judged(spark, sf).select("ray", "node", "verdict")


@query("SELECT count(*) AS rays, " + ", ".join(f"CAST(sum((verdict = '{x}')::INT) AS BIGINT) AS {x}" for x in ("explained", "early", "late", "missing")) + " FROM judged", S, SCENE, BEAM, HIT)
def validation_report(spark, sf):
    return rays.report(_judged(spark, sf))


@query("""SELECT node, count(*) AS rays, CAST(sum((verdict = 'explained')::INT) AS BIGINT) AS explained, round(median(error), 6) AS bias, round(sqrt(avg(error * error) FILTER (verdict = 'explained')), 6) AS rmse FROM judged WHERE node IS NOT NULL GROUP BY node HAVING count(*) >= 4""", S, SCENE, BEAM, HIT)
def validation_by_node(spark, sf):
    return rays.by_node(_judged(spark, sf)).withColumns({"bias": R("bias", 6), "rmse": R("rmse", 6)})


# --- generated worlds -----------------------------------------------------------------------


@query("""SELECT p_partkey AS id, CASE WHEN d < 0.5 THEN 'plain' WHEN d < 0.8 THEN 'bay' ELSE 'arcade' END AS family FROM (SELECT p_partkey, CAST(('0x' || substr(md5(p_partkey || '|family'), 1, 8)) AS BIGINT) / 4294967296.0 AS d FROM part)""")
def frontage_families(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), worldgen.family(F.col("p_partkey"), {"plain": 5, "bay": 3, "arcade": 2}).alias("family"))


OPEN = """n AS (SELECT patch AS wall, width, height, CAST(floor((width - 1.0) / 2.5 + 1) AS BIGINT) AS nc, CAST(floor((height - 1.5) / 3.0 + 1) AS BIGINT) AS nr FROM wall),
opens AS (SELECT wall, CAST(c AS INT) AS "column", CAST(r AS INT) AS "row", (width - ((nc - 1) * 2.5 + 1.0)) / 2 + c * 2.5 AS column_0, (width - ((nc - 1) * 2.5 + 1.0)) / 2 + c * 2.5 + 1.0 AS column_1, (height - ((nr - 1) * 3.0 + 1.5)) / 2 + r * 3.0 AS row_0, (height - ((nr - 1) * 3.0 + 1.5)) / 2 + r * 3.0 + 1.5 AS row_1
  FROM (SELECT *, unnest(generate_series(0, nr - 1)) AS r FROM (SELECT *, unnest(generate_series(0, nc - 1)) AS c FROM n WHERE nc >= 1 AND nr >= 1)))"""


def _opens(spark, sf):
    w = _walls(spark, sf).withColumnRenamed("patch", "wall")
    return w, worldgen.openings(w, 2.5, 3.0, 1.0, 1.5)


@query('SELECT wall, "column", "row", round(column_0, 6) AS column_0, round(column_1, 6) AS column_1, round(row_0, 6) AS row_0, round(row_1, 6) AS row_1 FROM opens', WALL, OPEN)
def opening_bands(spark, sf):
    return _opens(spark, sf)[1].withColumns({c: R(c, 6) for c in ("column_0", "column_1", "row_0", "row_1")})


@query("SELECT n.wall, round(width * height, 6) AS area, CAST(coalesce(k, 0) AS BIGINT) AS opens FROM n LEFT JOIN (SELECT wall, count(*) AS k FROM opens GROUP BY wall) o ON o.wall = n.wall", WALL, OPEN)
def punched_walls(spark, sf):
    w, o = _opens(spark, sf)
    cells = worldgen.punched(w, o)
    return cells.groupBy("wall").agg(R(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 6).alias("area"), F.sum(F.col("open").cast("long")).alias("opens"))


# --- imagery --------------------------------------------------------------------------------

PIX = "pix AS (SELECT CAST(o_orderkey % 7 AS BIGINT) AS image, CAST(floor(o_orderkey / 7.0) % 60 AS BIGINT) AS r, CAST(floor(o_orderkey / 420.0) % 30 AS BIGINT) AS c, max(o_custkey % 256) AS value FROM orders GROUP BY 1, 2, 3)"


def _pixels(spark, sf):
    k = F.col("o_orderkey")
    return v.table(spark, sf, "orders").groupBy((k % 7).cast("long").alias("image"), (F.floor(k / 7) % 60).cast("long").alias("r"), (F.floor(k / 420) % 30).cast("long").alias("c")).agg(F.max(F.col("o_custkey") % 256).alias("value"))


@query("""SELECT image, r, c, round(s / n, 6) AS mean FROM (SELECT a.image, a.r, a.c, sum(b.value) AS s, count(*) AS n FROM pix a JOIN pix b ON a.image = b.image AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY 1, 2, 3)""", PIX)
def image_box_blur(spark, sf):
    return imagery.box_mean(_pixels(spark, sf), "value", 2).select("image", "r", "c", R("mean", 6).alias("mean"))


@query("""WITH b AS (SELECT a.image, a.r, a.c, a.value, sum(b.value) / count(*) AS m FROM pix a JOIN pix b ON a.image = b.image AND abs(a.r - b.r) <= 4 AND abs(a.c - b.c) <= 4 GROUP BY 1, 2, 3, 4), w AS (SELECT image, sum(value) / count(*) AS g FROM pix GROUP BY image)
SELECT image, r, c, round(value * g / greatest(m, 1e-6), 7) AS value FROM b JOIN w USING (image)""", PIX)
def delighted_image(spark, sf):
    return imagery.delight(_pixels(spark, sf), "value", 4).select("image", "r", "c", R("value", 7).alias("value"))


@query("SELECT image, r, round(sum(value) / count(*), 6) AS mean FROM pix WHERE value > 20 GROUP BY image, r", PIX)
def row_profiles(spark, sf):
    return imagery.profile(_pixels(spark, sf).where("value > 20"), "r", "value").withColumn("mean", R("mean", 6))


@query("SELECT image, CAST(p AS BIGINT) AS phase, round(m, 6) AS mean FROM (SELECT image, r % 6 AS p, sum(value) / count(*) AS m FROM pix GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY image ORDER BY round(m, 9) DESC, p) = 1", PIX)
def grid_phases(spark, sf):
    return imagery.phase(_pixels(spark, sf), "r", "value", 6).withColumn("mean", R("mean", 6))


@query("SELECT t.image, CAST(rr AS BIGINT) AS r, CAST(cc AS BIGINT) AS c, value FROM pix t JOIN (SELECT unnest(generate_series(0, 40)) AS rr) x ON x.rr % 12 = t.r JOIN (SELECT unnest(generate_series(0, 20)) AS cc) y ON y.cc % 8 = t.c WHERE t.r < 12 AND t.c < 8", PIX)
def tiled_image(spark, sf):
    return imagery.tile(_pixels(spark, sf).where("r < 12 AND c < 8"), 12, 8, 41, 21)


@query("""WITH m AS (SELECT r % 6 AS cr, c % 5 AS cc, median(value) AS centre FROM pix GROUP BY 1, 2), s AS (SELECT cr, cc, centre, 1.4826 * median(abs(value - centre)) AS spread FROM pix JOIN m ON cr = r % 6 AND cc = c % 5 GROUP BY 1, 2, 3)
SELECT image, r, c FROM pix JOIN s ON cr = r % 6 AND cc = c % 5 WHERE abs(value - centre) > 1.2 * greatest(spread, 1e-6)""", PIX)
def damaged_pixels(spark, sf):
    return imagery.damaged(_pixels(spark, sf), "value", 6, 5, 1.2).select("image", "r", "c")
