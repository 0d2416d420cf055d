"""Queries over graphs, series, matches, records and cascades, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import cascades, graph, matching, polygons, records, series, voxels
from . import views as v
from .registry import query
from .spatial_queries import ED, MOM, P, PL, RA, RG, S, SHAPE, NCOV, NEAR, NSUM, R, _eigen_sql

# --- graphs ---------------------------------------------------------------------------------

REACH = """reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)"""


def _both(edges: str) -> str:
    return f"link AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges}))"


@query("SELECT c_custkey AS node, least(c_custkey, coalesce(m, c_custkey)) AS component FROM customer LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = c_custkey",
       _both("SELECT c_custkey AS a, c_custkey + 1 + c_custkey % 3 AS b FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey + 1 + c_custkey % 3 IN (SELECT c_custkey FROM customer)"), REACH, recursive=True)
def connected_components(spark, sf):
    nodes = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    e = nodes.where("node % 5 <> 0").select(F.col("node").alias("a"), (F.col("node") + 1 + F.col("node") % 3).alias("b"))
    return graph.label(nodes, e.join(nodes, e["b"] == nodes["node"], "left_semi"))


CELLS = "cells AS (SELECT DISTINCT i, j, i * 100000 + j AS id FROM raster WHERE c = 0)"


@query("SELECT i, j, least(id, coalesce(m, id)) AS component FROM cells LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = id",
       P, RA, CELLS, "link AS (SELECT x.id AS a, y.id AS b FROM cells x JOIN cells y ON (x.i = y.i AND abs(x.j - y.j) = 1) OR (x.j = y.j AND abs(x.i - y.i) = 1))", REACH, recursive=True)
def raster_labels(spark, sf):
    found = graph.raster_components(v.raster(spark, sf).where("c = 0"))
    first = found.groupBy("component").agg(F.min(F.col("i") * 100000 + F.col("j")).alias("first"))
    return found.join(first, "component").select("i", "j", F.col("first").alias("component"))


HIGH = "high AS (SELECT DISTINCT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, CAST(floor(z) AS BIGINT) AS k FROM sites WHERE z > 75), hid AS (SELECT *, (i * 1000 + j) * 1000 + k AS id FROM high)"


@query("SELECT i, j, k, least(id, coalesce(m, id)) AS component FROM hid LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = id",
       S, HIGH, "link AS (SELECT x.id AS a, y.id AS b FROM hid x JOIN hid y ON abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 AND abs(x.k - y.k) <= 1 AND x.id <> y.id)", REACH, recursive=True)
def voxel_labels(spark, sf):
    h = v.sites(spark, sf).where("z > 75").select(g.cell(F.col("x"), 2.0).alias("i"), g.cell(F.col("y"), 2.0).alias("j"), g.cell(F.col("z"), 1.0).alias("k"))
    found = graph.voxel_components(h)
    first = found.groupBy("component").agg(F.min((F.col("i") * 1000 + F.col("j")) * 1000 + F.col("k")).alias("first"))
    return found.join(first, "component").select("i", "j", "k", F.col("first").alias("component"))


@query("""SELECT count(*) AS n, min(x) AS minx, max(x) AS maxx, round(0.3 + 0.5 * least(1.0, count(*) / 250.0), 6) AS confidence FROM sites JOIN (SELECT i, j, k, least(id, coalesce(m, id)) AS component FROM hid LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = id) c
  ON c.i = CAST(floor(x / 2) AS BIGINT) AND c.j = CAST(floor(y / 2) AS BIGINT) AND c.k = CAST(floor(z / 2) AS BIGINT) WHERE z > 75 GROUP BY component HAVING count(*) >= 4 AND count(DISTINCT id) >= 2""".replace("count(DISTINCT id)", "count(DISTINCT (c.i, c.j, c.k))"),
       S, HIGH.replace("floor(z) AS BIGINT", "floor(z / 2) AS BIGINT"), "link AS (SELECT x.id AS a, y.id AS b FROM hid x JOIN hid y ON abs(x.i - y.i) <= 1 AND abs(x.j - y.j) <= 1 AND abs(x.k - y.k) <= 1 AND x.id <> y.id)", REACH, recursive=True)
def point_clusters(spark, sf):
    c = graph.clusters(v.sites(spark, sf).where("z > 75"), 2.0, 4, 2)
    return c.select("n", "minx", "maxx", R("confidence", 6).alias("confidence"))


REL = """rel AS (SELECT a.id AS a, b.id AS b, CASE WHEN abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) <= 0.3 THEN 'perpendicular' WHEN abs(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz) >= 0.94 THEN 'parallel' ELSE 'adjacent' END AS kind
  FROM planes a JOIN planes b ON a.id < b.id AND a.minx - 0.8 <= b.maxx AND b.minx <= a.maxx + 0.8 AND a.miny - 0.8 <= b.maxy AND b.miny <= a.maxy + 0.8 AND a.minz - 0.8 <= b.maxz AND b.minz <= a.maxz + 0.8)"""


@query("SELECT a, b, kind FROM rel", PL, REL)
def plane_relations(spark, sf):
    return matching.plane_relations(v.planes(spark, sf), 8.0)


@query("SELECT kind, count(*) AS n FROM rel GROUP BY kind", PL, REL)
def relation_counts(spark, sf):
    return matching.plane_relations(v.planes(spark, sf), 8.0).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, least(id, coalesce(m, id)) AS structure FROM planes LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = id", PL, REL, _both("SELECT a, b FROM rel WHERE kind = 'perpendicular'"), REACH, recursive=True)
def structure_groups(spark, sf):
    p = v.planes(spark, sf)
    r = matching.plane_relations(p, 8.0).withColumn("confidence", F.lit(0.9))
    return graph.structures(p.select("id"), r, ("perpendicular",)).select("id", "structure")


@query("SELECT a AS node, b AS neighbour, kind AS relation FROM rel WHERE kind = 'parallel' UNION ALL SELECT b, a, kind FROM rel WHERE kind = 'parallel'", PL, REL)
def node_neighbours(spark, sf):
    return graph.neighbours(matching.plane_relations(v.planes(spark, sf), 8.0).withColumnRenamed("kind", "relation"), "parallel")


@query("""SELECT 'missing parent' AS rule, CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE o_custkey % 7 = 0 AND o_orderkey + 3 NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'missing end', CAST(e AS VARCHAR) FROM (SELECT DISTINCT l_orderkey * 2 AS e FROM lineitem) WHERE e NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unknown relation', 'touches'""")
def graph_violations(spark, sf):
    nodes = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderkey") + 3).alias("parent"))
    e = v.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_orderkey") * 2).alias("b"), F.lit("touches").alias("relation"))
    return graph.violations(nodes, e, ("part_of", "adjacent"))


# --- gaps -----------------------------------------------------------------------------------

GAP = """dom AS (SELECT i, j, i IN (0, 19) OR j IN (0, 19) AS border FROM (SELECT unnest(generate_series(0, 19)) AS i) a, (SELECT unnest(generate_series(0, 19)) AS j) b),
cov AS (SELECT DISTINCT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j FROM sites WHERE id % 31 = 0 OR x + y < 30),
open AS (SELECT dom.*, i * 1000 + j AS id FROM dom ANTI JOIN cov USING (i, j)),
link AS (SELECT x.id AS a, y.id AS b FROM open x JOIN open y ON (x.i = y.i AND abs(x.j - y.j) = 1) OR (x.j = y.j AND abs(x.i - y.i) = 1))"""


@query("""WITH lab AS (SELECT i, j, border, least(id, coalesce(m, id)) AS component FROM open LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = id),
s AS (SELECT component, count(*) AS cells, bool_or(border) AS border, sum((i < 8 AND j < 12)::INT) AS west FROM lab GROUP BY component HAVING count(*) >= 2)
SELECT cells, cells * 4.0::DOUBLE AS area, CASE WHEN west * 2 > cells THEN 'courtyard' WHEN border THEN 'border' WHEN cells * 4.0 <= 30 THEN 'occlusion' ELSE 'void' END AS kind FROM s""", S, GAP, REACH, recursive=True)
def gap_kinds(spark, sf):
    ids = spark.range(400)
    dom = ids.select(F.floor(F.col("id") / 20).cast("long").alias("i"), (F.col("id") % 20).alias("j")).withColumn("border", F.col("i").isin(0, 19) | F.col("j").isin(0, 19))
    cov = v.sites(spark, sf).where("id % 31 = 0 OR x + y < 30").select(g.cell(F.col("x"), 2.0).alias("i"), g.cell(F.col("y"), 2.0).alias("j")).distinct()
    regions = dom.where("i < 8 AND j < 12").select("i", "j", F.lit("courtyard").alias("region"))
    return graph.gaps(cov, dom, regions, 2.0).select("cells", "area", "kind")


# --- series ---------------------------------------------------------------------------------


def _events(spark, sf):
    e = v.table(spark, sf, "events")
    return e.withColumn("minute", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long"))


HOURS = "hours AS (SELECT event_type AS g, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS o, count(*) AS n FROM events GROUP BY 1, 2)"


def _hours(spark, sf):
    return _events(spark, sf).groupBy(F.col("event_type").alias("g"), F.col("minute").alias("o")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH on_ AS (SELECT g, o, o - row_number() OVER (PARTITION BY g ORDER BY o) AS r FROM hours WHERE n >= 2), runs AS (SELECT g, r, min(o) AS first, max(o) AS last, count(*) AS length FROM on_ GROUP BY g, r)
SELECT g, first, last, length FROM runs QUALIFY row_number() OVER (PARTITION BY g ORDER BY length DESC, first) = 1""", HOURS)
def longest_runs(spark, sf):
    return series.longest_run(_hours(spark, sf).withColumn("on", F.col("n") >= 2), "g", "o", "on")


@query("""WITH d AS (SELECT g, o, n - lag(n) OVER (PARTITION BY g ORDER BY o) AS d FROM hours), e AS (SELECT g, sum(d * d) AS e FROM d GROUP BY g),
p AS (SELECT x.g, y.o - x.o AS lag, sum(x.d * y.d) AS p FROM d x JOIN d y ON x.g = y.g AND y.o - x.o BETWEEN 3 AND 29 WHERE x.d IS NOT NULL AND y.d IS NOT NULL GROUP BY 1, 2), s AS (SELECT g, lag, round(p / e, 9) AS strength FROM p JOIN e USING (g))
SELECT g, CAST(lag AS INT) AS lag, strength FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY strength DESC, lag) = 1""", HOURS)
def signal_periods(spark, sf):
    return series.period(_hours(spark, sf), "g", "o", "n", 3, 30)


@query("""WITH s AS (SELECT g, o, sum(n) OVER (PARTITION BY g ORDER BY o RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING) AS t FROM hours)
SELECT g, o AS start, CAST(t AS BIGINT) AS total FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY t DESC, o) = 1""", HOURS)
def best_windows(spark, sf):
    return series.best_window(_hours(spark, sf), "g", "o", "n", 24)


@query("SELECT event_id FROM events QUALIFY (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 7 = 0")
def thinned_events(spark, sf):
    return series.every_nth(v.table(spark, sf, "events"), ["ts", "event_id"], 7, "event_type").select("event_id")


@query("""WITH m AS (SELECT event_type, median(value) AS centre FROM events GROUP BY 1)
SELECT event_type, round(m.centre, 6) AS centre, round(1.4826 * median(abs(value - m.centre)), 6) AS spread FROM events JOIN m USING (event_type) GROUP BY event_type, m.centre""")
def robust_centres(spark, sf):
    return series.robust_centre(v.table(spark, sf, "events"), ["event_type"], "value").select("event_type", R("centre", 6).alias("centre"), R("spread", 6).alias("spread"))


@query("SELECT g, o, round(sum(n) OVER w / count(n) OVER w, 6) AS smooth FROM hours WINDOW w AS (PARTITION BY g ORDER BY o RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)", HOURS)
def smoothed_series(spark, sf):
    return series.smooth_mean(_hours(spark, sf), "g", "o", "n", 2).select("g", "o", R("smooth", 6).alias("smooth"))


@query("""WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return series.sessions(v.table(spark, sf, "events"), "user_id", "ts", "6 hours")


@query("""SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    from ..streaming.windows import tumbling

    return tumbling(v.table(spark, sf, "events"), "ts", "event_type", "value", "6 hours").select("event_type", "start", "n", R("total", 4).alias("total"))


# --- matching -------------------------------------------------------------------------------

NAT = "stems AS (SELECT ring_id AS site, avg(px) AS sx, avg(py) AS sy FROM rings GROUP BY ring_id)"


def _stems(spark, sf):
    return v.rings(spark, sf).groupBy(F.col("ring_id").alias("site")).agg(F.avg("px").alias("sx"), F.avg("py").alias("sy"))


@query("SELECT id, site, round(d2, 6) AS d2 FROM (SELECT id, site, (x-sx)*(x-sx) + (y-sy)*(y-sy) AS d2 FROM sites, stems) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, site) = 1", S, RG, NAT)
def nearest_sites(spark, sf):
    return matching.nearest(v.sites(spark, sf), _stems(spark, sf), "id", 4.0).select("id", "site", R("d2", 6).alias("d2"))


SEEDS = "seeds AS (SELECT DISTINCT CAST(floor(px) AS BIGINT) AS i, CAST(floor(py) AS BIGINT) AS j, min(ring_id) AS label FROM rings GROUP BY 1, 2)"


def _seeds(spark, sf):
    return v.rings(spark, sf).groupBy(g.cell(F.col("px"), 1.0).alias("i"), g.cell(F.col("py"), 1.0).alias("j")).agg(F.min("ring_id").alias("label"))


@query("""SELECT i + a.d AS i, j + b.d AS j, CAST(a.d * a.d + b.d * b.d AS INT) AS d2, label FROM seeds, (SELECT unnest(generate_series(-3, 3)) AS d) a, (SELECT unnest(generate_series(-3, 3)) AS d) b WHERE a.d * a.d + b.d * b.d <= 9
QUALIFY row_number() OVER (PARTITION BY seeds.i + a.d, seeds.j + b.d ORDER BY a.d * a.d + b.d * b.d, label) = 1""", RG, SEEDS)
def spread_labels(spark, sf):
    return matching.spread_labels(_seeds(spark, sf), 3)


REG = "reg AS (SELECT a.d AS di, b.d AS dj, count(*) / (SELECT count(*) FROM seeds) AS score FROM seeds s, (SELECT unnest(generate_series(-4, 4)) AS d) a, (SELECT unnest(generate_series(-4, 4)) AS d) b WHERE EXISTS (SELECT 1 FROM seeds t WHERE t.i + 2 = s.i + a.d AND t.j - 1 = s.j + b.d) GROUP BY 1, 2)"


def _registration(spark, sf):
    s = _seeds(spark, sf)
    return matching.registration(s, s.select((F.col("i") + 2).alias("i"), (F.col("j") - 1).alias("j")), 4)


@query("SELECT CAST(di AS INT) AS di, CAST(dj AS INT) AS dj, round(score, 6) AS score FROM reg", RG, SEEDS, REG)
def shift_scores(spark, sf):
    return _registration(spark, sf).withColumn("score", R("score", 6))


@query("""WITH t AS (SELECT di AS bi, dj AS bj, score AS peak FROM reg ORDER BY score DESC, di, dj LIMIT 1)
SELECT CAST(bi AS INT) AS di, CAST(bj AS INT) AS dj, round(any_value(peak), 6) AS peak, round(coalesce(max(score) FILTER (greatest(abs(di - bi), abs(dj - bj)) > 2), 0), 6) AS runner_up FROM reg, t GROUP BY bi, bj""", RG, SEEDS, REG)
def best_shift(spark, sf):
    b = matching.best_registration(_registration(spark, sf), 2)
    return b.withColumns({"peak": R("peak", 6), "runner_up": R("runner_up", 6)})


MOVED = "moved AS (SELECT id + 1000000 AS id, minx + id % 3 AS minx, maxx + id % 3 AS maxx, miny, maxy, minz - id % 2 AS minz, maxz FROM planes WHERE id % 5 <> 0)"
IOU = """iou AS (SELECT a.id AS truth, b.id AS found, i / (va + vb - i) AS iou, dd FROM (SELECT a.id, a, b, greatest(0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) * greatest(0, least(a.maxz, b.maxz) - greatest(a.minz, b.minz)) AS i,
  (a.maxx-a.minx)*(a.maxy-a.miny)*(a.maxz-a.minz) AS va, (b.maxx-b.minx)*(b.maxy-b.miny)*(b.maxz-b.minz) AS vb, 0 AS dd FROM planes a, moved b))"""


def _moved(spark, sf):
    p = v.planes(spark, sf).where("id % 5 <> 0")
    return p.select((F.col("id") + 1000000).alias("id"), (F.col("minx") + F.col("id") % 3).alias("minx"), "miny", (F.col("minz") - F.col("id") % 2).alias("minz"), (F.col("maxx") + F.col("id") % 3).alias("maxx"), "maxy", "maxz")


@query("SELECT a.id AS a, b.id AS b, round(i / (va + vb - i), 6) AS iou FROM (SELECT a.id AS ai, b.id AS bi, greatest(0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) * greatest(0, least(a.maxz, b.maxz) - greatest(a.minz, b.minz)) AS i, (a.maxx-a.minx)*(a.maxy-a.miny)*(a.maxz-a.minz) AS va, (b.maxx-b.minx)*(b.maxy-b.miny)*(b.maxz-b.minz) AS vb FROM planes a, moved b) x JOIN planes a ON a.id = ai JOIN moved b ON b.id = bi WHERE i > 0", PL, MOVED)
def box_overlaps(spark, sf):
    cols = [f"{m}{c}" for m in ("min", "max") for c in "xyz"]
    t, f = v.planes(spark, sf), _moved(spark, sf)
    met = matching.box_pairs(t, f, 8.0).join(t.select(F.col("id").alias("a"), *[F.col(c).alias(f"t{c}") for c in cols]), "a").join(f.select(F.col("id").alias("b"), *[F.col(c).alias(f"f{c}") for c in cols]), "b")
    return met.select("a", "b", R(g.box_iou({c: F.col(f"t{c}") for c in cols}, {c: F.col(f"f{c}") for c in cols}), 6).alias("iou")).where("iou > 0")


@query()
def box_assignment(spark, sf):
    """One-to-one assignment with the largest total overlap: held against brute force in the tests."""
    return matching.assign_boxes(v.planes(spark, sf), _moved(spark, sf)).withColumn("iou", R("iou", 6))


@query("""WITH t AS (SELECT DISTINCT a, b, kind FROM rel), f AS (SELECT DISTINCT a, b, CASE WHEN a % 4 = 0 THEN 'adjacent' ELSE kind END AS kind FROM rel WHERE b % 6 <> 0), x AS (SELECT t.a IS NOT NULL AS t, f.a IS NOT NULL AS f FROM t FULL JOIN f ON t.a = f.a AND t.b = f.b AND t.kind = f.kind),
c AS (SELECT CAST(count(*) FILTER (t AND f) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT t) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT f) AS BIGINT) AS fn FROM x)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""", PL, REL)
def relation_scores(spark, sf):
    t = matching.plane_relations(v.planes(spark, sf), 8.0)
    f = t.where("b % 6 <> 0").withColumn("kind", F.when(F.col("a") % 4 == 0, "adjacent").otherwise(F.col("kind")))
    s = matching.set_scores(t, f, ["a", "b", "kind"])
    return s.select("tp", "fp", "fn", *[R(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# --- records --------------------------------------------------------------------------------

TIERS = {"measured": 0, "derived": 1, "inferred": 2, "assumed": 3}
REP = "rep AS (SELECT l_orderkey AS entity, ['measured', 'derived', 'inferred', 'assumed'][CAST(l_linenumber % 4 + 1 AS INT)] AS tier, 'r' || l_linenumber AS repair, 's' || (l_suppkey % 5) AS evidence FROM lineitem)"


def _repairs(spark, sf):
    li = v.table(spark, sf, "lineitem")
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("entity"), tier.alias("tier"), F.concat(F.lit("r"), "l_linenumber").alias("repair"), F.array(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))).alias("evidence"))


@query("""WITH k AS (SELECT *, list_position(['measured', 'derived', 'inferred', 'assumed'], tier) - 1 AS k FROM rep), w AS (SELECT entity, tier, repair FROM k QUALIFY row_number() OVER (PARTITION BY entity ORDER BY k DESC, tier DESC, repair DESC) = 1)
SELECT w.entity, w.tier, w.repair, e.evidence FROM w JOIN (SELECT entity, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM rep GROUP BY entity) e USING (entity)""", REP)
def weakest_proofs(spark, sf):
    return records.weakest_proof(_repairs(spark, sf), TIERS).withColumn("evidence", F.concat_ws(",", "evidence"))


@query("SELECT 'tier' AS key, tier AS value, count(*) AS n FROM rep GROUP BY tier UNION ALL SELECT 'repair', repair, count(*) FROM rep GROUP BY repair UNION ALL SELECT 'all', '', count(*) FROM rep", REP)
def repair_summary(spark, sf):
    return records.summary(_repairs(spark, sf), "tier", "repair")


@query("""SELECT o_orderkey AS id, substr(sha256('{"a":' || o_custkey || ',"b":' || o_orderkey || '}'), 1, 16) AS hash FROM orders""")
def parameter_hashes(spark, sf):
    o = v.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), records.parameters_hash(F.create_map(F.lit("b"), F.col("o_orderkey"), F.lit("a"), F.col("o_custkey"))).alias("hash"))


@query("SELECT l_orderkey AS node, round(avg(((l_partkey & 128) <> 0)::INT), 6) AS measured, CASE WHEN avg(((l_partkey & 128) <> 0)::INT) >= 0.35 THEN 'derived' ELSE 'inferred' END AS state FROM lineitem GROUP BY 1")
def epistemic_states(spark, sf):
    cells = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("ctx"))
    return records.epistemic_state(cells, 128).withColumn("measured", R("measured", 6))


@query("""WITH r AS (SELECT l_orderkey AS id, count(*) AS rays, sum((l_returnflag = 'N')::INT) AS explained FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, round(CASE WHEN rays >= 3 THEN least(greatest(0.5 * (o_custkey % 100 / 100.0) + 0.5 * (explained / rays), 0.05), 0.99) ELSE o_custkey % 100 / 100.0 END, 6) AS confidence FROM orders LEFT JOIN r ON r.id = o_orderkey""")
def folded_confidence(spark, sf):
    nodes = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100 / 100.0).alias("confidence"))
    rays = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("rays"), F.sum((F.col("l_returnflag") == "N").cast("long")).alias("explained"))
    return records.fold_confidence(nodes, rays, least=3).withColumn("confidence", R("confidence", 6))


@query("""SELECT p_partkey AS id, CASE WHEN role = 'truth' THEN 'withheld: truth' WHEN epoch > 2020 THEN 'withheld: later than the epoch' WHEN role NOT IN ('input', 'prior') THEN 'withheld: role ' || role END AS reason FROM (SELECT p_partkey, 2010 + p_size % 20 AS epoch, ['input', 'prior', 'truth', 'style'][CAST(p_partkey % 4 + 1 AS INT)] AS role FROM part)""")
def layer_admission(spark, sf):
    p = v.table(spark, sf, "part")
    role = F.element_at(F.array(*[F.lit(x) for x in ("input", "prior", "truth", "style")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return records.admissible(p.select(F.col("p_partkey").alias("id"), role.alias("role"), (2010 + F.col("p_size") % 20).alias("epoch")), 2020, "reconstruction").select("id", "reason")


# --- cascades -------------------------------------------------------------------------------

DESC = "d AS (SELECT i, j, k, n / (27 * 1.5 * 1.5 * 1.5) AS density, round(linearity, 5) AS linearity, round(planarity, 5) AS planarity, (i % 10) / 10.0 AS verticality, (k * 1.5) AS hag, (j % 20) / 20.0 AS intensity FROM shapes)"


def _descriptors(spark, sf):
    d = voxels.descriptors(v.points(spark, sf), 1.5)
    return d.select("i", "j", "k", "density", R("linearity", 5).alias("linearity"), R("planarity", 5).alias("planarity"), (F.col("i") % 10 / 10.0).alias("verticality"), (F.col("k") * 1.5).alias("hag"), (F.col("j") % 20 / 20.0).alias("intensity"))


CLS = """cls AS (SELECT *, CASE WHEN density < 0.05 AND hag > 8 THEN 'noise' WHEN hag < 0.25 AND planarity > 0.35 AND intensity < 0.28 THEN 'road' WHEN hag < 0.25 THEN 'ground'
  WHEN linearity > 0.65 AND density < 3 AND hag > 4 AND verticality < 0.35 THEN 'wire' WHEN linearity > 0.65 AND hag > 1.5 AND verticality > 0.7 THEN 'pole'
  WHEN (verticality > 0.65 AND planarity > 0.45 AND hag > 1.5) OR (verticality < 0.35 AND planarity > 0.5 AND hag > 2.5) THEN 'building' WHEN hag > 0.5 THEN 'vegetation' ELSE 'unclassified' END AS class FROM d)"""
DSQL = (P, MOM, NEAR, NSUM, NCOV, _eigen_sql("ncov"), DESC, CLS)


@query("SELECT i, j, k, class FROM cls", *DSQL)
def semantic_classes(spark, sf):
    return cascades.first_match(_descriptors(spark, sf), cascades.surface_classes(), "class", ("unclassified", 0.0)).select("i", "j", "k", "class")


@query("""SELECT i, j, k, CASE WHEN class = 'building' AND planarity > 0.4 AND verticality > 0.62 AND hag > 0.8 THEN 'structure.wall' WHEN class = 'building' AND planarity > 0.4 AND slope > 12 AND hag > 2 THEN 'structure.roof.pitched'
  WHEN class = 'building' AND planarity > 0.4 AND hag > 2 THEN 'structure.roof.flat' WHEN class = 'building' AND planarity > 0.4 THEN 'structure.slab' WHEN class = 'building' THEN 'structure.wall' WHEN class = 'road' THEN 'ground.road' WHEN class = 'ground' THEN 'ground.terrain'
  WHEN class = 'vegetation' THEN 'vegetation.canopy' WHEN class = 'pole' THEN 'prop.pole' WHEN class = 'wire' THEN 'prop.wire' ELSE 'unknown' END AS role FROM (SELECT *, CAST((i + j) % 30 AS DOUBLE) AS slope FROM cls)""", *DSQL)
def point_roles(spark, sf):
    c = cascades.first_match(_descriptors(spark, sf), cascades.surface_classes(), "class", ("unclassified", 0.0))
    c = c.withColumn("slope", ((F.col("i") + F.col("j")) % 30).cast("double"))
    return cascades.first_match(c, cascades.point_roles(), "role", ("unknown", 0.1)).select("i", "j", "k", "role")


@query("SELECT quantile_cont(density, 0.9) >= 1.0 AS supported FROM d WHERE hag > 0.3 AND hag < 2.6", *DSQL[:-1])
def vehicle_density_gate(spark, sf):
    return cascades.density_gate(_descriptors(spark, sf))


@query("""SELECT id, CASE WHEN b AND NOT near THEN 'roof' WHEN p AND near THEN 'parking' WHEN s AND near THEN 'sidewalk' WHEN q AND near THEN 'pavement' WHEN b THEN 'building_ground' END AS owner
FROM (SELECT id, abs(z % 2) <= 0.5 AS near, id % 2 = 0 AS b, id % 3 = 0 AS p, id % 5 = 0 AS s, id % 7 = 0 AS q FROM sites)""", S)
def surface_owners(spark, sf):
    s = v.sites(spark, sf)
    flags = {"hag": F.col("z") % 2, "in_building": F.col("id") % 2 == 0, "in_parking": F.col("id") % 3 == 0, "in_sidewalk": F.col("id") % 5 == 0, "in_pavement": F.col("id") % 7 == 0}
    return cascades.owners(s.withColumns(flags)).select("id", "owner")


VOC = "voc(vocabulary, code) AS (VALUES ('a', 0), ('a', 1), ('a', 3), ('a', 5), ('b', 0), ('b', 1), ('b', 2), ('c', 1), ('c', 3), ('c', 5), ('c', 0))"


def _voc(spark):
    return spark.createDataFrame([(n, c) for n, cs in {"a": (0, 1, 3, 5), "b": (0, 1, 2), "c": (1, 3, 5, 0)}.items() for c in cs], "vocabulary string, code int")


@query("WITH ids AS (SELECT DISTINCT semantic AS code FROM points) SELECT vocabulary, round(count(ids.code) / (SELECT count(*) FROM ids), 6) AS coverage FROM voc LEFT JOIN ids USING (code) GROUP BY vocabulary", P, VOC)
def vocabulary_coverage(spark, sf):
    return cascades.vocabulary_coverage(v.points(spark, sf).select(F.col("semantic").alias("code")), _voc(spark)).select("vocabulary", R("coverage", 6).alias("coverage"))


@query("""WITH ids AS (SELECT DISTINCT semantic AS code FROM points), cov AS (SELECT vocabulary, count(ids.code) / (SELECT count(*) FROM ids) AS coverage, max(code) AS top FROM voc LEFT JOIN ids USING (code) GROUP BY vocabulary),
tied AS (SELECT count(*) AS n, min(vocabulary) AS first, max(top) AS top FROM cov WHERE coverage >= 0.9 AND coverage = (SELECT max(coverage) FROM cov))
SELECT CASE WHEN n = 0 OR (n > 1 AND top <= 9) THEN 'unknown' ELSE first END AS vocabulary FROM tied""", P, VOC)
def detected_vocabulary(spark, sf):
    return cascades.detect_vocabulary(v.points(spark, sf).select(F.col("semantic").alias("code")), _voc(spark))


@query("SELECT class, count(*) AS n FROM (SELECT CASE semantic WHEN 1 THEN 'ground' WHEN 5 THEN 'building' ELSE 'unclassified' END AS class FROM points) GROUP BY class", P)
def remapped_classes(spark, sf):
    t = spark.createDataFrame([(1, "ground"), (5, "building")], "code int, class string")
    return cascades.remap(v.points(spark, sf), "semantic", t).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
