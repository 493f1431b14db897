"""Joins of the inventory over the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.functions import geo
from quadrille.functions.num import half_up, percent
from quadrille.operators import folds, resolve, spatial
from quadrille.operators.graph import labelled
from quadrille.plans import views
from quadrille.plans.registry import query
from quadrille.plans.views import WITH, in_ward
from quadrille.storage import read_table


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers as records, suppliers as the master: some codes, some full names, some bare names."""
    c, s = read_table(spark, sf, "customer"), read_table(spark, sf, "supplier")
    key = F.col("c_custkey")
    records = c.select(
        key.alias("record_id"),
        F.when(key % 3 == 0, F.concat(F.col("c_nationkey"), F.lit(":"), (key % 200).cast("string"))).alias("code"),
        F.when(key % 3 != 2, F.concat(F.lit("w"), F.col("c_nationkey"), F.lit("-t"), (key % 40).cast("string"))).otherwise("").alias("full_key"),
        F.concat(F.lit("t"), (key % 90).cast("string")).alias("name_key"),
        F.col("c_acctbal").alias("value"),
    )
    k = F.col("s_suppkey")
    master = s.select(
        k.alias("master_id"), k.alias("ord"),
        F.concat(F.col("s_nationkey"), F.lit(":"), (k % 200).cast("string")).alias("code"),
        F.concat(F.lit("w"), F.col("s_nationkey"), F.lit("-t"), (k % 40).cast("string")).alias("full_key"),
        F.concat(F.lit("t"), (k % 90).cast("string")).alias("name_key"),
    )
    return records, master


RECORDS = """
WITH rec AS (
  SELECT c_custkey AS record_id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey || ':' || (c_custkey % 200) END AS code,
         CASE WHEN c_custkey % 3 <> 2 THEN 'w' || c_nationkey || '-t' || (c_custkey % 40) ELSE '' END AS full_key,
         't' || (c_custkey % 90) AS name_key, c_acctbal AS value FROM customer),
mas AS (
  SELECT s_suppkey AS master_id, s_nationkey || ':' || (s_suppkey % 200) AS code, 'w' || s_nationkey || '-t' || (s_suppkey % 40) AS full_key,
         't' || (s_suppkey % 90) AS name_key FROM supplier),
res AS (
  SELECT r.*, (SELECT max(master_id) FROM mas m WHERE m.code = r.code) AS by_code,
         CASE WHEN full_key <> '' THEN (SELECT count(*) FROM mas m WHERE m.full_key = r.full_key) ELSE (SELECT count(*) FROM mas m WHERE m.name_key = r.name_key) END AS n,
         CASE WHEN full_key <> '' THEN (SELECT min(master_id) FROM mas m WHERE m.full_key = r.full_key) ELSE (SELECT min(master_id) FROM mas m WHERE m.name_key = r.name_key) END AS by_name
  FROM rec r)
"""


@query("q_4_01_prioritised_join", RECORDS + """
SELECT record_id, coalesce(by_code, CASE WHEN n = 1 THEN by_name END) AS master_id,
       CASE WHEN by_code IS NOT NULL THEN 'code' WHEN n = 1 AND full_key <> '' THEN 'full-name' WHEN n = 1 THEN 'name' END AS method,
       CASE WHEN by_code IS NOT NULL THEN 'high' ELSE 'fallback' END AS confidence
FROM res WHERE by_code IS NOT NULL OR n = 1""")
def prioritised(spark, sf):
    return resolve.prioritised_join(*_records(spark, sf)).matched.select("record_id", "master_id", "method", "confidence")


@query("q_4_01_unmatched", RECORDS + """
SELECT record_id, CASE WHEN by_code IS NULL THEN n ELSE 0 END AS n_candidates,
       CASE WHEN coalesce(code, '') <> '' THEN 'code-not-in-master' ELSE 'no-code-and-no-single-name' END AS reason
FROM res WHERE by_code IS NULL AND n <> 1""")
def unmatched(spark, sf):
    return resolve.prioritised_join(*_records(spark, sf)).unmatched.select("record_id", F.col("n_candidates").cast("long").alias("n_candidates"), "reason")


@query("q_4_01_master_only", RECORDS + """
SELECT master_id FROM mas WHERE master_id NOT IN (SELECT coalesce(by_code, CASE WHEN n = 1 THEN by_name END) FROM res WHERE by_code IS NOT NULL OR n = 1)""")
def master_only(spark, sf):
    return resolve.prioritised_join(*_records(spark, sf)).master_only.select("master_id")


@query("q_5_06_match_summary", RECORDS + """
SELECT split_part(full_key, '-', 1) AS ward, count(*) AS n, count(*) FILTER (WHERE by_code IS NOT NULL) AS by_code,
       count(*) FILTER (WHERE by_code IS NULL AND n = 1) AS by_name, count(*) FILTER (WHERE by_code IS NULL AND n > 1) AS ambiguous,
       floor(count(*) FILTER (WHERE by_code IS NOT NULL OR n = 1) / count(*) * 1000 + 0.5) / 10 AS matched_percent
FROM res GROUP BY 1""")
def summary(spark, sf):
    found = resolve.prioritised_join(*_records(spark, sf))
    rows = found.matched.select("full_key", "method", F.lit(0).alias("n_candidates")).unionByName(found.unmatched.select("full_key", F.lit(None).cast("string").alias("method"), "n_candidates"))
    out = rows.groupBy(F.split_part(F.col("full_key"), F.lit("-"), F.lit(1)).alias("ward")).agg(
        F.count("*").alias("n"), F.count_if(F.col("method") == "code").alias("by_code"), F.count_if(F.col("method").isin("name", "full-name")).alias("by_name"),
        F.count_if(F.col("method").isNull() & (F.col("n_candidates") > 1)).alias("ambiguous"), F.count("method").alias("m"),
    )
    return out.select("ward", "n", "by_code", "by_name", "ambiguous", percent(F.col("m"), F.col("n")).alias("matched_percent"))


PERIODS = """
WITH old AS (
  SELECT s_suppkey AS id, s_suppkey AS ord, CASE WHEN s_suppkey % 4 <> 0 THEN 'c' || (s_suppkey % 80) END AS code, 't' || (s_suppkey % 60) AS name_key,
         CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE floor(s_acctbal) END AS value, s_suppkey % 13 = 0 AS withheld FROM supplier),
new AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'c' || (c_custkey % 120) END AS code, 't' || (c_custkey % 75) AS name_key,
         floor(c_acctbal) AS value, c_custkey % 17 = 0 AS withheld FROM customer),
oc AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY code ORDER BY ord DESC) = 1 AND code IS NOT NULL),
onm AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY ord DESC) = 1),
j AS (
  SELECT n.id, n.code, n.value, n.withheld, CASE WHEN oc.id IS NOT NULL THEN 'code' WHEN onm.id IS NOT NULL THEN 'name' ELSE 'unmatched' END AS method,
         coalesce(oc.id, onm.id) AS old_id, CASE WHEN oc.id IS NOT NULL THEN oc.code ELSE onm.code END AS old_code,
         CASE WHEN oc.id IS NOT NULL THEN oc.value ELSE onm.value END AS ov, CASE WHEN oc.id IS NOT NULL THEN oc.withheld ELSE onm.withheld END AS ow
  FROM new n LEFT JOIN oc ON n.code = oc.code LEFT JOIN onm ON n.name_key = onm.name_key),
s AS (SELECT *, CASE WHEN old_id IS NULL THEN 'new' WHEN ow OR withheld THEN 'suppressed' ELSE 'comparable' END AS status FROM j),
res AS (
  SELECT id, code, old_id, method, status, CASE WHEN NOT coalesce(ow, false) THEN ov END AS base,
         CASE WHEN status = 'new' OR NOT withheld THEN value END AS current, CASE WHEN status = 'comparable' THEN value - ov END AS change,
         CASE WHEN status = 'comparable' AND ov <> 0 THEN floor((value - ov) / ov * 1000 + 0.5) / 10 END AS rate FROM s
  UNION ALL
  SELECT NULL, code, id, 'unmatched', 'abolished', CASE WHEN NOT withheld THEN value END, NULL, NULL, NULL FROM old
  WHERE code IS NOT NULL AND code NOT IN (SELECT old_code FROM s WHERE old_code IS NOT NULL))
"""


def _periods(spark, sf):
    s, c = read_table(spark, sf, "supplier"), read_table(spark, sf, "customer")
    k = F.col("s_suppkey")
    old = s.select(k.alias("id"), k.alias("ord"), F.when(k % 4 != 0, F.concat(F.lit("c"), k % 80)).alias("code"), F.concat(F.lit("t"), k % 60).alias("name_key"), F.when(k % 11 == 0, 0.0).otherwise(F.floor("s_acctbal").cast("double")).alias("value"), (k % 13 == 0).alias("withheld"))
    k = F.col("c_custkey")
    new = c.select(k.alias("id"), k.alias("ord"), F.when(k % 2 == 0, F.concat(F.lit("c"), k % 120)).alias("code"), F.concat(F.lit("t"), k % 75).alias("name_key"), F.floor("c_acctbal").cast("double").alias("value"), (k % 17 == 0).alias("withheld"))
    return resolve.compare_periods(old, new)


@query("q_4_03_two_period_compare", PERIODS + "SELECT * FROM res")
def periods(spark, sf):
    return _periods(spark, sf)


@query("q_5_04_change_summary", PERIODS + """
SELECT status, method, count(*) AS n, count(*) FILTER (WHERE change > 0) AS increasing, count(*) FILTER (WHERE change < 0) AS decreasing, count(*) FILTER (WHERE change = 0) AS flat
FROM res GROUP BY status, method""")
def change_summary(spark, sf):
    c = F.col("change")
    return _periods(spark, sf).groupBy("status", "method").agg(F.count("*").alias("n"), F.count_if(c > 0).alias("increasing"), F.count_if(c < 0).alias("decreasing"), F.count_if(c == 0).alias("flat"))


@query("q_4_04_wide_merge", """
WITH o AS (SELECT o_custkey AS k, count(*) AS n_orders, floor(sum(floor(o_totalprice))) AS total FROM orders GROUP BY 1),
e AS (SELECT user_id AS k, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1)
SELECT c_custkey AS k, c_name AS name, n_orders, total, n_events, n_types, o.k IS NOT NULL AS has_orders, e.k IS NOT NULL AS has_events
FROM customer c LEFT JOIN o ON c.c_custkey = o.k LEFT JOIN e ON c.c_custkey = e.k""")
def wide(spark, sf):
    main = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    orders = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"), F.sum(F.floor("o_totalprice").cast("double")).alias("total"))
    events = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_types"))
    out = resolve.wide_merge(main, "k", orders=orders, events=events)
    return out.select("k", "name", "orders.n_orders", "orders.total", "events.n_events", "events.n_types", F.col("orders").isNotNull().alias("has_orders"), F.col("events").isNotNull().alias("has_events"))


@query("q_4_05_layer_comparison", """
WITH a AS (SELECT c_nationkey AS k, count(*) AS n, floor(sum(floor(c_acctbal))) AS v FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS k, count(*) AS n, floor(sum(floor(s_acctbal))) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only-a' WHEN a.k IS NULL THEN 'only-b' WHEN abs(a.v - b.v) > 0.1 * greatest(abs(a.v), abs(b.v)) THEN 'differs' ELSE 'same' END AS status,
       a.n AS n_a, b.n AS n_b FROM a FULL JOIN b ON a.k = b.k""")
def layers(spark, sf):
    side = lambda t, k, v: read_table(spark, sf, t).groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n"), F.sum(F.floor(v)).alias("v"))
    a = side("customer", "c_nationkey", "c_acctbal").select("k", F.col("n").alias("n_a"), F.col("v").alias("v_a"))
    b = side("supplier", "s_nationkey", "s_acctbal").select("k", F.col("n").alias("n_b"), F.col("v").alias("v_b"))
    far = F.abs(F.col("v_a") - F.col("v_b")) > 0.1 * F.greatest(F.abs("v_a"), F.abs("v_b"))
    status = F.when(F.col("n_b").isNull(), "only-a").when(F.col("n_a").isNull(), "only-b").when(far, "differs").otherwise("same")
    return a.join(b, "k", "full").select("k", status.alias("status"), "n_a", "n_b")


@query("q_4_06_sample_check", """
SELECT c_custkey AS k, CASE WHEN o.v IS NULL THEN 'missing' WHEN o.v = s.v THEN 'match' WHEN abs(o.v - s.v) <= 5 THEN 'close' ELSE 'mismatch' END AS verdict
FROM (SELECT c_custkey, c_custkey % 19 + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS v FROM customer) s
LEFT JOIN (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1) o ON s.c_custkey = o.o_custkey""")
def sample_check(spark, sf):
    k = F.col("c_custkey")
    sample = read_table(spark, sf, "customer").select(k.alias("k"), (k % 19 + F.when(k % 5 == 0, 2).otherwise(0)).alias("s"))
    official = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    verdict = F.when(F.col("v").isNull(), "missing").when(F.col("v") == F.col("s"), "match").when(F.abs(F.col("v") - F.col("s")) <= 5, "close").otherwise("mismatch")
    return sample.join(official, "k", "left").select("k", verdict.alias("verdict"))


HITS = WITH + f""", hit AS (SELECT DISTINCT p.point_id, w.ward_id FROM pts p JOIN ward_parts w ON {in_ward()}),
direct AS (SELECT point_id, count(*) AS n, min(ward_id) AS one FROM hit GROUP BY 1),
asked AS (
  SELECT p.point_id, m.i, p.x + m.dx AS x, p.z + m.dz AS z FROM pts p LEFT JOIN direct d ON p.point_id = d.point_id,
         (VALUES (0, 0.05, 0.0), (1, -0.05, 0.0), (2, 0.0, 0.05), (3, 0.0, -0.05)) m(i, dx, dz) WHERE coalesce(d.n, 0) <> 1),
voter AS (SELECT point_id, i, min(ward_id) AS ward_id FROM (SELECT DISTINCT a.point_id, a.i, w.ward_id FROM asked a JOIN ward_parts w ON {in_ward("a.x", "a.z")}) GROUP BY 1, 2 HAVING count(*) = 1),
votes AS (SELECT point_id, ward_id, count(*) AS v FROM voter GROUP BY 1, 2),
best AS (SELECT point_id, max(v) AS top, max_by(ward_id, v) AS ward_id, count(*) FILTER (WHERE v = mv) > 1 AS tie FROM (SELECT *, max(v) OVER (PARTITION BY point_id) AS mv FROM votes) GROUP BY 1),
res AS (
  SELECT p.point_id, p.ward, CASE WHEN coalesce(d.n, 0) = 1 THEN d.one WHEN b.top >= 2 AND NOT b.tie THEN b.ward_id END AS ward_id,
         CASE WHEN coalesce(d.n, 0) = 1 THEN 'inside' WHEN b.top >= 2 AND NOT b.tie THEN 'boundary-resolved' WHEN coalesce(d.n, 0) = 0 AND b.top IS NULL THEN 'outside' ELSE 'ambiguous' END AS status,
         coalesce(d.n, 0) AS n_hits FROM pts p LEFT JOIN direct d ON p.point_id = d.point_id LEFT JOIN best b ON p.point_id = b.point_id)
"""


@query("q_4_08_point_in_polygon", HITS + "SELECT point_id, ward_id, status, n_hits FROM res")
def point_in_polygon(spark, sf):
    return spatial.classify_points(views.pts(spark, sf), views.wards(spark, sf), 2000.0)


@query("q_4_07_reclassified", HITS + """
SELECT ward, CASE WHEN status = 'outside' THEN 'outside' WHEN status = 'ambiguous' THEN 'ambiguous' WHEN ward_id = ward THEN 'agree' ELSE 'other-ward' END AS verdict, count(*) AS n
FROM res GROUP BY 1, 2""")
def reclassified(spark, sf):
    p = views.pts(spark, sf)
    out = p.select("point_id", "ward").join(spatial.classify_points(p, views.wards(spark, sf), 2000.0), "point_id")
    verdict = F.when(F.col("status").isin("outside", "ambiguous"), F.col("status")).when(F.col("ward_id") == F.col("ward"), "agree").otherwise("other-ward")
    return out.groupBy("ward", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("q_5_07_ward_invariant", HITS + """
SELECT coalesce(CAST(ward_id AS VARCHAR), status) AS place, count(*) AS n, sum(count(*)) OVER () = (SELECT count(*) FROM customer) AS whole FROM res GROUP BY 1""")
def ward_invariant(spark, sf):
    p = views.pts(spark, sf)
    counts = spatial.classify_points(p, views.wards(spark, sf), 2000.0).groupBy(F.coalesce(F.col("ward_id").cast("string"), F.col("status")).alias("place")).agg(F.count("*").alias("n"))
    both = counts.agg(F.sum("n").alias("s")).select("s", F.lit(1).alias("one")).join(p.agg(F.count("*").alias("t")).withColumn("one", F.lit(1)), "one").select((F.col("s") == F.col("t")).alias("whole"), "one")
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(both), "one").select("place", "n", "whole")


@query("q_4_09_first_hit", WITH + f"SELECT p.point_id, min(w.ward_id) AS ward_id FROM pts p LEFT JOIN ward_parts w ON {in_ward()} GROUP BY 1")
def first_hit(spark, sf):
    return spatial.first_hit(views.pts(spark, sf), spatial.polygons(views.wards(spark, sf)), 2000.0, "point_id").select("point_id", "ward_id")


@query("q_4_11_clip_lines", WITH + f""", v AS (SELECT DISTINCT line_id, pos FROM line_points p JOIN ward_parts w ON {in_ward()}),
g AS (SELECT line_id, pos, pos - row_number() OVER (PARTITION BY line_id ORDER BY pos) AS g FROM v)
SELECT line_id, min(pos) - 1 AS run, count(*) AS n FROM g GROUP BY line_id, g HAVING count(*) >= 2""")
def clip_lines(spark, sf):
    return spatial.runs_inside(views.lines(spark, sf), views.wards(spark, sf), 2000.0, "line_id").select("line_id", F.col("run").cast("long").alias("run"), "n")


PAIRS = WITH + """, pair AS (
  SELECT a.rect_id AS a_id, b.rect_id AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0)) AS shared,
         a.area AS a_area, b.area AS b_area, sqrt((a.x0 + a.w / 2 - b.x0 - b.w / 2) ^ 2 + (a.z0 + a.h / 2 - b.z0 - b.h / 2) ^ 2) AS dist, a.x0 AS ax, b.x0 AS bx
  FROM rects a JOIN rects_b b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.z0 <= b.z1 AND b.z0 <= a.z1),
scored AS (SELECT *, shared / (a_area + b_area - shared) AS iou, least(a_area, b_area) / greatest(a_area, b_area) AS alike FROM pair)
"""


def _pairs(spark, sf):
    a = views.rects(spark, sf).select(F.col("rect_id").alias("a_id"), F.col("box").alias("a_box"), F.col("area").alias("a_area"))
    b = views.rects_b(spark, sf).select(F.col("rect_id").alias("b_id"), F.col("box").alias("b_box"), F.col("area").alias("b_area"))
    p = spatial.box_pairs(a, b, "a_box", "b_box", 100.0)
    mid = lambda box, lo, hi: (F.col(f"{box}.{lo}") + F.col(f"{box}.{hi}")) / 2
    dist = geo.distance(mid("a_box", "x0", "x1"), mid("a_box", "z0", "z1"), mid("b_box", "x0", "x1"), mid("b_box", "z0", "z1"))
    shared = geo.overlap_area(F.col("a_box"), F.col("b_box"))
    p = p.withColumn("shared", shared).withColumn("dist", dist)
    return p.withColumn("iou", F.col("shared") / (F.col("a_area") + F.col("b_area") - F.col("shared"))).withColumn("alike", F.least("a_area", "b_area") / F.greatest("a_area", "b_area"))


@query("q_4_14_mutual_best", PAIRS + """, m AS (SELECT *, floor((0.35 * iou + 0.25 * alike + 0.4 * greatest(0, 1 - dist / 20)) * 1e6 + 0.5) AS score FROM scored WHERE dist <= 20),
ba AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) = 1),
bb AS (SELECT b_id, a_id FROM m QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_id) = 1)
SELECT ba.a_id, ba.b_id, CAST(score AS BIGINT) AS score, ba.a_id = bb.a_id AS mutual,
       CASE WHEN ba.a_id = bb.a_id AND dist <= 8 AND alike >= 0.7 AND iou >= 0.4 AND score >= 550000 THEN 'HIGH' WHEN dist <= 15 AND alike >= 0.5 AND iou >= 0.15 AND score >= 300000 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM ba JOIN bb ON ba.b_id = bb.b_id""")
def mutual(spark, sf):
    score = F.floor((0.35 * F.col("iou") + 0.25 * F.col("alike") + 0.4 * F.greatest(F.lit(0.0), 1 - F.col("dist") / 20)) * 1e6 + 0.5)
    pairs = _pairs(spark, sf).where("dist <= 20").withColumn("score", score).select("a_id", "b_id", "score", "dist", "alike", "iou")
    best = resolve.mutual_best(pairs, "a_id", "b_id", "score")
    within = lambda d, a, i, s: (F.col("dist") <= d) & (F.col("alike") >= a) & (F.col("iou") >= i) & (F.col("score") >= s)
    confidence = F.when(F.col("mutual") & within(8, 0.7, 0.4, 550000), "HIGH").when(within(15, 0.5, 0.15, 300000), "MEDIUM").otherwise("LOW")
    return best.select("a_id", "b_id", "score", "mutual", confidence.alias("confidence"))


@query("q_4_15_overlap_components", PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, edge AS (SELECT 'a' || a_id AS a, 'b' || b_id AS b FROM pair WHERE shared > 0 AND dist <= 20), both_ways AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON r.node = e.a), comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1),
side AS (SELECT component, count(*) FILTER (WHERE node LIKE 'a%') AS n_a, count(*) FILTER (WHERE node LIKE 'b%') AS n_b FROM comp GROUP BY 1)
SELECT component, n_a, n_b, CASE WHEN n_a = 1 AND n_b = 1 THEN 'ONE_TO_ONE' WHEN n_a = 1 THEN 'ONE_TO_MANY' WHEN n_b = 1 THEN 'MANY_TO_ONE' ELSE 'COMPLEX' END AS kind FROM side""")
def overlap_components(spark, sf):
    """Groups of rectangles that touch, with how many of either side: one-to-one, one-to-many and so on."""
    pairs = _pairs(spark, sf).where("shared > 0 and dist <= 20")
    edges = pairs.select(F.concat(F.lit("a"), "a_id").alias("a"), F.concat(F.lit("b"), "b_id").alias("b"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    sides = labelled(nodes, edges).groupBy("comp").agg(F.count_if(F.col("node").startswith("a")).alias("n_a"), F.count_if(F.col("node").startswith("b")).alias("n_b"))
    kind = F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), "ONE_TO_ONE").when(F.col("n_a") == 1, "ONE_TO_MANY").when(F.col("n_b") == 1, "MANY_TO_ONE").otherwise("COMPLEX")
    return sides.select(F.col("comp").alias("component"), "n_a", "n_b", kind.alias("kind"))


@query("q_4_16_best_or_ambiguous", PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, dist, b_id) AS rn, shared / a_area AS covered, b_area / a_area AS ratio FROM scored),
two AS (SELECT a.a_id, f.b_id AS best_id, f.iou, f.dist, f.covered, f.ratio, s.b_id AS second_id, s.iou AS iou2, s.dist AS dist2, s.covered AS covered2
        FROM (SELECT rect_id AS a_id FROM rects) a LEFT JOIN r f ON a.a_id = f.a_id AND f.rn = 1 LEFT JOIN r s ON a.a_id = s.a_id AND s.rn = 2)
SELECT a_id, best_id, CASE WHEN best_id IS NULL THEN 'UNMATCHED' WHEN second_id IS NOT NULL AND ((iou - iou2 < 0.1 AND dist2 - dist < 3) OR (covered < 0.75 AND covered2 >= 0.15)) THEN 'AMBIGUOUS'
  WHEN iou >= 0.75 AND dist <= 10 AND ratio BETWEEN 0.8 AND 1.25 THEN 'HIGH' WHEN iou >= 0.6 AND dist <= 15 AND ratio BETWEEN 0.7 AND 1.4 THEN 'MEDIUM' ELSE 'UNMATCHED' END AS decision FROM two""")
def best_or_ambiguous(spark, sf):
    p = _pairs(spark, sf).withColumn("covered", F.col("shared") / F.col("a_area")).withColumn("area_ratio", F.col("b_area") / F.col("a_area"))
    two = resolve.best_and_second(p, "a_id", [F.desc("iou"), F.col("dist"), F.col("b_id")], ["b_id", "iou", "dist", "covered", "area_ratio"])
    all_ = views.rects(spark, sf).select(F.col("rect_id").alias("a_id")).join(two, "a_id", "left")
    return all_.select("a_id", F.col("best.b_id").alias("best_id"), resolve.decide(F.col("best"), F.col("second")).alias("decision"))


@query("q_4_17_overlap_classes", PAIRS + """, o AS (SELECT b_id, least(1, sum(shared) / any_value(b_area)) AS covered, max(iou) AS iou, max(shared / a_area) AS inside, max_by(a_area / b_area, shared / a_area) AS share, count(*) FILTER (WHERE shared > 0) AS partners FROM scored GROUP BY 1)
SELECT b.rect_id AS b_id, coalesce(partners, 0) AS partners, CASE WHEN covered >= 0.5 OR iou >= 0.5 THEN 'CLEAR' WHEN covered >= 0.2 OR (inside >= 0.5 AND share >= 0.3) THEN CASE WHEN (1 - covered) * b.area >= 60 AND covered < 0.35 AND NOT (inside >= 0.5 AND share >= 0.3) THEN 'AMBIGUOUS' ELSE 'LIKELY' END
  WHEN covered >= 0.02 THEN 'AMBIGUOUS' ELSE 'VALID' END AS class FROM rects_b b LEFT JOIN o ON b.rect_id = o.b_id""")
def overlap_classes(spark, sf):
    p = _pairs(spark, sf).withColumn("inside", F.col("shared") / F.col("a_area"))
    o = p.groupBy("b_id").agg(F.least(F.lit(1.0), F.sum("shared") / F.first("b_area")).alias("covered"), F.max("iou").alias("iou"), F.max("inside").alias("inside"), F.max_by(F.col("a_area") / F.col("b_area"), F.col("inside")).alias("share"), F.count_if(F.col("shared") > 0).alias("partners"))
    envelops = (F.col("inside") >= 0.5) & (F.col("share") >= 0.3)
    apart = ((1 - F.col("covered")) * F.col("area") >= 60) & (F.col("covered") < 0.35) & ~envelops
    kind = F.when((F.col("covered") >= 0.5) | (F.col("iou") >= 0.5), "CLEAR").when((F.col("covered") >= 0.2) | envelops, F.when(apart, "AMBIGUOUS").otherwise("LIKELY")).when(F.col("covered") >= 0.02, "AMBIGUOUS").otherwise("VALID")
    return views.rects_b(spark, sf).select(F.col("rect_id").alias("b_id"), "area").join(o, "b_id", "left").select("b_id", F.coalesce("partners", F.lit(0)).alias("partners"), kind.alias("class"))


@query("q_4_18_duplicates", PAIRS + "SELECT rect_id AS a_id FROM rects WHERE rect_id IN (SELECT a_id FROM scored WHERE iou >= 0.3)")
def duplicates(spark, sf):
    return views.rects(spark, sf).select(F.col("rect_id").alias("a_id")).join(_pairs(spark, sf).where("iou >= 0.3").select("a_id"), "a_id", "left_semi")


@query("q_4_19_presence_holes", WITH + """, c AS (SELECT DISTINCT floor(x0 / 200) + i AS cx, floor(z0 / 200) + j AS cz FROM rects, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)
  WHERE floor(x0 / 200) + i <= floor(x1 / 200) AND floor(z0 / 200) + j <= floor(z1 / 200))
SELECT target_id FROM (SELECT s_suppkey AS target_id, CAST((s_suppkey * 50021) % 24001 - 12000 AS DOUBLE) AS tx, CAST((s_suppkey * 30011) % 20001 - 10000 AS DOUBLE) AS tz FROM supplier) p
WHERE NOT EXISTS (SELECT 1 FROM c WHERE abs(c.cx - floor(p.tx / 200)) <= 1 AND abs(c.cz - floor(p.tz / 200)) <= 1)""")
def holes(spark, sf):
    from quadrille.operators.grid import around, box_cells

    near = around(box_cells(views.rects(spark, sf), 200.0), []).select("cx", "cz").distinct()
    p = _targets(spark, sf).select("target_id", geo.cell(F.col("tx"), 200.0).alias("cx"), geo.cell(F.col("tz"), 200.0).alias("cz"))
    return p.join(near, ["cx", "cz"], "left_anti").select("target_id")


@query("q_4_20_sparse_cells", WITH + """, a AS (SELECT floor((x0 + w / 2) / 1000) AS cx, floor((z0 + h / 2) / 1000) AS cz, count(*) AS n, sum(area) AS area FROM rects GROUP BY 1, 2),
b AS (SELECT floor(x / 1000) AS cx, floor(z / 1000) AS cz, count(*) * 100.0 AS area FROM pts GROUP BY 1, 2)
SELECT CAST(a.cx AS BIGINT) AS cx, CAST(a.cz AS BIGINT) AS cz, n FROM a LEFT JOIN b ON a.cx = b.cx AND a.cz = b.cz WHERE n >= 5 AND a.area / greatest(coalesce(b.area, 0), 200) >= 2.5""")
def sparse_cells(spark, sf):
    at = lambda df: df.groupBy(geo.cell(F.col("x0") + F.col("w") / 2, 1000.0).alias("cx"), geo.cell(F.col("z0") + F.col("h") / 2, 1000.0).alias("cz")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    b = views.pts(spark, sf).groupBy(geo.cell(F.col("x"), 1000.0).alias("cx"), geo.cell(F.col("z"), 1000.0).alias("cz")).agg((F.count("*") * 100.0).alias("other"))  # 100 square metres each
    out = at(views.rects(spark, sf)).join(b, ["cx", "cz"], "left")
    return out.where((F.col("n") >= 5) & (F.col("area") / F.greatest(F.coalesce("other", F.lit(0.0)), F.lit(200.0)) >= 2.5)).select("cx", "cz", "n")


NEAR = WITH + """, sup AS (SELECT s_suppkey AS target_id, s_nationkey AS kind, s_acctbal AS v, CAST((s_suppkey * 50021) % 24001 - 12000 AS DOUBLE) AS tx, CAST((s_suppkey * 30011) % 20001 - 10000 AS DOUBLE) AS tz FROM supplier),
near AS (SELECT p.*, s.*, sqrt((p.x - s.tx) ^ 2 + (p.z - s.tz) ^ 2) AS dist FROM pts p JOIN sup s ON abs(p.x - s.tx) <= 600 AND abs(p.z - s.tz) <= 600 AND sqrt((p.x - s.tx) ^ 2 + (p.z - s.tz) ^ 2) <= 600)
"""


def _targets(spark, sf):
    k = F.col("s_suppkey")
    return read_table(spark, sf, "supplier").select(k.alias("target_id"), F.col("s_nationkey").alias("kind"), F.col("s_acctbal").alias("v"), ((k * 50021) % 24001 - 12000).cast("double").alias("tx"), ((k * 30011) % 20001 - 10000).cast("double").alias("tz"))


def _near(spark, sf):
    return spatial.near_pairs(views.pts(spark, sf), _targets(spark, sf), "x", "z", "tx", "tz", 600.0)


@query("q_4_28_single_within", NEAR + """
SELECT p.point_id, CASE WHEN count(n.target_id) = 1 THEN min(n.target_id) END AS target_id, floor(min(n.dist) * 10 + 0.5) / 10 AS dist,
       CASE count(n.target_id) WHEN 0 THEN 'none-nearby' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS reason FROM pts p LEFT JOIN near n ON p.point_id = n.point_id GROUP BY 1""")
def single_within(spark, sf):
    return resolve.single_near(views.pts(spark, sf), _targets(spark, sf), 600.0)


@query("q_4_29_name_and_place", NEAR + """, same AS (SELECT p.point_id, s.target_id, sqrt((p.x - s.tx) ^ 2 + (p.z - s.tz) ^ 2) AS dist FROM pts p JOIN sup s ON p.ward = s.kind AND p.point_id % 8 = s.target_id % 8),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, target_id) AS rn FROM same),
two AS (SELECT f.point_id, f.target_id, f.dist AS d1, s.dist AS d2 FROM r f LEFT JOIN r s ON f.point_id = s.point_id AND s.rn = 2 WHERE f.rn = 1)
SELECT point_id, CASE WHEN d1 <= 4000 AND NOT coalesce(d2 - d1 < 300, false) THEN target_id END AS target_id, floor(d1 * 10 + 0.5) / 10 AS dist,
       CASE WHEN d1 > 4000 THEN 'too-far' WHEN d2 - d1 < 300 THEN 'ambiguous' ELSE 'verified' END AS reason FROM two""")
def name_and_place(spark, sf):
    p = views.pts(spark, sf).withColumn("m", F.col("point_id") % 8)
    s = _targets(spark, sf).withColumn("m", F.col("target_id") % 8).withColumnRenamed("kind", "ward")
    return resolve.by_name_and_place(folds.two_nearest(p, s, ["ward", "m"]), "point_id", "target_id", "dist", 4000, 300)


@query("q_4_30_settle_claims", """
WITH c AS (SELECT o_orderkey AS claim, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey % 700 END AS target, o_orderkey % 3 AS priority FROM orders),
b AS (SELECT *, count(*) OVER (PARTITION BY target) AS n, min(priority) OVER (PARTITION BY target) AS best FROM c),
t AS (SELECT *, count(*) FILTER (WHERE priority = best) OVER (PARTITION BY target) AS top FROM b)
SELECT claim, CASE WHEN target IS NOT NULL AND (n = 1 OR (priority = best AND top = 1)) THEN target END AS settled,
       CASE WHEN target IS NULL THEN 'no-target' WHEN n = 1 OR (priority = best AND top = 1) THEN 'kept' ELSE 'collision-lost' END AS reason FROM t""")
def settle(spark, sf):
    k = F.col("o_orderkey")
    claims = read_table(spark, sf, "orders").select(k.alias("claim"), F.when(k % 9 != 0, F.col("o_custkey") % 700).alias("target"), (k % 3).alias("priority"))
    return resolve.settle_claims(claims, "target", "priority").select("claim", "settled", "reason")


@query("q_4_34_open_candidates", """
SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND c_acctbal > 0""")
def open_candidates(spark, sf):
    c = read_table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    done = read_table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    tried = read_table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"))
    return c.join(done, "k", "left_anti").join(tried, "k", "left_anti")


@query("q_4_36_nearest_target", NEAR + "SELECT point_id, target_id, floor(dist * 1000 + 0.5) / 1000 AS dist FROM near QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, target_id) = 1")
def nearest(spark, sf):
    return spatial.nearest(views.pts(spark, sf), _targets(spark, sf), "point_id", "target_id", 600.0).withColumn("dist", half_up(F.col("dist"), 3))


@query("q_4_40_geometry_of_refs", WITH + """
SELECT line_id, count(*) AS n, floor(sum(d) * 1000 + 0.5) / 1000 AS length FROM (
  SELECT line_id, pos, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (z - lag(z) OVER w) ^ 2), 0) AS d FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)) GROUP BY 1""")
def refs(spark, sf):
    """Ways as lists of references, resolved to points by a join and put back in order."""
    nodes = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref"), F.struct((views.ix(F.col("o_custkey")) + (F.col("o_orderkey") * 37) % 401 - 200).alias("x"), (views.iz(F.col("o_custkey")) + (F.col("o_orderkey") * 53) % 301 - 150).alias("z")).alias("p"))
    ways = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("line_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("refs"))
    found = ways.select("line_id", F.posexplode("refs").alias("pos", "ref")).join(nodes, "ref")
    points = F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"])
    out = found.groupBy("line_id").agg(points.alias("points"))
    return out.select("line_id", F.size("points").cast("long").alias("n"), half_up(geo.path_length(F.col("points")), 3).alias("length"))


@query("q_4_42_first_wins", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(spark, sf):
    e = read_table(spark, sf, "events").select("event_type", "user_id", "event_id", F.struct("event_type", "user_id").alias("_k"))
    return resolve.first_by(e, "_k", "event_id").drop("_k")


@query("q_4_43_duplicate_candidates", WITH + """, p AS (SELECT point_id, x, z, segment, point_id % 50 AS name FROM pts),
d AS (SELECT a.point_id AS a, b.point_id AS b, sqrt((a.x - b.x) ^ 2 + (a.z - b.z) ^ 2) AS dist FROM p a JOIN p b ON a.segment = b.segment AND a.point_id < b.point_id AND a.name % 10 = b.name % 10 AND abs(a.x - b.x) <= 3000 AND abs(a.z - b.z) <= 3000)
SELECT id, count(*) AS n, min(other) AS least FROM (SELECT a AS id, b AS other FROM d WHERE dist <= 3000 UNION ALL SELECT b, a FROM d WHERE dist <= 3000) GROUP BY id""")
def duplicate_candidates(spark, sf):
    p = views.pts(spark, sf).withColumn("name", F.col("point_id") % 50)
    a = p.select(F.col("point_id").alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"), F.col("segment").alias("sa"), F.col("name").alias("na"))
    b = p.select(F.col("point_id").alias("b"), F.col("x").alias("bx"), F.col("z").alias("bz"), F.col("segment").alias("sb"), F.col("name").alias("nb"))
    pairs = spatial.near_pairs(a, b, "ax", "az", "bx", "bz", 3000.0).where("a < b and sa = sb and na % 10 = nb % 10").select("a", "b")
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    return both.groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("least"))


@query("q_4_45_nearest_k", WITH + """, sup AS (SELECT s_suppkey AS target_id, CAST((s_suppkey * 50021) % 24001 - 12000 AS DOUBLE) AS tx, CAST((s_suppkey * 30011) % 20001 - 10000 AS DOUBLE) AS tz FROM supplier)
SELECT * FROM (SELECT point_id, target_id, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((x - tx) ^ 2 + (z - tz) ^ 2), target_id) AS rank FROM pts p, sup s) WHERE rank <= 3""")
def nearest_k(spark, sf):
    return spatial.knn(views.pts(spark, sf).select("point_id", "x", "z"), _targets(spark, sf).select("target_id", "tx", "tz"), "point_id", "target_id", 3, 2000.0).select("point_id", "target_id", F.col("rank").cast("long").alias("rank"))


@query("q_3_36_overrides", """
SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 AND p_size % 2 = 0 THEN 'override' ELSE CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END END AS policy FROM part""")
def overrides(spark, sf):
    base = read_table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("policy"))
    over = base.where("k % 5 = 0").select("k", F.lit("even").alias("expected"), F.lit("override").alias("value"))
    return resolve.apply_overrides(base, over, "k", "policy")[0]
