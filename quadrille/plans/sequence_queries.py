"""Kernels, order-dependent operators and streams of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import geo, kernels, ringsets
from quadrille.functions.num import half_up
from quadrille.functions.triangles import triangulate
from quadrille.operators import sequential
from quadrille.operators.corridors import corridor_switches, track_corridors
from quadrille.operators.spatial import near_pairs
from quadrille.plans import views
from quadrille.plans.registry import query
from quadrille.plans.scalar_queries import pick, sql_pick
from quadrille.plans.views import SHAPES, WITH
from quadrille.storage import read_table, scratch
from quadrille.streaming import events, ids


RECURSIVE = WITH.replace("WITH ", "WITH RECURSIVE ", 1)


@query("q_10_07_inner_point", WITH + "SELECT rect_id, floor((x0 + w / 2) * 100 + 0.5) / 100 AS x, floor((z0 + h / 2) * 100 + 0.5) / 100 AS z, 'centroid' AS method FROM rects")
def inner_point(spark, sf):
    return views.rects(spark, sf).select("rect_id", kernels.inner_point_of(F.col("ring")).alias("p")).select("rect_id", "p.x", "p.z", "p.method")


@query("q_10_07_inner_point_shapes", WITH + SHAPES + """, c AS (SELECT *, CASE kind WHEN 1 THEN (1.5 * w * w + 2 * (h - 3)) / (3 * w + 2 * (h - 3)) WHEN 2 THEN w / 3 ELSE w / 2 END AS cx,
  CASE kind WHEN 1 THEN (4.5 * w + 2 * (h - 3) * (3 + (h - 3) / 2)) / (3 * w + 2 * (h - 3)) WHEN 2 THEN h / 3 WHEN 4 THEN 0 ELSE h / 2 END AS cz FROM shape),
m AS (SELECT *, CASE WHEN kind = 4 THEN 'box' WHEN kind = 1 AND cx >= 2 AND cz >= 3 THEN 'scan-line' ELSE 'centroid' END AS method FROM c)
SELECT shape_id, CAST(floor(floor((x0 + CASE WHEN method = 'scan-line' THEN 1 ELSE cx END) * 100 + 0.5) / 100) AS BIGINT) AS x, CAST(floor(floor((z0 + cz) * 100 + 0.5) / 100) AS BIGINT) AS z, method FROM m""")
def inner_point_shapes(spark, sf):
    """Whole metres of a point inside: the centroid, a scan line's middle where the centroid is outside, or the box's."""
    found = views.shapes(spark, sf).select("shape_id", kernels.inner_point_of(F.col("ring")).alias("p"))
    return found.select("shape_id", F.floor("p.x").alias("x"), F.floor("p.z").alias("z"), "p.method")


@query("q_10_12_thinned_shapes", WITH + SHAPES + """SELECT shape_id, CAST(CASE WHEN kind = 1 THEN 6 ELSE 4 END AS BIGINT) AS n, CASE kind WHEN 1 THEN 3 * w + 2 * (h - 3) WHEN 2 THEN w * h / 2 WHEN 4 THEN 0 ELSE w * h END AS area FROM shape""")
def thinned_shapes(spark, sf):
    """Outlines with a point in the middle of every edge: a corner is never dropped, and four points stay."""
    e = geo.edges(F.col("ring"))
    dense = F.flatten(F.transform(e, lambda s: F.array(s["p"], F.struct(((s["p"]["x"] + s["q"]["x"]) / 2).alias("x"), ((s["p"]["z"] + s["q"]["z"]) / 2).alias("z")))))
    out = views.shapes(spark, sf).select("shape_id", kernels.thin_ring(dense, F.lit(1.0)).alias("f")).select("shape_id", kernels.unflat(F.col("f")).alias("r"))
    return out.select("shape_id", F.size("r").cast("long").alias("n"), half_up(geo.area(F.col("r")), 6).alias("area"))


@query("q_10_14_clipped_shapes", WITH + SHAPES + """SELECT shape_id, floor(CASE kind WHEN 1 THEN (w - 1) * 2 + (h - 3) WHEN 2 THEN w * h / 2 * (1 - 1 / w - 1 / h) ^ 2 WHEN 4 THEN 0 ELSE (w - 1) * (h - 1) END * 1e6 + 0.5) / 1e6 AS area FROM shape""")
def clipped_shapes(spark, sf):
    """Outlines clipped by a rectangle of their size that stands a metre to the north-east."""
    at = lambda v, d: F.col(v) + d
    window = geo.rectangle(at("x0", 1), at("z0", 1), at("x0", 1) + F.col("w"), at("z0", 1) + F.col("h"))
    out = views.shapes(spark, sf).select("shape_id", ringsets.clip(F.col("ring"), window).alias("r"))
    return out.select("shape_id", half_up(F.coalesce(ringsets.area(F.col("r")), F.lit(0.0)), 6).alias("area"))


@query("q_10_18_triangles", WITH + SHAPES + """SELECT shape_id, CASE kind WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN 8 WHEN 4 THEN 0 ELSE 2 END AS n, CASE kind WHEN 1 THEN 3 * w + 2 * (h - 3) WHEN 2 THEN w * h / 2 WHEN 3 THEN w * h - 4 WHEN 4 THEN 0 ELSE w * h END AS filled,
  CASE WHEN kind = 4 THEN 'empty' END AS problem FROM shape""")
def triangle_faces(spark, sf):
    """The faces of each shape: how many, their area, and what is wrong with them."""
    return triangulate(views.shapes(spark, sf)).select("shape_id", F.size("faces").alias("n"), half_up(F.col("filled"), 6).alias("filled"), "problem")


@query("q_10_09_sampled_overlap", WITH + """, o AS (SELECT rect_id, a.x0 AS ax0, a.z0 AS az0, a.x1 AS ax1, a.z1 AS az1, b.x0 AS bx0, b.z0 AS bz0, b.x1 AS bx1, b.z1 AS bz1, least(a.x0, b.x0) AS lx, least(a.z0, b.z0) AS lz,
  greatest(a.x1, b.x1) - least(a.x0, b.x0) AS wide, greatest(a.z1, b.z1) - least(a.z0, b.z0) AS high, greatest(0.25::DOUBLE, greatest(1.0::DOUBLE, least(a.w, a.h, b.w, b.h)) / 12) AS cell FROM rects a JOIN rects_b b USING (rect_id)),
gx AS (SELECT *, lx + cell * (unnest(range(0, CAST(ceil(wide / cell) AS BIGINT))) + 0.5::DOUBLE) AS x FROM o), g AS (SELECT *, lz + cell * (unnest(range(0, CAST(ceil(high / cell) AS BIGINT))) + 0.5::DOUBLE) AS z FROM gx),
i AS (SELECT rect_id, x >= ax0 AND x < ax1 AND z >= az0 AND z < az1 AS in_a, x >= bx0 AND x < bx1 AND z >= bz0 AND z < bz1 AS in_b FROM g),
n AS (SELECT rect_id, count(*) FILTER (WHERE in_a) AS a, count(*) FILTER (WHERE in_b) AS b, count(*) FILTER (WHERE in_a AND in_b) AS both_ FROM i GROUP BY 1)
SELECT rect_id, floor(both_ / (a + b - both_) * 10000 + 0.5) / 10000 AS iou, floor(both_ / a * 10000 + 0.5) / 10000 AS covered_a, floor(both_ / b * 10000 + 0.5) / 10000 AS covered_b FROM n""")
def sampled_overlap(spark, sf):
    a = views.rects(spark, sf).select("rect_id", F.col("ring").alias("a"))
    b = views.rects_b(spark, sf).select("rect_id", F.col("ring").alias("b"))
    out = a.join(b, "rect_id").select("rect_id", ringsets.overlap_of(F.col("a"), F.col("b")).alias("o"))
    return out.select("rect_id", *(half_up(F.col(f"o.{k}"), 4).alias(k) for k in ("iou", "covered_a", "covered_b")))


@query("q_10_12_thinned_rings", WITH + "SELECT rect_id, CAST(4 AS BIGINT) AS n, area FROM rects")
def thinned_rings(spark, sf):
    """Rings with a point in the middle of every edge lose just those."""
    e = geo.edges(F.col("ring"))
    dense = F.flatten(F.transform(e, lambda s: F.array(s["p"], F.struct(((s["p"]["x"] + s["q"]["x"]) / 2).alias("x"), ((s["p"]["z"] + s["q"]["z"]) / 2).alias("z")))))
    out = views.rects(spark, sf).select("rect_id", kernels.thin_ring(dense, F.lit(1.0)).alias("f")).select("rect_id", kernels.unflat(F.col("f")).alias("r"))
    return out.select("rect_id", F.size("r").cast("long").alias("n"), half_up(geo.area(F.col("r")), 6).alias("area"))


@query("q_10_12_thinned_lines", RECURSIVE + """, n AS (SELECT line_id, count(*) AS n FROM line_points GROUP BY 1),
p AS MATERIALIZED (SELECT line_id, pos, x, z FROM line_points),
part(line_id, a, b) AS (SELECT line_id, CAST(1 AS BIGINT), n FROM n
  UNION ALL SELECT line_id, unnest([a, pos]), unnest([pos, b]) FROM (
    SELECT line_id, a, b, pos, d, row_number() OVER (PARTITION BY line_id, a, b ORDER BY d DESC, pos) AS rank FROM (
      SELECT line_id, a, b, pos, (x - ax - t * (bx - ax)) ^ 2 + (z - az - t * (bz - az)) ^ 2 AS d FROM (
        SELECT q.line_id, q.a, q.b, m.pos, m.x, m.z, f.x AS ax, f.z AS az, l.x AS bx, l.z AS bz, least(1, greatest(0, ((m.x - f.x) * (l.x - f.x) + (m.z - f.z) * (l.z - f.z)) / greatest((l.x - f.x) ^ 2 + (l.z - f.z) ^ 2, 1e-9))) AS t
        FROM part q JOIN p m ON m.line_id = q.line_id AND m.pos > q.a AND m.pos < q.b JOIN p f ON f.line_id = q.line_id AND f.pos = q.a JOIN p l ON l.line_id = q.line_id AND l.pos = q.b))) WHERE rank = 1 AND d > 3600),
kept AS (SELECT line_id, a AS pos FROM part UNION SELECT line_id, b FROM part),
step AS (SELECT line_id, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (z - lag(z) OVER w) ^ 2), 0) AS d FROM kept JOIN p USING (line_id, pos) WINDOW w AS (PARTITION BY line_id ORDER BY pos))
SELECT line_id, CAST(any_value(n) AS INTEGER) AS before, CAST(count(*) AS INTEGER) AS after, floor(sum(d) * 1000 + 0.5) / 1000 AS length FROM step JOIN n USING (line_id) GROUP BY 1""")
def thinned_lines(spark, sf):
    out = views.lines(spark, sf).select("line_id", F.size("points").alias("before"), kernels.thin_line(F.col("points"), F.lit(60.0)).alias("f")).select("line_id", "before", kernels.unflat(F.col("f")).alias("p"))
    return out.select("line_id", "before", F.size("p").alias("after"), half_up(geo.path_length(F.col("p")), 3).alias("length"))


@query("q_10_14_clip", WITH + """
SELECT a.rect_id, floor(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0)) * 1e6 + 0.5) / 1e6 AS area FROM rects a JOIN rects_b b ON a.rect_id = b.rect_id""")
def clip(spark, sf):
    a = views.rects(spark, sf).select("rect_id", F.col("ring").alias("a"))
    b = views.rects_b(spark, sf).select("rect_id", F.col("ring").alias("b"))
    out = a.join(b, "rect_id").select("rect_id", ringsets.clip(F.col("a"), F.col("b")).alias("r"))
    return out.select("rect_id", half_up(F.coalesce(ringsets.area(F.col("r")), F.lit(0.0)), 6).alias("area"))


@query("q_10_13_self_crossing", WITH + "SELECT rect_id, rect_id % 5 = 0 AS crosses FROM rects")
def self_crossing(spark, sf):
    """Every fifth rectangle gets its corners in crossing order."""
    r = F.col("ring")
    bow = F.array(*(F.element_at(r, i) for i in (1, 3, 2, 4)))
    return views.rects(spark, sf).select("rect_id", kernels.crosses_itself(F.when(F.col("rect_id") % 5 == 0, bow).otherwise(r)).alias("crosses"))


#: A plain loop for SQL, in each component of the pairs ``pr`` (i, j) on its own: items come by number n, ``gone`` holds
#: the numbers of those that went.
LOOP = """,
edge AS (SELECT i, j FROM pr UNION ALL SELECT j, i FROM pr),
chained(n, root) AS (SELECT i, i FROM edge UNION SELECT e.j, c.root FROM chained c JOIN edge e ON e.i = c.n),
g AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY n) AS k FROM (SELECT n, min(root) AS comp FROM chained GROUP BY n)),
taken(comp, k, gone) AS (SELECT DISTINCT comp, CAST(0 AS BIGINT), []::BIGINT[] FROM g
  UNION ALL SELECT w.comp, g.k, CASE WHEN m.i IS NULL OR list_contains(w.gone, g.n) THEN w.gone ELSE {step} END FROM taken w JOIN g ON g.comp = w.comp AND g.k = w.k + 1 LEFT JOIN m ON m.i = g.n),
lost AS (SELECT unnest(arg_max(gone, k)) AS n FROM taken GROUP BY comp)
"""
FACILITY_NAMES = ["中央小学校前広場", "みなと図書館分館北", "Kita Park Hall"]


@query("q_4_44_greedy_dedupe", RECURSIVE + f""", f AS (SELECT point_id AS id, row_number() OVER (ORDER BY point_id) AS n, x, z, segment, substring({sql_pick(FACILITY_NAMES, "point_id")}, 1, 2 + CAST(point_id % 7 AS INTEGER)) AS name FROM pts),
pr AS (SELECT a.n AS i, b.n AS j, length(a.name) >= length(b.name) AS beats FROM f a JOIN f b ON a.n < b.n AND a.segment = b.segment AND (a.x - b.x) ^ 2 + (a.z - b.z) ^ 2 < 810000 AND (contains(a.name, b.name) OR contains(b.name, a.name))),
m AS (SELECT i, coalesce(list(j) FILTER (beats), []) AS wins, coalesce(list(j) FILTER (NOT beats), []) AS loses FROM pr GROUP BY i)"""
       + LOOP.format(step="list_concat(list_concat(w.gone, m.wins), CASE WHEN len(list_filter(m.loses, lambda j: NOT list_contains(w.gone, j))) > 0 THEN [g.n] ELSE []::BIGINT[] END)")
       + "SELECT id, name FROM f WHERE n NOT IN (SELECT n FROM lost)")
def greedy_dedupe(spark, sf):
    """Near facilities of one segment whose names are part of one another: the longer name stays, the earlier on a tie."""
    name = F.substr(pick(FACILITY_NAMES, F.col("point_id")), F.lit(1), (2 + F.col("point_id") % 7).cast("int"))
    items = views.pts(spark, sf).select(F.col("point_id").alias("id"), F.col("point_id").alias("ord"), name.alias("name"), F.col("segment").alias("category"), "x", "z")
    return sequential.contained_names(items, 900.0).select("id", "name")


@query("q_5_18_station_clusters")
def station_clusters(spark, sf):
    p = views.pts(spark, sf)
    s = p.select(F.col("point_id").alias("station_id"), F.concat(F.lit("s"), F.col("point_id") % 30).alias("name"), F.when(F.col("point_id") % 25 == 0, F.concat(F.lit("g"), F.col("point_id") % 4)).alias("grp"), "x", "z")
    return sequential.station_clusters(s, 600.0, 3000.0, 1500.0)


@query("q_6_03_smoothed_widths", """
WITH RECURSIVE raw AS (SELECT o_custkey AS river, o_orderkey AS pos, floor(o_totalprice / 1000) + 5 AS w FROM orders),
s AS MATERIALIZED (SELECT *, row_number() OVER v AS i, lead(w) OVER v AS behind, count(*) OVER (PARTITION BY river) AS n, median(w) OVER (PARTITION BY river) AS mid FROM raw WINDOW v AS (PARTITION BY river ORDER BY pos)),
done(river, pos, i, width) AS (
  SELECT river, pos, i, CASE WHEN n < 3 THEN w WHEN e / mid BETWEEN 1 / 2.6::DOUBLE AND 2.6 THEN e ELSE (e + mid) / 2 END FROM (SELECT *, CASE WHEN w / behind BETWEEN 1 / 2.1::DOUBLE AND 2.1 THEN w ELSE (w + behind) / 2 END AS e FROM s WHERE i = 1)
  UNION ALL SELECT river, pos, i, CASE WHEN n < 3 THEN w WHEN i = n THEN CASE WHEN e / mid BETWEEN 1 / 2.6::DOUBLE AND 2.6 THEN e ELSE (e + mid) / 2 END
      WHEN greatest(before, behind) / least(before, behind) < 1.8 AND NOT w / ((before + behind) / 2) BETWEEN 1 / 1.8::DOUBLE AND 1.8 THEN (before + behind) / 2 ELSE w END
    FROM (SELECT s.*, d.width AS before, CASE WHEN s.w / d.width BETWEEN 1 / 2.1::DOUBLE AND 2.1 THEN s.w ELSE (s.w + d.width) / 2 END AS e FROM done d JOIN s ON s.river = d.river AND s.i = d.i + 1))
SELECT river, pos, width FROM done""")
def smoothed_widths(spark, sf):
    w = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("river"), F.col("o_orderkey").alias("pos"), (F.floor(F.col("o_totalprice") / 1000) + 5).alias("width"))
    return sequential.smooth_widths(w, "river", "pos", "width")


#: The best sequence of partners of each track, segment by segment; worths in millionths, state 1 is none.
TRACKS = """
WITH RECURSIVE raw AS (SELECT l_orderkey % 997 AS track, l_orderkey // 997 AS pos, CASE WHEN l_linenumber <> 4 THEN l_suppkey % 5 END AS partner, l_linenumber AS seg, floor(l_discount * 100) / 10 AS score FROM lineitem),
best AS (SELECT track, pos, partner, seg, CAST(round(score * 1000000) AS BIGINT) AS worth, row_number() OVER (PARTITION BY track, pos ORDER BY score DESC, seg, partner) AS rank FROM raw WHERE partner IS NOT NULL QUALIFY rank <= 3),
state AS (SELECT track, partner, row_number() OVER (PARTITION BY track ORDER BY n DESC, first) + 1 AS s FROM (SELECT track, partner, count(*) AS n, min(pos * 10 + rank) AS first FROM best GROUP BY 1, 2)),
cand AS (SELECT b.track, b.pos, s.s, max(worth) AS worth, arg_max(b.seg, worth * 10 - rank) AS seg FROM best b JOIN state s USING (track, partner) GROUP BY 1, 2, 3),
grid AS (SELECT track, pos, list(CASE WHEN k.s = 1 THEN -150000 ELSE c.worth END ORDER BY k.s) AS l FROM (SELECT DISTINCT track, pos FROM raw) JOIN (SELECT track, s FROM state UNION ALL SELECT DISTINCT track, 1 FROM raw) k USING (track) LEFT JOIN cand c USING (track, pos, s) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pos) AS i FROM grid),
fwd(track, i, v) AS (SELECT track, i, l FROM g WHERE i = 1
  UNION ALL SELECT g.track, g.i, list_transform(range(1, len(g.l) + 1), lambda s: g.l[s] + list_max(list_transform(range(1, len(g.l) + 1), lambda q: f.v[q] - CASE WHEN q <> s AND q > 1 AND s > 1 THEN 550000 ELSE 0 END))) FROM fwd f JOIN g ON g.track = f.track AND g.i = f.i + 1),
kept AS MATERIALIZED (SELECT * FROM fwd),
back(track, i, s) AS (SELECT track, i, list_position(v, list_max(v)) FROM kept QUALIFY row_number() OVER (PARTITION BY track ORDER BY i DESC) = 1
  UNION ALL SELECT track, i, list_position(w, list_max(w)) FROM (SELECT k.track, k.i, list_transform(range(1, len(k.v) + 1), lambda q: k.v[q] - CASE WHEN q <> b.s AND q > 1 AND b.s > 1 THEN 550000 ELSE 0 END) AS w FROM back b JOIN kept k ON k.track = b.track AND k.i = b.i - 1)),
path AS (SELECT b.track, g.pos, b.s, lag(b.s) OVER (PARTITION BY b.track ORDER BY b.i) AS before FROM back b JOIN g ON g.track = b.track AND g.i = b.i)
"""


def _corridors(spark, sf):
    k = F.col("l_orderkey")
    c = read_table(spark, sf, "lineitem").select((k % 997).alias("track"), F.floor(k / 997).alias("pos"), F.when(F.col("l_linenumber") != 4, F.col("l_suppkey") % 5).alias("partner"), F.col("l_linenumber").alias("seg"), (F.floor(F.col("l_discount") * 100) / 10).alias("score"))
    return track_corridors(c)


@query("q_6_06_corridors", TRACKS + """SELECT p.track, p.pos, s.partner, c.seg, c.worth / 1000000 AS score, coalesce(p.s <> p.before AND p.s > 1 AND p.before > 1, false) AS switched
FROM path p LEFT JOIN state s ON s.track = p.track AND s.s = p.s LEFT JOIN cand c ON c.track = p.track AND c.pos = p.pos AND c.s = p.s""")
def corridors(spark, sf):
    return _corridors(spark, sf)


@query("q_6_06_corridor_switches", TRACKS + "SELECT track, count(*) AS segments, count(*) FILTER (s > 1) AS paired, count(*) FILTER (s <> before AND s > 1 AND before > 1) AS switches FROM path GROUP BY 1")
def switches(spark, sf):
    return corridor_switches(_corridors(spark, sf))


@query("q_6_09_anchors", RECURSIVE + """, f AS (SELECT point_id AS id, row_number() OVER (ORDER BY point_id) AS n, x, z, segment || '-' || point_id % 20 AS name FROM pts),
pr AS (SELECT a.n AS i, b.n AS j FROM f a JOIN f b ON a.n < b.n AND a.name = b.name AND (a.x - b.x) ^ 2 + (a.z - b.z) ^ 2 <= 20250000),
m AS (SELECT i, list(j) AS near FROM pr GROUP BY 1)""" + LOOP.format(step="list_concat(w.gone, m.near)") + "SELECT id FROM f WHERE n NOT IN (SELECT n FROM lost)")
def anchors(spark, sf):
    p = views.pts(spark, sf).select(F.concat_ws("-", "segment", (F.col("point_id") % 20).cast("string")).alias("name"), F.col("point_id").alias("id"), F.col("point_id").alias("ord"), "x", "z")
    return sequential.anchors(p, "name", 4500.0)


@query("q_6_10_labels")
def labels(spark, sf):
    c = views.pts(spark, sf).select(
        (F.col("ward") % 5).alias("view"), F.col("point_id").alias("id"), F.floor("balance").alias("priority"), F.hypot("x", "z").alias("near"),
        (F.col("x") / 12000).alias("sx"), (F.col("z") / 10000).alias("sy"), F.lit(0.03).alias("hw"), F.lit(0.02).alias("hh"), (F.col("point_id") % 200 == 0).alias("pinned"),
    )
    return sequential.place_labels(c)


@query("q_10_16_assembled_rings", WITH + "SELECT rect_id AS relation, 'outer' AS role, CAST(0 AS BIGINT) AS ring, CAST(4 AS BIGINT) AS n, rect_id % 6 <> 0 AS closed FROM rects")
def assembled_rings(spark, sf):
    """Rectangles cut in two ways each, one turned round; every sixth lacks its last edge."""
    at = lambda *i: F.array(*(F.element_at("ring", j) for j in i))
    r = views.rects(spark, sf)
    one = r.select(F.col("rect_id").alias("relation"), F.lit("outer").alias("role"), F.lit(1).alias("ord"), at(1, 2, 3).alias("points"))
    two = r.select(F.col("rect_id").alias("relation"), F.lit("outer").alias("role"), F.lit(2).alias("ord"), F.when(F.col("rect_id") % 6 == 0, at(4, 3)).otherwise(at(1, 4, 3)).alias("points"))
    return sequential.assemble_rings(one.unionByName(two))


# ---- streams -------------------------------------------------------------------------------------


@query("q_11_01_request_windows")
def request_windows(spark, sf):
    return events.drained(events.request_windows(events.event_stream(spark, sf)), "requests")


@query("q_11_03_resumed_batches", "SELECT event_id FROM events")
def resumed(spark, sf):
    """A stream that is run, and run again with the same checkpoint and with a lost one, takes every event once: each
    batch is in the table's log."""
    checkpoint, path = scratch(spark, "resumed-checkpoint"), scratch(spark, "resumed")
    stream = events.event_stream(spark, sf).select("event_id")
    for folder in (checkpoint, checkpoint, scratch(spark, "resumed-anew")):
        out = events.ledgered(stream, path, folder)
    return out


@query("q_11_05_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    """The first event of each key, by a store of ids on disk; the stream itself has no state."""
    return ids.dedup_stream(events.event_stream(spark, sf), ["user_id", "event_type"], scratch(spark, "dedup"), scratch(spark, "dedup-checkpoint"))


@query("q_11_06_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    return events.drained(events.tumbling(events.event_stream(spark, sf)), "tumbling", "complete")


@query("q_11_06_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(spark, sf):
    return events.drained(events.sessions(events.event_stream(spark, sf)), "sessions", "complete")
