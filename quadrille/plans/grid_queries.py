"""Grid audits, areas and clusters of the inventory over the derived places."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille.functions import geo
from quadrille.functions.num import half_up
from quadrille.operators import grid, spatial
from quadrille.plans import views
from quadrille.plans.registry import query
from quadrille.plans.views import WITH, in_ward
from quadrille.storage import read_table

SIZE = 500.0


def to_edge(x0: str, z0: str, x1: str, z1: str) -> str:
    """SQL of the distance from p to the edge of a rectangle, from within and from without."""
    within = f"p.x >= {x0} AND p.x <= {x1} AND p.z >= {z0} AND p.z <= {z1}"
    return f"CASE WHEN {within} THEN least(p.x - ({x0}), {x1} - p.x, p.z - ({z0}), {z1} - p.z) ELSE sqrt(greatest(0, {x0} - p.x, p.x - ({x1})) ^ 2 + greatest(0, {z0} - p.z, p.z - ({z1})) ^ 2) END"



#: Segments and samples of the lines; land cells with their first ward; large rectangles as parks.
GRID = WITH + f""", seg AS (SELECT * FROM (SELECT line_id, x AS bx, z AS bz, lag(x) OVER w AS ax, lag(z) OVER w AS az FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE ax IS NOT NULL),
step AS (SELECT *, sqrt((bx - ax) ^ 2 + (bz - az) ^ 2) AS d, CAST(greatest(1, ceil(sqrt((bx - ax) ^ 2 + (bz - az) ^ 2) / 250)) AS BIGINT) AS steps FROM seg),
sample AS (SELECT line_id, d / steps AS part, ax + (bx - ax) * (i / steps) AS x, az + (bz - az) * (i / steps) AS z FROM (SELECT *, unnest(range(0, steps + 1)) AS i FROM step)),
linecell AS (SELECT line_id, CAST(floor(x / 500) AS BIGINT) AS cx, CAST(floor(z / 500) AS BIGINT) AS cz, sum(part) AS length FROM sample GROUP BY 1, 2, 3),
landcell AS (SELECT cx, cz, min(w.ward_id) AS ward_id FROM (SELECT unnest(range(-26, 25)) AS cx), (SELECT unnest(range(-21, 21)) AS cz), ward_parts w WHERE {in_ward("(cx + 0.5) * 500", "(cz + 0.5) * 500")} GROUP BY 1, 2),
park AS (SELECT s_suppkey AS park_id, s_nationkey AS kind, x0, z0, x0 + (5 + s_suppkey % 20) * 60 AS x1, z0 + (5 + (s_suppkey * 7) % 20) * 60 AS z1 FROM (
  SELECT *, CAST((s_suppkey * 7919) % 24001 - 12000 AS DOUBLE) AS x0, CAST((s_suppkey * 104729) % 20001 - 10000 AS DOUBLE) AS z0 FROM supplier)),
parkcell AS (SELECT DISTINCT cx, cz FROM landcell, park p WHERE (cx + 0.5) * 500 >= p.x0 AND (cx + 0.5) * 500 < p.x1 AND (cz + 0.5) * 500 >= p.z0 AND (cz + 0.5) * 500 < p.z1),
built AS (SELECT CAST(floor((x0 + w / 2) / 500) AS BIGINT) AS cx, CAST(floor((z0 + h / 2) / 500) AS BIGINT) AS cz, count(*) AS n, sum(area) AS area FROM rects GROUP BY 1, 2),
touched AS (SELECT DISTINCT CAST(floor(x0 / 500) + i AS BIGINT) AS cx, CAST(floor(z0 / 500) + j AS BIGINT) AS cz FROM rects, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j) WHERE floor(x0 / 500) + i <= floor(x1 / 500) AND floor(z0 / 500) + j <= floor(z1 / 500)),
road AS (SELECT cx, cz, sum(length) AS length FROM linecell GROUP BY 1, 2), railstep AS (SELECT x0 AS ax, z0 AS az, sqrt(1500 ^ 2 + 900 ^ 2) AS d, CAST(ceil(sqrt(1500 ^ 2 + 900 ^ 2) / 250) AS BIGINT) AS steps FROM park),
rail AS (SELECT CAST(floor((ax + 1500 * (i / steps)) / 500) AS BIGINT) AS cx, CAST(floor((az + 900 * (i / steps)) / 500) AS BIGINT) AS cz, sum(d / steps) AS length FROM (SELECT *, unnest(range(0, steps + 1)) AS i FROM railstep) GROUP BY 1, 2),
cov AS (
  SELECT l.cx, l.cz, l.ward_id, coalesce(b.n, 0) AS n, coalesce(b.area, 0) AS area, b.n IS NOT NULL OR t.cx IS NOT NULL AS covered, coalesce(r.length, 0) AS road, coalesce(ra.length, 0) AS rail, p.cx IS NOT NULL AS in_park
  FROM landcell l LEFT JOIN built b ON l.cx = b.cx AND l.cz = b.cz LEFT JOIN touched t ON l.cx = t.cx AND l.cz = t.cz LEFT JOIN road r ON l.cx = r.cx AND l.cz = r.cz LEFT JOIN rail ra ON l.cx = ra.cx AND l.cz = ra.cz LEFT JOIN parkcell p ON l.cx = p.cx AND l.cz = p.cz),
gaps AS (SELECT *, NOT covered AND road > 30 AND NOT (in_park OR rail > 40) AS gap FROM cov)
"""

#: Components of uncovered cells: every cell's least reachable cell.
CLUSTERS = GRID.replace("WITH ", "WITH RECURSIVE ", 1) + """, open AS (SELECT cx, cz, row_number() OVER (ORDER BY cx, cz) AS i FROM cov WHERE NOT covered),
hop AS (SELECT a.i AS a, b.i AS b FROM open a JOIN open b ON abs(a.cx - b.cx) <= 1 AND abs(a.cz - b.cz) <= 1),
reach(i, root) AS (SELECT i, i FROM open UNION SELECT hop.b, r.root FROM reach r JOIN hop ON r.i = hop.a AND hop.b > r.root),
comp AS (SELECT i, min(root) AS root FROM reach GROUP BY 1),
clusters AS (SELECT count(*) AS n, CAST(min((cx + 0.5) * 500) AS DOUBLE) AS x0, CAST(max((cx + 0.5) * 500) AS DOUBLE) AS x1, CAST(min((cz + 0.5) * 500) AS DOUBLE) AS z0, CAST(max((cz + 0.5) * 500) AS DOUBLE) AS z1, floor(count(*) * 500 * 500 / 1e6 * 1000 + 0.5) / 1000 AS km2 FROM open JOIN comp USING (i) GROUP BY root HAVING count(*) >= 3)
"""


def _parts(spark, sf):
    return spatial.polygons(views.wards(spark, sf))


def _buildings(spark, sf):
    r = views.rects(spark, sf)
    return r.select((F.col("x0") + F.col("w") / 2).alias("x"), (F.col("z0") + F.col("h") / 2).alias("z"), "area", "box")


def _parks(spark, sf) -> DataFrame:
    """One large rectangle, and one railway line from its corner, a supplier."""
    k, s = F.col("s_suppkey"), read_table(spark, sf, "supplier")
    x, z = views.ix(k), views.iz(k)
    ring = geo.rectangle(x, z, x + (5 + k % 20) * 60, z + (5 + (k * 7) % 20) * 60)
    return s.select(k.alias("park_id"), F.col("s_nationkey").cast("long").alias("kind"), ring.alias("ring"), F.array(geo.point(x, z), geo.point(x + 1500, z + 900)).alias("points"))


def _coverage(spark, sf) -> DataFrame:
    lines, parks = views.lines(spark, sf), _parks(spark, sf)
    return grid.coverage(_parts(spark, sf), _buildings(spark, sf), lines, parks.select("points"), parks.select("points").limit(0), parks.select("ring"), size=SIZE)


@query("q_5_08_line_cells", GRID + "SELECT cx, cz, floor(length * 1000 + 0.5) / 1000 AS length FROM road")
def line_cells(spark, sf):
    return grid.line_cells(views.lines(spark, sf), SIZE).withColumn("length", half_up(F.col("length"), 3))


@query("q_5_09_area_cells", GRID + """
SELECT DISTINCT CAST(p.kind AS BIGINT) AS kind, CAST(cx AS BIGINT) AS cx, CAST(cz AS BIGINT) AS cz FROM park p, (SELECT unnest(range(-60, 60)) AS cx), (SELECT unnest(range(-60, 60)) AS cz)
WHERE (cx + 0.5) * 500 >= p.x0 AND (cx + 0.5) * 500 < p.x1 AND (cz + 0.5) * 500 >= p.z0 AND (cz + 0.5) * 500 < p.z1""")
def area_cells(spark, sf):
    return grid.ring_cells(_parks(spark, sf), SIZE, keep=["kind"]).select("kind", "cx", "cz")


@query("q_10_15_cell_masks", GRID + """
SELECT CAST(cx AS BIGINT) AS cx, CAST(cz AS BIGINT) AS cz, bit_or(CAST(1 << CAST(p.kind % 8 AS INT) AS BIGINT)) AS mask FROM park p, (SELECT unnest(range(-60, 60)) AS cx), (SELECT unnest(range(-60, 60)) AS cz)
WHERE (cx + 0.5) * 500 >= p.x0 AND (cx + 0.5) * 500 < p.x1 AND (cz + 0.5) * 500 >= p.z0 AND (cz + 0.5) * 500 < p.z1 GROUP BY 1, 2""")
def cell_masks(spark, sf):
    """Which kinds of parks a cell's centre lies in, a bit each."""
    parks = _parks(spark, sf).withColumn("bit", F.expr("shiftleft(1L, cast(kind % 8 as int))"))
    return grid.cell_masks(parks, SIZE)


@query("q_5_10_coverage_cells", GRID + "SELECT cx, cz, ward_id, n, area, covered, in_park, gap FROM gaps")
def coverage_cells(spark, sf):
    return _coverage(spark, sf).select("cx", "cz", "ward_id", "n", "area", "covered", "in_park", "gap")


@query("q_5_10_coverage_by_ward", GRID + """
SELECT ward_id, count(*) AS land_cells, count(*) FILTER (WHERE covered) AS building_cells, CAST(sum(n) AS BIGINT) AS buildings, sum(area) AS footprint, count(*) FILTER (WHERE gap) AS gap_cells, floor(count(*) FILTER (WHERE covered) / count(*) * 1000 + 0.5) / 1000 AS coverage FROM gaps GROUP BY 1""")
def coverage_by_ward(spark, sf):
    return grid.coverage_by_ward(_coverage(spark, sf))


@query("q_5_11_anomaly_cells", GRID + """
SELECT cx, cz, ward_id, CASE WHEN n = 0 AND road <= 30 AND NOT (in_park OR rail > 20) THEN 'A' WHEN n >= 3 AND road <= 3 AND NOT (in_park OR rail > 20) THEN 'B' END AS kind FROM cov
WHERE (n = 0 AND road <= 30 AND NOT (in_park OR rail > 20)) OR (n >= 3 AND road <= 3 AND NOT (in_park OR rail > 20))""")
def anomaly_cells(spark, sf):
    c = _coverage(spark, sf)
    open_ = F.col("in_park") | (F.col("rail") > 20)
    kind = F.when((F.col("n") == 0) & (F.col("road") <= 30) & ~open_, "A").when((F.col("n") >= 3) & (F.col("road") <= 3) & ~open_, "B")
    return c.withColumn("kind", kind).where("kind is not null").select("cx", "cz", "ward_id", "kind")


@query("q_5_12_road_density", GRID + """, raw AS (SELECT DISTINCT floor(x / 200 + 0.5) AS gx, floor(z / 200 + 0.5) AS gz FROM pts),
nb AS (SELECT l.cx, l.cz, l.ward_id, coalesce(b.n, 0) AS n, EXISTS (SELECT 1 FROM linecell r WHERE abs(r.cx - l.cx) <= 1 AND abs(r.cz - l.cz) <= 1) AS near,
  EXISTS (SELECT 1 FROM raw WHERE abs(raw.gx - floor((l.cx + 0.5) * 500 / 200 + 0.5)) <= 1 AND abs(raw.gz - floor((l.cz + 0.5) * 500 / 200 + 0.5)) <= 1) AS raw FROM landcell l LEFT JOIN built b ON l.cx = b.cx AND l.cz = b.cz),
sp AS (SELECT ward_id, count(*) FILTER (WHERE NOT near AND NOT raw) / count(*) >= 0.08 AS sparse FROM nb GROUP BY 1)
SELECT cx, cz, nb.ward_id, n, CASE WHEN NOT near AND NOT raw THEN 'source-missing' WHEN sparse THEN 'sparse-ward' WHEN (cx + 0.5) * 500 BETWEEN -3000 AND 3000 AND (cz + 0.5) * 500 BETWEEN -3000 AND 3000 THEN 'facility-block' ELSE 'unexplained' END AS cause FROM nb JOIN sp ON nb.ward_id = sp.ward_id WHERE NOT near AND n >= 1""")
def road_density(spark, sf):
    return grid.density(_parts(spark, sf), _buildings(spark, sf), views.lines(spark, sf), views.pts(spark, sf), [(-3000, -3000, 3000, 3000)], SIZE, 1, 200.0)


@query("q_5_15_gap_clusters", CLUSTERS + "SELECT n, x0, x1, z0, z1, km2 FROM clusters")
def gap_clusters(spark, sf):
    cells = _coverage(spark, sf).where("not covered").select("cx", "cz", "x", "z", "ward_id")
    return grid.clusters(cells, SIZE, 3).select("n", "x0", "x1", "z0", "z1", "km2")


@query("q_5_14_lone_blanks", GRID + """, b AS (SELECT l.cx, l.cz, list_sort(list(coalesce(n.n, 0))) AS v FROM (SELECT cx, cz FROM cov WHERE n = 0) l, (VALUES (-1), (0), (1)) d(dx), (VALUES (-1), (0), (1)) e(dz) LEFT JOIN built n ON n.cx = l.cx + d.dx AND n.cz = l.cz + e.dz WHERE dx <> 0 OR dz <> 0 GROUP BY 1, 2)
SELECT cx, cz, v[5] AS median FROM b WHERE v[5] >= 1""")
def lone_blanks(spark, sf):
    c = _coverage(spark, sf)
    return grid.lone_blanks(c.where("n = 0").select("cx", "cz"), grid.point_cells(_buildings(spark, sf), SIZE), 1)


@query("q_5_14_severity", """
WITH t AS (SELECT p_partkey AS id, ['A', 'B', 'C', 'D', 'F', 'G', 'H'][CAST(p_partkey % 7 + 1 AS INT)] AS kind, (p_partkey % 40) / 20.0 AS km2, p_partkey % 37 AS n, p_partkey % 9 = 0 AS explained, p_partkey % 4 = 0 AS major FROM part)
SELECT id, CASE WHEN explained THEN CASE WHEN km2 >= 0.3 THEN 'LOW' ELSE 'INFO' END WHEN kind = 'A' THEN CASE WHEN km2 >= 1 THEN 'CRITICAL' WHEN km2 >= 0.3 THEN 'HIGH' WHEN km2 >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END
  WHEN kind = 'F' THEN CASE WHEN n >= 20 THEN 'CRITICAL' WHEN n >= 5 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END WHEN kind = 'C' THEN CASE WHEN n >= 30 THEN 'HIGH' WHEN n >= 8 THEN 'MEDIUM' ELSE 'LOW' END
  WHEN kind = 'B' THEN CASE WHEN km2 >= 0.3 THEN 'HIGH' WHEN km2 >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END WHEN kind = 'D' THEN CASE WHEN major THEN 'CRITICAL' WHEN km2 >= 0.3 THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN kind = 'G' THEN 'MEDIUM' WHEN major THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM t""")
def severity(spark, sf):
    from quadrille.plans.scalar_queries import pick

    k = F.col("p_partkey")
    return read_table(spark, sf, "part").select(k.alias("id"), grid.severity(pick(list("ABCDFGH"), k), (k % 40) / 20.0, k % 37, k % 9 == 0, k % 4 == 0).alias("severity"))


@query("q_6_08_row_runs", GRID + """, c AS (SELECT cx, cz, cx - row_number() OVER (PARTITION BY cz ORDER BY cx) AS g FROM cov WHERE NOT covered), i AS (SELECT *, (row_number() OVER (PARTITION BY cz, g ORDER BY cx) - 1) // 4 AS k FROM c)
SELECT cz, min(cx) AS cx0, count(*) AS n FROM i GROUP BY cz, g, k""")
def row_runs(spark, sf):
    return grid.row_runs(_coverage(spark, sf).where("not covered").select("cx", "cz"), 4)


@query("q_10_20_eroded", GRID + "SELECT a.cx, a.cz FROM landcell a JOIN landcell b ON abs(a.cx - b.cx) <= 1 AND abs(a.cz - b.cz) <= 1 AND NOT (a.cx = b.cx AND a.cz = b.cz) GROUP BY 1, 2 HAVING count(*) = 8")
def eroded(spark, sf):
    return grid.eroded(grid.land_cells(_parts(spark, sf), SIZE))


@query("q_4_13_sampled_share", WITH + f""", big AS (SELECT rect_id, x0, z0, x0 + w * 30 AS x1, z0 + h * 30 AS z1 FROM rects),
s AS (SELECT rect_id, x0 + (i + 0.5) / 12 * (x1 - x0) AS x, z0 + (j + 0.5) / 12 * (z1 - z0) AS z FROM big, (SELECT unnest(range(0, 12)) AS i), (SELECT unnest(range(0, 12)) AS j))
SELECT rect_id, w.ward_id, count(*) AS n, floor(count(*) / 144 * 1e6 + 0.5) / 1e6 AS share FROM s JOIN ward_parts w ON {in_ward("s.x", "s.z")} GROUP BY 1, 2""")
def sampled_share(spark, sf):
    r = views.rects(spark, sf)
    shapes = r.select("rect_id", geo.rectangle(F.col("x0"), F.col("z0"), F.col("x0") + F.col("w") * 30, F.col("z0") + F.col("h") * 30).alias("ring"))
    return spatial.sampled_share(shapes, views.wards(spark, sf), 2000.0, "rect_id").withColumn("share", half_up(F.col("share"), 6))


@query("q_4_12_nearest_ward", WITH + f""", d AS (SELECT p.point_id, w.ward_id, least({to_edge("w.x0", "w.z0", "w.x1", "w.z1")}, CASE WHEN w.holed THEN {to_edge("w.hx0", "w.hz0", "w.hx0 + 1000", "w.hz0 + 800")} ELSE 1e9 END) AS dist FROM pts p, ward_parts w)
SELECT point_id, ward_id, floor(dist * 1000 + 0.5) / 1000 AS dist FROM d WHERE dist <= 3000 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, ward_id) = 1""")
def nearest_ward(spark, sf):
    """The ward whose outline or hole's edge is nearest to a point, within 3 km."""
    return spatial.nearest_edge(views.pts(spark, sf), _parts(spark, sf), 3000.0, "point_id").withColumn("dist", half_up(F.col("dist"), 3))


@query("q_4_24_conflicts", WITH + """
SELECT substr(sha1(least('a' || a.rect_id, 'b' || b.rect_id) || '|' || greatest('a' || a.rect_id, 'b' || b.rect_id)), 1, 12) AS conflict, a.rect_id AS a_id, b.rect_id AS b_id FROM rects a JOIN rects_b b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.z0 <= b.z1 AND b.z0 <= a.z1""")
def conflicts(spark, sf):
    a = views.rects(spark, sf).select(F.col("rect_id").alias("a_id"), F.col("box").alias("a_box"))
    b = views.rects_b(spark, sf).select(F.col("rect_id").alias("b_id"), F.col("box").alias("b_box"))
    ids = F.array_sort(F.array(F.concat(F.lit("a"), "a_id"), F.concat(F.lit("b"), "b_id")))
    return spatial.box_pairs(a, b, "a_box", "b_box", 100.0).select(F.substring(F.sha1(F.array_join(ids, "|")), 1, 12).alias("conflict"), "a_id", "b_id")


@query("q_4_25_points_in_smallest", WITH + """, big AS (SELECT rect_id, x0 - w * 10 AS x0, z0 - h * 10 AS z0, x1 + w * 10 AS x1, z1 + h * 10 AS z1, area FROM rects)
SELECT p.point_id, b.rect_id FROM pts p JOIN big b ON p.x >= b.x0 AND p.x < b.x1 AND p.z >= b.z0 AND p.z < b.z1 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY area, rect_id) = 1""")
def points_in_smallest(spark, sf):
    r = views.rects(spark, sf)
    ring = geo.rectangle(F.col("x0") - F.col("w") * 10, F.col("z0") - F.col("h") * 10, F.col("x1") + F.col("w") * 10, F.col("z1") + F.col("h") * 10)
    parts = r.select("rect_id", "area", ring.alias("outer"), F.array().cast("array<array<struct<x:double,z:double>>>").alias("holes")).withColumn("box", geo.bbox(F.col("outer")))
    return spatial.smallest_hit(views.pts(spark, sf), parts, 400.0, "point_id", "rect_id")


@query("q_4_35_vertex_ratio", WITH + f""", v AS (SELECT p.line_id, p.pos, min(w.ward_id) AS ward_id FROM line_points p LEFT JOIN ward_parts w ON {in_ward()} GROUP BY 1, 2), n AS (SELECT line_id, count(*) AS total FROM line_points GROUP BY 1)
SELECT v.line_id, v.ward_id, CASE WHEN count(*) / any_value(total) >= 0.85 THEN 'STRONG' WHEN count(*) / any_value(total) >= 0.5 THEN 'MEDIUM' WHEN count(*) / any_value(total) >= 0.25 THEN 'WEAK' ELSE 'NONE' END AS match FROM v JOIN n USING (line_id) WHERE ward_id IS NOT NULL GROUP BY 1, 2""")
def vertex_ratio(spark, sf):
    lines = views.lines(spark, sf)
    v = lines.select("line_id", F.size("points").alias("total"), F.posexplode("points").alias("pos", "p")).select("line_id", "total", "pos", "p.x", "p.z", F.struct("line_id", "pos").alias("_id"))
    found = spatial.first_hit(v, _parts(spark, sf), 2000.0, "_id").where("ward_id is not null")
    share = F.count("*") / F.first("total")
    kind = F.when(share >= 0.85, "STRONG").when(share >= 0.5, "MEDIUM").when(share >= 0.25, "WEAK").otherwise("NONE")
    return found.groupBy("line_id", "ward_id").agg(kind.alias("match"))


@query("q_4_41_place_merge", WITH + """, p AS (SELECT point_id, x, z, segment || '-' || (point_id % 40) AS name, point_id % 3 AS source FROM pts)
SELECT point_id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.name = b.name AND b.source < a.source AND sqrt((a.x - b.x) ^ 2 + (a.z - b.z) ^ 2) <= 6000)""")
def place_merge(spark, sf):
    """Places that no same-named place of an earlier source is near to."""
    p = views.pts(spark, sf).select("point_id", "x", "z", F.concat_ws("-", "segment", (F.col("point_id") % 40).cast("string")).alias("name"), (F.col("point_id") % 3).alias("source"))
    b = p.select(F.col("x").alias("bx"), F.col("z").alias("bz"), F.col("name").alias("bn"), F.col("source").alias("bs"))
    near = (F.col("name") == F.col("bn")) & (F.col("bs") < F.col("source")) & (geo.distance(F.col("x"), F.col("z"), F.col("bx"), F.col("bz")) <= 6000)
    return p.join(b, near, "left_anti").select("point_id")


@query("q_2_04_replicated_tiles", WITH + """, t AS (SELECT rect_id, floor(x0 / 2000) AS a, greatest(floor(x0 / 2000), floor((x1 - 1e-9) / 2000)) AS b, floor(z0 / 2000) AS c, greatest(floor(z0 / 2000), floor((z1 - 1e-9) / 2000)) AS d FROM rects)
SELECT CAST(a + i AS BIGINT) AS tx, CAST(c + j AS BIGINT) AS tz, count(*) AS n FROM t, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j) WHERE a + i <= b AND c + j <= d GROUP BY 1, 2""")
def replicated_tiles(spark, sf):
    """Tiles written by tile key and read back: a feature is in every tile its box touches."""
    from quadrille.sources.sinks import write_tiles

    r = views.rects(spark, sf).select("rect_id", "box", "area")
    written = write_tiles(r, "box", 2000.0)
    return spark.read.parquet(written).groupBy(F.col("tx").cast("long").alias("tx"), F.col("tz").cast("long").alias("tz")).agg(F.count("*").alias("n"))


@query("q_2_09_metadata", "SELECT n_regionkey AS k, count(*) AS n, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS checksum, 'official' AS value_type FROM nation GROUP BY 1")
def metadata(spark, sf):
    n = read_table(spark, sf, "nation")
    out = n.groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("n_name")), ","), 256).alias("checksum"))
    return out.withColumn("value_type", F.lit("official"))
