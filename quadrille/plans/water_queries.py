"""Rivers and water, and agreement of names across languages, over the derived places."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import geo, kernels, names
from quadrille.functions.num import half_up
from quadrille.operators import folds, grid, raster, spatial, water
from quadrille.plans import views
from quadrille.plans.convert_queries import cells_of
from quadrille.plans.grid_queries import GRID, SIZE, _parts
from quadrille.plans.registry import query
from quadrille.plans.scalar_queries import pick
from quadrille.plans.views import IN_SHAPE, SHAPES, WITH
from quadrille.storage import read_table


def _middles(spark, sf, apart: bool = False):
    """The middle line of every rectangle, left to right; apart: the rectangles stand on a lattice, where none touch."""
    r, k = views.rects(spark, sf), F.col("rect_id")
    if apart:
        r = r.withColumns({"x0": (k % 1000 * 40).cast("double"), "z0": (F.floor(k / 1000) * 40).cast("double")})
        r = r.withColumn("ring", geo.rectangle(F.col("x0"), F.col("z0"), F.col("x0") + F.col("w"), F.col("z0") + F.col("h")))
    mid = F.col("z0") + F.col("h") / 2
    return r.select("rect_id", F.array(geo.point(F.col("x0"), mid), geo.point(F.col("x0") + F.col("w"), mid)).alias("points"), (F.col("h") / 2).alias("half"), "ring")


@query("q_4_38_river_widths", WITH + "SELECT rect_id, h AS width, CAST(9 AS BIGINT) AS n FROM rects")
def river_widths(spark, sf):
    """Every rectangle is a river's bank, so its width is the rectangle's height."""
    m = _middles(spark, sf, apart=True)
    out = water.river_widths(m.select("rect_id", "points"), m.select(F.col("rect_id").alias("bank_id"), "ring"), "rect_id")
    return out.select("rect_id", half_up(F.col("width"), 6).alias("width"), "n")


@query("q_10_19_ribbons", WITH + "SELECT rect_id, floor(w * h * 1e6 + 0.5) / 1e6 AS area, CAST(2 * (ceil(w / 6) + 1) AS BIGINT) AS n FROM rects")
def ribbons(spark, sf):
    """A ribbon as wide as the rectangle around its middle line covers it."""
    out = _middles(spark, sf).select("rect_id", kernels.ribbon_of(F.col("points"), F.col("half") * 2, 6.0).alias("f")).select("rect_id", kernels.unflat(F.col("f")).alias("r"))
    return out.select("rect_id", half_up(geo.area(F.col("r")), 6).alias("area"), F.size("r").cast("long").alias("n"))


@query("q_4_39_river_conflicts", WITH + f""", n AS (SELECT line_id, count(*) AS n FROM line_points GROUP BY 1 HAVING count(*) >= 2),
v AS (SELECT p.*, n, 8.0 + (pos - 1) % 5 * 2 AS h, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS tx, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS tz FROM line_points p JOIN n USING (line_id) WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
t AS (SELECT *, -tz / CASE WHEN d > 0 THEN d ELSE 1 END AS nx, tx / CASE WHEN d > 0 THEN d ELSE 1 END AS nz FROM (SELECT *, sqrt(tx ^ 2 + tz ^ 2) AS d FROM v)),
sc(step, s) AS (VALUES (0, 1.0::DOUBLE), (1, 0.85::DOUBLE), (2, 0.7::DOUBLE), (3, 0.55::DOUBLE), (4, 0.4::DOUBLE)),
spot AS (SELECT line_id, pos, -1 AS step, x, z FROM t UNION ALL SELECT line_id, pos, step, x + g * nx * (h * s), z + g * nz * (h * s) FROM t, sc, (VALUES (1), (-1)) k(g) WHERE step < 4 OR line_id % 3 = 0),
b AS (SELECT x0 - w * 8 AS x0, x1 + w * 8 AS x1, z0 - h * 8 AS z0, z1 + h * 8 AS z1 FROM rects),
held AS (SELECT DISTINCT line_id, pos, step FROM spot p JOIN {cells_of('b', 'x0', 'x1', 'z0', 'z1', 300)} c ON floor(p.x / 300) = c.kx AND floor(p.z / 300) = c.kz AND p.x >= c.x0 AND p.x < c.x1 AND p.z >= c.z0 AND p.z < c.z1),
e AS (SELECT n.line_id, s.step, s.s, n.n, count(h.pos) / n.n AS share FROM n JOIN (SELECT * FROM sc UNION ALL SELECT -1, 0) s ON s.step < 4 OR n.line_id % 3 = 0 LEFT JOIN held h ON h.line_id = n.line_id AND h.step = s.step GROUP BY 1, 2, 3, 4),
f AS (SELECT line_id, max(share) FILTER (step = -1) AS centre, min(step) FILTER (step >= 0 AND share <= 0.15) AS first, max(step) AS last FROM e GROUP BY 1),
g AS (SELECT *, centre >= 0.55 AS hidden, centre < 0.55 AND centre <= 0.3 AND first IS NOT NULL AS fits FROM f),
m AS (SELECT g.*, NOT hidden AND NOT fits AND line_id % 3 = 0 AND centre <= 0.3 AND (SELECT share FROM e WHERE e.line_id = g.line_id AND e.step = g.last) <= 0.35 AS thin, CASE WHEN hidden THEN 0 WHEN fits THEN first ELSE last END AS at FROM g)
SELECT m.line_id, CASE WHEN fits AND first = 0 THEN 'keep' WHEN fits OR thin THEN 'shrink' ELSE 'suppress' END AS action, CASE WHEN fits THEN e.s WHEN thin THEN 0.4 ELSE 0 END AS scale, e.share AS edge_share, m.centre AS centre_share, CAST(m.at + 1 AS INTEGER) AS tried, thin
FROM m JOIN e ON e.line_id = m.line_id AND e.step = m.at""")
def river_conflicts(spark, sf):
    """Lines of changing width against large rectangles; every third line should stay."""
    k = F.col("line_id")
    widths = F.transform("points", lambda _, i: 8.0 + i % 5 * 2)
    lines = views.lines(spark, sf).where("size(points) >= 2").select("line_id", "points", widths.alias("halves"), (k % 3 == 0).alias("prefer"))
    b = views.rects(spark, sf).select(F.col("rect_id").alias("building_id"), geo.rectangle(F.col("x0") - F.col("w") * 8, F.col("z0") - F.col("h") * 8, F.col("x1") + F.col("w") * 8, F.col("z1") + F.col("h") * 8).alias("ring"))
    return water.building_conflicts(lines, b, "line_id", 300.0)


@query("q_10_15_water_depths", GRID + """, wc AS (SELECT cx, cz FROM landcell WHERE ward_id % 3 = 0), lc AS (SELECT cx, cz FROM landcell WHERE ward_id % 3 <> 0)
SELECT w.cx, w.cz, floor(min(greatest(abs(w.cx - l.cx), abs(w.cz - l.cz)) + (sqrt(2) - 1) * least(abs(w.cx - l.cx), abs(w.cz - l.cz))) * 1e6 + 0.5) / 1e6 AS depth
FROM wc w, lc l GROUP BY 1, 2""")
def water_depths(spark, sf):
    """Steps to the shore, however far, over a raster of several blocks."""
    land = grid.land_cells(_parts(spark, sf), SIZE)
    cells = land.select("cx", "cz", F.when(F.col("ward_id") % 3 == 0, 1).otherwise(2).alias("mask"))
    out = raster.shore_depths(raster.of_cells(cells, side=16), 1, 2, side=16)
    return out.withColumn("depth", half_up(F.col("depth"), 6))


@query("q_10_15_bit_planes", WITH + SHAPES + f""", c AS (SELECT *, i + 0.5 AS x, unnest(range(0, CAST(h AS BIGINT))) + 0.5 AS z FROM (SELECT *, unnest(range(0, CAST(w AS BIGINT))) AS i FROM shape)),
m AS (SELECT floor(x0 + x) AS cx, floor(z0 + z) AS cz, bit_or(1 << CAST(shape_id % 3 AS INTEGER)) AS mask FROM c WHERE {IN_SHAPE} GROUP BY 1, 2)
SELECT CAST(b AS BIGINT) AS bit, count(*) AS cells, count(*) FILTER (mask = (1 << b)) AS alone FROM m, (VALUES (0), (1), (2)) v(b) WHERE (mask >> b) & 1 = 1 GROUP BY 1""")
def bit_planes(spark, sf):
    """Three layers of shapes in square metres: rectangles, L shapes, triangles, and rectangles with holes."""
    layers = views.shapes(spark, sf).select("rings", (F.col("shape_id") % 3).alias("bit"))
    return raster.plane_counts(raster.fill(layers, 1.0))


@query("q_9_08_cross_language", "SELECT c_custkey AS id, CAST(c_custkey % 6 AS INT) IN (0, 1, 4) AS agrees FROM customer")
def cross_language(spark, sf):
    k = F.col("c_custkey")
    ja = pick(["北病院", "医療法人 南小学校", "北病院", "謎北病院", "北店", "病院"], k)
    en = pick(["Kita Hospital", "Minami Elementary School", "Minami Hospital", "Kita Hospital", "KITA store", "Hospital"], k)
    agrees = names.same_in_both(ja, en, {"北": "kita", "南": "minami"}, {"病院": ["hospital", "clinic"], "小学校": ["elementary school"]}, ["医療法人"])
    return read_table(spark, sf, "customer").select(k.alias("id"), agrees.alias("agrees"))


@query("q_4_33_variant_evidence", "SELECT c_custkey AS id, list_extract(['exact', 'rename', NULL, 'alias', NULL], CAST(c_custkey % 5 + 1 AS INT)) AS evidence FROM customer")
def variant_evidence(spark, sf):
    k = F.col("c_custkey")
    a, b = pick(["あさひ園", "あさひ丘の保育園", "森保育園", "ふぁみま", None], k), pick(["あさひ園", "あさひ丘のこども園", "森こども園", "ふぁみりーまーと北", "x"], k)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return read_table(spark, sf, "customer").select(k.alias("id"), names.variant_evidence(blank(a), blank(b), ["保育園", "こども園", "幼稚園"], 4, {"ふぁみま": "ふぁみりーまーと"}).alias("evidence"))


@query("q_4_22_envelopes", WITH + """, big AS (SELECT rect_id, x0 - w * 20 AS x0, z0 - h * 20 AS z0, x1 + w * 20 AS x1, z1 + h * 20 AS z1 FROM rects),
o AS (SELECT b.rect_id, count(*) AS partners, sum(greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.z1, r.z1) - greatest(b.z0, r.z0))) / any_value((b.x1 - b.x0) * (b.z1 - b.z0)) AS covered FROM big b JOIN rects r ON b.x0 < r.x1 AND r.x0 < b.x1 AND b.z0 < r.z1 AND r.z0 < b.z1 GROUP BY 1)
SELECT rect_id, partners FROM o WHERE partners >= 2 AND covered >= 0.0005""")
def envelopes(spark, sf):
    """Outlines that cover two or more others whose areas make up enough of theirs."""
    r = views.rects(spark, sf)
    corners = {"x0": F.col("x0") - F.col("w") * 20, "z0": F.col("z0") - F.col("h") * 20, "x1": F.col("x1") + F.col("w") * 20, "z1": F.col("z1") + F.col("h") * 20}
    a = r.select(F.col("rect_id").alias("id"), F.struct(*(v.alias(k) for k, v in corners.items())).alias("box"))
    areas = a.select("id", geo.box_area(F.col("box")).alias("area")).dropDuplicates(["id"])
    o = folds.covered_by(a, r.select("box"), 500.0).where("partners >= 2").join(areas, "id")
    return o.where("shared / area >= 0.0005").select(F.col("id").alias("rect_id"), "partners")
