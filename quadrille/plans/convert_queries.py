"""Conversions, census rows, class rules, road edges in full, and geometry measures of the inventory."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quadrille.functions import classify, geo, kernels, names, ringsets
from quadrille.functions.num import half_up
from quadrille.operators import convert, matching, resolve, sequential, spatial
from quadrille.plans import views
from quadrille.plans.grid_queries import CLUSTERS, SIZE, _coverage, to_edge
from quadrille.plans.registry import query
from quadrille.plans.resolve_queries import PAIRS, _pairs
from quadrille.plans.sequence_queries import LOOP, RECURSIVE
from quadrille.plans.scalar_queries import pick, sql_pick, sql_tagged, tagged
from quadrille.plans.views import WITH
from quadrille.storage import read_table, stored

ELEMENTS = {
    "leisure": (["park", None, "garden"], 1), "landuse": ([None, "grass", "forest", None], 2), "waterway": (["river", "canal", "stream", "drain", "ditch", "riverbank", None, None, "dam"], 1),
    "natural": ([None, "water", None, "coastline"], 3), "water": ([None, "pond"], 5), "tunnel": ([None, "culvert", "no"], 7), "layer": ([None, "-1", "1"], 11), "width": ([None, "12.5 m", "500", "0"], 2),
    "railway": ([None, "rail", "station", None, "subway"], 2), "amenity": ([None, "hospital", "school", "university", "library", "townhall", "cafe"], 3), "name": (["Alpha", None, "Beta", ""], 5), "name__ja": ([None, None, "Gamma"], 4),
}

#: Elements for SQL: t has the tags, n the corners before a closing one (c) is added, way, and the places.
E = sql_tagged(**ELEMENTS) + """, e AS (SELECT *, id % 4 <> 3 AS way, CAST(size % 5 + 1 AS INT) AS n, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS c, coalesce(name__ja, name, '') AS shown,
  floor((id % 50) * 0.001 * 111320.0 * 100 + 0.5) / 100 AS x0 FROM t)
"""


def _elements(spark, sf) -> DataFrame:
    t, k = tagged(spark, sf, **ELEMENTS), F.col("id")
    n = (F.col("size") % 5 + 1).cast("int")
    at = lambda i: F.struct(((k % 100 + i) * 0.001).alias("lat"), ((k % 50 + i * i) * 0.001).alias("lon"))
    ring = F.transform(F.sequence(F.lit(0), n - 1), at)
    way = k % 4 != 3
    geometry = F.when(way, F.when(k % 2 == 0, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring))
    place = lambda m: F.when(~way & (k % 8 != 7), k % m * 0.001)
    # A table, as elements are read from one: what the layers compute does not repeat how these were made.
    return stored(t.select("id", F.when(way, "way").otherwise("node").alias("type"), place(100).alias("lat"), place(50).alias("lon"), "tags", geometry.alias("geometry")), "elements")


ORIGIN = (0.0, 0.0)


@query("q_3_13_parks", E + "SELECT id, CASE WHEN leisure = 'park' THEN 'leisure_park' ELSE 'landuse_' || landuse END AS tag, coalesce(name, '') AS name, n, x0 FROM e WHERE way AND n >= 3 AND (leisure = 'park' OR landuse IS NOT NULL)")
def parks(spark, sf):
    return convert.parks(_elements(spark, sf), ORIGIN).select("id", "tag", "name", F.size("p").alias("n"), F.col("p")[0]["x"].alias("x0"))


@query("q_3_13_waterways", E + """, w AS (SELECT *, waterway IN ('river', 'canal', 'stream', 'drain', 'ditch') AS flows FROM e),
k AS (SELECT *, CASE WHEN flows THEN waterway WHEN "natural" = 'water' OR water IS NOT NULL OR waterway = 'riverbank' THEN 'water' END AS type, CASE WHEN flows THEN n + c ELSE n END AS points FROM w WHERE way)
SELECT id, type, CASE WHEN flows THEN 'line' ELSE 'area' END AS kind, points AS n, CASE WHEN "natural" = 'coastline' THEN 'harbour' WHEN waterway IN ('river', 'riverbank') THEN 'river' WHEN waterway IN ('canal', 'drain', 'ditch') THEN 'canal' WHEN waterway = 'stream' THEN 'stream' WHEN water = 'pond' THEN 'pond' ELSE 'water' END AS water_class,
  NOT (coalesce(tunnel = 'culvert', false) OR coalesce(layer = '-1', false)) AS surface, CASE WHEN width = '12.5 m' THEN 12.5::DOUBLE END AS width FROM k WHERE type IS NOT NULL AND points >= CASE WHEN flows THEN 2 ELSE 3 END""")
def waterways(spark, sf):
    return convert.waterways(_elements(spark, sf), ORIGIN).select("id", "type", "kind", F.size("p").alias("n"), "water_class", "surface", "width")


@query("q_3_13_railways", E + "SELECT id, 'line' AS kind, shown AS name, n + c AS n FROM e WHERE way AND railway IS NOT NULL AND n + c >= 2 UNION ALL SELECT id, 'station', shown, 1 FROM e WHERE NOT way AND railway = 'station' AND id % 8 <> 7")
def railways(spark, sf):
    lines, stations = convert.railways(_elements(spark, sf), ORIGIN)
    return lines.select("id", F.lit("line").alias("kind"), "name", F.size("p").alias("n")).unionByName(stations.select("id", F.lit("station").alias("kind"), "name", F.lit(1).alias("n")))


@query("q_3_13_facilities", E + """
SELECT id, shown AS name, CASE WHEN railway = 'station' THEN 'station' WHEN amenity = 'townhall' THEN 'government' ELSE amenity END AS category,
  CASE WHEN railway = 'station' THEN 1 WHEN amenity = 'townhall' THEN 2 WHEN amenity = 'hospital' THEN 3 WHEN amenity = 'university' THEN 4 ELSE 5 END AS priority, CASE WHEN NOT way THEN x0 END AS x
FROM e WHERE (railway = 'station' OR amenity IN ('hospital', 'school', 'university', 'library', 'townhall')) AND shown <> '' AND id % 8 <> 7""")
def facilities(spark, sf):
    e = _elements(spark, sf)
    out = convert.facilities(e, ORIGIN).join(e.select("id", "type"), "id")
    return out.select("id", "name", "category", "priority", F.when(F.col("type") == "node", F.col("at.x")).alias("x"))


@query("q_3_14_facility_report", E + """, p AS (SELECT id, shown, CASE WHEN way THEN (id % 100 + n * (n - 1) / 2.0 / (n + c)) * 0.001 WHEN id % 8 <> 7 THEN (id % 100) * 0.001 END AS lat,
  CASE WHEN way THEN (id % 50 + (n - 1) * n * (2 * n - 1) / 6.0 / (n + c)) * 0.001 WHEN id % 8 <> 7 THEN (id % 50) * 0.001 END AS lon FROM e)
SELECT id, CASE WHEN lat IS NULL THEN 'no-coordinates' WHEN NOT (lat BETWEEN 0.01033 AND 0.05033 AND lon BETWEEN 0.00533 AND 0.04033) THEN 'outside-bbox' WHEN shown = '' THEN 'no-name' END AS reason FROM p""")
def facility_report(spark, sf):
    """Where a ring is closed its first corner counts twice in the mean, as it stands in the element."""
    e = _elements(spark, sf)
    return convert.facility_report(e, (0.01033, 0.00533, 0.05033, 0.04033)).select("id", "reason")


@query("q_12_02_converters", E + """, n AS (SELECT 'parks' AS layer, count(*) FILTER (WHERE way AND n >= 3 AND (leisure = 'park' OR landuse IS NOT NULL)) AS n FROM e
UNION ALL SELECT 'rail_lines', count(*) FILTER (WHERE way AND railway IS NOT NULL AND n + c >= 2) FROM e UNION ALL SELECT 'stations', count(*) FILTER (WHERE NOT way AND railway = 'station' AND id % 8 <> 7) FROM e) SELECT * FROM n WHERE n > 0""")
def converters(spark, sf):
    """The registry's layers by name, over the same elements."""
    e, out = _elements(spark, sf), None
    for layer in ("parks", "rail_lines", "stations"):
        rows = convert.CONVERTERS[layer](e, ORIGIN).groupBy(F.lit(layer).alias("layer")).agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("q_12_03_derived_layers", WITH + """
SELECT l.level, rect_id, type FROM rects, (VALUES ('far'), ('mid'), ('near')) l(level) WHERE l.level = 'near' OR (l.level = 'far' AND area >= 400) OR (l.level = 'mid' AND area >= 200)""")
def derived_layers(spark, sf):
    shows = lambda level, f: (level == "near") | ((level == "far") & (f["area"] >= 400)) | ((level == "mid") & (f["area"] >= 200))
    return convert.derived(views.rects(spark, sf), ["far", "mid", "near"], shows, lambda f: [f["rect_id"], f["type"]])


# ---- census ----------------------------------------------------------------------------------------

CENSUS = {
    "sex": ["総数", "総数", "男", "女"], "level": ["4", "4", "3", " 4 ", "1", "5", "x", "3"], "municipality": ["大阪市北区", "大阪市西区", "堺市北区", "大阪市", "大阪市港区"], "town": ["本町", None, "東町"], "chome": ["一丁目", None],
    "code": ["12", "345678", "x1", None], "municipality_code": ["27102", "27103", None, "27104"], "population": ["1,234", "X", "-", "56", None],
}
FACTOR = {"sex": 1, "level": 3, "municipality": 7, "town": 2, "chome": 11, "code": 5, "municipality_code": 13, "population": 1}


def _cells(spark, sf, *columns: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda c: F.when(k % 23 != 0, F.coalesce(pick(CENSUS[c], F.floor(k / FACTOR[c])), F.lit("")))
    return read_table(spark, sf, "customer").select(k.alias("id"), *(text(c).alias(c) for c in columns))


def _sql_cells(*columns: str) -> str:
    return "WITH t AS (SELECT c_custkey AS id, c_custkey % 23 = 0 AS blank, " + ", ".join(f"coalesce({sql_pick(CENSUS[c], f'c_custkey // {FACTOR[c]}')}, '') AS {c}" for c in columns) + " FROM customer) "


AGE = ("sex", "level", "municipality", "town", "chome", "code")
PEOPLE = ("municipality_code", "level", "municipality", "town", "chome", "code", "population")


@query("q_3_06_age_rows", _sql_cells(*AGE) + """
SELECT id, CASE WHEN blank THEN 'empty-row' WHEN sex <> '総数' THEN 'sex-breakdown-row' WHEN trim(level) <> '4' THEN CASE trim(level) WHEN '1' THEN 'municipality-total-row' WHEN '3' THEN 'subtotal-row' ELSE 'unknown-region-level' END
  WHEN municipality IN ('堺市北区', '大阪市') THEN 'non-city-row' WHEN municipality = '大阪市港区' THEN 'ward-not-in-target' WHEN town || chome = '' THEN 'empty-block-name' END AS reason FROM t""")
def age_rows(spark, sf):
    return convert.age_rows(_cells(spark, sf, *AGE), ["北区", "西区"], keep=["id"]).select("id", "reason")


@query("q_3_07_population_rows", _sql_cells(*PEOPLE) + """
SELECT id, CASE WHEN blank THEN 'empty-row' WHEN municipality_code NOT IN ('27102', '27103') THEN 'municipality-not-in-target' WHEN trim(level) <> '3' THEN CASE WHEN trim(level) = '1' THEN 'municipality-total-row' ELSE 'unknown-region-level' END WHEN town || chome = '' THEN 'empty-block-name' END AS reason,
  CASE WHEN NOT blank AND municipality_code <> '' AND code <> '' THEN municipality_code || ':' || CASE WHEN code = '12' THEN '000012' ELSE code END END AS composite_code,
  CASE WHEN NOT blank THEN CASE population WHEN '1,234' THEN 1234.0 WHEN '-' THEN 0.0 WHEN '56' THEN 56.0 END END::DOUBLE AS population, NOT blank AND population = 'X' AS withheld FROM t""")
def population_rows(spark, sf):
    rows = convert.population_rows(_cells(spark, sf, *PEOPLE), ["27102", "27103"], keep=["id"])
    return rows.select("id", "reason", "composite_code", F.col("population_2015").alias("population"), "withheld")


# ---- class rules -----------------------------------------------------------------------------------

BUILDING_TAGS = {"building": (["yes", "house", "roof", "Ruins ", None, "no", "office", "demolished", ""], 1), "height": ([None, "12", "350 m", "-3", "0"], 2), "building__levels": ([None, "2", "100", "0.5", "x"], 3)}


@query("q_3_20_building_eligible", sql_tagged(**BUILDING_TAGS) + "SELECT id, coalesce(lower(trim(building)), '') NOT IN ('', 'no', 'roof', 'construction', 'ruins', 'proposed', 'demolished', 'razed', 'collapsed', 'abandoned') AS eligible FROM t")
def building_eligible(spark, sf):
    return tagged(spark, sf, **BUILDING_TAGS).select("id", classify.building_eligible(F.col("tags")["building"]).alias("eligible"))


@query("q_3_22_recovered_height", sql_tagged(**BUILDING_TAGS) + """, h AS (SELECT id, TRY_CAST(replace(height, ' m', '') AS DOUBLE) AS h, TRY_CAST(building__levels AS DOUBLE) AS l FROM t)
SELECT id, CASE WHEN h > 0 THEN least(300, h) WHEN l >= 1 THEN least(300, l * 3.2::DOUBLE) END::DOUBLE AS height, CASE WHEN h > 0 THEN 'osm-height' WHEN l >= 1 THEN 'osm-levels' END AS source, CASE WHEN h > 0 THEN h > 300 WHEN l >= 1 THEN l * 3.2::DOUBLE > 300 END AS clamped FROM h""")
def recovered_height(spark, sf):
    return tagged(spark, sf, **BUILDING_TAGS).select("id", classify.recovered_height(F.col("tags")).alias("h")).select("id", "h.height", "h.source", "h.clamped")


SURFACE = {"highway": ([None, "residential", "footway", "motorway_link", None, "trunk"], 1), "detail": ([None, None, "LOCAL_ALLEY", "LOCAL_UNCLASSIFIED", "PEDESTRIAN", None, "MID"], 2), "tier": (["local", "local", "mid", None], 5), "structure": ([None, "intersection", None, "elevated", None, "ground"], 7)}


def _picked(spark, sf, table: dict) -> DataFrame:
    return views.rects(spark, sf).select("rect_id", "w", "h", "box", "area", *(pick(values, F.floor(F.col("rect_id") / factor)).alias(name) for name, (values, factor) in table.items()))


def _sql_picked(table: dict) -> str:
    return WITH + ", t AS (SELECT *, " + ", ".join(f"{sql_pick(values, f'rect_id // {factor}')} AS {name}" for name, (values, factor) in table.items()) + " FROM rects)"


@query("q_3_26_road_surface_class", _sql_picked(SURFACE) + """, s AS (SELECT *, greatest(w * 4, h) / greatest(1, least(w * 4, h)) AS aspect, 2 * (w * 4 * h) / (2 * (w * 4 + h)) AS width, w * 4 * h AS big,
  coalesce(highway IN ('residential', 'trunk'), false) OR coalesce(detail = 'MID', false) OR coalesce(tier = 'mid', false) AS driven FROM t)
SELECT rect_id, CASE WHEN rect_id % 17 = 0 OR coalesce(structure = 'elevated', false) THEN 'BRIDGE' WHEN coalesce(highway = 'footway', false) OR coalesce(detail = 'PEDESTRIAN', false) THEN 'PEDESTRIAN' WHEN coalesce(structure = 'intersection', false) THEN 'INTERSECTION'
  WHEN coalesce(highway = 'motorway_link', false) THEN 'RAMP' WHEN driven THEN 'ROADWAY' WHEN coalesce(detail = 'LOCAL_ALLEY', false) THEN 'ALLEY' WHEN rect_id % 13 = 0 OR rect_id % 11 = 0 THEN 'ROADWAY' WHEN width <= 8 AND (aspect >= 1.6 OR big < 350) THEN 'ROADWAY' WHEN width >= 9 AND aspect < 2.2 THEN 'ROAD_RESERVE' ELSE 'UNKNOWN' END AS class FROM s""")
def road_surface_class(spark, sf):
    """Rectangles stretched fourfold are the surfaces; some are bridges, some hold or come from a centre line."""
    t, k = _picked(spark, sf, SURFACE), F.col("rect_id")
    w, h = F.col("w") * 4, F.col("h")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("z0"), w.alias("x1"), h.alias("z1"))
    c = classify.road_surface_class(F.col("highway"), F.col("detail"), F.col("tier"), F.col("structure"), k % 17 == 0, k % 11 == 0, k % 13 == 0, box, w * h, 2 * (w + h))
    return t.select("rect_id", c["class"].alias("class"))


DETAILS = {
    "natural": ([None, "tree", "tree_row"], 1), "highway": (["traffic_signals", "crossing", "bus_stop", "footway", None], 1), "railway": ([None, "subway_entrance"], 3), "amenity": (["post_office", "police", "fire_station", "toilets", "bicycle_parking", "parking", None], 2),
    "public_transport": (["platform", None], 4), "bus": (["yes", "no"], 5), "footway": (["crossing", "sidewalk", None], 3), "place": ([None, "square"], 7), "leisure": ([None, "common"], 11), "barrier": ([None, "kerb", "guard_rail"], 2),
}


@query("q_3_30_street_details", sql_tagged(**DETAILS) + """
SELECT id, CASE WHEN "natural" = 'tree' THEN 'T' WHEN highway = 'traffic_signals' THEN 'S' WHEN highway = 'crossing' THEN 'X' WHEN highway = 'bus_stop' OR (public_transport = 'platform' AND bus = 'yes') THEN 'b' WHEN railway = 'subway_entrance' THEN 'e'
  WHEN amenity = 'post_office' THEN 'p' WHEN amenity = 'police' THEN 'c' WHEN amenity = 'fire_station' THEN 'f' WHEN amenity = 'toilets' THEN 't' WHEN amenity = 'bicycle_parking' THEN 'y' END AS point_kind,
  CASE WHEN highway = 'footway' AND footway = 'crossing' THEN 'xw' WHEN highway = 'footway' AND footway = 'sidewalk' THEN 'w' WHEN "natural" = 'tree_row' THEN 'tr' WHEN amenity = 'parking' THEN 'P' WHEN place = 'square' OR leisure = 'common' THEN 'Z' WHEN barrier IN ('kerb', 'guard_rail') THEN 'm' END AS way_kind FROM t""")
def street_details(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf, **DETAILS).select("id", classify.detail_point(t).alias("point_kind"), classify.detail_way(t).alias("way_kind"))


PLACES = list(classify.RELEVANCE) + [None, "bench", None]
RANKED = {"category": ["medical", "transport", "food", "tourism", None], "subcategory": ["station", "bench", "platform", None]}


@query("q_3_32_relevance", f"WITH t AS (SELECT s_suppkey AS id, {sql_pick(PLACES, 's_suppkey')} AS sub, {sql_pick(['北神社', '寺院', '寺院前', None, '寺'], 's_suppkey // 2')} AS name FROM supplier) SELECT id, coalesce(CASE " + " ".join(f"WHEN sub = '{k}' THEN '{v}'" for k, v in classify.RELEVANCE.items()) + " END, CASE WHEN name IN ('北神社', '寺院', '寺院前') THEN 'temple-shrine' END) AS class FROM t")
def relevance(spark, sf):
    k = F.col("s_suppkey")
    name = pick(["北神社", "寺院", "寺院前", None, "寺"], F.floor(k / 2))
    return read_table(spark, sf, "supplier").select(k.alias("id"), classify.relevance(pick(PLACES, k), name).alias("class"))


@query("q_3_32_priority_rank", f"WITH t AS (SELECT c_custkey AS id, {sql_pick(RANKED['category'], 'c_custkey')} AS c, {sql_pick(RANKED['subcategory'], 'c_custkey // 5')} AS s FROM customer) SELECT id, CASE WHEN c = 'medical' THEN 0 WHEN c = 'transport' AND s = 'station' THEN 1 WHEN c IN ('food') THEN 1 WHEN s IN ('bench', 'platform') THEN 3 ELSE 2 END AS rank FROM t")
def priority_rank(spark, sf):
    k = F.col("c_custkey")
    c, s = pick(RANKED["category"], k), pick(RANKED["subcategory"], F.floor(k / 5))
    return read_table(spark, sf, "customer").select(k.alias("id"), classify.priority_rank(c, s, ["medical"], ["station"], ["food"], ["bench", "platform"]).alias("rank"))


LISTED = ["ＡＢＣ ビル（本館）", "あべの・ハルカス", "Kita 「Tower」", None, "１２３（東）【旧】"]


@query("q_9_05_place_keys", f"""
WITH t AS (SELECT s_suppkey AS id, lower(regexp_replace(translate(coalesce({sql_pick(LISTED, 's_suppkey')}, ''), 'ＡＢＣ１２３', 'ABC123'), '[\\s　・･]', '', 'g')) AS building FROM supplier)
SELECT id, building, regexp_replace(building, '[（）()「」【】]', '', 'g') AS place FROM t""")
def place_keys(spark, sf):
    name = pick(LISTED, F.col("s_suppkey"))
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), names.building_key(name).alias("building"), names.place_key(name).alias("place"))


# ---- matching and order ----------------------------------------------------------------------------


@query("q_4_21_recovered_duplicates", RECURSIVE + """, both_ AS (SELECT rect_id * 2 AS id, area, x0, z0, x1, z1 FROM rects UNION ALL SELECT rect_id * 2 + 1, area, x0, z0, x1, z1 FROM rects_b),
f AS (SELECT id, row_number() OVER (ORDER BY id) AS n, CASE WHEN id % 3 = 0 THEN 4.0::DOUBLE ELSE 0.0 END + CASE WHEN id % 5 = 0 THEN 2.0::DOUBLE ELSE 0.0 END + area / 1e6::DOUBLE AS rank, x0, z0, x1, z1 FROM both_),
pr AS (SELECT a.n AS i, b.n AS j, a.rank >= b.rank AS beats FROM f a JOIN f b ON a.n < b.n AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.z0 < b.z1 AND b.z0 < a.z1),
m AS (SELECT i, coalesce(list(j) FILTER (beats), []) AS wins, coalesce(list(j) FILTER (NOT beats), []) AS loses FROM pr GROUP BY i)"""
       + LOOP.format(step="list_concat(list_concat(w.gone, list_filter(m.wins, lambda j: j < coalesce(list_min(list_filter(m.loses, lambda k: NOT list_contains(w.gone, k))), 9223372036854775807))), CASE WHEN len(list_filter(m.loses, lambda j: NOT list_contains(w.gone, j))) > 0 THEN [g.n] ELSE []::BIGINT[] END)")
       + "SELECT id FROM f WHERE n NOT IN (SELECT n FROM lost)")
def recovered_duplicates(spark, sf):
    """Candidates of both views without those that overlap a better one: a name counts most, then storeys, then the
    area. Taken by id. Each candidate is measured against all of them, itself among them, so it is always wholly
    covered: any partner that it overlaps makes it a clear duplicate."""
    both = None
    for i, df in enumerate((views.rects(spark, sf), views.rects_b(spark, sf))):
        k = F.col("rect_id") * 2 + i
        rank = F.when(k % 3 == 0, 4.0).otherwise(0.0) + F.when(k % 5 == 0, 2.0).otherwise(0.0) + F.col("area") / 1e6
        rows = df.select(k.alias("id"), k.alias("ord"), rank.alias("rank"), "box")
        both = rows if both is None else both.unionByName(rows)
    a, b = both.select(F.col("id").alias("a"), F.col("box").alias("a_box")), both.select(F.col("id").alias("b"), F.col("box").alias("b_box"))
    pairs = spatial.box_pairs(a, b, "a_box", "b_box", 100.0).where((F.col("a") < F.col("b")) & (geo.overlap_area(F.col("a_box"), F.col("b_box")) > 0)).select("a", "b")
    return sequential.greedy_dedupe(both, pairs).select("id")


@query("q_6_02_best_two", PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, dist, b_id) AS rn FROM scored)
SELECT f.a_id, f.b_id AS best, s.b_id AS second, floor((f.iou - s.iou) * 1e6 + 0.5) / 1e6 AS lead FROM r f LEFT JOIN r s ON f.a_id = s.a_id AND s.rn = 2 WHERE f.rn = 1""")
def best_two(spark, sf):
    two = resolve.best_and_second(_pairs(spark, sf), "a_id", [F.desc("iou"), F.col("dist"), F.col("b_id")], ["b_id", "iou"])
    return two.select("a_id", F.col("best.b_id").alias("best"), F.col("second.b_id").alias("second"), half_up(F.col("best.iou") - F.col("second.iou"), 6).alias("lead"))


@query("q_7_06_clusters_by_size", CLUSTERS + "SELECT n, x0, z0 FROM clusters")
def clusters_by_size(spark, sf):
    from quadrille.operators import grid

    cells = _coverage(spark, sf).where("not covered").select("cx", "cz", "x", "z", "ward_id")
    return grid.clusters(cells, SIZE, 3).orderBy(F.desc("n"), "cluster").select("n", "x0", "z0")


def cells_of(table: str, x0: str, x1: str, z0: str, z1: str, size: int = 50) -> str:
    """SQL for the rows of a table, once for every cell that their box touches."""
    span = lambda a, b: f"unnest(range(CAST(floor(least({a}, {b}) / {size}) AS BIGINT), CAST(floor(greatest({a}, {b}) / {size}) AS BIGINT) + 1))"
    return f"(SELECT *, {span(z0, z1)} AS kz FROM (SELECT *, {span(x0, x1)} AS kx FROM {table}))"


#: Segments of the lines, each with its best partner and what speaks for or against it.
EDGES = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", lp AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, sum(step) OVER (PARTITION BY line_id) AS len FROM (
  SELECT line_id, pos, x, z, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (z - lag(z) OVER w) ^ 2), 0) AS step FROM (SELECT line_id, pos, x, z FROM line_points UNION ALL SELECT line_id + 1000000000, pos, x + 6, z + 9 FROM line_points) WINDOW w AS (PARTITION BY line_id ORDER BY pos))),
walk AS (SELECT line_id, pos, 0.0::DOUBLE AS acc, 0 AS chunk, false AS cut FROM lp WHERE pos = 1 AND n >= 2
  UNION ALL SELECT p.line_id, p.pos, CASE WHEN w.acc + p.step >= 30 OR p.pos = p.n THEN 0.0 ELSE w.acc + p.step END, CASE WHEN w.acc + p.step >= 30 OR p.pos = p.n THEN w.chunk + 1 ELSE w.chunk END, w.acc + p.step >= 30 OR p.pos = p.n FROM walk w JOIN lp p ON p.line_id = w.line_id AND p.pos = w.pos + 1),
whole AS (SELECT DISTINCT line_id FROM lp WHERE n >= 2 AND n <= 8 AND len <= 66),
member AS (SELECT line_id, chunk, pos FROM walk WHERE NOT cut AND line_id NOT IN (SELECT line_id FROM whole) UNION ALL SELECT line_id, chunk - 1, pos FROM walk WHERE cut AND line_id NOT IN (SELECT line_id FROM whole)
  UNION ALL SELECT w.line_id, w.chunk, w.pos FROM walk w JOIN lp p ON p.line_id = w.line_id AND p.pos = w.pos WHERE w.cut AND w.pos < p.n AND w.line_id NOT IN (SELECT line_id FROM whole) UNION ALL SELECT line_id, 0, pos FROM lp WHERE line_id IN (SELECT line_id FROM whole)),
coords AS MATERIALIZED (SELECT m.line_id AS parent, m.chunk AS n, m.pos, p.x, p.z FROM member m JOIN lp p ON p.line_id = m.line_id AND p.pos = m.pos),
sg AS (SELECT parent, n, arg_min(x, pos) AS px, arg_min(z, pos) AS pz, arg_max(x, pos) AS qx, arg_max(z, pos) AS qz FROM coords GROUP BY 1, 2),
s AS MATERIALIZED (SELECT *, floor((px + qx) / 90) AS cx, floor((pz + qz) / 90) AS cz, (px + qx) / 2 AS mx, (pz + qz) / 2 AS mz, (qx - px) / CASE WHEN d > 0 THEN d ELSE 1 END AS ux, (qz - pz) / CASE WHEN d > 0 THEN d ELSE 1 END AS uz FROM (SELECT *, sqrt((qx - px) ^ 2 + (qz - pz) ^ 2) AS d FROM sg)),
pr AS (SELECT a.parent AS ap, a.n AS an, b.parent AS bp, b.n AS bn, a.mx AS x0, a.mz AS z0, b.mx AS x1, b.mz AS z1, sqrt((a.mx - b.mx) ^ 2 + (a.mz - b.mz) ^ 2) AS dist, abs(a.ux * b.ux + a.uz * b.uz) AS parallel,
  a.px * a.ux + a.pz * a.uz AS a0, a.qx * a.ux + a.qz * a.uz AS a1, b.px * a.ux + b.pz * a.uz AS b0, b.qx * a.ux + b.qz * a.uz AS b1 FROM (SELECT *, cx + unnest([-1, 0, 1]) AS kx FROM s) a JOIN (SELECT *, cz + unnest([-1, 0, 1]) AS kz FROM s) b ON a.kx = b.cx AND a.cz = b.kz AND a.parent <> b.parent AND abs(a.mx - b.mx) <= 45 AND abs(a.mz - b.mz) <= 45),
po AS (SELECT *, least(1, greatest(0, least(greatest(a0, a1), greatest(b0, b1)) - greatest(least(a0, a1), least(b0, b1))) / CASE WHEN least(abs(a1 - a0), abs(b1 - b0)) <> 0 THEN least(abs(a1 - a0), abs(b1 - b0)) ELSE 1 END) AS overlap FROM pr WHERE dist BETWEEN 3 AND 45 AND parallel >= 0.75),
sc AS MATERIALIZED (SELECT *, floor((0.32 * parallel + 0.28 * overlap + 0.20 * CASE WHEN dist BETWEEN 4 AND 35 THEN 1.0 ELSE 0.65 END + 0.20 * 0.6) * 1000 + 0.5) / 1000 AS score FROM po WHERE overlap >= 0.35),
ba AS MATERIALIZED (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY ap, an ORDER BY score DESC, bp, bn) = 1), bb AS (SELECT bp, bn, ap, an FROM sc QUALIFY row_number() OVER (PARTITION BY bp, bn ORDER BY score DESC, ap, an) = 1),
piece AS MATERIALIZED (SELECT * FROM (SELECT parent, n, x AS ex1, z AS ez1, lag(x) OVER w AS ex0, lag(z) OVER w AS ez0 FROM coords WINDOW w AS (PARTITION BY parent, n ORDER BY pos)) WHERE ex0 IS NOT NULL),
hit AS (SELECT DISTINCT ap, an FROM (SELECT l.ap, l.an, l.x0, l.z0, l.x1 - l.x0 AS lx, l.z1 - l.z0 AS lz, e.ex0, e.ez0, e.ex1 - e.ex0 AS ex, e.ez1 - e.ez0 AS ez FROM {cells_of('ba', 'x0', 'x1', 'z0', 'z1')} l JOIN {cells_of('piece', 'ex0', 'ex1', 'ez0', 'ez1')} e ON l.kx = e.kx AND l.kz = e.kz AND NOT (e.parent = l.ap AND e.n = l.an) AND NOT (e.parent = l.bp AND e.n = l.bn)
  AND least(l.x0, l.x1) <= greatest(e.ex0, e.ex1) AND greatest(l.x0, l.x1) >= least(e.ex0, e.ex1) AND least(l.z0, l.z1) <= greatest(e.ez0, e.ez1) AND greatest(l.z0, l.z1) >= least(e.ez0, e.ez1))
  WHERE abs(lx * ez - lz * ex) >= 1e-9 AND ((ex0 - x0) * ez - (ez0 - z0) * ex) / (lx * ez - lz * ex) > 0.05 AND ((ex0 - x0) * ez - (ez0 - z0) * ex) / (lx * ez - lz * ex) < 0.95
    AND ((ex0 - x0) * lz - (ez0 - z0) * lx) / (lx * ez - lz * ex) > 0.05 AND ((ex0 - x0) * lz - (ez0 - z0) * lx) / (lx * ez - lz * ex) < 0.95),
node AS (SELECT floor(x / 0.75 + 0.5) * 0.75 AS x, floor(z / 0.75 + 0.5) * 0.75 AS z FROM lp WHERE n >= 2 AND (pos = 1 OR pos = n) GROUP BY 1, 2 HAVING count(*) >= 3),
close AS (SELECT DISTINCT ap, an FROM (SELECT ap, an, x0 AS x, z0 AS z FROM ba UNION ALL SELECT ap, an, x1, z1 FROM ba) m JOIN (SELECT *, unnest([-1, 0, 1]) + floor(x / 10) AS kx FROM node) q ON floor(m.x / 10) = q.kx AND sqrt((m.x - q.x) ^ 2 + (m.z - q.z) ^ 2) <= 10),
verdict AS (SELECT ba.*, coalesce(bb.ap = ba.ap AND bb.an = ba.an, false) AS mutual, hit.ap IS NOT NULL AS crossed, close.ap IS NOT NULL AS near_crossroad FROM ba LEFT JOIN bb ON ba.bp = bb.bp AND ba.bn = bb.bn LEFT JOIN hit ON hit.ap = ba.ap AND hit.an = ba.an LEFT JOIN close ON close.ap = ba.ap AND close.an = ba.an)
"""


def _paths(spark, sf) -> DataFrame:
    """The lines, and each of them again some metres beside as the road's other edge."""
    beside = F.transform("points", lambda p: F.struct((p["x"] + 6).alias("x"), (p["z"] + 9).alias("z")))
    both = F.array(F.struct("line_id", "points"), F.struct((F.col("line_id") + 1_000_000_000).alias("line_id"), beside.alias("points")))
    return views.lines(spark, sf).select(F.inline(both))


@query("q_4_37_edge_verdicts", EDGES + """
SELECT ap || '#' || an AS a, bp || '#' || bn AS b, score, mutual, crossed, near_crossroad, CASE WHEN crossed THEN 'reject' WHEN NOT mutual THEN 'low' WHEN near_crossroad THEN 'medium' WHEN score >= 0.78 AND floor(parallel * 1000 + 0.5) / 1000 >= 0.88 AND floor(overlap * 1000 + 0.5) / 1000 >= 0.55 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM verdict""")
def edge_verdicts(spark, sf):
    v = matching.edge_verdicts(_paths(spark, sf))
    name = lambda c: F.concat_ws("#", F.col(f"{c}.parent"), F.col(f"{c}.n")).alias(c)
    return v.select(name("a"), name("b"), "score", "mutual", "crossed", "near_crossroad", "confidence")


@query("q_4_37_edge_claims", EDGES + """,
told AS (SELECT *, CASE WHEN crossed THEN 'reject' WHEN NOT mutual THEN 'low' WHEN near_crossroad THEN 'medium' WHEN score >= 0.78 AND floor(parallel * 1000 + 0.5) / 1000 >= 0.88 AND floor(overlap * 1000 + 0.5) / 1000 >= 0.55 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM verdict),
seg AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY p, k) AS n FROM (SELECT ap AS p, an AS k FROM ba UNION SELECT bp, bn FROM ba)),
f AS MATERIALIZED (SELECT t.*, a.n AS n, b.n AS j FROM told t JOIN seg a ON a.p = t.ap AND a.k = t.an JOIN seg b ON b.p = t.bp AND b.k = t.bn),
pq AS (SELECT n AS i, j FROM f), m AS (SELECT n AS i, j, confidence <> 'reject' AS takes FROM f)"""
       + LOOP.format(step="CASE WHEN list_contains(w.gone, m.j) THEN list_concat(w.gone, [-g.n]) WHEN m.takes THEN list_concat(w.gone, [g.n, m.j]) ELSE list_concat(w.gone, [g.n]) END").replace("FROM pr", "FROM pq").replace("THEN w.gone ELSE", "THEN list_concat(w.gone, [-g.n]) ELSE")
       + "SELECT ap || '#' || an AS a, bp || '#' || bn AS b, confidence FROM f WHERE -n NOT IN (SELECT n FROM lost)")
def edge_claims(spark, sf):
    """The pairs that stand. In the SQL a negative number marks a segment whose own pair did not."""
    v = matching.claim_edges(matching.edge_verdicts(_paths(spark, sf)))
    name = lambda c: F.concat_ws("#", F.col(f"{c}.parent"), F.col(f"{c}.n")).alias(c)
    return v.select(name("a"), name("b"), "confidence")


# ---- geometry --------------------------------------------------------------------------------------


@query("q_10_06_centroids", WITH + """
SELECT rect_id, CASE rect_id % 3 WHEN 0 THEN floor((x0 + x1) / 2 * 1e6 + 0.5) / 1e6 WHEN 1 THEN floor((x0 + x1 + x1) / 3 * 1e6 + 0.5) / 1e6 ELSE x0 END AS x, CASE rect_id % 3 WHEN 1 THEN floor((z0 + z0 + z1) / 3 * 1e6 + 0.5) / 1e6 ELSE floor((z0 + z1) / 2 * 1e6 + 0.5) / 1e6 END AS z FROM rects""")
def centroids(spark, sf):
    """Rectangles, triangles, and rings of no area, whose centre is the mean of their points."""
    k, x0, z0, x1, z1 = (F.col(c) for c in ("rect_id", "x0", "z0", "x1", "z1"))
    ring = F.when(k % 3 == 0, F.col("ring")).when(k % 3 == 1, F.slice("ring", 1, 3)).otherwise(geo.rectangle(x0, z0, x0, z1))
    return views.rects(spark, sf).select("rect_id", ringsets.measures(ring).alias("c")).select("rect_id", half_up(F.col("c.cx"), 6).alias("x"), half_up(F.col("c.cz"), 6).alias("z"))


@query("q_10_10_ring_distances", WITH + f""", near AS (SELECT a.rect_id AS a_id, b.rect_id AS b_id, a.x0 AS ax0, a.z0 AS az0, a.x1 AS ax1, a.z1 AS az1, b.x0 AS bx0, b.z0 AS bz0, b.x1 AS bx1, b.z1 AS bz1
  FROM rects a JOIN rects_b b ON a.x0 - 60 <= b.x1 AND b.x0 <= a.x1 + 60 AND a.z0 - 60 <= b.z1 AND b.z0 <= a.z1 + 60),
corner AS (SELECT a_id, b_id, unnest([ax0, ax1, ax1, ax0]) AS x, unnest([az0, az0, az1, az1]) AS z, bx0 AS x0, bz0 AS z0, bx1 AS x1, bz1 AS z1 FROM near UNION ALL SELECT a_id, b_id, unnest([bx0, bx1, bx1, bx0]), unnest([bz0, bz0, bz1, bz1]), ax0, az0, ax1, az1 FROM near),
far AS (SELECT a_id, b_id, max({to_edge("p.x0", "p.z0", "p.x1", "p.z1")}) AS d FROM corner p GROUP BY 1, 2)
SELECT a_id, b_id, floor(sqrt(greatest(0, ax0 - bx1, bx0 - ax1) ^ 2 + greatest(0, az0 - bz1, bz0 - az1) ^ 2) * 1000 + 0.5) / 1000 AS apart, floor(d * 1000 + 0.5) / 1000 AS hausdorff FROM near JOIN far USING (a_id, b_id)""")
def ring_distances(spark, sf):
    a = views.rects(spark, sf).select(F.col("rect_id").alias("a_id"), F.col("box").alias("a_box"), kernels.flat(F.col("ring")).alias("a_ring"))
    b = views.rects_b(spark, sf).select(F.col("rect_id").alias("b_id"), F.col("box").alias("b_box"), kernels.flat(F.col("ring")).alias("b_ring"))
    near = spatial.box_pairs(a, b, "a_box", "b_box", 100.0, pad=60.0)
    near = near.select("a_id", "b_id", kernels.ring_gaps(F.col("a_ring"), F.col("b_ring")).alias("d"))
    return near.select("a_id", "b_id", half_up(F.col("d.apart"), 3).alias("apart"), half_up(F.col("d.hausdorff"), 3).alias("hausdorff"))


@query("q_12_06_polygon_parts", WITH + "SELECT ward_id, part, CAST(CASE WHEN holed THEN 1 ELSE 0 END AS INT) AS n_holes FROM ward_parts")
def polygon_parts(spark, sf):
    return spatial.polygons(views.wards(spark, sf)).select("ward_id", "part", F.size("holes").alias("n_holes"))


def _zone_sql(lat0: float, lon0: float) -> str:
    """The published series as SQL, with its coefficients as numbers."""
    a, f, m0 = 6_378_137.0, 298.257222101, 0.9999
    n = 1 / (2 * f - 1)
    arc = [1 + n**2 / 4 + n**4 / 64, -3 / 2 * (n - n**3 / 8 - n**5 / 64), 15 / 16 * (n**2 - n**4 / 4), -35 / 48 * (n**3 - 5 / 16 * n**5), 315 / 512 * n**4, -693 / 1280 * n**5]
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4 - 127 / 288 * n**5, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4 + 281 / 630 * n**5, 61 / 240 * n**3 - 103 / 140 * n**4 + 15061 / 26880 * n**5, 49561 / 161280 * n**4 - 179 / 168 * n**5, 34729 / 80640 * n**5]
    phi0, scale, k = math.radians(lat0), m0 * a / (1 + n) * arc[0], 2 * math.sqrt(n) / (1 + n)
    start = m0 * a / (1 + n) * (arc[0] * phi0 + sum(arc[j] * math.sin(2 * j * phi0) for j in range(1, 6)))
    # Hyperbolic functions by exponentials, so that any engine has them.
    north = " + ".join(f"{c!r} * sin({2 * j} * xi) * (exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2" for j, c in enumerate(alpha, 1))
    east = " + ".join(f"{c!r} * cos({2 * j} * xi) * (exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2" for j, c in enumerate(alpha, 1))
    return f"""
WITH p AS (SELECT c_custkey AS id, radians(34.6::DOUBLE + (c_custkey % 100) / 1000.0::DOUBLE) AS phi, radians(135.5::DOUBLE + (c_custkey % 77) / 1000.0::DOUBLE - {lon0!r}) AS lam FROM customer),
u AS (SELECT id, lam, 0.5 * ln((1 + sin(phi)) / (1 - sin(phi))) - {k!r} * 0.5 * ln((1 + {k!r} * sin(phi)) / (1 - {k!r} * sin(phi))) AS q FROM p),
t AS (SELECT id, lam, (exp(q) - exp(-q)) / 2 AS t FROM u),
x AS (SELECT id, atan(t / cos(lam)) AS xi, 0.5 * ln((1 + sin(lam) / sqrt(1 + t * t)) / (1 - sin(lam) / sqrt(1 + t * t))) AS eta FROM t)
SELECT id, floor(({scale!r} * (xi + {north}) - {start!r}) * 100 + 0.5) / 100 AS n, floor({scale!r} * (eta + {east}) * 100 + 0.5) / 100 AS e FROM x"""


@query("q_10_02_plane_rectangular", _zone_sql(36.0, 136.0))
def plane_rectangular(spark, sf):
    """Zone 6, to centimetres; a test holds it against published values too."""
    k = F.col("c_custkey")
    p = matching.plane_rectangular(34.6 + (k % 100) / 1000.0, 135.5 + (k % 77) / 1000.0, 36.0, 136.0)
    return read_table(spark, sf, "customer").select(k.alias("id"), p.alias("p")).select("id", half_up(F.col("p.n"), 2).alias("n"), half_up(F.col("p.e"), 2).alias("e"))
