"""Projections, ordered rules, scalar functions and plain aggregates of the inventory over the plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quadrille.functions import classify, geo, names, ringsets
from quadrille.functions.num import cell_value, half_up, percent, suppressed_sum
from quadrille.plans import views
from quadrille.plans.registry import query
from quadrille.plans.views import WITH
from quadrille.storage import read_table


def pick(values: list[str | None], number: Column) -> Column:
    """The value at a number modulo their count; an empty value is null."""
    return F.nullif(F.element_at(F.array(*(F.lit(v or "") for v in values)), (number % len(values) + 1).cast("int")), F.lit(""))


def sql_pick(values: list[str | None], number: str) -> str:
    return f"nullif(list_extract([{', '.join(repr(v or '') for v in values)}], CAST(({number}) % {len(values)} + 1 AS INT)), '')"


def tagged(spark: SparkSession, sf: str, **tags: tuple[list[str | None], int]) -> DataFrame:
    """Parts with a tag map; each tag picks from its values by the key times a factor."""
    key = F.col("p_partkey")
    entries = [x for name, (values, factor) in tags.items() for x in (F.lit(name.replace("__", ":")), pick(values, F.floor(key / factor)))]
    return read_table(spark, sf, "part").select(key.alias("id"), F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("tags"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


def sql_tagged(**tags: tuple[list[str | None], int]) -> str:
    columns = ", ".join(f"{sql_pick(values, f'p_partkey // {factor}')} AS {name}" for name, (values, factor) in tags.items())
    return f"WITH t AS (SELECT p_partkey AS id, {columns}, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) "


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_case(key: str, table: dict) -> str:
    """CASE arms of a table; the caller closes them."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, (int, float)) else repr(v)}" for k, v in table.items())


#: Every road class, service and access there is a rule for, some others, and none.
ROADS = {
    "highway": ([*classify.MAJOR_ROADS, *classify.MIDDLE_ROADS, *classify.OTHER_ROADS, "footway", None], 1),
    "service": (["alley", *classify.SERVICES_LEFT_OUT, None, None], 2),
    "access": ([None, *classify.TRACK_ACCESS_LEFT_OUT, None, "yes"], 3),
    "motor_vehicle": ([None, None, "no"], 5),
    "width": ([None, "6.5 m", "40", "1", "abc", None], 7),
    "lanes": ([None, "2", "3", "0", None], 11),
}
MAJOR, MIDDLE = sql_list(classify.MAJOR_ROADS), sql_list(classify.MIDDLE_ROADS)
ALLOWED = f"{MAJOR}, {MIDDLE}, {sql_list(classify.OTHER_ROADS)}"
SERVICES, ACCESSES = sql_list(classify.SERVICES_LEFT_OUT), sql_list(classify.TRACK_ACCESS_LEFT_OUT)


@query("q_3_11_road_eligibility", sql_tagged(**ROADS) + f"""
SELECT id, CASE WHEN coalesce(highway, '') NOT IN ({ALLOWED}) THEN 'highway-not-eligible:' || coalesce(highway, '?')
  WHEN service IN ({SERVICES}) THEN 'service:' || service WHEN highway = 'track' AND access IN ({ACCESSES}) THEN 'track-access:' || access WHEN access IN ('private', 'no') THEN 'access:' || access
  WHEN motor_vehicle = 'no' AND highway NOT IN ('pedestrian', 'living_street') THEN 'motor_vehicle:no' END AS skip_reason,
  CASE WHEN highway IN ({MAJOR}) THEN 'major' WHEN highway IN ({MIDDLE}) THEN 'mid' ELSE 'local' END AS tier,
  CASE WHEN highway IN ({MAJOR}) THEN 'MAJOR' WHEN highway IN ({MIDDLE}) THEN 'MID' WHEN highway = 'service' AND service = 'alley' THEN 'LOCAL_ALLEY' WHEN highway = 'service' THEN 'LOCAL_SERVICE'
    WHEN highway = 'residential' THEN 'LOCAL_RESIDENTIAL' WHEN highway = 'living_street' THEN 'LOCAL_LIVING' WHEN highway = 'unclassified' THEN 'LOCAL_UNCLASSIFIED' WHEN highway = 'track' THEN 'LOCAL_TRACK' WHEN highway = 'pedestrian' THEN 'PEDESTRIAN' ELSE 'LOCAL_ROAD' END AS detail FROM t""")
def road_eligibility(spark, sf):
    t = F.col("tags")
    return tagged(spark, sf, **ROADS).select("id", classify.road_skip_reason(t).alias("skip_reason"), classify.road_tier(t["highway"]).alias("tier"), classify.road_detail(t).alias("detail"))


@query("q_3_12_road_report", sql_tagged(**ROADS) + f"""
SELECT coalesce(CASE WHEN coalesce(highway, '') NOT IN ({ALLOWED}) THEN 'highway' WHEN service IN ({SERVICES}) THEN 'service' WHEN highway = 'track' AND access IN ({ACCESSES}) THEN 'track-access'
  WHEN access IN ('private', 'no') THEN 'access' WHEN motor_vehicle = 'no' AND highway NOT IN ('pedestrian', 'living_street') THEN 'motor_vehicle' END, 'kept') AS reason, count(*) AS n FROM t GROUP BY 1""")
def road_report(spark, sf):
    reason = F.regexp_replace(F.split_part(classify.road_skip_reason(F.col("tags")), F.lit(":"), F.lit(1)), "^highway-not-eligible$", "highway")
    return tagged(spark, sf, **ROADS).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("q_3_25_road_width", sql_tagged(**ROADS) + f"""
SELECT id, greatest(2.5, least(28, CASE WHEN width IN ('6.5 m') THEN 6.5 WHEN width = '40' THEN 40 WHEN width = '1' THEN 1 WHEN lanes IN ('2', '3') THEN CAST(lanes AS INT) * 3.25 WHEN highway = 'service' AND service = 'alley' THEN 3
  ELSE {sql_case('highway', classify.ROAD_WIDTHS)} ELSE 5.5 END END))::DOUBLE AS width,
  CASE WHEN width IN ('6.5 m', '40', '1') THEN 'width' WHEN lanes IN ('2', '3') THEN 'lanes' ELSE 'class-default' END AS source FROM t""")
def road_width(spark, sf):
    return tagged(spark, sf, **ROADS).select("id", classify.road_width(F.col("tags")).alias("w")).select("id", "w.width", "w.source")


LAND = {
    "amenity": ([None, "parking", None, None, "school"], 1), "parking": (["surface", "Multi-Storey", None, "rooftop", "underground", "lane"], 5), "leisure": ([None, "park", "garden", "pitch", None, "nature_reserve", "water_park"], 2),
    "landuse": ([None, "grass", "cemetery", "retail", "railway", "recreation_ground", "forest", "village_green"], 3), "natural": ([None, "wood", "scrub", "water", "coastline", "grassland"], 7), "waterway": ([None, "riverbank", "stream", "DITCH"], 11), "water": ([None, "lake", "pond", "basin", "lagoon", "moat", "tidal_channel"], 13),
}


@query("q_3_16_land_use", sql_tagged(**LAND) + """
SELECT id, CASE WHEN amenity = 'parking' THEN 'parking' WHEN leisure = 'park' OR landuse = 'recreation_ground' THEN 'park' WHEN landuse = 'grass' THEN 'grass' WHEN landuse = 'cemetery' THEN 'cemetery' WHEN landuse = 'retail' THEN 'commercial' WHEN landuse = 'railway' THEN 'railway'
  WHEN "natural" IN ('wood', 'scrub') THEN 'wood' WHEN "natural" = 'grassland' THEN 'grass' WHEN "natural" = 'water' OR waterway = 'riverbank' THEN 'water' END AS category,
  CASE WHEN amenity = 'parking' THEN CASE lower(parking) WHEN 'surface' THEN 'parking_surface' WHEN 'multi-storey' THEN 'parking_multi_storey' WHEN 'rooftop' THEN 'parking_rooftop' WHEN 'underground' THEN 'parking_underground' ELSE 'parking_unspecified' END
  WHEN leisure = 'park' THEN 'leisure_park' WHEN landuse IN ('recreation_ground', 'grass', 'cemetery', 'retail', 'railway') THEN 'landuse_' || landuse WHEN "natural" IN ('wood', 'scrub', 'grassland', 'water') THEN 'natural_' || "natural" WHEN waterway = 'riverbank' THEN 'waterway_riverbank' END AS subtype FROM t""")
def land_use(spark, sf):
    return tagged(spark, sf, **LAND).select("id", classify.land_use(F.col("tags")).alias("u")).select("id", "u.category", "u.subtype")


@query("q_3_17_water_class", sql_tagged(**LAND) + """, c AS (
SELECT id, size, CASE WHEN "natural" = 'coastline' OR water = 'lagoon' THEN 'harbour' WHEN waterway = 'riverbank' OR water = 'tidal_channel' THEN 'river' WHEN lower(waterway) = 'ditch' OR water = 'moat' THEN 'canal' WHEN waterway = 'stream' THEN 'stream'
  WHEN water = 'lake' THEN 'lake' WHEN water = 'pond' THEN 'pond' WHEN water = 'basin' THEN 'reservoir' ELSE 'water' END AS class FROM t)
SELECT id, class, CASE WHEN class = 'harbour' THEN 'harbour' WHEN class IN ('lake', 'pond', 'reservoir') THEN 'basin' WHEN class = 'water' AND NOT size * 30 > 600 THEN 'basin' ELSE 'linear' END AS family FROM c""")
def water_class(spark, sf):
    kind = classify.water_class(F.col("tags"))
    return tagged(spark, sf, **LAND).select("id", kind.alias("class"), classify.water_family(kind, F.col("size") * 30).alias("family"))


@query("q_3_18_park_class", sql_tagged(**LAND) + """
SELECT id, CASE WHEN leisure IN ('park', 'garden') THEN leisure WHEN leisure = 'pitch' THEN 'sports_ground' WHEN leisure = 'nature_reserve' THEN 'green_space' WHEN leisure = 'water_park' THEN 'other' WHEN landuse = 'recreation_ground' THEN 'recreation_ground'
  WHEN landuse = 'forest' OR "natural" IN ('wood', 'scrub') THEN 'green_space' WHEN landuse IN ('grass', 'village_green') THEN 'grass' ELSE 'other' END AS park_class,
  coalesce(leisure IN ('park', 'garden', 'pitch', 'nature_reserve'), false) OR (coalesce(leisure, '') <> 'water_park' AND coalesce(landuse, '') = 'recreation_ground') AS rankable FROM t""")
def park_class(spark, sf):
    return tagged(spark, sf, **LAND).select("id", classify.park_class(F.col("tags")).alias("p")).select("id", "p.park_class", "p.rankable")


#: Every building word of the tables, some in capitals, those that are left out, unknown ones, and none.
BUILDINGS = [*dict.fromkeys([*classify.CATEGORIES, *classify.CLASS_HEIGHTS, *classify.BUILDINGS_LEFT_OUT]), "Apartments", "OFFICE", "yes", "true", "unheard", None]
BUILT = {"building": (BUILDINGS, 1), "height": ([None, "12.5", "200", "x", "0"], 3), "building__levels": ([None, "4", "0", "30"], 7)}


@query("q_3_21_building_height", sql_tagged(**BUILT) + f""", b AS (SELECT *, {sql_case('lower(building)', classify.CLASS_HEIGHTS)} END AS usual FROM t)
SELECT id, CASE WHEN height IN ('12.5', '200') THEN least(60, CAST(height AS DOUBLE)) WHEN building__levels IN ('4', '30') THEN least(60, CAST(building__levels AS DOUBLE) * 3.2) ELSE coalesce(usual, 6) END::DOUBLE AS height,
  CASE WHEN height IN ('12.5', '200') THEN 'height' WHEN building__levels IN ('4', '30') THEN 'levels' WHEN usual IS NOT NULL THEN 'class-default' ELSE 'generic-default' END AS source,
  CASE WHEN height IN ('12.5', '200') THEN 0.92 WHEN building__levels IN ('4', '30') THEN 0.78 WHEN usual IS NOT NULL THEN 0.55 ELSE 0.4 END::DOUBLE AS confidence FROM b""")
def building_height(spark, sf):
    return tagged(spark, sf, **BUILT).select("id", classify.building_height(F.col("tags")).alias("h")).select("id", "h.height", "h.source", "h.confidence")


@query("q_3_19_building_category", sql_tagged(**BUILT) + f"""
SELECT id, {sql_case('lower(building)', classify.CATEGORIES)} ELSE 'other' END AS category, coalesce(lower(building) NOT IN ({sql_list(classify.BUILDINGS_LEFT_OUT)}), false) AS eligible FROM t""")
def building_category(spark, sf):
    b = F.col("tags")["building"]
    return tagged(spark, sf, **BUILT).select("id", classify.building_category(b).alias("category"), classify.building_eligible(b).alias("eligible"))


@query("q_3_24_height_class", """
SELECT p_partkey AS id, CASE WHEN p_retailprice / 10 >= 150 THEN 'very_tall' WHEN p_retailprice / 10 >= 100 THEN 'skyscraper' WHEN p_retailprice / 10 >= 40 THEN 'high' WHEN p_retailprice / 10 >= 15 THEN 'mid' ELSE 'low' END AS class FROM part""")
def height_class(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), classify.height_class(F.col("p_retailprice") / 10).alias("class"))


@query("q_3_27_visibility", """
WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'mid' ELSE 'local' END AS class, (p_partkey * 97) % 12000 AS d FROM part)
SELECT id, class, CASE WHEN d > 9000 THEN 'far' WHEN d > 3500 THEN 'mid' ELSE 'near' END AS band, class = 'major' OR (class = 'mid' AND d <= 9000) OR d <= 3500 AS visible FROM t""")
def visibility(spark, sf):
    key = F.col("p_partkey")
    kind, d = pick(["major", "mid", "local"], key), (key * 97) % 12000
    return read_table(spark, sf, "part").select(key.alias("id"), kind.alias("class"), classify.band(d).alias("band"), classify.visible(kind, d).alias("visible"))


@query("q_3_28_derived_levels", WITH + """
SELECT rect_id AS id, l.level, area FROM rects, (VALUES ('far'), ('mid'), ('near')) l(level)
WHERE l.level = 'near' OR (l.level = 'far' AND (size >= 30 OR area >= 400)) OR (l.level = 'mid' AND (size >= 12 OR area >= 400))""")
def derived_levels(spark, sf):
    out = views.rects(spark, sf).withColumn("level", F.explode(F.array(*map(F.lit, ("far", "mid", "near")))))
    return out.where(classify.shown_at("buildings", F.col("level"), F.lit(""), F.when(F.col("area") >= 400, 3000.0).otherwise(F.col("area")), F.col("size"))).select(F.col("rect_id").alias("id"), "level", "area")


@query("q_3_09_tag_projection", sql_tagged(**ROADS) + "SELECT id, (highway IS NOT NULL)::INT + (lanes IS NOT NULL)::INT AS n, coalesce(highway, '-') || '/' || coalesce(lanes, '-') AS kept FROM t")
def tag_projection(spark, sf):
    kept = F.map_filter(F.col("tags"), lambda k, v: k.isin("highway", "lanes"))
    return tagged(spark, sf, **ROADS).select("id", F.size(kept).alias("n"), F.concat_ws("/", *(F.coalesce(kept[k], F.lit("-")) for k in ("highway", "lanes"))).alias("kept"))


CELLS = ["12", "1,234", "X", "-", "", "n/a", " 7 ", "秘匿", "3.5"]


@query("q_3_01_cell_values", f"WITH t AS (SELECT p_partkey AS id, {sql_pick(CELLS, 'p_partkey')} AS raw FROM part) " + """
SELECT id, CASE WHEN trim(raw) IN ('X', '秘匿') THEN NULL WHEN trim(raw) = '-' THEN 0 ELSE TRY_CAST(replace(trim(raw), ',', '') AS DOUBLE) END AS value, coalesce(trim(raw) IN ('X', '秘匿'), false) AS suppressed FROM t""")
def cell_values(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), cell_value(pick(CELLS, F.col("p_partkey"))).alias("v")).select("id", "v.value", "v.suppressed")


@query("q_3_05_skip_reasons", """
WITH t AS (SELECT c_custkey AS id, c_custkey % 6 AS level, c_nationkey AS ward, c_custkey % 23 = 0 AS blank, c_custkey % 31 = 0 AS other FROM customer)
SELECT coalesce(CASE WHEN blank THEN 'empty-row' WHEN level <> 4 THEN CASE WHEN level = 1 THEN 'total-row' WHEN level <= 3 THEN 'subtotal-row' ELSE 'unknown-level' END WHEN other THEN 'other-city' WHEN ward >= 20 THEN 'ward-not-in-target' END, 'kept') AS reason, count(*) AS n FROM t GROUP BY 1""")
def skip_reasons(spark, sf):
    k = F.col("c_custkey")
    level = k % 6
    reason = classify.skip_reason([(k % 23 == 0, "empty-row"), (level == 1, "total-row"), (level <= 3, "subtotal-row"), (level != 4, "unknown-level"), (k % 31 == 0, "other-city"), (F.col("c_nationkey") >= 20, "ward-not-in-target")])
    return read_table(spark, sf, "customer").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("q_3_10_bbox_filter", WITH + "SELECT rect_id FROM rects WHERE x0 <= 4000 AND x1 >= -4000 AND z0 <= 3000 AND z1 >= -3000")
def bbox_filter(spark, sf):
    frame = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("x0", -4000), ("z0", -3000), ("x1", 4000), ("z1", 3000))))
    return views.rects(spark, sf).where(geo.boxes_touch(F.col("box"), frame)).select("rect_id")


@query("q_3_34_footprint_problems", WITH + "SELECT rect_id, CASE WHEN area < 60 THEN 'too-small' WHEN area > 400 THEN 'too-big' END AS problem FROM rects")
def footprint_problems(spark, sf):
    return views.rects(spark, sf).select("rect_id", geo.shape_problem(F.col("ring"), 60, 400).alias("problem"))


@query("q_3_33_shape_guard", WITH + "SELECT rect_id, area, greatest(w, h) / least(w, h) AS aspect, CASE WHEN area < 60 THEN 'area' WHEN greatest(w, h) / least(w, h) > 2.5 THEN 'aspect' ELSE 'ok' END AS verdict FROM rects")
def shape_guard(spark, sf):
    aspect = F.greatest("w", "h") / F.least("w", "h")
    return views.rects(spark, sf).select("rect_id", geo.area(F.col("ring")).alias("area"), aspect.alias("aspect"), F.when(geo.area(F.col("ring")) < 60, "area").when(aspect > 2.5, "aspect").otherwise("ok").alias("verdict"))


@query("q_3_35_placement", WITH + """
SELECT rect_id, CASE WHEN rect_id % 50 = 0 THEN 'keep:prior' WHEN type LIKE '%STEEL%' THEN 'keep:exempt' WHEN rect_id % 11 = 0 AND size > 20 THEN 'suppress:water' WHEN rect_id % 13 = 0 AND size > 10 THEN 'suppress:road' ELSE 'keep:clear' END AS decision FROM rects""")
def placement(spark, sf):
    k, size = F.col("rect_id"), F.col("size")
    rules = [(k % 50 == 0, "keep:prior"), (F.col("type").contains("STEEL"), "keep:exempt"), ((k % 11 == 0) & (size > 20), "suppress:water"), ((k % 13 == 0) & (size > 10), "suppress:road")]
    return views.rects(spark, sf).select("rect_id", classify.first_rule(rules, "keep:clear").alias("decision"))


# ---- aggregates ----------------------------------------------------------------------------------


@query("q_5_01_age_brackets", """
WITH v AS (SELECT c_custkey AS id, a.lower, (c_custkey * (a.lower + 3)) % 97 AS value, (c_custkey + a.lower) % 41 = 0 AS suppressed FROM customer, (SELECT unnest(range(0, 90, 5)) AS lower) a),
g AS (SELECT *, CASE WHEN lower <= 14 THEN 'age0to14' WHEN lower <= 24 THEN 'age15to24' WHEN lower <= 39 THEN 'age25to39' WHEN lower <= 64 THEN 'age40to64' WHEN lower <= 74 THEN 'age65to74' ELSE 'age75plus' END AS bracket FROM v)
SELECT id, bracket, CASE WHEN NOT bool_or(suppressed) THEN CAST(sum(value) AS BIGINT) END AS value, bool_or(suppressed) AS suppressed FROM g GROUP BY 1, 2""")
def age_brackets(spark, sf):
    k = F.col("c_custkey")
    long = read_table(spark, sf, "customer").select(k.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(85), F.lit(5))).alias("lower"))
    long = long.withColumn("value", (F.col("id") * (F.col("lower") + 3)) % 97).withColumn("suppressed", (F.col("id") + F.col("lower")) % 41 == 0)
    low = F.col("lower")
    bracket = classify.first_rule([(low <= 14, "age0to14"), (low <= 24, "age15to24"), (low <= 39, "age25to39"), (low <= 64, "age40to64"), (low <= 74, "age65to74")], "age75plus")
    return long.groupBy("id", bracket.alias("bracket")).agg(F.when(~F.bool_or("suppressed"), F.sum("value")).alias("value"), F.bool_or("suppressed").alias("suppressed"))


@query("q_5_03_suppressed_sum", """
WITH v AS (SELECT c_custkey AS id, c_custkey % 7 AS a, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 11 END AS b, c_custkey % 13 = 0 AS sa, c_custkey % 17 = 0 AS sb FROM customer)
SELECT id, CASE WHEN NOT sa AND NOT sb THEN CAST(a + b AS DOUBLE) END AS total, sa OR sb AS suppressed, CASE WHEN NOT sa AND NOT sb AND id % 5 <> 0 THEN floor((a + b) / (id % 5) * 1000 + 0.5) / 10 END AS rate FROM v""")
def suppressed(spark, sf):
    k = F.col("c_custkey")
    cell = lambda v, s: F.struct(v.cast("double").alias("value"), s.alias("suppressed"))
    total = suppressed_sum([cell(k % 7, k % 13 == 0), cell(F.when(k % 9 != 0, k % 11), k % 17 == 0)])
    return read_table(spark, sf, "customer").select(k.alias("id"), total["value"].alias("total"), total["suppressed"].alias("suppressed"), percent(total["value"], k % 5).alias("rate"))


@query("q_5_05_counts_by_key", "SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1")
def counts_by_key(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n")).orderBy("k")


@query("q_5_22_translation_summary", """
SELECT o_orderpriority AS k, count(*) AS n, list_sort(list(v))[least(count(*) - 1, floor(count(*) * 0.5))::INT + 1] AS p50, list_sort(list(v))[least(count(*) - 1, floor(count(*) * 0.9))::INT + 1] AS p90,
       list_sort(list(v))[least(count(*) - 1, floor(count(*) * 0.99))::INT + 1] AS p99, floor(avg(v) * 100 + 0.5) / 100 AS mean, floor(stddev_pop(v) * 100 + 0.5) / 100 AS std
FROM (SELECT o_orderpriority, floor(o_totalprice) AS v FROM orders) GROUP BY 1""")
def translation_summary(spark, sf):
    """Nearest-rank quantiles by rank, so no group is gathered in one list: counts by value, then a running count."""
    v = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.floor("o_totalprice").cast("double").alias("v"))
    base = v.groupBy("k").agg(F.count("*").alias("n"), half_up(F.avg("v"), 2).alias("mean"), half_up(F.stddev_pop("v"), 2).alias("std"))
    counts = v.groupBy("k", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("c").over(w)).join(base, "k")
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))), F.col("v")))
    return ranked.groupBy("k", "n", "mean", "std").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


@query("q_5_23_regression", """
SELECT l_returnflag AS k, count(*) AS n, floor(regr_slope(y, x) * 1e6 + 0.5) / 1e6 AS slope, floor(regr_intercept(y, x) * 1e2 + 0.5) / 1e2 AS intercept, floor(corr(y, x) * 1e6 + 0.5) / 1e6 AS r
FROM (SELECT l_returnflag, l_quantity AS x, floor(l_extendedprice) AS y FROM lineitem) GROUP BY 1""")
def regression(spark, sf):
    d = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("x"), F.floor("l_extendedprice").cast("double").alias("y"))
    return d.groupBy("k").agg(F.count("*").alias("n"), half_up(F.regr_slope("y", "x"), 6).alias("slope"), half_up(F.regr_intercept("y", "x"), 2).alias("intercept"), half_up(F.corr("y", "x"), 6).alias("r"))


@query("q_5_24_height_summary", """
SELECT count(*) AS n, count(*) FILTER (WHERE h >= 30) AS ge30, count(*) FILTER (WHERE h >= 100) AS ge100, count(*) FILTER (WHERE h >= 150) AS ge150, max(h) AS top FROM (SELECT floor(p_retailprice / 10) AS h FROM part)""")
def height_summary(spark, sf):
    h = F.col("h")
    d = read_table(spark, sf, "part").select(F.floor(F.col("p_retailprice") / 10).cast("double").alias("h"))
    return d.agg(F.count("*").alias("n"), F.count_if(h >= 30).alias("ge30"), F.count_if(h >= 100).alias("ge100"), F.count_if(h >= 150).alias("ge150"), F.max(h).alias("top"))


@query("q_5_25_height_histogram", "SELECT CAST(least(floor(p_retailprice / 100) * 100, 1500) AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY 1")
def histogram(spark, sf):
    return read_table(spark, sf, "part").groupBy(F.least(F.floor(F.col("p_retailprice") / 100) * 100, F.lit(1500)).alias("bin")).agg(F.count("*").alias("n"))


@query("q_5_26_class_counters", "SELECT coalesce(o_orderstatus, 'total') AS class, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
def class_counters(spark, sf):
    return read_table(spark, sf, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("total")).alias("class"), "n")


@query("q_5_27_cliff", WITH + """, h AS (SELECT CAST(floor(CASE WHEN point_id % 20 = 0 THEN z ELSE -abs(z) END / 500) AS BIGINT) AS bin, count(*) AS n FROM pts GROUP BY 1),
l AS (SELECT *, lag(n) OVER (ORDER BY bin) AS before FROM h) SELECT min(bin) AS bin FROM l WHERE before >= 5 * n""")
def cliff(spark, sf):
    """Most places lie north of the origin, so their number drops there."""
    z = F.when(F.col("point_id") % 20 == 0, F.col("z")).otherwise(-F.abs("z"))
    h = views.pts(spark, sf).groupBy(F.floor(z / 500).alias("bin")).agg(F.count("*").alias("n"))
    # The histogram's length is the grid's, not the data's.
    return h.withColumn("before", F.lag("n").over(Window.orderBy("bin"))).where(F.col("before") >= 5 * F.col("n")).agg(F.min("bin").alias("bin"))


@query("q_5_28_manifest", WITH + """
SELECT l.level AS level, CAST(floor(x0 / 2000) AS BIGINT) AS tx, CAST(floor(z0 / 2000) AS BIGINT) AS tz, count(*) AS n, count(DISTINCT rect_id) AS ids, CAST(4 * count(*) AS BIGINT) AS vertices FROM rects, (VALUES ('far'), ('near')) l(level)
WHERE l.level = 'near' OR size >= 30 GROUP BY 1, 2, 3""")
def manifest(spark, sf):
    out = views.rects(spark, sf).withColumn("level", F.explode(F.array(F.lit("far"), F.lit("near")))).where((F.col("level") == "near") | (F.col("size") >= 30))
    return out.groupBy("level", geo.cell(F.col("x0"), 2000.0).alias("tx"), geo.cell(F.col("z0"), 2000.0).alias("tz")).agg(F.count("*").alias("n"), F.countDistinct("rect_id").alias("ids"), F.sum(F.size("ring")).alias("vertices"))


@query("q_5_29_preferred_photo", """
WITH s AS (SELECT o_custkey AS k, o_orderkey AS photo, CASE WHEN o_orderpriority LIKE '1%' THEN 5 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END - CASE WHEN o_orderpriority LIKE '5%' THEN 4 ELSE 0 END AS score FROM orders)
SELECT k, photo, score FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, photo) = 1""")
def preferred_photo(spark, sf):
    hit = lambda cond, w: F.when(cond, w).otherwise(0)
    p = F.col("o_orderpriority")
    score = hit(p.rlike("^1"), 5) + hit(F.col("o_orderstatus") == "F", 3) - hit(p.rlike("^5"), 4)
    s = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("photo"), score.alias("score"))
    return s.groupBy("k").agg(F.min_by(F.struct("photo", "score"), F.struct(-F.col("score"), F.col("photo"))).alias("b")).select("k", "b.photo", "b.score")


@query("q_5_30_performance_rows", """
WITH e AS (SELECT event_type AS metric, floor(sum(CASE WHEN event_id % 2 = 0 THEN floor(value * 100) END)) AS a, floor(sum(CASE WHEN event_id % 2 = 1 THEN floor(value * 100) END)) AS b FROM events GROUP BY 1)
SELECT metric, CASE WHEN a IS NULL OR b IS NULL THEN 'MISSING' WHEN b > a * 1.1 THEN 'REGRESS' WHEN b < a * 0.9 THEN 'IMPROVE' ELSE 'OK' END AS verdict FROM e""")
def performance(spark, sf):
    run = lambda r: F.sum(F.when(F.col("event_id") % 2 == r, F.floor(F.col("value") * 100)))
    e = read_table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(run(0).alias("a"), run(1).alias("b"))
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), "MISSING").when(F.col("b") > F.col("a") * 1.1, "REGRESS").when(F.col("b") < F.col("a") * 0.9, "IMPROVE").otherwise("OK")
    return e.select("metric", verdict.alias("verdict"))


@query("q_5_31_confusion", """
SELECT p_size % 3 AS predicted, count(*) FILTER (WHERE p_partkey % 3 = 0) AS truth_0, count(*) FILTER (WHERE p_partkey % 3 = 1) AS truth_1, count(*) FILTER (WHERE p_partkey % 3 = 2) AS truth_2,
       floor(count(*) FILTER (WHERE p_partkey % 3 = p_size % 3) / count(*) * 1000 + 0.5) / 10 AS agree FROM part GROUP BY 1""")
def confusion(spark, sf):
    d = read_table(spark, sf, "part").select((F.col("p_size") % 3).alias("predicted"), (F.col("p_partkey") % 3).alias("truth"))
    counts = [F.count_if(F.col("truth") == i).alias(f"truth_{i}") for i in range(3)]
    return d.groupBy("predicted").agg(*counts, percent(F.count_if(F.col("truth") == F.col("predicted")), F.count("*")).alias("agree"))


@query("q_5_32_detectability", WITH + """
SELECT g.gsd AS gsd, count(*) AS n, count(*) FILTER (WHERE least(w, h) >= 3 * g.gsd) AS seen, floor(count(*) FILTER (WHERE least(w, h) >= 3 * g.gsd) / count(*) * 1000 + 0.5) / 10 AS rate FROM rects, (SELECT unnest(range(1, 9)) AS gsd) g GROUP BY 1""")
def detectability(spark, sf):
    out = views.rects(spark, sf).withColumn("gsd", F.explode(F.sequence(F.lit(1), F.lit(8))))
    seen = F.count_if(F.least("w", "h") >= 3 * F.col("gsd"))
    return out.groupBy("gsd").agg(F.count("*").alias("n"), seen.alias("seen"), percent(seen, F.count("*")).alias("rate")).withColumn("gsd", F.col("gsd").cast("long"))


@query("q_5_21_town_aggregate", WITH + """
SELECT ward, floor(sum(x * (balance_i)) / sum(balance_i) * 100 + 0.5) / 100 AS cx, least(count(DISTINCT point_id % 60), 40) AS blocks, max(x) - min(x) AS spread FROM (SELECT *, abs(floor(balance)) + 1 AS balance_i FROM pts) GROUP BY 1""")
def town_aggregate(spark, sf):
    w = F.abs(F.floor("balance")) + 1
    return views.pts(spark, sf).groupBy("ward").agg(half_up(F.sum(F.col("x") * w) / F.sum(w), 2).alias("cx"), F.least(F.countDistinct(F.col("point_id") % 60), F.lit(40)).alias("blocks"), (F.max("x") - F.min("x")).alias("spread"))


# ---- windows, order, sets ------------------------------------------------------------------------


@query("q_6_01_rank_tiers", """
WITH r AS (SELECT c_custkey AS id, c_nationkey AS ward, floor(c_acctbal) AS score, row_number() OVER (ORDER BY floor(c_acctbal) DESC, c_custkey) AS rk FROM customer),
w AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY score DESC, id) AS wr FROM r)
SELECT id, CASE WHEN rk <= 60 THEN 'major' WHEN rk <= 280 OR wr <= 3 THEN 'medium' ELSE 'minor' END AS tier FROM w""")
def rank_tiers(spark, sf):
    """Tiers by rank without a global sort: the first ranks are a top-k, wards have their own windows."""
    d = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("ward"), F.floor("c_acctbal").alias("score"))
    top = d.orderBy(F.desc("score"), "id").limit(280)
    top = top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", "rk")
    best = d.withColumn("wr", F.row_number().over(Window.partitionBy("ward").orderBy(F.desc("score"), "id"))).where("wr <= 3").select("id", "wr")
    out = d.join(F.broadcast(top), "id", "left").join(best, "id", "left")
    return out.select("id", F.when(F.col("rk") <= 60, "major").when(F.col("rk").isNotNull() | F.col("wr").isNotNull(), "medium").otherwise("minor").alias("tier"))


@query("q_6_04_change_points", """
WITH s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_quantity AS w FROM lineitem),
m AS (SELECT *, list_sort(list(w) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS f FROM s)
SELECT k, pos, abs(w - f[len(f) // 2 + 1]) > 15 AS spike FROM m""")
def change_points(spark, sf):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    d = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), rank.alias("pos"), F.col("l_quantity").alias("w"))
    f = F.array_sort(F.collect_list("w").over(Window.partitionBy("k").orderBy("pos").rowsBetween(-3, 3)))
    return d.withColumn("f", f).select("k", "pos", (F.abs(F.col("w") - F.element_at("f", (F.floor(F.size("f") / 2) + 1).cast("int"))) > 15).alias("spike"))


@query("q_7_01_priority_batch", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderpriority, floor(o_totalprice) DESC, o_orderkey LIMIT 100")
def priority_batch(spark, sf):
    return read_table(spark, sf, "orders").orderBy("o_orderpriority", F.desc(F.floor("o_totalprice")), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("k"))


@query("q_7_02_tiles_by_distance", WITH + """, t AS (SELECT DISTINCT CAST(floor(x / 1000) AS BIGINT) AS tx, CAST(floor(z / 1000) AS BIGINT) AS tz FROM pts)
SELECT tx, tz, tx * tx + tz * tz AS d2 FROM t ORDER BY d2, tx, tz LIMIT 40""")
def tiles_by_distance(spark, sf):
    t = views.pts(spark, sf).select(geo.cell(F.col("x"), 1000.0).alias("tx"), geo.cell(F.col("z"), 1000.0).alias("tz")).distinct()
    return t.withColumn("d2", F.col("tx") * F.col("tx") + F.col("tz") * F.col("tz")).orderBy("d2", "tx", "tz").limit(40)


@query("q_7_03_batches", """
SELECT o_custkey AS k, o_orderkey AS item, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS batch FROM orders""")
def batches(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), F.floor((F.row_number().over(w) - 1) / 10).alias("batch"))


@query("q_7_05_top_k", "SELECT o_custkey AS k, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice) DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_k(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.floor("o_totalprice")), "o_orderkey")
    return read_table(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), F.col("rank").cast("long").alias("rank"))


@query("q_8_01_union_sets", WITH + "SELECT rect_id, 'base' AS source FROM rects UNION ALL SELECT rect_id, 'recovered' FROM rects_b")
def union_sets(spark, sf):
    a = views.rects(spark, sf).select("rect_id", F.lit("base").alias("source"))
    return a.unionByName(views.rects_b(spark, sf).select("rect_id", F.lit("recovered").alias("source")))


@query("q_8_03_set_difference", """
SELECT 'only-a' AS side, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'only-b', k FROM (SELECT user_id AS k FROM events EXCEPT SELECT c_custkey FROM customer)""")
def set_difference(spark, sf):
    a = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct()
    b = read_table(spark, sf, "events").select(F.col("user_id").alias("k")).distinct()
    return a.join(b, "k", "left_anti").select(F.lit("only-a").alias("side"), "k").unionByName(b.join(a, "k", "left_anti").select(F.lit("only-b").alias("side"), "k"))


@query("q_8_04_missing_and_duplicate_ids", """
SELECT 'missing' AS kind, n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'duplicate', c_nationkey FROM customer GROUP BY 2 HAVING count(*) > 60""")
def missing_ids(spark, sf):
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    there = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    many = read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("c")).where("c > 60")
    return n.join(there, "k", "left_anti").select(F.lit("missing").alias("kind"), "k").unionByName(many.select(F.lit("duplicate").alias("kind"), "k"))


@query("q_8_06_corrections", WITH + """
SELECT rect_id, CASE WHEN rect_id % 10 = 0 AND area > 100 THEN 'corrected' WHEN rect_id % 10 = 0 THEN 'guard-failed' ELSE 'as-is' END AS state FROM rects""")
def corrections(spark, sf):
    """Corrections by id that name the hash of the geometry they were made for; others are reported."""
    r = views.rects(spark, sf).withColumn("hash", F.sha1(F.to_json("ring")))
    c = r.where("rect_id % 10 = 0").select("rect_id", F.when(F.col("area") > 100, F.col("hash")).otherwise("stale").alias("expected"))
    j = r.join(c, "rect_id", "left")
    return j.select("rect_id", F.when(F.col("expected").isNull(), "as-is").when(F.col("expected") == F.col("hash"), "corrected").otherwise("guard-failed").alias("state"))


# ---- strings -------------------------------------------------------------------------------------

TOWNS = ["本町一丁目", "本町１丁目", "茶屋ヶ丘十二丁目", "茶屋が丘二十丁目", "北 廣岡", "南髙﨑３丁目", "澤之町十丁目", "plain", ""]
TOWN_KEYS = ["本町1丁目", "本町1丁目", "茶屋ケ丘12丁目", "茶屋ケ丘20丁目", "北広岡", "南高崎3丁目", "沢之町10丁目", "plain", ""]


@query("q_9_01_town_key", f"SELECT c_custkey AS id, coalesce({sql_pick(TOWN_KEYS, 'c_custkey')}, '') AS key FROM customer")
def town_key(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), names.town_key(pick(TOWNS, F.col("c_custkey"))).alias("key"))


CODES = ["1001", "24003", "123456", "1234567", "A12", "", " 7 "]
PADDED = ["001001", "024003", "123456", "1234567", "A12", "", "000007"]


@query("q_9_02_padded_code", f"SELECT c_custkey AS id, {sql_pick(PADDED, 'c_custkey')} AS code FROM customer")
def padded(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), names.padded_code(pick(CODES, F.col("c_custkey"))).alias("code"))


@query("q_9_06_names_agree", """
WITH t AS (SELECT p_partkey AS id, lower(replace(p_type, ' ', '')) AS a, lower(replace(p_brand, ' ', '')) AS b, lower(split_part(p_type, ' ', 1)) AS c FROM part)
SELECT id, a = b OR (length(a) >= 3 AND length(b) >= 3 AND (contains(a, b) OR contains(b, a))) AS ab, a = c OR (length(a) >= 3 AND length(c) >= 3 AND (contains(a, c) OR contains(c, a))) AS ac FROM t""")
def agree(spark, sf):
    a, b, c = names.building_key(F.col("p_type")), names.building_key(F.col("p_brand")), names.building_key(F.split_part(F.col("p_type"), F.lit(" "), F.lit(1)))
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.names_agree(a, b).alias("ab"), names.names_agree(a, c).alias("ac"))


@query("q_9_07_core_name", "SELECT p_partkey AS id, regexp_replace(p_type, '^(STANDARD |SMALL |PROMO |ECONOMY )+', '') AS core FROM part")
def core(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.core_name(F.col("p_type"), ["STANDARD ", "SMALL ", "PROMO ", "ECONOMY "]).alias("core"))


@query("q_9_11_ward_of", f"SELECT c_custkey AS id, {sql_pick(['住吉区', '北区', '', ''], 'c_custkey')} AS ward FROM customer")
def ward(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), names.ward_of(pick(["大阪市住吉区", "大阪市北区", "堺市堺区", None], F.col("c_custkey"))).alias("ward"))


@query("q_9_13_ordered_patterns", """
SELECT p_partkey AS id, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE 'ECONOMY%' THEN 'economy' ELSE 'other' END AS operator FROM part""")
def patterns(spark, sf):
    t = F.col("p_type")
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), classify.first_rule([(t.rlike("BRASS"), "brass"), (t.rlike("STEEL"), "steel"), (t.rlike("^ECONOMY"), "economy")], "other").alias("operator"))


@query("q_9_15_stable_ids", "SELECT c_custkey AS id, 'c-' || substr(sha1('{\"name\":\"' || c_name || '\"}'), 1, 12) AS stable FROM customer")
def stable(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), names.stable_id("c-", F.col("c_name").alias("name")).alias("stable"))


# ---- geometry ------------------------------------------------------------------------------------


@query("q_10_01_projection", """
WITH g AS (SELECT c_custkey AS id, 34.6 + (c_custkey % 100) / 1000.0 AS lat, 135.5 + (c_custkey % 77) / 1000.0 AS lon FROM customer)
SELECT id, floor((lon - 135.5) * cos(radians(34.6)) * 111320 * 100 + 0.5) / 100 AS x, floor((lat - 34.6) * 111320 * 100 + 0.5) / 100 AS z FROM g""")
def projection(spark, sf):
    k = F.col("c_custkey")
    p = geo.to_local(34.6 + (k % 100) / 1000.0, 135.5 + (k % 77) / 1000.0, 34.6, 135.5)
    return read_table(spark, sf, "customer").select(k.alias("id"), p.alias("p")).select("id", "p.x", "p.z")


@query("q_10_04_haversine", """
SELECT c_custkey AS id, floor(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians((c_custkey % 100) / 1000.0) / 2), 2) + cos(radians(34.6)) * cos(radians(34.6 + (c_custkey % 100) / 1000.0)) * pow(sin(radians((c_custkey % 77) / 1000.0) / 2), 2)))) * 100 + 0.5) / 100 AS metres FROM customer""")
def haversine(spark, sf):
    k = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(k.alias("id"), half_up(geo.haversine(F.lit(34.6), F.lit(135.5), 34.6 + (k % 100) / 1000.0, 135.5 + (k % 77) / 1000.0), 2).alias("metres"))


@query("q_10_05_ring_measures", WITH + "SELECT rect_id, area, 2 * (w + h) AS perimeter, x0 + w / 2 AS cx, z0 + h / 2 AS cz, CAST(CASE WHEN w >= h THEN 0 ELSE 90 END AS DOUBLE) AS direction FROM rects WHERE w <> h")
def ring_measures(spark, sf):
    out = views.rects(spark, sf).where("w <> h").select("rect_id", ringsets.measures(F.col("ring")).alias("m"))
    return out.select("rect_id", "m.area", "m.perimeter", *(half_up(F.col(f"m.{k}"), 6).alias(k) for k in ("cx", "cz", "direction")))


@query("q_10_08_boxes", WITH + """
SELECT a.rect_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0)) AS shared, floor(coalesce(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0))
  / (a.area + b.area - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.z1, b.z1) - greatest(a.z0, b.z0))), 0) * 1e6 + 0.5) / 1e6 AS iou FROM rects a JOIN rects_b b ON a.rect_id = b.rect_id""")
def boxes(spark, sf):
    a = views.rects(spark, sf).select("rect_id", F.col("box").alias("a"))
    b = views.rects_b(spark, sf).select("rect_id", F.col("box").alias("b"))
    return a.join(b, "rect_id").select("rect_id", geo.overlap_area(F.col("a"), F.col("b")).alias("shared"), half_up(geo.box_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("q_10_22_tiles", WITH + """, t AS (SELECT rect_id, floor(x0 / 100) AS a, greatest(floor(x0 / 100), floor((x1 - 1e-9) / 100)) AS b, floor(z0 / 100) AS c, greatest(floor(z0 / 100), floor((z1 - 1e-9) / 100)) AS d FROM rects)
SELECT rect_id, CAST(a + i AS BIGINT) AS tx, CAST(c + j AS BIGINT) AS tz FROM t, (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j) WHERE a + i <= b AND c + j <= d""")
def tiles(spark, sf):
    return views.rects(spark, sf).select("rect_id", F.explode(geo.tiles_of_box(F.col("box"), 100.0)).alias("t")).select("rect_id", "t.tx", "t.tz")


@query("q_10_21_anchor", WITH + """, d AS (SELECT line_id, pos, x, z, lag(x) OVER w AS px, lag(z) OVER w AS pz FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
s AS (SELECT *, sqrt((x - px) ^ 2 + (z - pz) ^ 2) AS l FROM d), c AS (SELECT *, sum(l) OVER (PARTITION BY line_id ORDER BY pos) AS upto, sum(l) OVER (PARTITION BY line_id) AS total FROM s),
f AS (SELECT * FROM c WHERE l > 0 AND upto >= total / 2 QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY pos) = 1)
SELECT line_id, floor((px + (x - px) * (total / 2 - (upto - l)) / l) * 1000 + 0.5) / 1000 AS x, floor((pz + (z - pz) * (total / 2 - (upto - l)) / l) * 1000 + 0.5) / 1000 AS z FROM f""")
def anchor(spark, sf):
    l = views.lines(spark, sf).where(geo.path_length(F.col("points")) > 0)
    return l.select("line_id", geo.at_share(F.col("points"), 0.5).alias("p")).select("line_id", half_up(F.col("p.x"), 3).alias("x"), half_up(F.col("p.z"), 3).alias("z"))


@query("q_10_25_demographic_checks", """
WITH t AS (SELECT c_custkey AS id, c_acctbal AS population, abs(c_acctbal) * (c_custkey % 5) / 3 AS foreigners, c_custkey % 130 AS share FROM customer)
SELECT id, 'negative-population' AS issue FROM t WHERE population < 0 UNION ALL SELECT id, 'foreign-exceeds-total' FROM t WHERE foreigners > population UNION ALL SELECT id, 'percentage-out-of-range' FROM t WHERE share > 100""")
def demographic_checks(spark, sf):
    k, p = F.col("c_custkey"), F.col("c_acctbal")
    issue = lambda cond, name: F.when(cond, name)
    found = F.array_compact(F.array(issue(p < 0, "negative-population"), issue(F.abs(p) * (k % 5) / 3 > p, "foreign-exceeds-total"), issue(k % 130 > 100, "percentage-out-of-range")))
    return read_table(spark, sf, "customer").select(k.alias("id"), F.explode(found).alias("issue"))


@query("q_10_26_layer_checks", WITH + """
SELECT count(*) AS n, count(*) FILTER (WHERE type IS NULL OR type = '') AS missing, count(*) FILTER (WHERE abs(x0) > 10000 OR abs(z0) > 9000) AS outside, count(*) FILTER (WHERE abs(x0) > 10000 OR abs(z0) > 9000) < 0.5 * count(*) AS passes FROM rects""")
def layer_checks(spark, sf):
    out = (F.abs("x0") > 10000) | (F.abs("z0") > 9000)
    d = views.rects(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("type").isNull() | (F.col("type") == "")).alias("missing"), F.count_if(out).alias("outside"))
    return d.withColumn("passes", F.col("outside") < 0.5 * F.col("n"))


@query("q_10_28_json_maps", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n FROM events")
def json_maps(spark, sf):
    m = F.from_json("props", "map<string,long>")
    return read_table(spark, sf, "events").select("event_id", m["k"].alias("k"), F.size(m).cast("long").alias("n"))
