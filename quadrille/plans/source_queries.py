"""Readers and sinks of the inventory: files written from the plain tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille.plans import views
from quadrille.plans.registry import query
from quadrille.plans.views import WITH
from quadrille.sources import files, sinks, versions
from quadrille.storage import read_table, scratch


def _text(lines: DataFrame, label: str) -> str:
    """Write a text column as lines."""
    path = scratch(lines.sparkSession, label)
    lines.write.text(path)
    return path


@query("q_1_05_csv_cells", "SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name || ',\"q\"' AS name, '' AS blank FROM supplier")
def csv_cells(spark, sf):
    s, path = read_table(spark, sf, "supplier"), scratch(spark, "csv")
    s.select("s_suppkey", F.concat("s_name", F.lit(',"q"')), F.lit(None).cast("string")).write.csv(path, quote='"', escape='"', emptyValue="")
    c = F.col("cells")
    return files.read_csv_cells(spark, path).select(c[0].alias("k"), c[1].alias("name"), c[2].alias("blank"))


@query("q_1_07_elements", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def elements(spark, sf):
    """One document a region, each with its elements."""
    n = read_table(spark, sf, "nation")
    e = F.struct(F.lit("node").alias("type"), F.col("n_nationkey").cast("long").alias("id"), F.create_map(F.lit("name"), F.col("n_name")).alias("tags"))
    docs = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(e).alias("elements"))).alias("value"))
    path = scratch(spark, "elements")
    docs.select("value").repartition(5).write.text(path)
    lines = spark.read.text(path).withColumn("e", F.explode(F.from_json("value", "struct<elements:array<struct<id:int,tags:map<string,string>>>>")["elements"]))
    return lines.select("e.id", F.col("e.tags")["name"].alias("name"))


@query("q_1_09_feature_lines", "SELECT p_partkey AS k, p_name AS name FROM part")
def feature_lines(spark, sf):
    p = read_table(spark, sf, "part")
    line = F.concat(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")).alias("properties"))), F.lit(","))
    path = _text(p.select(line.alias("value")), "features")
    return files.read_feature_lines(spark, path, "type string, properties struct<k:bigint,name:string>").select("properties.k", "properties.name")


@query("q_1_10_json_lines", "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM part GROUP BY 1")
def json_lines(spark, sf):
    p, k = read_table(spark, sf, "part"), F.col("p_partkey")
    path = _text(p.select(F.when(k % 7 == 0, F.concat(F.lit('{"id": '), k)).otherwise(F.to_json(F.struct(k.alias("id")))).alias("value")), "lines")
    good, bad = files.read_json_lines(spark, path, "id long")
    return good.select(F.lit("good").alias("kind")).unionByName(bad.select(F.lit("bad").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("q_1_12_city_buildings", """
SELECT 'b' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN (p_size % 9 + 1) * 3.0::DOUBLE ELSE 3.0::DOUBLE END AS height, p_partkey % 2 = 0 AS has_ring FROM part""")
def city_buildings(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    ring = F.lit("<bldg:lod0FootPrint><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>34 135 0 34 136 0 35 136 0 34 135 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0FootPrint>")
    body = F.when(k % 3 == 0, F.concat(F.lit("<bldg:measuredHeight>"), size, F.lit("</bldg:measuredHeight>"))).when(k % 3 == 1, F.concat(F.lit("<bldg:storeysAboveGround>"), size % 9 + 1, F.lit("</bldg:storeysAboveGround>"))).otherwise("<bldg:usage>x</bldg:usage>")
    line = F.concat(F.lit('<bldg:Building gml:id="b'), k, F.lit('">'), body, F.when(k % 2 == 0, ring).otherwise(""), F.lit("</bldg:Building>"))
    rows = read_table(spark, sf, "part").select(F.floor(k / 500).alias("file"), line.alias("value"))
    document = F.concat(F.lit('<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g">'), F.array_join(F.collect_list("value"), ""), F.lit("</core:CityModel>"))
    path = scratch(spark, "gml")
    rows.groupBy("file").agg(document.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return files.read_buildings(spark, path).select("id", "height", F.col("ring").isNotNull().alias("has_ring"))


@query("q_1_18_area_codes", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN substr(lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '0'), 1, 5) END AS municipality, CASE WHEN c_custkey % 5 <> 0 THEN substr(lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '0'), 6, 6) END AS town FROM customer""")
def area_codes(spark, sf):
    k = F.col("c_custkey")
    c = read_table(spark, sf, "customer").select(k.alias("id"), F.when(k % 5 == 0, F.concat(F.lit("x"), k)).otherwise(F.lpad((k * 7919).cast("string"), 11, "0")).alias("KEY_CODE"))
    return c.select("id", files.small_area_code().alias("a")).select("id", "a.municipality", "a.town")


@query("q_1_17_admin_areas", "SELECT n_nationkey AS ward_id, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END AS parts FROM nation WHERE n_nationkey % 7 <> 3")
def admin_areas(spark, sf):
    """Features by code and name: some wards come in two parts, some have a wrong name."""
    n, k = read_table(spark, sf, "nation"), F.col("n_nationkey")
    registry = n.select(k.alias("ward_id"), F.col("n_name").alias("name"), k.cast("string").alias("code"))
    outer = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in ((0, 0), (1, 0), (1, 1))))
    features = n.select(k.cast("string").alias("code"), F.when(k % 7 == 3, F.lit("other")).otherwise(F.col("n_name")).alias("name"), outer.alias("outer"), F.explode(F.sequence(F.lit(1), F.when(k % 4 == 0, 2).otherwise(1))).alias("i")).drop("i")
    areas, _, _ = files.ingest_areas(features, registry)
    return areas.select("ward_id", F.size("polygons").alias("parts"))


@query("q_2_01_checked_write", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier")
def checked_write(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    """Published twice: readers see one version or the other, by the table's log."""
    path = scratch(spark, "checked")
    versions.publish(s.limit(1), path)
    versions.publish(s, path)
    return versions.current(spark, path, s.schema)


@query("q_2_03_tile_manifest", WITH + """, t AS (SELECT r.*, CAST(floor(x0 / 2000) AS BIGINT) AS tx, CAST(floor(z0 / 2000) AS BIGINT) AS tz FROM rects r WHERE floor(x0 / 2000) = floor((x1 - 1e-9) / 2000) AND floor(z0 / 2000) = floor((z1 - 1e-9) / 2000))
SELECT tx, tz, count(*) AS n, min(x0) AS x0, max(z1) AS z1 FROM t GROUP BY 1, 2""")
def tile_manifest(spark, sf):
    from quadrille.functions import geo

    r = views.rects(spark, sf).where(F.size(geo.tiles_of_box(F.col("box"), 2000.0)) == 1).select("rect_id", "box")
    return sinks.manifest(r, "box", 2000.0).select("tx", "tz", "n", "x0", "z1")


@query("q_2_06_shards", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1")
def shards(spark, sf):
    n = read_table(spark, sf, "nation").withColumnRenamed("n_regionkey", "k")
    return sinks.write_shards(n, "k", 5, scratch(spark, "shards")).select("k", "n")


@query("q_2_07_geojson", WITH + "SELECT rect_id, CAST(5 AS INT) AS corners, x0 AS first_x FROM rects")
def geojson(spark, sf):
    g = views.rects(spark, sf).select("rect_id", sinks.geojson(F.col("ring"), F.struct("rect_id")).alias("g"))
    c = F.from_json(F.get_json_object("g", "$.geometry.coordinates"), "array<array<array<double>>>")[0]
    return g.select("rect_id", F.size(c).alias("corners"), c[0][0].alias("first_x"))


@query("q_2_08_join_report", """
SELECT CASE WHEN c_nationkey NOT IN (SELECT s_nationkey FROM supplier) THEN 'ward-not-acquired' WHEN c_custkey % 3 = 0 THEN 'suppressed' ELSE 'unclassified' END AS reason, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1""")
def join_report(spark, sf):
    u = read_table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("ward"), (F.col("c_custkey") % 3 == 0).alias("withheld"))
    there = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("ward")).distinct()
    return sinks.join_report(u, "ward", there, "withheld")


@query("q_2_10_durable_records", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def durable(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return sinks.durable(s, ["id", "name"], "(?i)api_?key|token=", "^[0-9]+$")
