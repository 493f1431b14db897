"""Places, shapes and records derived from the plain tables by integer arithmetic.

The same rows come out of WITH-clauses for SQL, so every query over them has a plain counterpart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.functions import geo
from quadrille.storage import dealt, read_table


def ix(key: Column) -> Column:
    return ((key * 7919) % 24001 - 12000).cast("double")


def iz(key: Column) -> Column:
    return ((key * 104729) % 20001 - 10000).cast("double")


def pts(spark: SparkSession, sf: str) -> DataFrame:
    """point_id, x, z, ward (stored), segment, balance."""
    c = read_table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("point_id"), ix(F.col("c_custkey")).alias("x"), iz(F.col("c_custkey")).alias("z"), F.col("c_nationkey").alias("ward"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def rects(spark: SparkSession, sf: str) -> DataFrame:
    """rect_id, x0, z0, x1, z1, box, ring, area: one rectangle a part."""
    p, key = read_table(spark, sf, "part"), F.col("p_partkey")
    out = p.select(key.alias("rect_id"), ix(key).alias("x0"), iz(key).alias("z0"), (5 + key % 20).cast("double").alias("w"), (5 + (key * 7) % 20).cast("double").alias("h"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("size"))
    return _shape(dealt(out))


def rects_b(spark: SparkSession, sf: str) -> DataFrame:
    """The rectangles again, moved a little; every seventh is missing."""
    key = F.col("rect_id")
    out = rects(spark, sf).where(key % 7 != 0)
    return _shape(out.select("rect_id", (F.col("x0") + key % 3 - 1).alias("x0"), (F.col("z0") + key % 2).alias("z0"), (F.col("w") + key % 2).alias("w"), "h", "type", "size"))


def _shape(df: DataFrame) -> DataFrame:
    x1, z1 = F.col("x0") + F.col("w"), F.col("z0") + F.col("h")
    box = F.struct("x0", "z0", x1.alias("x1"), z1.alias("z1"))
    return df.withColumns({"x1": x1, "z1": z1, "box": box, "ring": geo.rectangle(F.col("x0"), F.col("z0"), x1, z1), "area": F.col("w") * F.col("h")})


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """shape_id, kind, x0, z0, w, h, rings (outline and holes), ring (outline), one a part: kind 0 a rectangle, 1 an L, 2 a
    triangle, 3 a rectangle with a hole, 4 a line without an area. w is odd and h even, so no edge of a triangle meets
    the middle of a square metre."""
    key = F.col("p_partkey")
    s = dealt(read_table(spark, sf, "part").select("p_partkey")).select(key.alias("shape_id"), (key % 5).cast("int").alias("kind"), ix(key).alias("x0"), iz(key).alias("z0"), (5 + 2 * (key % 10)).cast("double").alias("w"), (6 + 2 * ((key * 7) % 10)).cast("double").alias("h"))
    at = lambda x, z: geo.point(F.col("x0") + x, F.col("z0") + z)
    w, h, none = F.col("w"), F.col("h"), F.lit(0)
    box = F.array(at(none, none), at(w, none), at(w, h), at(none, h))
    angle = F.array(at(none, none), at(w, none), at(w, F.lit(3)), at(F.lit(2), F.lit(3)), at(F.lit(2), h), at(none, h))
    flat = F.array(at(none, none), at(w, none), at(w / 2, none))
    ring = F.when(F.col("kind") == 1, angle).when(F.col("kind") == 2, F.array(at(none, none), at(w, none), at(none, h))).when(F.col("kind") == 4, flat).otherwise(box)
    hole = F.array(at(F.lit(1), F.lit(2)), at(F.lit(3), F.lit(2)), at(F.lit(3), F.lit(4)), at(F.lit(1), F.lit(4)))
    return s.withColumn("ring", ring).withColumn("rings", F.when(F.col("kind") == 3, F.array("ring", hole)).otherwise(F.array("ring")))


def wards(spark: SparkSession, sf: str) -> DataFrame:
    """ward_id, polygons: a 5 x 5 grid of nations. Ward 7 has a hole, ward 18 has one that ward 3 fills as an
    exclave, and ward 24 reaches 300 m into ward 23."""
    k = F.col("n_nationkey")
    x0, z0 = (k % 5) * 4800 - 12000, F.floor(k / 5) * 4000 - 10000
    left = F.when(k == 24, x0 - 300).otherwise(x0)
    hole = lambda: F.array(geo.rectangle(x0 + 1000, z0 + 1000, x0 + 2000, z0 + 1800))
    none = F.array().cast("array<array<struct<x:double,z:double>>>")
    main = F.struct(geo.rectangle(left, z0, x0 + 4800, z0 + 4000).alias("outer"), F.when(k.isin(7, 18), hole()).otherwise(none).alias("holes"))
    ex0, ez0 = F.lit(3 * 4800 - 12000 + 1000), F.lit(3 * 4000 - 10000 + 1000)
    exclave = F.struct(geo.rectangle(ex0, ez0, ex0 + 1000, ez0 + 800).alias("outer"), none.alias("holes"))
    return read_table(spark, sf, "nation").select(k.alias("ward_id"), F.col("n_name").alias("ward_name"), F.when(k == 3, F.array(main, exclave)).otherwise(F.array(main)).alias("polygons"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """line_id, points: the orders of a customer as a polyline, by order key; steps are short."""
    o = read_table(spark, sf, "orders")
    key, at = F.col("o_orderkey"), F.col("o_custkey")
    p = F.struct(key.alias("k"), (ix(at) + (key * 37) % 401 - 200).alias("x"), (iz(at) + (key * 53) % 301 - 150).alias("z"))
    pts_ = F.transform(F.sort_array(F.collect_list(p)), lambda s: F.struct(s["x"].alias("x"), s["z"].alias("z")))
    return o.groupBy(at.alias("line_id")).agg(pts_.alias("points"))


#: The same views for SQL; a ward's polygons are rows (ward_id, part, x0, z0, x1, z1, hole corners).
WITH = """
WITH pts AS (
  SELECT c_custkey AS point_id, CAST((c_custkey * 7919) % 24001 - 12000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 20001 - 10000 AS DOUBLE) AS z,
         c_nationkey AS ward, c_mktsegment AS segment, c_acctbal AS balance FROM customer),
rects AS (
  SELECT *, x0 + w AS x1, z0 + h AS z1, w * h AS area FROM (
    SELECT p_partkey AS rect_id, CAST((p_partkey * 7919) % 24001 - 12000 AS DOUBLE) AS x0, CAST((p_partkey * 104729) % 20001 - 10000 AS DOUBLE) AS z0,
           CAST(5 + p_partkey % 20 AS DOUBLE) AS w, CAST(5 + (p_partkey * 7) % 20 AS DOUBLE) AS h, p_type AS type, CAST(p_size AS DOUBLE) AS size FROM part)),
rects_b AS (
  SELECT *, x0 + w AS x1, z0 + h AS z1, w * h AS area FROM (
    SELECT rect_id, x0 + rect_id % 3 - 1 AS x0, z0 + rect_id % 2 AS z0, w + rect_id % 2 AS w, h, type, size FROM rects WHERE rect_id % 7 <> 0)),
ward_parts AS (
  SELECT n_nationkey AS ward_id, 0 AS part, CAST((n_nationkey % 5) * 4800 - 12000 - CASE WHEN n_nationkey = 24 THEN 300 ELSE 0 END AS DOUBLE) AS x0,
         CAST((n_nationkey // 5) * 4000 - 10000 AS DOUBLE) AS z0, CAST((n_nationkey % 5) * 4800 - 7200 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 4000 - 6000 AS DOUBLE) AS z1,
         n_nationkey IN (7, 18) AS holed, CAST((n_nationkey % 5) * 4800 - 11000 AS DOUBLE) AS hx0, CAST((n_nationkey // 5) * 4000 - 9000 AS DOUBLE) AS hz0 FROM nation
  UNION ALL SELECT 3, 1, 3400, 3000, 4400, 3800, false, 0, 0 FROM nation WHERE n_nationkey = 3),
line_points AS (
  SELECT o_custkey AS line_id, o_orderkey, CAST((o_custkey * 7919) % 24001 - 12000 + (o_orderkey * 37) % 401 - 200 AS DOUBLE) AS x,
         CAST((o_custkey * 104729) % 20001 - 10000 + (o_orderkey * 53) % 301 - 150 AS DOUBLE) AS z,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
"""

#: The shapes for SQL, and whether a place (x, z) from a shape's corner is inside.
SHAPES = """, shape AS (SELECT p_partkey AS shape_id, p_partkey % 5 AS kind, CAST((p_partkey * 7919) % 24001 - 12000 AS DOUBLE) AS x0, CAST((p_partkey * 104729) % 20001 - 10000 AS DOUBLE) AS z0,
  CAST(5 + 2 * (p_partkey % 10) AS DOUBLE) AS w, CAST(6 + 2 * ((p_partkey * 7) % 10) AS DOUBLE) AS h FROM part)
"""
IN_SHAPE = "CASE kind WHEN 0 THEN true WHEN 1 THEN x < 2 OR z < 3 WHEN 2 THEN x * h + z * w < w * h WHEN 3 THEN NOT (x >= 1 AND x < 3 AND z >= 2 AND z < 4) ELSE false END"

#: A point (x, z) inside a row of ward_parts: edges to the west and north count, holes do not.
IN_WARD = "{x} >= w.x0 AND {x} < w.x1 AND {z} >= w.z0 AND {z} < w.z1 AND NOT (w.holed AND {x} >= w.hx0 AND {x} < w.hx0 + 1000 AND {z} >= w.hz0 AND {z} < w.hz0 + 800)"


def in_ward(x: str = "p.x", z: str = "p.z") -> str:
    return IN_WARD.format(x=x, z=z)
