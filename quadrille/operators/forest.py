"""Least spanning forests of parts in the plane, by rounds of Boruvka's method.

A part is a few points; the distance of two parts is that of their nearest points. In each round every component takes
its least edge to another one, and the edges taken are contracted. The search for that edge is by cells: with all
parts nearer than ``merged`` already joined, a cell of a diagonal below ``merged`` holds one component only, so pairs
of cells within reach are few, their boxes bound the edge from both sides, and only points of cells that may hold it
meet. Where no component has an edge within reach, the reach grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.operators.folds import chain_edges
from quadrille.operators.graph import components
from quadrille.storage import scratch, stored

#: The reach over ``merged``, and a cell's sides to the reach: 2/3 of ``merged``, so that its diagonal is below it.
GROWTH, FINE = 4, 6


def _square(x: Column) -> Column:
    return x * x


def _apart(lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(lo2) - F.col(hi1), F.col(lo1) - F.col(hi2))


def _least_edges(points: DataFrame, reach: float) -> DataFrame:
    """(comp, edge) of every component with another one of its group within ``reach``: edge is struct<d2, hi, lo>, the
    least of its edges. ``points``: grp, comp, part, x, z."""
    side = reach / FINE
    own = points.withColumns({"cx": F.floor(F.col("x") / side), "cz": F.floor(F.col("z") / side)})
    bounds = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "z")]
    boxes = stored(own.groupBy("grp", "comp", "cx", "cz").agg(*bounds), "boxes")
    names = [c for c in boxes.columns if c != "grp"]
    coarse = lambda c: F.floor(F.col(c) / FINE)
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    left = boxes.select("grp", *(F.col(c).alias(f"a_{c}") for c in names)).withColumn("kx", F.explode(F.transform(around, lambda d: coarse("a_cx") + d))).withColumn("kz", F.explode(F.transform(around, lambda d: coarse("a_cz") + d)))
    right = boxes.select("grp", *(F.col(c).alias(f"b_{c}") for c in names)).withColumn("kx", coarse("b_cx")).withColumn("kz", coarse("b_cz"))
    pairs = left.join(right, ["grp", "kx", "kz"]).where(F.col("a_comp") != F.col("b_comp"))
    near = _square(_apart("a_min_x", "a_max_x", "b_min_x", "b_max_x")) + _square(_apart("a_min_z", "a_max_z", "b_min_z", "b_max_z"))
    far = _square(F.greatest(F.col("a_max_x"), F.col("b_max_x")) - F.least("a_min_x", "b_min_x")) + _square(F.greatest(F.col("a_max_z"), F.col("b_max_z")) - F.least("a_min_z", "b_min_z"))
    pairs = pairs.withColumns({"near": near, "far": far}).where(F.col("near") <= reach * reach)
    pairs = stored(pairs.select("grp", "a_comp", "a_cx", "a_cz", "b_comp", "b_cx", "b_cz", "near", "far"), "box-pairs")
    bound = pairs.groupBy("a_comp").agg(F.min("far").alias("bound"))
    kept = pairs.join(bound, "a_comp").where(F.col("near") <= F.col("bound")).drop("near", "far")
    at = lambda s: own.select("grp", F.col("comp").alias(f"{s}_comp"), F.col("cx").alias(f"{s}_cx"), F.col("cz").alias(f"{s}_cz"), F.col("part").alias(s), F.col("x").alias(f"{s}x"), F.col("z").alias(f"{s}z"))
    met = kept.join(at("a"), ["grp", "a_comp", "a_cx", "a_cz"]).join(at("b"), ["grp", "b_comp", "b_cx", "b_cz"])
    d2 = _square(F.col("ax") - F.col("bx")) + _square(F.col("az") - F.col("bz"))
    edge = F.struct(d2.alias("d2"), F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    return met.where(d2 <= reach * reach).groupBy("grp", F.col("a_comp").alias("comp")).agg(F.min(edge).alias("edge"))


def touching(points: DataFrame, radius: float) -> DataFrame:
    """(grp, part, comp): parts of a group that points within ``radius`` chain together; comp is the least part."""
    edges = chain_edges(points.where("grp is not null").withColumnRenamed("part", "id"), radius, ["grp"], closed=True)
    found = components(edges).withColumnRenamed("node", "part")
    return points.select("grp", "part").distinct().join(found, "part", "left").withColumn("comp", F.coalesce("comp", "part"))


def spanning_forest(points: DataFrame, labels: DataFrame, merged: float) -> DataFrame:
    """(grp, a, b, d2): the least edges that join the components of each group into one, a < b, d2 the square of
    their length; of edges of one length, that with the lesser (b, a).

    ``points``: grp, part, x, z, a part in one group only; ``labels``: grp, part, comp, in which all parts of a group
    nearer than ``merged`` have one comp. Points without a place and groups without a name take no part."""
    if merged <= 0:
        raise ValueError("parts are joined from a distance above 0 on")
    spark, folder, at = points.sparkSession, scratch(points.sparkSession, "forest"), 0
    whole = points.where("grp is not null and x is not null and z is not null").select("grp", "part", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))
    now = stored(whole.join(labels.select("part", "comp"), "part"), "forest-points")
    schema = f"grp {dict(points.dtypes)['grp']}, a {dict(points.dtypes)['part']}, b {dict(points.dtypes)['part']}, d2 double"
    while True:
        apart = now.groupBy("grp").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
        now = stored(now.join(apart.select("grp"), "grp", "left_semi"), "forest-points")
        if now.isEmpty():
            break
        reach = merged * GROWTH
        taken = stored(_least_edges(now, reach), "edges")
        if taken.isEmpty():
            merged = reach
            continue
        edges = taken.select("grp", F.col("edge.lo").alias("a"), F.col("edge.hi").alias("b"), F.col("edge.d2").alias("d2")).distinct()
        edges.write.parquet(f"{folder}/{at}")
        at += 1
        of = now.select("part", "comp").distinct()
        joined = edges.join(of.withColumnRenamed("part", "a").withColumnRenamed("comp", "ca"), "a").join(of.withColumnRenamed("part", "b").withColumnRenamed("comp", "cb"), "b")
        merge = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        now = stored(now.join(merge, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to"), "forest-points")
    return spark.read.schema(schema).parquet(f"{folder}/*") if at else spark.createDataFrame([], schema)
