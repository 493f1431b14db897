"""Sinks: tiles, shards, checked overwrites, documents of features.

Every sink writes with Spark's own writers, so a task that runs again replaces only its own files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions import geo
from quadrille.storage import scratch, stored

# Kinds of values in metadata, and the fields a durable record may have.
VALUE_TYPES = ["official", "official-estimate", "calculated", "estimate"]


def write_tiles(features: DataFrame, box: str, size: float, path: str | None = None) -> str:
    """Write features to every tile their box touches, partitioned by tile; rows of a tile meet in few files, and a
    dense tile is written by several tasks."""
    path = path or scratch(features.sparkSession, "tiles")
    tiles = features.withColumn("_t", F.explode(geo.tiles_of_box(F.col(box), size))).select(*features.columns, F.col("_t.tx").alias("tx"), F.col("_t.tz").alias("tz"))
    tiles.hint("rebalance", F.col("tx"), F.col("tz")).write.partitionBy("tx", "tz").parquet(path)
    return path


def manifest(features: DataFrame, box: str, size: float) -> DataFrame:
    """One row a tile: tx, tz, n, and the bounds of what lies in it."""
    tiles = features.withColumn("_t", F.explode(geo.tiles_of_box(F.col(box), size)))
    bounds = [F.min(f"{box}.{k}").alias(k) for k in ("x0", "z0")] + [F.max(f"{box}.{k}").alias(k) for k in ("x1", "z1")]
    return tiles.groupBy(F.col("_t.tx").alias("tx"), F.col("_t.tz").alias("tz")).agg(F.count("*").alias("n"), *bounds)


def write_checked(df: DataFrame, path: str, format: str = "json") -> int:
    """Write to a staging folder beside ``path``, compare rows and content, then swap it in; a failure
    leaves the old data. Returns the number of rows. Folders cannot be swapped at once: a reader that opens ``path``
    between the two renames finds nothing and must try again; ``versions.publish`` has no such moment."""
    spark = df.sparkSession
    staged, old = f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").format(format).save(staged)
    back = spark.read.schema(df.schema).format(format).load(staged)
    look = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)")).alias("h")).first()
    wrote, found = look(df), look(back)
    if wrote != found:
        raise RuntimeError(f"read back {found}, wrote {wrote}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    fs.delete(at(old), True)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise RuntimeError(f"{path} could not be moved away")
    if not fs.rename(at(staged), at(path)):
        fs.rename(at(old), at(path))
        raise RuntimeError(f"{staged} could not be moved in")
    fs.delete(at(old), True)
    return wrote["n"]


def sync_partitions(df: DataFrame, path: str, key: str) -> DataFrame:
    """Bring a folder of parquet partitions in line with ``df``: a partition of the same content is left alone, others
    are written anew, and those that ``df`` does not have are removed. What was written is read back and must agree.
    Returns (key, action): same, written, removed."""
    spark = df.sparkSession
    columns = sorted(df.columns)
    schema = df.schema
    look = lambda d: d.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)
    new, old = look(df), look(there).select(F.col(key).alias("_k"), F.col("n").alias("_n"), F.col("h").alias("_h"))
    both = new.join(old, F.col(key).eqNullSafe(F.col("_k")), "full")
    same = F.coalesce((F.col("n") == F.col("_n")) & (F.col("h") == F.col("_h")), F.lit(False))
    action = F.when(F.col("n").isNull(), "removed").when(same, "same").otherwise("written")
    plan = stored(both.select(F.coalesce(key, "_k").alias(key), action.alias("action")), "sync")
    changed = df.join(plan.where("action = 'written'").select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    for row in plan.where("action = 'removed'").toLocalIterator():  # folder names, one a partition
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={row[key]}"), True)
    back = look(spark.read.schema(schema).parquet(path))
    if new.exceptAll(back).unionByName(back.exceptAll(new)).take(1):
        raise RuntimeError(f"{path} does not hold what was written")
    return plan


def is_date(text: Column) -> Column:
    """Whether a text is an ISO date that exists; null is none."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull(), F.lit(False))


def write_shards(df: DataFrame, key: str, required: int, path: str) -> DataFrame:
    """Write one folder a key; raises unless there are ``required`` keys. Returns (key, n), whose sum is checked."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    checked = counts.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if checked["k"] != required:
        raise ValueError(f"{checked['k']} shards, {required} are required")
    df.hint("rebalance", F.col(key)).write.mode("overwrite").partitionBy(key).parquet(path)
    if df.sparkSession.read.parquet(path).count() != checked["n"]:
        raise RuntimeError("the shards do not add up")
    return counts


def geojson(ring: Column, properties: Column) -> Column:
    """A polygon feature as GeoJSON text; the ring is closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    coordinates = F.array(F.transform(closed, lambda p: F.array(p["x"], p["z"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def with_metadata(df: DataFrame, provider: str, license: str, reference_date: str, value_type: str, *content: str) -> DataFrame:
    """Each row with a metadata struct whose checksum is the content's."""
    if value_type not in VALUE_TYPES:
        raise ValueError(f"{value_type} is no kind of value")
    fields = {"provider": provider, "license": license, "reference_date": reference_date, "value_type": value_type}
    return df.withColumn("metadata", F.struct(*(F.lit(v).alias(k) for k, v in fields.items()), F.sha2(F.to_json(F.struct(*content)), 256).alias("checksum")))


def durable(df: DataFrame, allowed: list[str], forbidden: str, id_pattern: str, id_col: str = "id") -> DataFrame:
    """Only the allowed columns; raises for another column, a value that matches ``forbidden``, or a bad id."""
    extra = [c for c in df.columns if c not in allowed]
    if extra:
        raise ValueError(f"columns that must not last: {extra}")
    bad = ~F.col(id_col).rlike(id_pattern)
    for column, kind in df.dtypes:
        if kind == "string":
            bad = bad | F.coalesce(F.col(column).rlike(forbidden), F.lit(False))
    return df.withColumn(id_col, F.when(bad, F.raise_error(F.concat(F.lit("unsafe record "), F.col(id_col)))).otherwise(F.col(id_col)))


def join_report(unmatched: DataFrame, key: str, wards_there: DataFrame, withheld: str) -> DataFrame:
    """Unmatched rows by reason: ward not acquired, suppressed, unclassified."""
    there = wards_there.select(key).distinct().withColumn("_there", F.lit(True))
    reason = F.when(F.col("_there").isNull(), "ward-not-acquired").when(F.col(withheld), "suppressed").otherwise("unclassified")
    return unmatched.join(there, key, "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
