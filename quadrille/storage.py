"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder is set only where that is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task's input where a row means some work.
ROWS = 20_000


def dealt(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` dealt over tasks by its number of rows. Files are split by bytes, so a million short rows may be one task's."""
    n = df.count()
    return df if n <= rows else df.repartition(math.ceil(n / rows))


def tasks(df: DataFrame) -> int:
    """As many tasks as the session's shuffles have, for joins on few rows that make many pairs: left to itself, the planner
    folds such rows in few tasks by their bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
