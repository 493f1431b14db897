"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quadrille.storage import stored


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: A hub's edges meet its minimum in so many parts.
SALTS = 256


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least v of its u. The minimum is pre-aggregated and goes to every salt that u's
    edges have, so a hub's edges are dealt over SALTS keys; any other u has few edges."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("salt").alias("salts"))
    return salted.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, comp) of every node with an edge to another one; comp is the component's smallest node.

    Each round is written to the shared folder. Minima are pre-aggregated, and a hub's edges do not meet in one
    task. Loops and edges with a null end are ignored; repeated edges count once."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    now = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _print_of(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Every (u, v) goes on as (v, m), and u itself as (u, m).
        small = _with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.distinct(), "edges")
        if (found := _print_of(now)) == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def labelled(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Every node with its component; a node without an edge is its own."""
    found = components(edges)
    return nodes.join(found.withColumnRenamed("node", node), node, "left").withColumn("comp", F.coalesce("comp", node))
