"""Greedy decisions that depend on their order, taken in parallel rounds.

What a plain loop decides item by item is written as variables that are the AND of literals on earlier variables
("b stays if a does not"). A round decides every variable whose literals are known, and sends the literals that stand
on a variable with a single literal of its own on to that one's variable, so a chain of dependencies halves with each
round. The answer is the loop's answer; no group is one task's work, and each round's state is a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadrille.storage import scratch, stored


def settle(items: DataFrame, literals: DataFrame, rounds: int = 200, known: DataFrame | None = None) -> DataFrame:
    """(id, value) of every row of ``items`` (id): true if all its literals hold. ``literals`` (id, on, want): holds if
    the variable ``on`` comes out as ``want``; a null ``on`` never holds. Literals may stand on earlier variables only,
    of whatever order; a literal that leads back to its own variable ends in an error. ``known``: (id, value) of further
    variables, which have no literals."""
    spark, folder = items.sparkSession, scratch(items.sparkSession, "settled")
    now = stored(literals.select("id", "on", "want").distinct(), "literals")
    new = items.select("id").distinct().join(now.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("value"))
    (new if known is None else new.unionByName(known)).write.parquet(f"{folder}/0")
    new = spark.read.parquet(f"{folder}/0")
    for at in range(1, rounds):
        if now.isEmpty():
            break
        met = stored(now.join(new.select(F.col("id").alias("on"), "value"), "on", "left"), "met")
        unknown = F.col("on").isNotNull() & F.col("value").isNull()
        state = met.groupBy("id").agg(
            F.count_if(~unknown & (F.col("on").isNull() | (F.col("value") != F.col("want")))).alias("broken"), F.count_if(unknown).alias("open"), F.min(F.when(unknown, F.struct("on", "want"))).alias("one")
        )
        # A variable without an open literal is decided, and so is one with a broken literal.
        state.withColumn("value", F.when(F.col("broken") > 0, False).when(F.col("open") == 0, True)).write.parquet(f"{folder}/{at}")
        state = spark.read.parquet(f"{folder}/{at}")
        new = state.where(F.col("value").isNotNull()).select("id", "value")
        left = met.where(unknown).select("id", "on", "want").join(state.where(F.col("value").isNull()).select("id"), "id", "left_semi")
        single = state.where(F.col("value").isNull() & (F.col("open") == 1)).select(F.col("id").alias("on"), F.col("one.on").alias("to"), F.col("one.want").alias("as"))
        moved = left.join(single, "on", "left").select("id", F.coalesce("to", "on").alias("on"), F.when(F.col("to").isNull(), F.col("want")).otherwise(F.col("want") == F.col("as")).alias("want"))
        now = stored(moved.distinct(), "literals")
    else:
        raise RuntimeError(f"not settled in {rounds} rounds: literals lead in a circle")
    facts = [spark.read.parquet(f"{folder}/{i}").where(F.col("value").isNotNull()).select("id", "value") for i in range(at)]
    return reduce(DataFrame.unionByName, facts)


def _earlier_first(items: DataFrame, pairs: DataFrame, id_col: str, order: str, *columns: str) -> DataFrame:
    """Pairs (a, b) as (i, j) with i the earlier by (order, id), each once, with both sides' columns."""
    own = {s: items.select(F.col(id_col).alias(s), *(F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys((order, *columns)))) for s in "ab"}
    rows = pairs.select("a", "b").where(F.col("a") != F.col("b")).join(own["a"], "a").join(own["b"], "b")
    side = lambda s: F.struct(F.col(f"{s}_{order}").alias("ord"), F.col(s).alias("id"), *(F.col(f"{s}_{c}").alias(c) for c in columns))
    return rows.select(F.least(side("a"), side("b")).alias("i"), F.greatest(side("a"), side("b")).alias("j")).distinct()


def greedy_dedupe(items: DataFrame, pairs: DataFrame, id_col: str = "id", order: str = "ord", rank: str = "rank") -> DataFrame:
    """Items without those that lose a pair (a, b). Pairs are taken by order of the earlier item, then of the later; the
    higher rank wins, a tie keeps the earlier; a pair of which one has lost before decides nothing.

    The variable (x, k) says that x stands after the first k pairs that it may lose: it stood before the k-th, and the
    k-th one's winner had lost by then."""
    met = _earlier_first(items, pairs, id_col, order, rank)
    first_wins = F.col(f"i.{rank}") >= F.col(f"j.{rank}")
    key = F.struct(F.col("i.ord").alias("o1"), F.col("i.id").alias("i1"), F.col("j.ord").alias("o2"), F.col("j.id").alias("i2"))
    events = met.select(key.alias("key"), F.when(first_wins, F.col("i.id")).otherwise(F.col("j.id")).alias("w"), F.when(first_wins, F.col("j.id")).otherwise(F.col("i.id")).alias("x"))
    sides = events.select("key", F.explode(F.array(F.struct(F.col("x").alias("item"), F.lit(1).alias("loses")), F.struct(F.col("w").alias("item"), F.lit(0).alias("loses")))).alias("s")).select("key", "s.*")
    so_far = Window.partitionBy("item").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    told = stored(sides.select("key", "item", "loses", F.sum("loses").over(so_far).alias("k")), "events")
    loses, wins = told.where("loses = 1").select("key", "item", "k"), told.where("loses = 0").select("key", F.col("item").alias("w"), F.col("k").alias("n"))
    name = lambda x, k: F.struct(F.col(x).alias("item"), k.cast("long").alias("k"))
    variables = loses.select(name("item", F.col("k")).alias("id"))
    before = loses.where("k > 1").select(name("item", F.col("k")).alias("id"), name("item", F.col("k") - 1).alias("on"), F.lit(True).alias("want"))
    beaten = loses.join(wins, "key").select(name("item", F.col("k")).alias("id"), F.when(F.col("n") > 0, name("w", F.col("n"))).alias("on"), F.lit(False).alias("want"))
    lost = settle(variables, before.unionByName(beaten)).where("not value").select(F.col("id.item").alias(id_col)).distinct()
    return items.join(lost, id_col, "left_anti")


def drop_contained(items: DataFrame, pairs: DataFrame, id_col: str = "id", order: str = "ord", size: str = "size") -> DataFrame:
    """Items without the shorter of each pair (a, b). Items are taken by order; one that is gone by then is passed over,
    the others meet all later partners that are still there: the longer one stays, the earlier on a tie. An item that
    goes while it is taken goes on through its later partners.

    An item starts if no earlier partner of at least its size starts. One that starts goes if a longer later partner
    is still there when it is met, that is, if no item taken before removes that partner."""
    met = stored(_earlier_first(items, pairs, id_col, order, size).select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ij" for c in ("ord", "id", size))), "pairs")
    beats = F.col(f"i_{size}") >= F.col(f"j_{size}")
    starts = stored(settle(items.select(F.col(id_col).alias("id")), met.where(beats).select(F.col("j_id").alias("id"), F.col("i_id").alias("on"), F.lit(False).alias("want"))), "starts")
    runs = met.join(starts.where("value").select(F.col("id").alias("i_id")), "i_id")
    gone = runs.where(beats).groupBy("j_id").agg(F.min(F.struct("i_ord", "i_id")).alias("by"))
    still = F.col("by").isNull() | (F.col("by") > F.struct("i_ord", "i_id"))
    goes = runs.where(~beats).join(gone, "j_id", "left").where(still).select(F.col("i_id").alias("id"))
    lost = starts.where("not value").select("id").unionByName(goes).distinct().withColumnRenamed("id", id_col)
    return items.join(lost, id_col, "left_anti")


def first_apart(items: DataFrame, pairs: DataFrame, id_col: str = "id", order: str = "ord") -> DataFrame:
    """Items taken by order, those kept that are no partner of one kept before."""
    met = _earlier_first(items, pairs, id_col, order)
    kept = settle(items.select(F.col(id_col).alias("id")), met.select(F.col("j.id").alias("id"), F.col("i.id").alias("on"), F.lit(False).alias("want")))
    return items.join(kept.where("value").select(F.col("id").alias(id_col)), id_col, "left_semi")


#: So many distinct numbers are broadcast.
FEW = 1 << 20


def claims(wishes: DataFrame) -> DataFrame:
    """Rows of ``wishes`` (a, b, takes) that stand. Taken by a, which is unique: a row stands if neither a nor b is used
    up; a is used up by it, and b too if ``takes``. a and b are whole numbers below 2^62."""
    return wishes.join(standing(wishes), "a", "left_semi").select(wishes.columns)


def standing(wishes: DataFrame) -> DataFrame:
    """The a of the rows that stand (``claims``).

    The variable 2a says that a's row stands; 2a + 1, of a row that takes b, that neither it stands nor any before it that
    takes b. Only rows that ask for something that is taken by some row depend on the latter. A row without such takers
    stands if b comes after a or has no row, and does not if b's row stands for the same reason, so most rows need no round."""
    kind = dict(wishes.dtypes)["a"]
    row, free = (lambda c, by=by: (F.col(c) * 2 + by).cast(kind) for by in (0, 1))
    few = lambda df: df.hint("broadcast" if df.count() <= FEW else "merge")
    takers = wishes.where("takes").select(F.col("b").alias("x"), "a")
    taken = few(stored(takers.select("x").distinct(), "taken"))
    asks = wishes.select("a", F.explode(F.array("a", "b")).alias("x")).join(taken, "x", "left_semi")
    # For every row that asks for x, and for every taker: the last taker of x before it.
    both = takers.select("x", "a", F.lit(1).alias("takes")).unionByName(asks.select("x", "a", F.lit(0).alias("takes")))
    so_far = Window.partitionBy("x").orderBy("a", "takes").rowsBetween(Window.unboundedPreceding, -1)
    told = stored(both.select("a", "takes", F.last(F.when(F.col("takes") == 1, F.col("a")), ignorenulls=True).over(so_far).alias("last")), "takers")
    own, asked = told.where("takes = 1"), told.where("takes = 0 and last is not null")
    bound = few(stored(asked.select("a").distinct().withColumn("bound", F.lit(True)), "bound"))
    rows = wishes.select("a", "b").join(bound, "a", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
    on = rows.select(F.col("a").alias("b"), (~F.col("bound") & (F.col("b") >= F.col("a"))).alias("stands"))
    # stands: whether b's row does, if that is known so far; null without a row that comes before.
    rows = rows.where("b >= a").withColumn("stands", F.lit(None).cast("boolean")).unionByName(rows.where("b < a").join(on, "b", "left").select("a", "b", "bound", "stands"))
    rows = stored(rows, "rows")
    known = rows.where("stands or (stands is null and not bound)").select(row("a").alias("id"), F.col("stands").isNull().alias("value"))
    lit = lambda df, a, b, want: df.select(a.alias("id"), b.alias("on"), F.lit(want).alias("want"))
    still = rows.where("not stands or (stands is null and bound)")
    literals = [
        lit(own, free("a"), row("a"), False),
        lit(own.where("last is not null"), free("a"), free("last"), True),
        lit(asked.join(few(still.where("bound").select("a")), "a", "left_semi"), row("a"), free("last"), True),
        lit(still.where("not stands"), row("a"), row("b"), False),
    ]
    items = still.select(row("a").alias("id")).unionByName(own.select(free("a").alias("id")))
    found = settle(items, reduce(DataFrame.unionByName, literals), known=known).where("value")
    half = F.expr("id div 2") if kind in ("tinyint", "smallint", "int", "bigint") else (F.col("id") / 2).cast(kind)
    return found.where("id % 2 = 0").select(half.cast(kind).alias("a"))


def partners(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """(a, b) of pairs, each way of writing a pair once."""
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
