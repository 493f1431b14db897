"""Greedy decisions over near items, a prefix of their order at a time, without a row for each pair of a dense table.

An item that starts rules out later ones near it, so where items lie thick few of them start. A prefix with few pairs is
decided by rounds; the items that its starters rule out leave, and the next prefix is taken of those that are left. The
answer is the plain loop's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions import geo
from quadrille.operators.rounds import settle
from quadrille.storage import stored, tasks

#: Pairs of neighbouring cells' items that a prefix may have: so many for a row of the input, and so many at least.
PAIRS, LEAST = 8, 1 << 22


def placed(items: DataFrame, order: str, radius: float) -> DataFrame:
    """``items`` (id, x, z, ``order``, ...) with ``pos``, a number that rises with (order, id), and their cell."""
    cells = {"_cx": geo.cell(F.col("x"), radius), "_cz": geo.cell(F.col("z"), radius)}
    rows = items.repartitionByRange(tasks(items), order, "id").sortWithinPartitions(order, "id").withColumn("pos", F.monotonically_increasing_id())
    return stored(rows.withColumns(cells), "placed")


def near(first: DataFrame, second: DataFrame, radius: float, closed: bool, rule: Column, how: str = "inner") -> DataFrame:
    """Pairs of placed rows as i_ and j_ columns: of the same ``kind``, closer than ``radius`` (``closed``: or just as far
    apart), that ``rule`` takes. Rows of ``first``, the fewer ones, go to nine cells."""
    n = tasks(first)
    around = lambda v: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col(v) + d)
    left, right = (df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for s, df in (("i", first), ("j", second)))
    left = left.withColumn("i__cx", F.explode(around("i__cx"))).withColumn("i__cz", F.explode(around("i__cz")))
    left, right = (df.repartition(n, *(f"{s}_{c}" for c in ("kind", "_cx", "_cz"))) for s, df in (("i", left), ("j", right)))
    same = reduce(Column.__and__, (F.col(f"i_{c}") == F.col(f"j_{c}") for c in ("kind", "_cx", "_cz")))
    dx, dz = F.col("i_x") - F.col("j_x"), F.col("i_z") - F.col("j_z")
    apart = geo.distance(F.col("i_x"), F.col("i_z"), F.col("j_x"), F.col("j_z"))
    close = (dx * dx + dz * dz <= radius * radius * (1 + 1e-9)) & (apart <= radius if closed else apart < radius)
    return left.join(right.hint("merge"), same & close & (F.col("i_id") != F.col("j_id")) & rule, how)


def _upto(left: DataFrame, n: int, most: int) -> int | None:
    """The ``pos`` up to which the items of neighbouring cells make ``most`` pairs at most; None for all items."""
    if n * n <= most:
        return None
    shares, size = [], n / 2
    while size * size > most:
        shares.append(size / n)
        size /= 2
    bounds = sorted(set(left.approxQuantile("pos", [*shares, size / n], 1e-4)), reverse=True)
    upto = lambda k: F.col(f"n{k}")
    counts = left.groupBy("kind", "_cx", "_cz").agg(F.count("*").alias("n0"), *(F.count_if(F.col("pos") <= b).alias(f"n{k}") for k, b in enumerate(bounds, 1)))
    counts = stored(counts, "counts")
    cell = lambda c, d: (F.col(c) + d).alias(c)
    steps = counts.select("kind", cell("_cx", 0), cell("_cz", 0), *(upto(k).alias(f"m{k}") for k in range(len(bounds) + 1)))
    for c in ("_cx", "_cz"):
        steps = steps.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    sums = counts.join(steps, ["kind", "_cx", "_cz"]).agg(*(F.sum((upto(k) * F.col(f"m{k}")).cast("double")).alias(f"n{k}") for k in range(len(bounds) + 1))).first()
    fits = [k for k in range(len(bounds) + 1) if (sums[f"n{k}"] or 0) <= most]
    return None if fits[:1] == [0] else int(bounds[(fits[0] if fits else len(bounds)) - 1])


def starters(rows: DataFrame, radius: float, closed: bool = False, beats: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(starters, lost) of ``placed`` rows with a ``kind`` (null: near nothing): ``pos`` of the items that no earlier starter
    near them ``beats`` (i_ the starter, j_ the item; all do if it is not given), and the others' ``pos`` with that of
    the first starter that beats them, ``by``."""
    beats = F.lit(True) if beats is None else beats
    earlier = (F.col("i_pos") < F.col("j_pos")) & beats
    left, n, told = rows, rows.count(), []
    most = max(PAIRS * n, LEAST)
    while True:
        last = _upto(left, n, most)
        batch = left if last is None else left.where(F.col("pos") <= last)
        literals = near(batch, batch, radius, closed, earlier).select(F.col("j_pos").alias("id"), F.col("i_pos").alias("on"), F.lit(False).alias("want"))
        new = stored(settle(batch.select(F.col("pos").alias("id")), literals).where("value").select(F.col("id").alias("pos")), "starters")
        lost = near(batch.join(new, "pos", "left_semi"), left, radius, closed, earlier).groupBy(F.col("j_pos").alias("pos")).agg(F.min("i_pos").alias("by"))
        told.append((new, stored(lost, "lost")))
        if last is None:
            break
        left = stored(left.where(F.col("pos") > last).join(told[-1][1], "pos", "left_anti"), "left")
        if not (n := left.count()):
            break
    return tuple(reduce(DataFrame.unionByName, part) for part in zip(*told))
