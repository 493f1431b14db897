"""Sums over near rows without a row for each pair: a cell's rows meet those around them as numpy blocks in a task.

Pairs within a fixed radius grow with the square of the density. Here they are only ever bits of a block of bounded
size, so what is shuffled and written grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions import geo
from quadrille.storage import stored, tasks

#: Pairs of a block.
BLOCK = 1 << 20

#: Cells along a side of a block of cells.
BLOCK_CELLS = 4

Fold = Callable[[pd.DataFrame, pd.DataFrame, Iterator[tuple[slice, np.ndarray]]], pd.DataFrame]


def within(dx: np.ndarray, dz: np.ndarray, radius: float) -> np.ndarray:
    """Which of many steps are at most ``radius`` long."""
    square = radius * radius
    far = dx * dx + dz * dz
    near = far <= square
    edge = np.nonzero(np.abs(far - square) <= 1e-9 * square)  # there the distance itself decides, as in ``near_pairs``
    near[edge] = np.hypot(dx[edge], dz[edge]) <= radius
    return near


def blocks(left: pd.DataFrame, right: pd.DataFrame, radius: float) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of ``left``, which of ``right`` are within ``radius`` of each of them and are no rows of the same ``id``)."""
    lx, lz, rx, rz = (df[c].to_numpy(np.float64) for df in (left, right) for c in ("x", "z"))
    code, _ = pd.factorize(pd.concat([left["id"], right["id"]], ignore_index=True))
    own, other = code[: len(left)], code[len(left) :]
    step = max(1, BLOCK // max(1, len(right)))
    for i in range(0, len(left), step):
        rows = slice(i, i + step)
        near = within(lx[rows, None] - rx, lz[rows, None] - rz, radius)
        near &= own[rows, None] != other
        yield rows, near


def near_fold(left: DataFrame, right: DataFrame, radius: float, fold: Fold, schema: str) -> DataFrame:
    """``fold`` of the rows of each cell of ``left`` (id, x, z, ...) and all rows of ``right`` (id, x, z, ...) around it. Cells
    are as wide as the radius; ``right`` goes to the nine around its own."""
    n = tasks(left)
    around = lambda v: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: geo.cell(F.col(v), radius) + d)
    a = left.withColumns({"_cx": geo.cell(F.col("x"), radius), "_cz": geo.cell(F.col("z"), radius)}).repartition(n, "_cx", "_cz")
    b = right.withColumn("_cx", F.explode(around("x"))).withColumn("_cz", F.explode(around("z"))).repartition(n, "_cx", "_cz")

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return fold(one, two, blocks(one, two, radius))

    return stored(a.groupBy("_cx", "_cz").cogroup(b.groupBy("_cx", "_cz")).applyInPandas(run, schema), "fold")  # joins with ``points`` may follow


def cell_fold(left: DataFrame, right: DataFrame, size: float, fold: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, within: list[str] | None = None) -> DataFrame:
    """``fold`` of the rows of both sides, with the same columns ``within``, in each cell that the ``box`` of some touches; a
    row goes to all cells of its box, and a row without a place to none."""
    n, by = tasks(left), [*(within or []), "_cx", "_cz"]

    def spread(df: DataFrame) -> DataFrame:
        out = df.withColumn("_c", F.explode(geo.cells_of_box(F.col("box"), size))).withColumns({"_cx": F.col("_c.cx"), "_cz": F.col("_c.cz")})
        return out.drop("_c", "box").repartition(n, *by).groupBy(*by)

    return stored(spread(left).cogroup(spread(right)).applyInPandas(fold, schema), "fold")


def _starts(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted column, and where each begins."""
    distinct, starts = np.unique(values.to_numpy(), return_index=True)
    return distinct, starts


#: Squares are halved until one holds so many lines, or so often at most.
LEAF, DEPTH = 8, 20


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, number) of all whole numbers of many ranges, in order."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) + np.repeat(low - (np.cumsum(n) - n), n)


def _spread_bits(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


class _Squares:
    """Lines (first_x, first_z, last_x, last_z) by the square of their first end: one square, its quarters, theirs, and so on;
    a level's squares are runs of ``rows``. ``boxes``: the least and the greatest of a square's four columns."""

    def __init__(self, lines: np.ndarray, corner: np.ndarray, side: float) -> None:
        at = np.clip((lines[:, :2] - corner) / side * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)
        self.code = (_spread_bits(at[:, 0]) << np.uint64(1)) | _spread_bits(at[:, 1])
        self.rows = np.argsort(self.code, kind="stable")
        self.code, self.lines = self.code[self.rows], lines[self.rows]

    def starts(self, level: int) -> np.ndarray:
        code = self.code >> np.uint64(2 * (DEPTH - level))
        return np.flatnonzero(np.r_[True, code[1:] != code[:-1]])

    def cut(self, depth: int) -> None:
        first = [self.starts(level) for level in range(depth + 1)]
        self.first = [(a, np.r_[a[1:], len(self.rows)]) for a in first]
        self.inner = [np.searchsorted(below, (a, b)) for (a, b), below in zip(self.first, first[1:])]
        self.boxes = [(np.minimum.reduceat(self.lines, a), np.maximum.reduceat(self.lines, a)) for a in first]


def count_near(asked: np.ndarray, lines: np.ndarray, radius: float) -> np.ndarray:
    """How many of ``lines`` have an end within ``radius`` of an end of each of ``asked``; rows are first_x, first_z, last_x, last_z.

    Squares of the one meet squares of the other: where an end of all lines of both is near, they are counted at once, where
    none is near, they are left, and only the others are cut in four, down to few lines. So what is looked at line by line
    is what lies about a radius away. Lines whose ends are far apart are taken by themselves, as they widen a square's boxes."""
    n = np.zeros(len(asked), np.int64)
    far = [np.hypot(v[:, 0] - v[:, 2], v[:, 1] - v[:, 3]) > radius / 2 for v in (asked, lines)]
    for own in (far[0], ~far[0]):
        n[own] = sum(_count_near(asked[own], lines[other], radius) for other in (far[1], ~far[1]))
    return n


def _count_near(asked: np.ndarray, lines: np.ndarray, radius: float) -> np.ndarray:
    n = np.zeros(len(asked), np.int64)
    if not len(asked) or not len(lines):
        return n
    corner = np.minimum(asked[:, :2].min(axis=0), lines[:, :2].min(axis=0))
    side = float(max((np.maximum(asked[:, :2].max(axis=0), lines[:, :2].max(axis=0)) - corner).max(), radius)) * (1 + 1e-9)
    a, b = _Squares(asked, corner, side), _Squares(lines, corner, side)
    depth = 0
    while depth < DEPTH:
        size = np.diff(np.r_[b.starts(depth), len(lines)])
        if (size * size).sum() <= LEAF * len(lines):
            break
        depth += 1
    a.cut(depth)
    b.cut(depth)
    counts, square = [np.zeros(len(f[0]), np.int64) for f in a.first], radius * radius
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        (a_low, a_high), (b_low, b_high) = ([v[k] for v in s.boxes[level]] for s, k in ((a, i), (b, j)))
        every, none = np.zeros(len(i), bool), np.ones(len(i), bool)
        for e in (0, 2):
            for f in (0, 2):
                most = least = 0.0
                for c in (0, 1):
                    up, down = b_high[:, f + c] - a_low[:, e + c], a_high[:, e + c] - b_low[:, f + c]
                    most = most + np.maximum(up, down) ** 2
                    least = least + np.maximum(np.maximum(-up, -down), 0.0) ** 2
                every |= most <= square * (1 - 1e-9)
                none &= least > square * (1 + 1e-9)
        sizes = b.first[level][1] - b.first[level][0]
        np.add.at(counts[level], i[every], sizes[j[every]])
        left = ~(every | none)
        i, j = i[left], j[left]
        parts = a.inner[level] if level < depth else a.first[level], b.inner[level] if level < depth else b.first[level]
        wide = parts[1][1][j] - parts[1][0][j]
        work, at = np.cumsum((parts[0][1][i] - parts[0][0][i]) * wide), 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + BLOCK, "right")))
            pair, own = ranges(parts[0][0][i[at:to]], parts[0][1][i[at:to]])
            row, other = ranges(parts[1][0][j[at:to]][pair], parts[1][1][j[at:to]][pair])
            own = own[row]
            at = to
            if level < depth:
                todo.append((level + 1, own, other))
                continue
            near = np.zeros(len(own), bool)
            for e in (0, 2):
                for f in (0, 2):
                    k = np.flatnonzero(~near)
                    p, q = own[k], other[k]
                    near[k] = within(a.lines[p, e] - b.lines[q, f], a.lines[p, e + 1] - b.lines[q, f + 1], radius)
            n += np.bincount(own[near], minlength=len(n))
    for (first, last), found in zip(a.first, counts):
        n += np.repeat(found, last - first)
    out = np.empty(len(n), np.int64)
    out[a.rows] = n
    return out


def near_lines(lines: DataFrame, radius: float, group: str) -> DataFrame:
    """(id, n): how many other lines of its group have an end within ``radius`` of an end of a line; one without any is left
    out. ``lines``: group, id, first, last (struct<x, z>). Lines are counted in the cell of both ends; where these are two, near
    the first end, and others near the last."""
    size = 4 * radius
    ends = lambda df: df.select(group, "id", *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("x", "z")))
    box = lambda e, by: F.struct(*((F.col(f"{e}_{c}") + (by if k else -by)).alias(f"{c}{k}") for c in ("x", "z") for k in (0, 1)))
    same = reduce(Column.__and__, (geo.cell(F.col(f"first_{c}"), size) == geo.cell(F.col(f"last_{c}"), size) for c in ("x", "z")))
    way = lambda i, e: F.struct(F.lit(i).alias("way"), box(e, 0.0).alias("box"))
    left = ends(lines).select("*", F.inline(F.when(same, F.array(way(2, "first"))).otherwise(F.array(way(0, "first"), way(1, "last")))))
    right = ends(lines).select("*", F.explode(F.array(box("first", radius), box("last", radius))).alias("box"))
    kinds, columns = dict(lines.dtypes), ["first_x", "first_z", "last_x", "last_z"]

    def places(df: pd.DataFrame) -> np.ndarray:
        """A line that lacks an end has the other one twice."""
        p = df[columns].to_numpy(np.float64, copy=True)
        for e, f in ((slice(0, 2), slice(2, 4)), (slice(2, 4), slice(0, 2))):
            lacks = np.isnan(p[:, e]).any(axis=1)
            p[lacks, e] = p[lacks, f]
        return p

    def fold(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(one), np.int64)
        if len(one) and len(two):
            two = two.drop_duplicates("id")
            code, _ = pd.factorize(pd.concat([one["id"], two["id"]], ignore_index=True))
            where = np.full(code.max() + 1, -1)
            where[code[len(one) :]] = np.arange(len(two))
            a, b, kind, own = places(one), places(two), one["way"].to_numpy(), where[code[: len(one)]]

            def count(rows: np.ndarray, columns: list[int]) -> np.ndarray:
                """Lines other than the row's own."""
                p = a[rows][:, columns]
                q = b[own[rows]]
                itself = np.zeros(len(rows), bool)
                for e in (0, 2):
                    for f in (0, 2):
                        itself |= within(p[:, e] - q[:, f], p[:, e + 1] - q[:, f + 1], radius)
                return count_near(p, b, radius) - (itself & (own[rows] >= 0))

            first, last, both = (np.flatnonzero(kind == k) for k in (0, 1, 2))
            n[first], n[both] = count(first, [0, 1, 0, 1]), count(both, [0, 1, 2, 3])
            n[last] = count(last, [0, 1, 2, 3])
            more = last[one[["first_x", "first_z"]].notna().all(axis=1).to_numpy()[last]]
            n[more] -= count(more, [0, 1, 0, 1])
        return pd.DataFrame({"id": one["id"], "n": n})[n > 0]

    found = cell_fold(left, right, size, fold, f"id {kinds['id']}, n long", [group])
    return found.groupBy("id").agg(F.sum("n").alias("n"))


#: The points of a key are dealt over so many groups, each with all targets of the key.
SALTS = 8


def two_nearest(points: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(point_id, target_id, dist): the two nearest targets (target_id, tx, tz) of each point (point_id, x, z) with its
    columns ``by``, of all distances; the smaller id on a tie. One row where there is only one target."""
    n, group = tasks(points), [*by, "_salt"]
    kind = {**dict(targets.dtypes), **dict(points.dtypes)}
    left = points.select(*by, "point_id", "x", "z").withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.lit(SALTS)).cast("int"))
    right = targets.select(*by, "target_id", "tx", "tz").withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    known = lambda df: df.where(" and ".join(f"{c} is not null" for c in by)).repartition(n, *group).groupBy(*group)

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"point_id": one["point_id"][:0], "target_id": two["target_id"][:0], "dist": []})]
        if len(one) and len(two):
            two = two.sort_values("target_id", ignore_index=True)
            x, z, tx, tz = (v.to_numpy(np.float64) for v in (one["x"], one["z"], two["tx"], two["tz"]))
            names, targets_, step = one["point_id"].to_numpy(), two["target_id"].to_numpy(), max(1, BLOCK // len(two))
            for i in range(0, len(one), step):
                at = slice(i, i + step)
                far = np.hypot(x[at, None] - tx, z[at, None] - tz)
                rows = np.arange(len(far))
                for _ in range(min(2, len(two))):
                    best = far.argmin(axis=1)
                    out.append(pd.DataFrame({"point_id": names[at], "target_id": targets_[best], "dist": far[rows, best]}))
                    far[rows, best] = np.inf
        return pd.concat(out[1:] or out)

    return stored(known(left).cogroup(known(right)).applyInPandas(run, f"point_id {kind['point_id']}, target_id {kind['target_id']}, dist double"), "fold")


def nearest_of(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(point_id, n, target_id, dist): how many targets (target_id, tx, tz) are within ``radius`` of a point (point_id, x, z),
    and the nearest one, the smaller id on a tie; a point without any is left out."""
    kind = {**dict(targets.dtypes), **dict(points.dtypes)}
    box = lambda x, z, by: F.struct(*((F.col(c) + (by if k else -by)).alias(f"{name}{k}") for name, c in (("x", x), ("z", z)) for k in (0, 1)))

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"point_id": one["point_id"][:0], "n": [], "target_id": two["target_id"][:0], "dist": []})]
        if len(one) and len(two):
            two = two.sort_values("target_id", ignore_index=True)
            x, z, tx, tz = (v.to_numpy(np.float64) for v in (one["x"], one["z"], two["tx"], two["tz"]))
            names, targets_, step = one["point_id"].to_numpy(), two["target_id"].to_numpy(), max(1, BLOCK // len(two))
            for i in range(0, len(one), step):
                at = slice(i, i + step)
                far = np.hypot(x[at, None] - tx, z[at, None] - tz)
                n, best = (far <= radius).sum(axis=1), far.argmin(axis=1)
                part = pd.DataFrame({"point_id": names[at], "n": n, "target_id": targets_[best], "dist": far[np.arange(len(far)), best]})
                out.append(part[n > 0])
        return pd.concat(out[1:] or out)

    left = points.select("point_id", "x", "z", box("x", "z", 0.0).alias("box"))
    right = targets.select("target_id", "tx", "tz", box("tx", "tz", radius).alias("box"))
    return cell_fold(left, right, radius, run, f"point_id {kind['point_id']}, n long, target_id {kind['target_id']}, dist double")


def near_medians(points: DataFrame, value: str, radius: float) -> DataFrame:
    """(id, m, c): the median of ``value`` (no null) over the other points within ``radius``, and their number; a point
    without any is left out. ``points``: id, x, z; a row that is there k times counts its near ones k times."""
    rows = points.select("id", "x", "z", F.col(value).cast("double").alias("v"))

    def fold(left: pd.DataFrame, right: pd.DataFrame, near: Iterator) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": left["id"][:0], "m": [], "c": []})
        right.sort_values("v", inplace=True, ignore_index=True)
        distinct, starts = _starts(right["v"])
        c, m = np.zeros(len(left), np.int64), np.zeros(len(left))
        for at, mask in near:
            upto = np.add.reduceat(mask, starts, axis=1, dtype=np.int32).cumsum(axis=1)
            n = c[at] = upto[:, -1]
            low, high = ((upto > k[:, None]).argmax(axis=1) for k in ((n - 1) // 2, n // 2))
            m[at] = (distinct[low] + distinct[high]) / 2
        return pd.DataFrame({"id": left["id"], "m": m, "c": c * left["times"]})[c > 0]

    # ``blocks`` reads ``right`` when the first block is asked for, so it is sorted by then.
    left = rows.groupBy("id", "x", "z").agg(F.count("*").alias("times"))
    return near_fold(left, rows, radius, fold, f"id {dict(rows.dtypes)['id']}, m double, c long")


def near_kinds(points: DataFrame, kind: str, radius: float) -> DataFrame:
    """(id, n): how many values of ``kind`` (null: none) the other points within ``radius`` have. ``points``: id, x, z."""
    rows = points.select("id", "x", "z", F.col(kind).alias("k"))

    def fold(left: pd.DataFrame, right: pd.DataFrame, near: Iterator) -> pd.DataFrame:
        n = np.zeros(len(left), np.int64)
        if len(left) and len(right):
            right["k"], _ = pd.factorize(right["k"])
            right.sort_values("k", inplace=True, ignore_index=True)
            _, starts = _starts(right["k"])
            for at, mask in near:
                n[at] = np.logical_or.reduceat(mask, starts, axis=1).sum(axis=1)
        return pd.DataFrame({"id": left["id"], "n": n})

    return near_fold(rows.select("id", "x", "z").distinct(), rows.where("k is not null"), radius, fold, f"id {dict(rows.dtypes)['id']}, n long")


def chain_edges(points: DataFrame, radius: float, within: list[str] | None = None, closed: bool = False) -> DataFrame:
    """(a, b) that connect what pairs of points (id, x, z) closer than ``radius`` (``closed``: or just as far apart) connect,
    of points with the same columns ``within``. Cells have a diagonal below the radius, so a cell's points all go to its
    least one; of two cells whose points come close, one pair is enough."""
    side = radius / 1.5
    by = [*(within or []), "_cx", "_cz"]
    at = {"_cx": geo.cell(F.col("x"), side), "_cz": geo.cell(F.col("z"), side)}
    rows = points.select(*(within or []), "id", "x", "z").withColumns(at)
    least = rows.groupBy(*by).agg(F.min("id").alias("least"))
    own = rows.join(least.hint("merge"), by).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    # Each pair of cells is looked at once: a cell meets those after it, two cells away at most. A task's group is a block of
    # cells; rows go to the blocks of all cells that they are after.
    after = [(dx, dz) for dx in range(3) for dz in range(-2, 3) if (dx, dz) > (0, 0)]
    n, span = tasks(points), lambda c, low, high: F.sequence(geo.cell(F.col(c) - low, BLOCK_CELLS), geo.cell(F.col(c) + high, BLOCK_CELLS))
    block = [*(within or []), "_bx", "_bz"]
    here = rows.withColumns({"_bx": geo.cell(F.col("_cx"), BLOCK_CELLS), "_bz": geo.cell(F.col("_cz"), BLOCK_CELLS)})
    far = rows.withColumn("_bx", F.explode(span("_cx", 2, 0))).withColumn("_bz", F.explode(span("_cz", 2, 2)))
    kind = dict(points.dtypes)["id"]

    def by_cell(df: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
        cells = df[["_cx", "_cz"]].to_numpy()
        order = np.lexsort(cells.T)
        starts = np.flatnonzero(np.r_[True, (cells[order][1:] != cells[order][:-1]).any(axis=1)])
        return {tuple(cells[at[0]].tolist()): at for at in np.split(order, starts[1:])}

    def nearest(x: np.ndarray, z: np.ndarray, rows: np.ndarray, to_x: np.ndarray, to_z: np.ndarray) -> np.ndarray:
        gap = np.hypot(*(np.maximum(np.maximum(to.min() - v[rows], v[rows] - to.max()), 0.0) for v, to in ((x, to_x), (z, to_z))))
        order = np.argsort(gap, kind="stable")
        return rows[order[: np.searchsorted(gap[order], radius * (1 + 1e-9), "right")]]

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(two):
            (a, ax, az), (b, bx, bz) = ([df[c].to_numpy() for c in ("id", "x", "z")] for df in (one, two))
            ahead = by_cell(two)
            for (cx, cz), mine in by_cell(one).items():
                for dx, dz in after:
                    other = ahead.get((cx + dx, cz + dz))
                    if other is None:
                        continue
                    # Only points near the other cell's box count; the nearest ones come first, few at a time.
                    own, other = nearest(ax, az, mine, bx[other], bz[other]), nearest(bx, bz, other, ax[mine], az[mine])
                    i, step = 0, 16
                    while i < len(own) and len(other):
                        at = own[i : i + step]
                        apart = np.hypot(ax[at, None] - bx[other], az[at, None] - bz[other])
                        i_, j_ = np.nonzero(apart <= radius if closed else apart < radius)
                        if len(i_):
                            out.append((a[at[i_[0]]], b[other[j_[0]]]))
                            break
                        i, step = i + step, max(1, min(2 * step, BLOCK // len(other)))
        return pd.DataFrame(out, columns=["a", "b"])

    between = here.repartition(n, *block).groupBy(*block).cogroup(far.repartition(n, *block).groupBy(*block)).applyInPandas(run, f"a {kind}, b {kind}")
    return own.unionByName(stored(between, "chain"))


def covered_by(outlines: DataFrame, parts: DataFrame, size: float) -> DataFrame:
    """(id, partners, shared): how many ``parts`` (box) share an area with each outline (id, box), and the sum of those
    areas; an outline without any is left out. A pair is counted in the cell of the lower corner of what both share."""

    def spread(df: DataFrame, keep: list[str]) -> DataFrame:
        corners = [F.col(f"box.{c}").cast("double").alias(c) for c in ("x0", "z0", "x1", "z1")]
        out = df.select(*keep, *corners, F.explode(geo.cells_of_box(F.col("box"), size)).alias("_c"))
        return out.select(*keep, "x0", "z0", "x1", "z1", F.col("_c.cx").alias("_cx"), F.col("_c.cz").alias("_cz"))

    kind = dict(outlines.dtypes)["id"]

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        n, s = np.zeros(len(one), np.int64), np.zeros(len(one))
        if len(one) and len(two):
            cx, cz = one["_cx"].iloc[0], one["_cz"].iloc[0]
            a, b = ({c: df[c].to_numpy() for c in ("x0", "z0", "x1", "z1")} for df in (one, two))
            first = lambda v, k, c: np.floor(v[k] / size) == c  # noqa: E731  no box begins in a cell behind one that it touches
            ax, az, bx, bz = first(a, "x0", cx), first(a, "z0", cz), first(b, "x0", cx), first(b, "z0", cz)
            step = max(1, BLOCK // len(two))
            for i in range(0, len(one), step):
                at = slice(i, i + step)
                wide = np.minimum(a["x1"][at, None], b["x1"]) - np.maximum(a["x0"][at, None], b["x0"])
                high = np.minimum(a["z1"][at, None], b["z1"]) - np.maximum(a["z0"][at, None], b["z0"])
                both = np.where((wide > 0) & (high > 0) & (ax[at, None] | bx) & (az[at, None] | bz), wide * high, 0.0)
                n[at], s[at] = (both > 0).sum(axis=1), both.sum(axis=1)
        return pd.DataFrame({"id": one["id"], "partners": n, "shared": s})[n > 0]

    a, b, t = spread(outlines, ["id"]), spread(parts, []), tasks(outlines)
    found = a.repartition(t, "_cx", "_cz").groupBy("_cx", "_cz").cogroup(b.repartition(t, "_cx", "_cz").groupBy("_cx", "_cz")).applyInPandas(run, f"id {kind}, partners long, shared double")
    return stored(found, "fold").groupBy("id").agg(F.sum("partners").alias("partners"), F.sum("shared").alias("shared"))
