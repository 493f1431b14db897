"""Networks of lines: ends that hang, gaps between parts, chains in order, and origins of a plane."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quadrille.functions import geo
from quadrille.functions.num import half_up
from quadrille.operators.folds import chain_edges, near_lines
from quadrille.operators.forest import spanning_forest, touching
from quadrille.operators.graph import components
from quadrille.operators.spatial import box_pairs
from quadrille.storage import stored, tasks


def to_segment(x: Column, z: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dz = bx - ax, bz - az
    n = dx * dx + dz * dz
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (z - az) * dz) / n))).otherwise(0.0)
    return F.hypot(x - (ax + t * dx), z - (az + t * dz))


def segments(lines: DataFrame, line_id: str) -> DataFrame:
    """(line_id, ax, az, bx, bz, box) of all segments."""
    pairs = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    s = lines.where(F.size("points") >= 2).select(line_id, F.explode(pairs).alias("s"))
    s = s.select(line_id, F.col("s.p.x").alias("ax"), F.col("s.p.z").alias("az"), F.col("s.q.x").alias("bx"), F.col("s.q.z").alias("bz"))
    return s.withColumn("box", F.struct(F.least("ax", "bx").alias("x0"), F.least("az", "bz").alias("z0"), F.greatest("ax", "bx").alias("x1"), F.greatest("az", "bz").alias("z1")))


def hanging_ends(lines: DataFrame, line_id: str, touch: float = 6.0, reach: float = 25.0, cell: float = 200.0) -> DataFrame:
    """(line_id, side, x, z, kind) of the ends that no other line shares: touching (within ``touch`` of another
    line's segment), near-miss (within ``reach``), or hanging. Ends are shared when they round to one metre."""
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    sides = F.array(F.struct(F.lit("first").alias("side"), first.alias("p")), F.struct(F.lit("last").alias("side"), last.alias("p")))
    ends = lines.where(F.size("points") >= 2).select(line_id, F.explode(sides).alias("e")).select(line_id, "e.side", F.col("e.p.x").alias("x"), F.col("e.p.z").alias("z"))
    ends = ends.withColumn("gx", F.floor(F.col("x") + 0.5)).withColumn("gz", F.floor(F.col("z") + 0.5))
    shared = ends.groupBy("gx", "gz").agg(F.count("*").alias("degree"))
    alone = ends.join(shared, ["gx", "gz"]).where("degree = 1").select(line_id, "side", "x", "z", F.struct(F.col("x").alias("x0"), F.col("z").alias("z0"), F.col("x").alias("x1"), F.col("z").alias("z1")).alias("pbox"))
    other = segments(lines, line_id).withColumnRenamed(line_id, "_other")
    near = box_pairs(alone, other, "pbox", "box", cell, pad=reach).where(F.col(line_id) != F.col("_other"))
    d = near.groupBy(line_id, "side").agg(F.min(to_segment(*(F.col(c) for c in ("x", "z", "ax", "az", "bx", "bz")))).alias("d"))
    kind = F.when(F.col("d") <= touch, "touching").when(F.col("d") <= reach, "near-miss").otherwise("hanging")
    return alone.join(d, [line_id, "side"], "left").select(line_id, "side", "x", "z", kind.alias("kind"))


def _named_ends(lines: DataFrame, river: str, line_id: str) -> DataFrame:
    """(grp, part, x, z): both ends of every line that has points."""
    sides = F.array(F.element_at("points", 1), F.element_at("points", -1))
    return lines.where(F.size("points") > 0).select(F.col(river).alias("grp"), F.col(line_id).alias("part"), F.explode(sides).alias("p")).select("grp", "part", "p.x", "p.z")


def river_gaps(lines: DataFrame, river: str = "river", line_id: str = "line_id", joined: float = 60.0) -> DataFrame:
    """(river, a, b, gap): what keeps the lines of a river apart, as the least tree of gaps between their ends. Lines
    whose ends are within ``joined`` are one part. Lines without a river's name are no river; ``line_id`` names a line."""
    ends = stored(_named_ends(lines, river, line_id).where("grp is not null"), "ends")
    gaps = spanning_forest(ends, touching(ends, joined), joined)
    return gaps.select(F.col("grp").alias(river), "a", "b", F.sqrt("d2").alias("gap"))


def river_continuity(lines: DataFrame, gaps: DataFrame, river: str = "river", line_id: str = "line_id") -> DataFrame:
    """(river, segments, components, gaps, max_gap, total_length) of every river; ``gaps`` are its river_gaps. A line
    without a name is a river of its own."""
    alone = F.when(F.col(river).isNull(), F.col(line_id))
    whole = lines.where(F.size("points") > 0).groupBy(river, alone.alias("alone")).agg(F.count("*").alias("segments"), F.sum(geo.path_length(F.col("points"))).alias("length"))
    most = gaps.groupBy(river).agg(F.count("*").alias("gaps"), F.max("gap").alias("widest"))
    n = F.coalesce("gaps", F.lit(0))
    return whole.join(most, river, "left").select(river, "segments", (n + 1).alias("components"), n.alias("gaps"), half_up(F.coalesce("widest", F.lit(0.0)), 1).alias("max_gap"), half_up(F.col("length"), 0).cast("long").alias("total_length"))


def gap_cause(gap: Column, near_city_edge: Column, ward_edge: Column) -> Column:
    """What a gap is put down to: A an end's tolerance, D the city's edge, C a ward's edge within 120 m (null: not
    known), B a part that is missing, E the middle range."""
    return F.when(gap <= 80, "A").when(near_city_edge, "D").when(ward_edge < 120, "C").when(gap > 400, "B").otherwise("E")


class _Free:
    """Rows that are not taken, by the squares of their ends. Of a square that lies wholly within ``joined`` of a place only the
    first free row is asked for; of one that lies partly within it, those before the best row found."""

    def __init__(self, first: np.ndarray, last: np.ndarray, joined: float) -> None:
        self.first, self.last, self.joined, self.n = first, last, joined, len(first)
        self.taken = np.zeros(self.n, bool)
        ends = np.concatenate([first, last])
        rows = np.flatnonzero(np.isfinite(ends).all(axis=1))
        ends = ends[rows]
        self.corner = ends.min(axis=0) if len(ends) else np.zeros(2)
        span = float((ends.max(axis=0) - self.corner).max()) if len(ends) else 0.0
        self.side = max(joined / 8, span / (8 * math.sqrt(self.n) + 64)) or 1.0  # so that squares are not many more than rows
        self.slack, self.reach = 1e-9 * (joined + span), math.ceil(joined / self.side) + 1
        at = np.floor((ends - self.corner) / self.side).astype(np.int64)
        self.shape = tuple(int(v) + 1 for v in at.max(axis=0)) if len(ends) else (1, 1)
        self.low = [self.corner[c] + self.side * np.arange(self.shape[c]) for c in (0, 1)]
        square, row = at[:, 0] * self.shape[1] + at[:, 1], rows % self.n
        self.squares = np.full((2, self.n), -1)
        self.squares[rows // self.n, row] = square
        order = np.lexsort((row, square))
        self.rows = row[order]
        self.next, self.end = (np.searchsorted(square[order], np.arange(self.shape[0] * self.shape[1]), side) for side in ("left", "right"))
        self.least = np.full(self.shape[0] * self.shape[1], self.n)
        some = np.flatnonzero(self.end > self.next)
        self.least[some] = self.rows[self.next[some]]

    def take(self, row: int) -> None:
        self.taken[row] = True
        for square in self.squares[:, row].tolist():
            if square >= 0 and self.least[square] == row:
                at, end = int(self.next[square]), int(self.end[square])
                while at < end and self.taken[self.rows[at]]:
                    at += 1
                self.next[square], self.least[square] = at, self.rows[at] if at < end else self.n

    def goes_on(self, place: np.ndarray) -> int | None:
        """The first free row with an end within ``joined`` of the place."""
        if not np.isfinite(place).all():
            return None
        near, far, slices = [], [], []
        for c in (0, 1):
            at = math.floor((place[c] - self.corner[c]) / self.side)
            own = slice(max(0, at - self.reach), max(0, at + self.reach + 1))
            low = self.low[c][own] - place[c]
            high = low + self.side
            near.append(np.maximum(np.maximum(low, -high), 0.0) ** 2)
            far.append(np.maximum(-low, high) ** 2)
            slices.append(own)
        least = self.least.reshape(self.shape)[slices[0], slices[1]]
        if not least.size:
            return None
        whole = far[0][:, None] + far[1] <= max(0.0, self.joined - self.slack) ** 2
        best = int(np.where(whole, least, self.n).min())
        part = ~whole & (near[0][:, None] + near[1] <= (self.joined + self.slack) ** 2) & (least < best)
        if part.any():
            x, z = np.nonzero(part)
            for i in np.argsort(least[x, z], kind="stable").tolist():
                if least[x[i], z[i]] >= best:
                    break
                square = (x[i] + slices[0].start) * self.shape[1] + z[i] + slices[1].start
                at, end, step = int(self.next[square]), int(self.end[square]), 64
                while at < end and self.rows[at] < best:
                    rows = self.rows[at : min(end, at + step)]
                    met = (np.hypot(*(self.first[rows] - place).T) <= self.joined) | (np.hypot(*(self.last[rows] - place).T) <= self.joined)
                    met &= ~self.taken[rows]
                    if met.any():
                        best = min(best, int(rows[met.argmax()]))
                        break
                    at, step = at + step, 2 * step
        return best if best < self.n else None


def _walks(first: np.ndarray, last: np.ndarray, degree: np.ndarray, joined: float) -> list[list[tuple[int, bool]]]:
    """Chains of (row, turned round) over one component: rows are by id, ends are (n, 2). What goes on from a place is
    the first row by id that is not taken and is near."""
    free, chains = _Free(first, last, joined), []
    for start in np.lexsort((np.arange(len(degree)), degree)).tolist():
        chain, part, came = [], None if free.taken[start] else start, None
        while part is not None:
            free.take(part)
            if came is not None:
                turned = math.dist(last[part], came) < math.dist(first[part], came)
            else:  # the way out is the end that goes on
                turned = free.goes_on(first[part]) is not None and free.goes_on(last[part]) is None
            chain.append((part, turned))
            came = first[part] if turned else last[part]
            part = free.goes_on(came)
        if chain:
            chains.append(chain)
    return chains


def walked(parts: list[tuple], joined: float) -> list[list[tuple]]:
    """Chains of (part, turned round) over one component. ``parts``: (id, first end, last end, neighbours), by id.

    Walks start at parts of few neighbours, then of low id, and go one way: from a part's free end to the first part
    by id that is not taken and has an end within ``joined`` of it."""
    first, last = (np.array([p[i] for p in parts], np.float64).reshape(-1, 2) for i in (1, 2))
    return [[(parts[i][0], turned) for i, turned in chain] for chain in _walks(first, last, np.array([len(p[3]) for p in parts]), joined)]


def river_chains(lines: DataFrame, river: str = "river", line_id: str = "line_id", joined: float = 60.0) -> DataFrame:
    """(river, chain, pos, line_id, turned): the lines of a river in order along their chains, numbered from 0. A line
    without a neighbour is in no chain: its chain and pos are null.

    A walk stays within the lines that near ends chain together, so these are what one task walks; where a chain
    stands among the river's chains follows from its first line. Neighbours are counted, and are no rows."""
    kind = dict(lines.dtypes)
    own = stored(lines.where(F.size("points") > 0).select(river, line_id, *(F.struct(*(F.element_at("points", i)[k].cast("double").alias(k) for k in ("x", "z"))).alias(name) for name, i in (("first", 1), ("last", -1)))), "lines")
    named = own.where(F.col(river).isNotNull()).select(F.col(river).alias("grp"), F.col(line_id).alias("id"), "first", "last")
    ends = named.select("grp", "id", F.explode(F.array("first", "last")).alias("p")).select("grp", "id", "p.*")
    degree = stored(near_lines(named, joined, "grp"), "degree").select(F.col("id").alias(line_id), F.col("n").alias("degree"))
    groups = components(chain_edges(ends, joined, ["grp"], closed=True)).withColumnRenamed("node", line_id)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(line_id, ignore_index=True)
        first, last = (pdf[[f"{e}_x", f"{e}_z"]].to_numpy() for e in ("first", "last"))
        ids, degrees = pdf[line_id].tolist(), pdf["degree"].tolist()
        out = [(pdf[river].iloc[0], degrees[chain[0][0]], ids[chain[0][0]], i, ids[part], turned) for chain in _walks(first, last, pdf["degree"].to_numpy(), joined) for i, (part, turned) in enumerate(chain)]
        return pd.DataFrame(out, columns=[river, "degree", "start", "pos", line_id, "turned"])

    rows = own.select(river, line_id, *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("x", "z"))).join(degree, line_id).join(groups, line_id)
    walks = stored(rows.repartition(tasks(rows), "comp").groupBy("comp").applyInPandas(run, f"{river} {kind[river]}, degree long, start {kind[line_id]}, pos long, {line_id} {kind[line_id]}, turned boolean"), "walks")
    order = walks.where("pos = 0").select(river, "start", (F.row_number().over(Window.partitionBy(river).orderBy("degree", "start")) - 1).cast("long").alias("chain"))
    chains = walks.join(order.drop(river), "start").select(river, "chain", "pos", line_id, "turned")
    none = F.lit(None).cast("long")
    return chains.unionByName(own.join(degree, line_id, "left_anti").select(river, none.alias("chain"), none.alias("pos"), line_id, F.lit(False).alias("turned")))


def estimate_origin(refs: DataFrame, inlier: float = 50.0) -> DataFrame:
    """The axis signs whose offsets agree best: sx, sz, ox, oz, n, residual. ``refs``: x, z (local), e, n (metres
    in a zone). For each of four sign pairs: the median offset, outliers left out, at least three kept."""
    signs = F.array(*(F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sz")) for a in (1, -1) for b in (1, -1)))
    rows = refs.withColumn("_s", F.explode(signs)).select("_s.*", (F.col("e") - F.col("_s.sx") * F.col("x")).alias("ox"), (F.col("n") - F.col("_s.sz") * F.col("z")).alias("oz"))
    middle = rows.groupBy("sx", "sz").agg(F.median("ox").alias("mx"), F.median("oz").alias("mz"))
    good = rows.join(F.broadcast(middle), ["sx", "sz"]).where(F.hypot(F.col("ox") - F.col("mx"), F.col("oz") - F.col("mz")) <= inlier)  # four rows
    fits = good.groupBy("sx", "sz").agg(F.count("*").alias("n"), F.median("ox").alias("ox"), F.median("oz").alias("oz"), F.max(F.hypot(F.col("ox") - F.col("mx"), F.col("oz") - F.col("mz"))).alias("residual")).where("n >= 3")
    return fits.orderBy(F.desc("n"), "residual").limit(1)


def nested_rings(rings: DataFrame, area_id: str = "area_id", cell: float = 500.0) -> DataFrame:
    """(area_id, ring_id, depth, outer_id): rings of an area by how many others hold their first point; an odd
    depth is a hole of the smallest ring that holds it. ``rings``: area_id, ring_id, ring. A ring meets those in whose
    box its first point lies, by cells."""
    at, own = F.element_at("ring", 1), geo.area(F.col("ring"))
    here = F.struct(at["x"].alias("x0"), at["z"].alias("z0"), at["x"].alias("x1"), at["z"].alias("z1"))
    inner = rings.select(F.col(area_id).alias("_area"), F.col("ring_id").alias("i"), at.alias("p"), own.alias("ai"), here.alias("at"))
    outer = rings.select(area_id, F.col("ring_id").alias("o"), F.col("ring").alias("r"), own.alias("ao"), geo.bbox(F.col("ring")).alias("box"))
    met = box_pairs(inner, outer, "at", "box", cell).where(F.col(area_id) == F.col("_area"))
    held = met.where((F.col("i") != F.col("o")) & (F.col("ao") > F.col("ai")) & geo.in_ring(F.col("p.x"), F.col("p.z"), F.col("r")))
    depth = held.groupBy(area_id, "i").agg(F.count("*").alias("depth"), F.min_by("o", F.struct("ao", "o")).alias("o"))
    out = rings.select(area_id, F.col("ring_id").alias("i")).join(depth, [area_id, "i"], "left")
    n = F.coalesce("depth", F.lit(0))
    return out.select(area_id, F.col("i").alias("ring_id"), n.alias("depth"), F.when(n % 2 == 1, F.col("o")).alias("outer_id"))
