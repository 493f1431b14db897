"""Geometry that column expressions cannot say, as Arrow UDFs over flat rings [x0, z0, x1, z1, ...].

Each kernel is a small numpy function; the Series-level wrapper is made on first use, when a session is there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

FLAT = ArrayType(DoubleType())
GAPS = StructType([StructField(k, DoubleType()) for k in ("apart", "hausdorff")])
CELLS = StructType([StructField(k, ArrayType(LongType())) for k in ("full", "met")])
OVERLAP = StructType([StructField(k, DoubleType()) for k in ("iou", "covered_a", "covered_b")])
SAMPLES = StructType([StructField(k, LongType()) for k in ("total", "n")])
POINT = StructType([StructField("x", DoubleType()), StructField("z", DoubleType()), StructField("method", StringType())])


def flat(ring: Column) -> Column:
    """A ring of structs as a flat array."""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["z"])))


def unflat(values: Column) -> Column:
    n = (F.size(values) / 2).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(F.element_at(values, i * 2 - 1).alias("x"), F.element_at(values, i * 2).alias("z")))


def points(values) -> np.ndarray:
    return np.asarray(values, np.float64).reshape(-1, 2)


def inside(x: np.ndarray, z: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of many points."""
    out = np.zeros(np.shape(x), bool)
    for (ax, az), (bx, bz) in zip(ring, np.roll(ring, 1, axis=0)):
        if az != bz:
            out ^= ((az > z) != (bz > z)) & (x < (bx - ax) * (z - az) / (bz - az) + ax)
    return out


def shoelace(ring: np.ndarray) -> float:
    nxt = np.roll(ring, -1, axis=0)
    return float((ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]).sum() / 2)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """IoU and covered shares from a grid over both: cells of a twelfth of the smallest side, 160,000 at most."""
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    width, height = high - low
    if width <= 0 or height <= 0:
        return 0.0, 0.0, 0.0
    cell = max(0.25, max(1.0, min(*np.ptp(a, axis=0), *np.ptp(b, axis=0))) / 12)
    while (nx := int(np.ceil(width / cell))) * (nz := int(np.ceil(height / cell))) > 160_000:
        cell *= 1.5
    x, z = np.meshgrid(low[0] + cell * (np.arange(nx) + 0.5), low[1] + cell * (np.arange(nz) + 0.5))
    in_a, in_b = inside(x, z, a), inside(x, z, b)
    both, n_a, n_b = (in_a & in_b).sum(), in_a.sum(), in_b.sum()
    share = lambda n, d: float(n / d) if d else 0.0
    return share(both, n_a + n_b - both), share(both, n_a), share(both, n_b)


def crossing(ring: np.ndarray) -> bool:
    """Whether two edges without a common corner cross."""
    n = len(ring)
    a, b = ring, np.roll(ring, -1, axis=0)
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    d1, d2, d3, d4 = side(a[j], b[j], a[i]), side(a[j], b[j], b[i]), side(a[i], b[i], a[j]), side(a[i], b[i], b[j])
    return bool(((d1 * d2 < 0) & (d3 * d4 < 0)).any())


#: Rings of up to so many points are thinned by plain numbers, as arrays of a few points cost more than the sums.
SMALL = 24


def _crosses(ring: list[list[float]]) -> bool:
    """``crossing`` of a few points."""
    n = len(ring)
    for i in range(n - 2):
        (ax, az), (bx, bz) = ring[i], ring[i + 1]
        for j in range(i + 2, n - (i == 0)):
            (cx, cz), (dx, dz) = ring[j], ring[(j + 1) % n]
            if ((dx - cx) * (az - cz) - (dz - cz) * (ax - cx)) * ((dx - cx) * (bz - cz) - (dz - cz) * (bx - cx)) < 0 and ((bx - ax) * (cz - az) - (bz - az) * (cx - ax)) * ((bx - ax) * (dz - az) - (bz - az) * (dx - ax)) < 0:
                return True
    return False


def _thinned_small(ring: list[list[float]], tolerance: float, least: int) -> np.ndarray:
    while len(ring) > least:
        size = [abs((p[0] - a[0]) * (b[1] - a[1]) - (b[0] - a[0]) * (p[1] - a[1])) / 2 for a, p, b in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1])]
        i = size.index(min(size))
        rest = ring[:i] + ring[i + 1 :]
        if size[i] > tolerance**2 or _crosses(rest):
            break
        ring = rest
    return points(ring)


def thinned_ring(ring: np.ndarray, tolerance: float, least: int = 4) -> np.ndarray:
    """Drop the point whose triangle is smallest, while it is at most tolerance squared, ``least`` points stay,
    and the ring does not cross itself by it."""
    if len(ring) <= SMALL:
        return _thinned_small(ring.tolist(), tolerance, least)
    ring = ring.copy()
    while len(ring) > least:
        before, after = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
        size = np.abs((ring - before)[:, 0] * (after - before)[:, 1] - (after - before)[:, 0] * (ring - before)[:, 1]) / 2
        i = int(size.argmin())
        rest = np.delete(ring, i, axis=0)
        if size[i] > tolerance**2 or crossing(rest):
            break
        ring = rest
    return ring


def thinned_line(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Keep the ends, and of every stretch the farthest point while it is farther than the tolerance."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        a, d = line[low], line[high] - line[low]
        p = line[low + 1 : high] - a
        t = np.clip((p @ d) / max(float(d @ d), 1e-9), 0, 1)
        far = ((p - t[:, None] * d) ** 2).sum(axis=1)
        i = int(far.argmax())
        if far[i] > tolerance**2:
            keep.add(low + 1 + i)
            todo += [(low, low + 1 + i), (low + 1 + i, high)]
    return line[sorted(keep)]


def clipped(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex window, edge by edge."""
    if shoelace(window) < 0:
        window = window[::-1]
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        if not len(ring):
            break
        side = (b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0])
        out = []
        for p, q, sp, sq in zip(np.roll(ring, 1, axis=0), ring, np.roll(side, 1), side):
            if (sp >= 0) != (sq >= 0):
                out.append(p + (q - p) * (sp / (sp - sq)))
            if sq >= 0:
                out.append(q)
        ring = np.array(out).reshape(-1, 2)
    return ring


def inner_point(ring: np.ndarray) -> tuple[float, float, str]:
    """The centroid if it is inside; else the middle of the widest inner stretch of a scan line; else the box's centre."""
    area, nxt = shoelace(ring), np.roll(ring, -1, axis=0)
    cross = (ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1])[:, None]
    centre = ((ring + nxt) * cross).sum(0) / (6 * area) if abs(area) > 5e-10 else ring.mean(0)
    low, high = ring.min(0), ring.max(0)
    cm = lambda v: float(np.floor(v * 100 + 0.5) / 100)
    if area and inside(centre[:1], centre[1:], ring)[0]:
        return cm(centre[0]), cm(centre[1]), "centroid"
    for z in [centre[1], *(low[1] + (high[1] - low[1]) * s / 9 for s in (4.5, *range(1, 9)))]:
        cuts = sorted(p[0] + (z - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for p, q in zip(ring, nxt) if (p[1] > z) != (q[1] > z))
        stretches = [(b - a, (a + b) / 2) for a, b in zip(cuts[::2], cuts[1::2])]
        if stretches and inside(np.array([max(stretches)[1]]), np.array([z]), ring)[0]:
            return cm(max(stretches)[1]), cm(z), "scan-line"
    return cm((low[0] + high[0]) / 2), cm((low[1] + high[1]) / 2), "box"


def denser(line: np.ndarray, most: float) -> np.ndarray:
    """A line with points put in so that no step is longer than ``most``."""
    parts = [np.linspace(p, q, max(1, int(np.ceil(np.hypot(*(q - p)) / most))), endpoint=False) for p, q in zip(line, line[1:])]
    return np.concatenate([*parts, line[-1:]])


def sideways(line: np.ndarray, half: float, ratio: float) -> np.ndarray:
    """The line moved by ``half`` to the left of its direction (negative: right), mitred by at most ``ratio``."""
    step = np.diff(line, axis=0)
    length = np.hypot(*step.T)[:, None]
    unit = np.divide(step, length, out=np.zeros_like(step), where=length > 0)
    normal = np.stack([-unit[:, 1], unit[:, 0]], axis=1)
    a, b = np.concatenate([normal[:1], normal]), np.concatenate([normal, normal[-1:]])
    both = a + b
    size = np.hypot(*both.T)[:, None]
    way = np.where(size < 1e-6, a, np.divide(both, size, out=np.zeros_like(both), where=size > 0))
    scale = np.minimum(ratio, 1 / np.maximum((way * a).sum(1), 1e-3))
    scale[[0, -1]] = 1
    return line + way * half * scale[:, None]


def ribbon(line: np.ndarray, width: float, most: float, ratio: float) -> np.ndarray:
    """A ring around a line: its left side, and its right side back."""
    line = denser(line, most)
    return np.concatenate([sideways(line, width / 2, ratio), sideways(line, -width / 2, ratio)[::-1]])


def polygon_cells(outer: np.ndarray, holes: list[np.ndarray], size: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the cells that lie wholly inside a polygon, and of those that an edge may meet (its box touches them)."""
    low = np.floor(outer.min(0) / size).astype(np.int64)
    n = np.floor(outer.max(0) / size).astype(np.int64) - low + 1
    met = np.zeros(n, bool)
    slack = 1e-6 * size
    for ring in (outer, *holes):
        other = np.roll(ring, -1, axis=0)
        begin = np.clip(np.floor((np.minimum(ring, other) - slack) / size).astype(np.int64) - low, 0, n)
        end = np.clip(np.floor((np.maximum(ring, other) + slack) / size).astype(np.int64) - low + 1, 0, n)
        for (x0, z0), (x1, z1) in zip(begin.tolist(), end.tolist()):
            met[x0:x1, z0:z1] = True
    cx, cz = np.arange(n[0]) + low[0], np.arange(n[1]) + low[1]
    x, z = np.meshgrid((cx + 0.5) * size, (cz + 0.5) * size, indexing="ij")
    held = inside(x, z, outer)
    for hole in holes:
        held &= ~inside(x, z, hole)
    code = (cx[:, None] << 32) + cz[None, :]
    return code[held & ~met], code[met]


def _to_edges(p: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Distances of each pair's points (n, k, 2) to its ring's (n, m, 2) nearest edge, as ``geo.to_segment``."""
    at, q = ring[:, None], np.roll(ring, -1, axis=1)[:, None]
    d, v, w = q - at, p[:, :, None] - at, p[:, :, None] - q
    square, along = (d * d).sum(-1), (v * d).sum(-1)
    beside = np.divide(np.abs(v[..., 0] * d[..., 1] - v[..., 1] * d[..., 0]), np.sqrt(square), out=np.zeros_like(along), where=square > 0)
    first, last = np.hypot(v[..., 0], v[..., 1]), np.hypot(w[..., 0], w[..., 1])
    return np.where((along <= 0) | (square == 0), first, np.where(along >= square, last, beside)).min(-1)


def _holds(ring: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each pair's ring (n, m, 2) holds its point (n, 2), as ``geo.in_ring``."""
    q, x, z = np.roll(ring, -1, axis=1), p[:, None, 0], p[:, None, 1]
    spans, rise = (q[..., 1] > z) != (ring[..., 1] > z), ring[..., 1] - q[..., 1]
    meets = x < np.divide((ring[..., 0] - q[..., 0]) * (z - q[..., 1]), rise, out=np.zeros_like(rise), where=rise != 0) + q[..., 0]
    return (spans & meets).sum(1) % 2 == 1


def ring_gap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``geo.rings_apart`` and ``geo.hausdorff`` of many pairs of rings (n, k, 2) and (n, m, 2)."""
    one, two = _to_edges(a, b), _to_edges(b, a)
    side = lambda o, p, q: (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])
    ap, aq, bp, bq = a[:, :, None], np.roll(a, -1, axis=1)[:, :, None], b[:, None], np.roll(b, -1, axis=1)[:, None]
    crossing = ((side(ap, aq, bp) * side(ap, aq, bq) < 0) & (side(bp, bq, ap) * side(bp, bq, aq) < 0)).any(axis=(1, 2))
    meet = crossing | _holds(b, a[:, 0]) | _holds(a, b[:, 0])
    return np.where(meet, 0.0, np.minimum(one.min(1), two.min(1))), np.maximum(one.max(1), two.max(1))


_made: dict[str, Callable] = {}


def _udf(name: str, kind, function: Callable) -> Callable:
    if name not in _made:

        def table(*columns: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([function(*row) for row in zip(*columns)], columns=kind.names)

        def series(*columns: pd.Series) -> pd.Series:
            return pd.Series([function(*row) for row in zip(*columns)])

        _made[name] = F.pandas_udf(table if isinstance(kind, StructType) else series, kind)
    return _made[name]


#: Corner pairs of a block of ring pairs.
RING_BLOCK = 1 << 18


def ring_gaps(a: Column, b: Column) -> Column:
    """struct<apart, hausdorff> of two flat rings: pairs of rings of as many corners are taken together as arrays."""
    if "gaps" not in _made:
        import pyarrow as pa

        def gaps(p: pa.Array, q: pa.Array) -> pa.Array:
            out = np.full((len(p), 2), np.nan)
            starts = [s.offsets.to_numpy()[:-1] for s in (p, q)]
            sizes = np.stack([np.where(s.is_valid().to_numpy(zero_copy_only=False), np.diff(s.offsets.to_numpy()), 0) for s in (p, q)], axis=1)
            numbers = [s.values.to_numpy(zero_copy_only=False) for s in (p, q)]
            for n, m in np.unique(sizes[(sizes > 0).all(axis=1)], axis=0).tolist():
                rows = np.nonzero((sizes[:, 0] == n) & (sizes[:, 1] == m))[0]
                step = max(1, 4 * RING_BLOCK // (n * m))
                for i in range(0, len(rows), step):
                    at = rows[i : i + step]
                    first, second = (numbers[k][starts[k][at][:, None] + np.arange(w)].reshape(len(at), -1, 2) for k, w in ((0, n), (1, m)))
                    out[at] = np.stack(ring_gap(first, second), axis=1)
            return pa.StructArray.from_arrays([pa.array(out[:, i], from_pandas=True) for i in range(2)], names=GAPS.names)

        gaps.__annotations__ = {"p": pa.Array, "q": pa.Array, "return": pa.Array}
        _made["gaps"] = F.arrow_udf(gaps, GAPS)
    return _made["gaps"](a, b)


def cells_of_polygon(outer: Column, holes: Column, size: float) -> Column:
    """struct<full, met>: ``polygon_cells``; a cell's code is ``cell_code``."""
    many = F.transform(F.coalesce(holes, F.array()), flat)
    return _udf("cells", CELLS, lambda p, h, s: polygon_cells(points(p), [points(r) for r in h if len(r)], s) if len(p) else ([], []))(flat(outer), many, F.lit(size))


def cell_code(cx: Column, cz: Column) -> Column:
    return F.shiftleft(cx.cast("long"), 32) + cz.cast("long")


def sampled(ring: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a grid of ``steps`` by ``steps`` over a ring's box that are inside the ring."""
    low, high, at = ring.min(0), ring.max(0), (np.arange(steps) + 0.5) / steps
    x, z = (v.ravel() for v in np.meshgrid(low[0] + at * (high[0] - low[0]), low[1] + at * (high[1] - low[1]), indexing="ij"))
    held = inside(x, z, ring)
    return x[held], z[held]


def samples_in(ring: np.ndarray, outer: np.ndarray, holes: list[np.ndarray], steps: int) -> tuple[int, int]:
    """How many samples of a ring there are, and how many of them a polygon holds."""
    x, z = sampled(ring, steps)
    held = inside(x, z, outer)
    for hole in holes:
        held &= ~inside(x, z, hole)
    return len(x), int(held.sum())


def samples_held(ring: Column, outer: Column, holes: Column, steps: int) -> Column:
    """struct<total, n>: ``samples_in`` of a flat ring and a flat outline with its flat holes."""
    return _udf("samples", SAMPLES, lambda r, p, h, s: samples_in(points(r), points(p), [points(v) for v in h if len(v)], s) if len(r) and len(p) else (0, 0))(ring, outer, holes, F.lit(steps))


def crosses_itself(ring: Column) -> Column:
    return _udf("crossing", BooleanType(), lambda p: crossing(points(p)))(flat(ring))


def thin_ring(ring: Column, tolerance: Column) -> Column:
    """Flat; ``unflat`` it in a select of its own, as a UDF cannot stand in a lambda."""
    return _udf("ring", FLAT, lambda p, t: thinned_ring(points(p), t).ravel())(flat(ring), tolerance)


def thin_line(line: Column, tolerance: Column) -> Column:
    """Flat, as ``thin_ring``."""
    return _udf("line", FLAT, lambda p, t: thinned_line(points(p), t).ravel())(flat(line), tolerance)


def inner_point_of(ring: Column) -> Column:
    return _udf("inner", POINT, lambda p: inner_point(points(p)))(flat(ring))


def side_line(line: Column, half: Column, ratio: Column) -> Column:
    """Flat, as ``thin_ring``."""
    return _udf("side", FLAT, lambda p, h, r: sideways(points(p), h, r).ravel())(flat(line), half, ratio)


def ribbon_of(line: Column, width: Column, most: float = 60.0, ratio: float = 2.5) -> Column:
    """Flat, as ``thin_ring``."""
    return _udf("ribbon", FLAT, lambda p, w, m, r: ribbon(points(p), w, m, r).ravel())(flat(line), width, F.lit(most), F.lit(ratio))
