"""Geometry of many rings at a time: the rows of an Arrow batch are taken together as arrays, not one by one.

Rings are ARRAY<STRUCT<x, z>> or flat. A null ring gives null, or an empty list where the result is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quadrille.functions.kernels import FLAT, OVERLAP

MEASURES = StructType([StructField(k, DoubleType()) for k in ("area", "perimeter", "cx", "cz", "direction")])

#: Numbers of a block.
BLOCK = 1 << 20

_made: dict[str, Callable] = {}


def _udf(name: str, kind, function: Callable, n: int) -> Callable:
    if name not in _made:
        function.__annotations__ = {**{c: pa.Array for c in function.__code__.co_varnames[:n]}, "return": pa.Array}
        _made[name] = F.arrow_udf(function, kind)
    return _made[name]


def corners(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points (m, 2) of all rings, where each ring begins, how many it has); a null ring has none."""
    offsets = rings.offsets.to_numpy()
    values = rings.values
    if pa.types.is_struct(values.type):
        found, per = np.stack([values.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "z")], axis=1), 1
    else:
        found, per = values.to_numpy(zero_copy_only=False).astype(np.float64)[: len(values) // 2 * 2].reshape(-1, 2), 2
    size = np.where(rings.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets) // per, 0)
    return found, offsets[:-1] // per, size


def alike(*columns: tuple[np.ndarray, np.ndarray, np.ndarray], work: Callable = lambda n: n) -> Iterator[tuple]:
    """(rows, the rings (n, k, 2) of each column) of the rows whose rings have as many corners; rows without any are left
    out."""
    sizes = np.stack([c[2] for c in columns], axis=1)
    for many in np.unique(sizes[(sizes > 0).all(axis=1)], axis=0).tolist():
        rows = np.flatnonzero((sizes == many).all(axis=1))
        step = max(1, BLOCK // work(sum(many) * 2))
        for i in range(0, len(rows), step):
            at = rows[i : i + step]
            yield (at, *(found[begin[at][:, None] + np.arange(k)] for (found, begin, _), k in zip(columns, many)))


def _total(values: np.ndarray) -> np.ndarray:
    """Sums along the second axis, added one after the other as ``geo.total`` does."""
    return values.cumsum(axis=1)[:, -1]


def _doubled(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nxt = np.roll(ring, -1, axis=1)
    return ring[..., 0] * nxt[..., 1] - nxt[..., 0] * ring[..., 1], nxt


def areas(ring: np.ndarray) -> np.ndarray:
    return np.abs(_total(_doubled(ring)[0]) / 2)


def measured(ring: np.ndarray) -> np.ndarray:
    """(n, 5): ``geo.area``, ``perimeter``, ``centroid`` and ``orientation`` of rings (n, k, 2)."""
    cross, nxt = _doubled(ring)
    area = _total(cross) / 2
    flat = np.abs(area) < 5e-10
    whole = np.where(flat, 1.0, 6 * area)
    centre = np.stack([np.where(flat, _total(ring[..., i]) / ring.shape[1], _total((ring[..., i] + nxt[..., i]) * cross) / whole) for i in (0, 1)], axis=1)
    dx, dz = ring[..., 0] - centre[:, :1], ring[..., 1] - centre[:, 1:]
    xz, xx, zz = (_total(v) / ring.shape[1] for v in (dx * dz, dx * dx, dz * dz))
    degrees = np.degrees(np.arctan2(2 * xz, xx - zz) / 2)
    perimeter = _total(np.hypot(ring[..., 0] - nxt[..., 0], ring[..., 1] - nxt[..., 1]))
    return np.column_stack([np.abs(area), perimeter, centre, np.where(degrees < 0, degrees + 180, degrees)])


def measures(ring: Column) -> Column:
    """struct<area, perimeter, cx, cz, direction> of a ring; null for one without points."""

    def run(r):
        out = np.full((len(r), 5), np.nan)
        for at, ring in alike(corners(r)):
            out[at] = measured(ring)
        return pa.StructArray.from_arrays([pa.array(out[:, i], from_pandas=True) for i in range(5)], names=MEASURES.names)

    return _udf("measures", MEASURES, run, 1)(ring)


def area(ring: Column) -> Column:
    """``geo.area``; 0 for a ring without points, null for null."""

    def run(r):
        out = np.zeros(len(r))
        for at, ring in alike(corners(r)):
            out[at] = areas(ring)
        return pa.array(out, mask=r.is_null().to_numpy(zero_copy_only=False))

    return _udf("area", DoubleType(), run, 1)(ring)


def _before(size: np.ndarray) -> np.ndarray:
    """Where the point before each one in its ring is, for rings that follow one another."""
    at, end = np.arange(size.sum()) - 1, np.cumsum(size)
    full = size > 0
    at[(end - size)[full]] = end[full] - 1
    return at


def clipped(ring: tuple, window: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(points, how many of each row) of the parts of rings inside convex windows, edge by edge as ``kernels.clipped``."""
    found, begin, size = ring
    row = np.repeat(np.arange(len(size)), size)
    at = found[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)]
    edges, first, many = window
    turned = np.zeros(len(many), bool)
    for rows, shape in alike(window):
        turned[rows] = _total(_doubled(shape)[0]) / 2 < 0
    for e in range(int(many.max()) if len(many) else 0):
        on, last = many > e, np.maximum(many - 1, 0)
        k = np.where(turned, last - e, e)
        nxt = np.where(turned, np.where(k > 0, k - 1, last), np.where(k < last, k + 1, 0))
        a, b = (edges[np.where(on, first + i, 0)][row] for i in (k, nxt))
        sq = (b[:, 0] - a[:, 0]) * (at[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (at[:, 0] - a[:, 0])
        before = _before(size)
        p, sp = at[before], sq[before]
        cuts, held = (sp >= 0) != (sq >= 0), sq >= 0
        cuts, held = cuts & on[row], held | ~on[row]
        met = p + (at - p) * (sp / np.where(cuts, sp - sq, 1.0))[:, None]
        keep = np.stack([cuts, held], axis=1).ravel()
        at, row = np.stack([met, at], axis=1).reshape(-1, 2)[keep], np.repeat(row, 2)[keep]
        size = np.bincount(row, minlength=len(size))
    return at, size


def clip(ring: Column, window: Column) -> Column:
    """The part of a ring inside a convex window, flat; none where a side is null."""

    def run(r, w):
        one, two = corners(r), corners(w)
        at, size = clipped((one[0], one[1], np.where(w.is_valid().to_numpy(zero_copy_only=False), one[2], 0)), two)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * size)], pa.int32()), pa.array(at.ravel()))

    return _udf("clip", FLAT, run, 2)(ring, window)


def _upto(cut: np.ndarray, low: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the places ``low + cell * (i + 0.5)``, i < n, are below a cut."""
    at = lambda i: low + cell * (i + 0.5)
    k = np.clip(np.ceil((cut - low) / cell - 0.5), 0, n)
    k = np.where((k > 0) & (at(k - 1) >= cut), k - 1, k)
    return np.where((k < n) & (at(k) < cut), k + 1, k)


def _odd(counts: np.ndarray) -> np.ndarray:
    """How many places are below an odd number of cuts, given how many are below each."""
    down = np.sort(counts, axis=1)[:, ::-1]
    return down[:, ::2].sum(axis=1) - down[:, 1::2].sum(axis=1)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, 3): ``kernels.overlap`` of pairs of rings (n, k, 2) and (n, m, 2), a row of the grid at a time."""
    low, high = np.minimum(a.min(1), b.min(1)), np.maximum(a.max(1), b.max(1))
    wide = high - low
    cell = np.maximum(0.25, np.maximum(1.0, np.minimum(np.ptp(a, axis=1).min(1), np.ptp(b, axis=1).min(1))) / 12)
    good = (wide > 0).all(axis=1)
    while (many := good & (np.ceil(wide / cell[:, None]).prod(axis=1) > 160_000)).any():
        cell[many] *= 1.5
    n = np.where(good[:, None], np.ceil(wide / cell[:, None]), 0).astype(np.int64)
    sums, step = np.zeros((len(a), 3)), max(1, BLOCK // (4 * (a.shape[1] + b.shape[1])))
    ends = np.cumsum(n[:, 1])
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + step, "right")))
        row = np.repeat(np.arange(start, stop), n[start:stop, 1])
        number = np.arange(len(row)) - np.repeat(ends[start:stop] - n[start:stop, 1] - (ends[start - 1] if start else 0), n[start:stop, 1])
        z = (low[row, 1] + cell[row] * (number + 0.5))[:, None]
        below = []
        for ring in (a, b):
            p, q = ring[row], np.roll(ring, 1, axis=1)[row]
            spans = (p[..., 1] > z) != (q[..., 1] > z)
            rise = np.where(spans, q[..., 1] - p[..., 1], 1.0)
            cut = (q[..., 0] - p[..., 0]) * (z - p[..., 1]) / rise + p[..., 0]
            below.append(np.where(spans, _upto(cut, low[row, :1], cell[row, None], n[row, :1]), 0))
        one, two, apart = _odd(below[0]), _odd(below[1]), _odd(np.concatenate(below, axis=1))
        for i, v in enumerate(((one + two - apart) / 2, one, two)):
            sums[start:stop, i] = np.bincount(row - start, v, stop - start)
        start = stop
    both, n_a, n_b = sums.T
    return np.stack([np.divide(both, d, out=np.zeros(len(a)), where=d > 0) for d in (n_a + n_b - both, n_a, n_b)], axis=1)


def overlap_of(a: Column, b: Column) -> Column:
    """struct<iou, covered_a, covered_b> from a grid over both rings; null where one has no points."""

    def run(p, q):
        out = np.full((len(p), 3), np.nan)
        for at, one, two in alike(corners(p), corners(q)):
            out[at] = overlaps(one, two)
        return pa.StructArray.from_arrays([pa.array(out[:, i], from_pandas=True) for i in range(3)], names=OVERLAP.names)

    return _udf("overlap", OVERLAP, run, 2)(a, b)
