"""Triangles of rings with holes by ear clipping, and what shows that they are right."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.functions.ringsets import corners

#: Twice an area below which a ring or an ear is flat.
FLAT = 1e-9


def turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of a, b, c: above 0 where they turn left."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def cleaned(ring: np.ndarray, left: bool) -> np.ndarray:
    """The ring without points that repeat the one before, turning left or right as asked."""
    ring = ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)] if len(ring) > 1 else ring
    twice = float((ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]).sum())
    return ring if (twice > 0) == left else ring[::-1]


def bridge(outer: np.ndarray, hole: np.ndarray) -> np.ndarray:
    """One ring around both: from the hole's easternmost point to a corner of the outer ring that it sees."""
    start = int(hole[:, 0].argmax())
    m, a, b = hole[start], outer, np.roll(outer, -1, axis=0)
    spans = (a[:, 1] <= m[1]) & (b[:, 1] > m[1]) | (b[:, 1] <= m[1]) & (a[:, 1] > m[1])
    at = np.full(len(a), np.inf)
    with np.errstate(all="ignore"):
        x = a[:, 0] + (m[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    at[spans & (x >= m[0] - FLAT)] = x[spans & (x >= m[0] - FLAT)]
    k = int(at.argmin())
    if not np.isfinite(at[k]):
        return outer  # a hole outside: it takes nothing away
    hit, seen = np.array([at[k], m[1]]), k if a[k][0] > b[k][0] else (k + 1) % len(a)
    # Corners inside the triangle of hole, edge and corner may hide it: then the one nearest to the eastward line is seen.
    p = outer[seen]
    tri = (m, hit, p) if turn(m, hit, p) > 0 else (m, p, hit)
    inside = np.all([turn(u, v, outer) >= -FLAT for u, v in zip(tri, (*tri[1:], tri[0]))], axis=0) & (outer != p).any(axis=1) & (outer[:, 0] >= m[0])
    reflex = turn(np.roll(outer, 1, axis=0), outer, b) <= FLAT
    if (hidden := np.flatnonzero(inside & reflex)).size:
        away = np.abs(outer[hidden, 1] - m[1]) / np.maximum(outer[hidden, 0] - m[0], FLAT)
        seen = int(hidden[np.lexsort((np.hypot(*(outer[hidden] - m).T), away))[0]])
    same = np.flatnonzero((outer == outer[seen]).all(axis=1))  # bridges before may have doubled it: take the copy that opens towards the hole
    for s in same:
        u, v, w = outer[s - 1], outer[s], outer[(s + 1) % len(outer)]
        to = m[None] if m.ndim == 1 else m
        opens = (turn(u, v, to) >= 0)[0] and (turn(v, w, to) >= 0)[0] if turn(u, v, w) > 0 else (turn(u, v, to) >= 0)[0] or (turn(v, w, to) >= 0)[0]
        if opens:
            seen = int(s)
            break
    return np.concatenate([outer[: seen + 1], np.roll(hole, -start, axis=0), hole[start : start + 1], outer[seen:]])


def triangles(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 3, 2): the triangles of an outline and its holes; none for an outline without an area."""
    rings = [r for r in rings if len(r) >= 3]
    if not rings:
        return np.zeros((0, 3, 2))
    ring = cleaned(rings[0], True)
    for hole in sorted((cleaned(r, False) for r in rings[1:]), key=lambda r: -r[:, 0].max()):
        if len(hole) >= 3:
            ring = bridge(ring, hole)
    left, out, since = list(range(len(ring))), [], 0
    at = 0
    while len(left) > 3 and since < len(left):
        n = len(left)
        i, j, k = left[at - 1], left[at % n], left[(at + 1) % n]
        a, b, c = ring[i], ring[j], ring[k]
        area = float(turn(a, b, c))
        ear = area > FLAT
        if ear:
            rest = ring[[p for p in left if p not in (i, j, k)]]
            rest = rest[~((rest == a).all(1) | (rest == b).all(1) | (rest == c).all(1))]
            ear = not np.any((turn(a, b, rest) >= -FLAT) & (turn(b, c, rest) >= -FLAT) & (turn(c, a, rest) >= -FLAT))
        if ear or abs(area) <= FLAT:
            if ear:
                out.append((a, b, c))
            del left[at % n]
            at, since = (at - 1) % (n - 1), 0
        else:
            at, since = (at + 1) % n, since + 1
    if len(left) == 3 and turn(*(ring[p] for p in left)) > FLAT:
        out.append(tuple(ring[p] for p in left))
    return np.array(out).reshape(-1, 3, 2)


def area_of(rings: list[np.ndarray]) -> float:
    """The outline's area less that of its holes."""
    sizes = [abs(float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum())) / 2 for r in rings if len(r) >= 3]
    return sizes[0] - sum(sizes[1:]) if sizes else 0.0


def outside(faces: np.ndarray, rings: list[np.ndarray]) -> int:
    """Faces whose middle is not inside the rings."""
    middle, odd = faces.mean(axis=1), np.zeros(len(faces), bool)
    for ring in rings:
        for p, q in zip(ring, np.roll(ring, -1, axis=0)):
            crosses = (p[1] > middle[:, 1]) != (q[1] > middle[:, 1])
            with np.errstate(all="ignore"):
                odd ^= crosses & (middle[:, 0] < p[0] + (middle[:, 1] - p[1]) * (q[0] - p[0]) / (q[1] - p[1]))
    return int((~odd).sum())


#: Outlines of up to so many points, holes included, are cut by plain numbers, as arrays of a few points cost more than the sums.
SMALL = 24

Ring = list[list[float]]


def _turn(a: list[float], b: list[float], c: list[float]) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _cleaned_small(ring: Ring, left: bool) -> Ring:
    """``cleaned`` of a few points."""
    ring = [p for p, q in zip(ring, ring[-1:] + ring[:-1]) if p != q] if len(ring) > 1 else ring
    twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
    return ring if (twice > 0) == left else ring[::-1]


def triangles_small(rings: list[Ring]) -> list[tuple]:
    """``triangles`` of a few points."""
    rings = [r for r in rings if len(r) >= 3]
    if not rings:
        return []
    ring = _cleaned_small(rings[0], True)
    for hole in sorted((_cleaned_small(r, False) for r in rings[1:]), key=lambda r: -max((p[0] for p in r), default=0.0)):
        if len(hole) >= 3:
            ring = bridge(np.array(ring, float).reshape(-1, 2), np.array(hole)).tolist()
    left, out, since, at = ring, [], 0, 0
    while len(left) > 3 and since < len(left):
        n = len(left)
        a, b, c = left[at - 1], left[at], left[(at + 1) % n]
        area = _turn(a, b, c)
        ear = area > FLAT
        if ear:
            ear = not any(_turn(a, b, p) >= -FLAT and _turn(b, c, p) >= -FLAT and _turn(c, a, p) >= -FLAT for p in left if p != a and p != b and p != c)
        if ear or abs(area) <= FLAT:
            if ear:
                out.append((a, b, c))
            left = left[:at] + left[at + 1 :]
            at, since = (at - 1) % (n - 1), 0
        else:
            at, since = (at + 1) % n, since + 1
    if len(left) == 3 and _turn(*left) > FLAT:
        out.append(tuple(left))
    return out


def _outside_small(faces: list[tuple], rings: list[Ring]) -> bool:
    """Whether ``outside`` finds any of a few faces."""
    for a, b, c in faces:
        x, z, odd = (a[0] + b[0] + c[0]) / 3, (a[1] + b[1] + c[1]) / 3, False
        for ring in rings:
            for p, q in zip(ring, ring[-1:] + ring[:-1]):
                if (p[1] > z) != (q[1] > z) and x < p[0] + (z - p[1]) * (q[0] - p[0]) / (q[1] - p[1]):
                    odd = not odd
        if not odd:
            return True
    return False


def _facts_small(rings: list[Ring]) -> tuple[list[tuple], float, float, bool]:
    """(faces, area of the rings, area of the faces, whether a face is outside)."""
    faces = triangles_small(rings)
    sizes = [abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))) / 2 for r in rings if len(r) >= 3]
    area = sizes[0] - sum(sizes[1:]) if sizes else 0.0
    return faces, area, sum(abs(_turn(*f)) for f in faces) / 2, _outside_small(faces, rings)


def triangulate(shapes: DataFrame, shape_id: str = "shape_id", rings: str = "rings", tolerance: float = 1e-6) -> DataFrame:
    """Per shape: its id, faces (three points each), area (of the rings), filled (of the faces), problem: null, or ``empty``
    (no face), ``area`` (the faces do not add up to the rings), ``outside`` (a face lies outside). Null rings are empty."""
    kind = shapes.schema[shape_id].dataType.simpleString()

    def facts(own: list[Ring]) -> tuple[list, float, float, str | None]:
        if sum(map(len, own)) <= SMALL:
            faces, area, filled, out = _facts_small(own)
        else:
            arrays = [np.array(r, float) for r in own]
            found, area = triangles(arrays), area_of(arrays)
            filled, out, faces = float(np.abs(turn(found[:, 0], found[:, 1], found[:, 2])).sum()) / 2, outside(found, arrays) > 0, found.tolist()
        return faces, area, filled, "empty" if not faces else "area" if abs(filled - area) > tolerance * max(1.0, area) else "outside" if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("rings")
            points, begin, size = corners(column.values)
            points, begin, size = points.tolist(), begin.tolist(), size.tolist()
            whole, known = column.offsets.to_pylist(), column.is_valid().to_pylist()
            # A null ring and one without points have no corners.
            out = [facts([points[begin[i] : begin[i] + size[i]] for i in range(a, b) if size[i]] if k else []) for a, b, k in zip(whole, whole[1:], known)]
            faces, area, filled, problem = zip(*out) if out else ((), (), (), ())
            flat = np.array([p for many in faces for p in many], float).reshape(-1, 2)
            corner = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "z"])
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 3), pa.int32()), corner)
            many = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, faces)]), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column("id"), many, pa.array(area, pa.float64()), pa.array(filled, pa.float64()), pa.array(problem, pa.string())], names=[shape_id, "faces", "area", "filled", "problem"])

    own = shapes.select(shapes[shape_id].alias("id"), shapes[rings].alias("rings"))
    return own.mapInArrow(run, f"{shape_id} {kind}, faces array<array<struct<x:double,z:double>>>, area double, filled double, problem string")
