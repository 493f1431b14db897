"""Rasters in blocks and triangles, against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quadrille.functions import triangles
from quadrille.operators import raster


def in_rings(x, z, rings):
    odd = False
    for ring in rings:
        for (ax, az), (bx, bz) in zip(ring, [*ring[1:], ring[0]]):
            if (az > z) != (bz > z) and x < ax + (z - az) * (bx - ax) / (bz - az):
                odd = not odd
    return odd


def star(rng, x, z, least, most, n):
    """A ring around a point that turns left, with corners in and out."""
    return [(x + math.cos(2 * math.pi * k / n) * (r := rng.uniform(least, most)), z + math.sin(2 * math.pi * k / n) * r) for k in range(n)]


def random_shapes(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, z = rng.uniform(-60, 60), rng.uniform(-60, 60)
        rings = [star(rng, x, z, 12, 30, rng.randrange(5, 14))]
        if rng.random() < 0.6:
            rings.append(star(rng, x, z, 2, 5, rng.randrange(3, 8)))
        out.append(rings)
    return out


def test_bit_planes(spark):
    shapes = random_shapes(1, 14)
    rows = [([[{"x": x, "z": z} for x, z in ring] for ring in rings], i % 3) for i, rings in enumerate(shapes)] + [([], 1)]
    blocks = raster.fill(spark.createDataFrame(rows, "rings array<array<struct<x:double,z:double>>>, bit int").repartition(5), 2.0, side=8)
    expected = {}
    for i, rings in enumerate(shapes):
        for cx in range(-50, 50):
            for cz in range(-50, 50):
                if in_rings((cx + 0.5) * 2, (cz + 0.5) * 2, rings):
                    expected[cx, cz] = expected.get((cx, cz), 0) | 1 << i % 3
    assert {(r["cx"], r["cz"]): r["mask"] for r in raster.cells_of(blocks, side=8).collect()} == expected
    counts = {r["bit"]: (r["cells"], r["alone"]) for r in raster.plane_counts(blocks).collect()}
    assert counts == {b: (sum(m >> b & 1 for m in expected.values()), sum(m == 1 << b for m in expected.values())) for b in range(3)}
    again = spark.createDataFrame([(x, z, m & 3) for (x, z), m in expected.items()] + [(x, z, m & 6) for (x, z), m in expected.items()], "cx long, cz long, mask long")
    assert {(r["cx"], r["cz"]): r["mask"] for r in raster.cells_of(raster.of_cells(again, side=8), side=8).collect()} == expected


def two_passes(land, water, x0, z0, nx, nz):
    d = {(x, z): 0.0 if (x, z) in land else math.inf for x in range(x0, x0 + nx) for z in range(z0, z0 + nz)}
    for sign in (1, -1):
        for z in range(z0, z0 + nz)[::sign]:
            for x in range(x0, x0 + nx)[::sign]:
                for dx, dz, cost in ((-1, 0, 1), (0, -1, 1), (-1, -1, 2**0.5), (1, -1, 2**0.5)):
                    d[x, z] = min(d[x, z], d.get((x + dx * sign, z + dz * sign), math.inf) + cost)
    return {p: d[p] for p in water}


@pytest.mark.parametrize("share", [0.001, 0.05])
def test_depths_over_many_blocks(spark, share):
    """Depths of many blocks' length, over blocks without any cell, equal the plain two passes over the whole raster."""
    rng = random.Random(2)
    land = {(rng.randrange(-20, 60), rng.randrange(-10, 40)) for _ in range(max(1, int(4000 * share)))}
    water = {(x, z) for x in range(-20, 60) for z in range(-10, 40) if rng.random() < 0.3 and not (0 <= x < 16 and 8 <= z < 16)} - land
    cells = spark.createDataFrame([(x, z, 2) for x, z in land] + [(x, z, 1) for x, z in water], "cx long, cz long, mask long").repartition(4)
    found = {(r["cx"], r["cz"]): r["depth"] for r in raster.shore_depths(raster.of_cells(cells, side=8), 1, 2, side=8).collect()}
    assert found == pytest.approx(two_passes(land, water, -24, -16, 88, 56), abs=1e-9) and max(found.values()) > (20 if share < 0.01 else 2)


def test_depths_without_land(spark):
    cells = spark.createDataFrame([(3, 4, 1)], "cx long, cz long, mask long")
    assert [tuple(r) for r in raster.shore_depths(raster.of_cells(cells, side=8), 1, 2, side=8).collect()] == [(3, 4, None)]
    assert raster.shore_depths(raster.of_cells(cells.limit(0), side=8), 1, 2, side=8).count() == 0


def test_triangles_of_shapes_with_holes(spark):
    rng, shapes = random.Random(3), random_shapes(3, 120)
    for rings in shapes:
        if rng.random() < 0.5:
            rings[0].reverse()
        if rng.random() < 0.3:
            rings[0].append(rings[0][0])  # closed by its first point
    square = [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)]
    many = [square] + [[(x, z), (x + 4, z), (x + 4, z + 4), (x, z + 4)] for x in (3.0, 13.0, 23.0, 33.0) for z in (3.0, 13.0, 23.0, 33.0)]
    comb = [(0.0, 0.0), (40.0, 0.0)] + [p for k in range(10, 0, -1) for p in ((4.0 * k, 30.0), (4.0 * k - 2, 30.0), (4.0 * k - 2, 2.0), (4.0 * k - 4, 2.0))]
    rows = [(i, [[{"x": x, "z": z} for x, z in ring] for ring in rings]) for i, rings in enumerate([*shapes, many, [comb]])]
    rows += [(900, None), (901, []), (902, [[{"x": 0.0, "z": 0.0}, {"x": 5.0, "z": 5.0}, {"x": 9.0, "z": 9.0}]]), (903, [[{"x": 1.0, "z": 2.0}]])]
    found = {r["shape_id"]: r for r in triangles.triangulate(spark.createDataFrame(rows, "shape_id long, rings array<array<struct<x:double,z:double>>>")).collect()}
    for i, rings in enumerate([*shapes, many, [comb]]):
        r, own = found[i], [np.array(ring) for ring in rings]
        assert r["problem"] is None, (i, r["problem"], r["filled"], r["area"])
        assert r["filled"] == pytest.approx(triangles.area_of(own), rel=1e-6)
        middles = [(sum(p["x"] for p in face) / 3, sum(p["z"] for p in face) / 3) for face in r["faces"]]
        assert all(in_rings(x, z, rings) for x, z in middles)
    assert {found[i]["problem"] for i in (900, 901, 902, 903)} == {"empty"}


def test_faces_that_are_wrong():
    """The checks see a face that is missing and one that lies outside."""
    angle = np.array([(0, 0), (9, 0), (9, 3), (2, 3), (2, 8), (0, 8)], float)
    faces = triangles.triangles([angle])
    assert len(faces) == 4 and triangles.outside(faces, [angle]) == 0
    assert triangles.outside(np.array([[(9, 3), (2, 8), (2, 3)]], float), [angle]) == 1
    assert np.abs(triangles.turn(*faces[:3].transpose(1, 0, 2))).sum() / 2 != pytest.approx(triangles.area_of([angle]))
