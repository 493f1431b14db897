"""Joins and kernels on inputs whose size the planner misjudges, or that one task would have to take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators import spatial


def squares(spark, n, side, across=200.0):
    rng = random.Random(n)
    rows = [(i, float(rng.randrange(int(across))), float(rng.randrange(int(across))), float(1 + rng.randrange(side))) for i in range(n)]
    ring = geo.rectangle(F.col("x0"), F.col("z0"), F.col("x0") + F.col("w"), F.col("z0") + F.col("w"))
    parts = spark.createDataFrame(rows, "ward_id long, x0 double, z0 double, w double").select("ward_id", ring.alias("outer"), F.array().cast("array<array<struct<x:double,z:double>>>").alias("holes"), (F.col("w") * F.col("w")).alias("area"))
    return rows, parts.withColumn("box", geo.bbox(F.col("outer")))


def test_exploded_sides_are_not_broadcast(spark):
    """A few thousand polygons in many cells are far more bytes than the planner takes them for."""
    _, parts = squares(spark, 3000, 60)
    points = spark.range(1000).select(F.col("id").alias("point_id"), (F.col("id") % 200).cast("double").alias("x"), (F.col("id") % 190).cast("double").alias("z"))
    boxes = lambda df: df._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in boxes(spatial.hits(points, parts, 1.0))
    assert "BroadcastHashJoin" not in boxes(spatial.box_pairs(parts.select(F.col("box").alias("a")), parts.select(F.col("box").alias("b")), "a", "b", 5.0))
    assert "BroadcastHashJoin" not in boxes(spatial.near_pairs(points, points.select(F.col("x").alias("bx"), F.col("z").alias("bz")), "x", "z", "bx", "bz", 5.0))
    assert "BroadcastHashJoin" in boxes(spatial.hits(points, parts.limit(10), 100.0))


def test_smallest_hit_in_classes(spark):
    rows, parts = squares(spark, 300, 60)
    rng = random.Random(5)
    points = [(i, rng.randrange(220) + 0.5, rng.randrange(220) + 0.5) for i in range(200)]
    found = spatial.smallest_hit(spark.createDataFrame(points, "point_id long, x double, z double"), parts, 30.0, "point_id", first=3)
    expected = {}
    for i, x, z in points:
        held = [(w * w, k) for k, x0, z0, w in rows if x0 <= x < x0 + w and z0 <= z < z0 + w]
        if held:
            expected[i] = min(held)[1]
    assert {r["point_id"]: r["ward_id"] for r in found.collect()} == expected


def test_small_rings_are_thinned_as_large_ones(monkeypatch):
    import numpy as np

    from quadrille.functions import kernels

    rng = np.random.default_rng(3)
    rings = [np.round(rng.uniform(0, 4, (n, 2)), 1) for n in range(3, 13) for _ in range(30)]
    found = [kernels.thinned_ring(r, 1.5) for r in rings]
    monkeypatch.setattr(kernels, "SMALL", 0)
    assert all(np.array_equal(a, kernels.thinned_ring(r, 1.5)) for a, r in zip(found, rings))


def test_rings_are_taken_together_as_one_by_one():
    """Clips and overlaps of a whole batch: the very numbers of the row kernels, among them null and turned windows."""
    import numpy as np
    import pyarrow as pa

    from quadrille.functions import kernels, ringsets

    rng = np.random.default_rng(1)
    rings = [np.round(rng.uniform(0, 20, (rng.integers(3, 9), 2)), 1) for _ in range(400)]
    boxes = [np.array([[x, z], [x + w, z], [x + w, z + h], [x, z + h]])[:: 1 if turned else -1] for x, z, w, h, turned in zip(*rng.uniform(1, 15, (4, 400)), rng.random(400) < 0.5)]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("z", pa.float64())]))
    one, two = (ringsets.corners(pa.array([[{"x": x, "z": z} for x, z in r.tolist()] for r in many], kind)) for many in (rings, boxes))
    at, size = ringsets.clipped(one, two)
    parts = np.split(at, np.cumsum(size)[:-1])
    assert all(np.array_equal(kernels.clipped(a, b).reshape(-1, 2), part) for a, b, part in zip(rings, boxes, parts)) and 0 in size.tolist()
    found = np.zeros((400, 3))
    for rows, a, b in ringsets.alike(one, two):
        found[rows] = ringsets.overlaps(a, b)
    assert np.array_equal(found, [kernels.overlap(a, b) for a, b in zip(rings, boxes)])
    none = ringsets.corners(pa.array([None, [], [{"x": 1.0, "z": 2.0}]], kind))
    assert none[2].tolist() == [0, 0, 1] and ringsets.clipped(none, none)[1].tolist()[:2] == [0, 0]


def test_measures_of_rings(spark):
    """The numbers of the expressions, of rings of any size, flat ones and null too."""
    from quadrille.functions import ringsets

    rng = random.Random(4)
    rows = [(i, [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randrange(1, 8))]) for i in range(60)] + [(60, [(0.0, 1.0), (4.0, 1.0)]), (61, None)]
    df = spark.createDataFrame(rows, "id long, ring array<struct<x:double,z:double>>")
    c = geo.centroid(F.col("ring"))
    plain = df.select("id", geo.area(F.col("ring")).alias("area"), geo.perimeter(F.col("ring")).alias("perimeter"), c["x"].alias("cx"), c["z"].alias("cz"), geo.orientation(F.col("ring")).alias("direction"))
    found = df.select("id", ringsets.measures(F.col("ring")).alias("m"), ringsets.area(F.col("ring")).alias("a"))
    expected = {r["id"]: r for r in plain.collect()}
    for r in found.collect():
        for k in ringsets.MEASURES.names:
            a, b = r["m"][k], expected[r["id"]][k]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-7), (r["id"], k)
        assert r["a"] == r["m"]["area"]


def test_small_outlines_are_cut_as_large_ones():
    import numpy as np

    from quadrille.functions import triangles

    rng = np.random.default_rng(2)
    for k in range(300):
        angle = np.sort(rng.uniform(0, 6.28, rng.integers(1, 9)))
        own = [np.round(np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(5, 10, (len(angle), 1)), 1)]
        own += [np.array([[-1.0, -1], [1, -1], [1, 1], [-1, 1]]) * rng.uniform(0.3, 1.5)] if k % 2 else []
        faces = triangles.triangles(own)
        found, area, _, out = triangles._facts_small([r.tolist() for r in own])
        assert np.array_equal(np.array(found, float).reshape(-1, 3, 2), faces)
        assert abs(area - triangles.area_of(own)) < 1e-9 and out == (triangles.outside(faces, own) > 0)


def test_rows_are_dealt_by_number(spark):
    from quadrille.storage import dealt

    rows = spark.range(1000).coalesce(1)
    assert dealt(rows, 100).rdd.getNumPartitions() == 10 and dealt(rows, 100).count() == 1000
    assert dealt(rows).rdd.getNumPartitions() == 1


def test_equal_distances_are_equal(spark):
    """A point on the edge of two rectangles is at 0.0 of both; a place computed on the edge is off by a rounding."""
    p = spark.range(2500, 7100).select(F.col("id").cast("double").alias("x"), F.lit(2000.0).alias("z"))
    one, two = (geo.rectangle(F.lit(2400), F.lit(z), F.lit(7200), F.lit(z + 4000)) for z in (-2000, 2000))
    assert p.where((geo.to_ring(F.col("x"), F.col("z"), one) != 0) | (geo.to_ring(F.col("x"), F.col("z"), two) != 0)).count() == 0


def test_equal_ways_over_blocks(spark):
    """Of equal ways, the one that the walk back meets first, wherever blocks begin: the same for all block sizes."""
    from quadrille.operators.corridors import track_corridors

    rng = random.Random(11)
    rows = [(t, pos, rng.choice([0, 1, 2, 3, None]), seg, rng.randrange(5) / 10) for t in range(40) for pos in range(17) for seg in (1, 2)]
    candidates = spark.createDataFrame(rows, "track long, pos long, partner long, seg long, score double")
    whole, cut = ({tuple(r) for r in track_corridors(candidates, block=n).collect()} for n in (64, 3))
    assert len(whole) == 40 * 17 and cut == whole


def test_nearest_meets_few_targets_where_they_lie_thick(spark, monkeypatch):
    rng = random.Random(2)
    targets = [(i, float(rng.randrange(100)), float(rng.randrange(100))) for i in range(400)]
    points = [(i, float(rng.randrange(140)), float(rng.randrange(100))) for i in range(80)]
    near_pairs, reach = spatial.near_pairs, []
    monkeypatch.setattr(spatial, "near_pairs", lambda *a: reach.append(a[-1]) or near_pairs(*a))
    p, t = spark.createDataFrame(points, "p long, x double, z double"), spark.createDataFrame(targets, "t long, tx double, tz double")
    order = {i: sorted((((x - tx) ** 2 + (z - tz) ** 2) ** 0.5, k) for k, tx, tz in targets) for i, x, z in points}
    found = {r["p"]: r["t"] for r in spatial.nearest(p, t, "p", "t", 30.0).collect()}
    assert found == {i: d[0][1] for i, d in order.items() if d[0][0] <= 30} and reach[0] < 10 and reach[-1] <= 30
    del reach[:]
    found = sorted((r["p"], r["rank"], r["t"]) for r in spatial.knn(p, t, "p", "t", 3, 90.0).collect())
    assert found == sorted((i, n, d[n - 1][1]) for i, d in order.items() for n in (1, 2, 3)) and reach[0] < 20


def test_in_any_asks_few_where_polygons_lie_thick(spark, monkeypatch):
    """Points in any of many polygons over each other: cells inside one need no test, and pairs are few."""
    rng = random.Random(9)
    rows = [(float(rng.randrange(-60, 60)), float(rng.randrange(-60, 60)), float(40 + rng.randrange(60)), i % 3 == 0) for i in range(150)]
    ring = lambda a, b: geo.rectangle(F.col("x0") + a, F.col("z0") + a, F.col("x0") + F.col("w") - b, F.col("z0") + F.col("w") - b)
    holes = F.when(F.col("holed"), F.array(ring(5.0, 5.0))).otherwise(F.array().cast("array<array<struct<x:double,z:double>>>"))
    parts = spark.createDataFrame(rows, "x0 double, z0 double, w double, holed boolean").select(ring(0.0, 0.0).alias("outer"), holes.alias("holes"))
    places = [(i, rng.randrange(-90, 190) / 1.0 + rng.choice([0.0, 0.5]), rng.randrange(-90, 190) / 1.0) for i in range(3000)]
    points = spark.createDataFrame(places, "p long, x double, z double")
    held = lambda x, z: any(x0 <= x < x0 + w and z0 <= z < z0 + w and not (h and x0 + 5 <= x < x0 + w - 5 and z0 + 5 <= z < z0 + w - 5) for x0, z0, w, h in rows)
    expected = {i for i, x, z in places if held(x, z)}
    for few in (spatial.FEW, 0):
        monkeypatch.setattr(spatial, "FEW", few)
        found = [r["p"] for r in spatial.in_any(points, parts, 7.0).collect()]
        assert set(found) == expected and len(found) < 3 * len(expected)


def scattered(spark, n, seed):
    """Points of a few places each, some of them thick, as rows and as a table (id, x, z, v, k)."""
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(60) * (1 + i % 7)), float(rng.randrange(60) - 30), float(rng.randrange(9)), rng.choice(["a", "b", "c", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, z double, v double, k string")


def near_of(rows, radius):
    return {r[0]: [s for s in rows if s[0] != r[0] and ((r[1] - s[1]) ** 2 + (r[2] - s[2]) ** 2) ** 0.5 <= radius] for r in rows}


def no_pairs(df):
    """No join's output is larger than a few times the rows."""
    return "SortMergeJoin" not in df._jdf.queryExecution().toString()


def test_medians_of_near_points_without_pairs(spark, monkeypatch):
    from statistics import median

    from quadrille.operators import folds

    monkeypatch.setattr(spatial, "near_pairs", None)
    rows, points = scattered(spark, 400, 3)
    expected = {i: (median(s[3] for s in near), len(near)) for i, near in near_of(rows, 25.0).items() if near}
    for block in (1 << 20, 50):
        monkeypatch.setattr(folds, "BLOCK", block)
        found = folds.near_medians(points, "v", 25.0)
        assert no_pairs(found) and {r["id"]: (r["m"], r["c"]) for r in found.collect()} == expected


def test_kinds_of_near_points_without_pairs(spark):
    from quadrille.operators import matching

    rows, points = scattered(spark, 400, 4)
    expected = {i: len({s[4] for s in near} - {None}) for i, near in near_of(rows, 25.0).items()}
    stations = points.select(F.col("id").alias("station_id"), F.col("k").alias("operator"), "x", "z")
    found = matching.transfers(stations, 25.0)
    assert "_cx" not in found._jdf.queryExecution().toString() and {r["station_id"]: r["operators"] for r in found.collect()} == expected


def test_covered_boxes_without_pairs(spark):
    from quadrille.operators import folds

    rng = random.Random(6)
    box = lambda most: tuple((lambda x, z: (x, z, x + 1.0 + rng.randrange(most), z + 1.0 + rng.randrange(most)))(float(rng.randrange(-50, 50)), float(rng.randrange(-50, 50))))
    big, small = [(i, box(50)) for i in range(60)], [(box(9),) for _ in range(200)]
    kind = "struct<x0:double,z0:double,x1:double,z1:double>"
    found = folds.covered_by(spark.createDataFrame(big, f"id long, box {kind}"), spark.createDataFrame(small, f"box {kind}"), 10.0)
    shared = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    expected = {i: ([shared(a, b) > 0 for (b,) in small].count(True), sum(shared(a, b) for (b,) in small)) for i, a in big}
    assert no_pairs(found) and {r["id"]: (r["partners"], r["shared"]) for r in found.collect()} == {i: e for i, e in expected.items() if e[0]}


def test_pairs_are_dealt_over_all_tasks(spark):
    """Few rows that make many pairs are not folded in one task by their bytes."""
    p = spark.range(4000).select(F.col("id").alias("p"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("z"))
    q = p.select(F.col("p").alias("q"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    assert spatial.near_pairs(p, q, "x", "z", "bx", "bz", 3.0).rdd.getNumPartitions() == 4
    box = lambda x, z: F.struct(F.col(x).alias("x0"), F.col(z).alias("z0"), (F.col(x) + 2).alias("x1"), (F.col(z) + 2).alias("z1"))
    assert spatial.box_pairs(p.select(box("x", "z").alias("a")), q.select(box("bx", "bz").alias("b")), "a", "b", 5.0).rdd.getNumPartitions() == 4


def test_chains_by_few_edges(spark):
    """The edges connect what all pairs connect, and are few where points lie thick."""
    from quadrille.operators import folds, graph

    rows, points = scattered(spark, 500, 8)
    edges = folds.chain_edges(points, 6.0)
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = 0
    for a in rows:
        for b in rows:
            if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 < 6.0:
                n += 1
                low, high = sorted((find(a[0]), find(b[0])))
                root[high] = low
    found = {r["id"]: r["comp"] for r in graph.labelled(points, edges, "id").collect()}
    assert found == {i: find(i) for i in root} and 1 < len(set(found.values()))
    _, thick = scattered(spark, 500, 9)
    assert folds.chain_edges(thick, 40.0).count() < 1200


def test_ring_gaps_as_the_plain_expressions(spark):
    """Many pairs at a time give what the expressions give for each, for rings of any number of corners."""
    from quadrille.functions import kernels

    rng = random.Random(12)
    ring = lambda: [(float(rng.randrange(20)), float(rng.randrange(20))) for _ in range(rng.randrange(1, 6))]
    kind = "array<struct<x:double,z:double>>"
    rows = spark.createDataFrame([(i, ring(), ring()) for i in range(300)], f"i long, a {kind}, b {kind}")
    both = rows.select("i", geo.rings_apart(F.col("a"), F.col("b")).alias("apart"), geo.hausdorff(F.col("a"), F.col("b")).alias("hausdorff"), kernels.ring_gaps(kernels.flat(F.col("a")), kernels.flat(F.col("b"))).alias("d"))
    for r in both.collect():
        assert abs(r["apart"] - r["d"]["apart"]) < 1e-9 and abs(r["hausdorff"] - r["d"]["hausdorff"]) < 1e-9, r


def test_ring_distances_are_taken_many_at_a_time(spark):
    from quadrille.plans import catalogue

    plan = catalogue.QUERIES["q_10_10_ring_distances"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan or "ArrowPythonUDF" in plan or "gaps(" in plan


def test_edge_partners_without_pairs(spark, monkeypatch):
    """Partners and crossed links as plain loops find them, with no row for a pair of segments."""
    from math import hypot

    from quadrille.operators import folds, matching

    rng = random.Random(13)
    rows = [(i, [(float(x + rng.randrange(-40, 40)), float(z + rng.randrange(-40, 40))) for _ in range(4)]) for i, (x, z) in enumerate((rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(120))]
    lines = spark.createDataFrame(rows, "line_id long, points array<struct<x:double,z:double>>")
    segments = {tuple(r["seg"]): [tuple(p) for p in r["coords"]] for r in matching.edge_segments(lines).collect()}

    def facts(a, b):
        (px, pz), (qx, qz), (rx, rz), (sx, sz) = segments[a][0], segments[a][-1], segments[b][0], segments[b][-1]
        la, lb = hypot(qx - px, qz - pz) or 1.0, hypot(sx - rx, sz - rz) or 1.0
        ux, uz, vx, vz = (qx - px) / la, (qz - pz) / la, (sx - rx) / lb, (sz - rz) / lb
        far, parallel = hypot((px + qx - rx - sx) / 2, (pz + qz - rz - sz) / 2), abs(ux * vx + uz * vz)
        a0, a1 = sorted((px * ux + pz * uz, qx * ux + qz * uz))
        b0, b1 = sorted((rx * ux + rz * uz, sx * ux + sz * uz))
        overlap = min(1.0, max(0.0, min(a1, b1) - max(a0, b0)) / (min(a1 - a0, b1 - b0) or 1.0))
        return int((0.32 * parallel + 0.28 * overlap + 0.2 * (1.0 if 4 <= far <= 35 else 0.65) + 0.2 * 0.6) * 1000 + 0.5) if 3 <= far <= 45 and parallel >= 0.75 and overlap >= 0.35 else None

    pairs = {(a, b): f for a in segments for b in segments if a[0] != b[0] and (f := facts(a, b)) is not None}
    best = {a: min((-f, b) for (c, b), f in pairs.items() if c == a)[1] for a, _ in pairs}
    back = {b: min((-f, a) for (a, c), f in pairs.items() if c == b)[1] for _, b in pairs}
    monkeypatch.setattr(matching, "box_pairs", None, raising=False)
    for block in (1 << 20, 40):
        monkeypatch.setattr(folds, "BLOCK", block)
        found = matching.edge_verdicts(lines).collect()
        assert {tuple(r["a"]): (tuple(r["b"]), r["mutual"]) for r in found} == {a: (b, back[b] == a) for a, b in best.items()}
        assert len({r["crossed"] for r in found}) == 2


def test_edge_partners_look_at_few_directions(monkeypatch):
    """Where segments lie thick, partners are those of all pairs, and few pairs are scored; so with crossed links."""
    import numpy as np
    import pandas as pd

    from quadrille.operators import matching

    rng = np.random.default_rng(17)
    n = 1500
    middle, turn, half = rng.integers(50, 250, (n, 2)), rng.uniform(0, 2 * np.pi, n), rng.uniform(20, 90, n)
    step = np.stack([np.cos(turn), np.sin(turn)], axis=1) * half[:, None]
    p, q = np.round(middle - step), np.round(middle + step)
    rows = pd.DataFrame({"cell": 0, "parent": np.arange(n), "n": 0, "flags": 7, "px": p[:, 0], "pz": p[:, 1], "qx": q[:, 0], "qz": q[:, 1], "ex": np.nan, "ez": np.nan})
    facts, looked = matching._facts, []
    monkeypatch.setattr(matching, "_facts", lambda a, i, *rest: looked.append(len(i)) or facts(a, i, *rest))
    found = matching._verdicts(rows.sample(frac=1, random_state=1))

    m, d = (p + q) / 2, np.hypot(*(q - p).T)
    u = (q - p) / d[:, None]
    s = {"from": (p * u).sum(axis=1), "to": (q * u).sum(axis=1)} | {f"{k}{c}": v[:, e] for k, v in (("p", p), ("q", q), ("u", u)) for e, c in enumerate("xz")}
    i, j = (v.ravel() for v in np.indices((n, n)))
    far, parallel = ((m[i] - m[j]) ** 2).sum(axis=1), np.abs((u[i] * u[j]).sum(axis=1))
    near = (far >= 9) & (far <= 2025) & (i != j)
    score, overlap = facts(s, i, s, j, parallel, far)
    i, j, score = (v[near & (parallel >= 0.75) & (overlap >= 0.35)] for v in (i, j, score))
    pairs = pd.DataFrame({"i": i, "j": j, "score": -score})
    best = pairs.sort_values(["score", "j"]).groupby("i")["j"].first()
    back = pairs.sort_values(["score", "i"]).groupby("j")["i"].first()
    assert dict(zip(found["parent"], found["o_parent"])) == best.to_dict() and len(best) > 1400
    assert list(found["mutual"]) == [back[b] == a for a, b in zip(found["parent"], found["o_parent"])] and found["mutual"].any()
    assert sum(looked) < near.sum() / 4

    def meets(a, b):
        (x, z), (lx, lz) = m[a], m[b] - m[a]
        det = lx * (q - p)[:, 1] - lz * (q - p)[:, 0]
        dx, dz, ok = p[:, 0] - x, p[:, 1] - z, np.abs(det) >= 1e-9
        det = np.where(ok, det, 1.0)
        t, v = (dx * (q - p)[:, 1] - dz * (q - p)[:, 0]) / det, (dx * lz - dz * lx) / det
        ok[[a, b]] = False
        return bool((ok & (t > 0.05) & (t < 0.95) & (v > 0.05) & (v < 0.95)).any())

    assert list(found["crossed"]) == [meets(a, b) for a, b in zip(found["parent"], found["o_parent"])] and not found["crossed"].all()


def test_edge_claims_by_number(spark):
    """Segments are taken by the number of their line, below zero and of any size too."""
    from quadrille.operators import matching

    side = "struct<parent:long,n:int>"
    for far in (0, 1 << 62):
        rows = [((-12, 0), (-5, 0), "high"), ((-5, 0), (3, 0), "high"), ((3, 0), (-12, 0), "high"), ((4 + far, 1), (3, 0), "reject"), ((5 + far, 0), (4 + far, 1), "low")]
        found = matching.claim_edges(spark.createDataFrame(rows, f"a {side}, b {side}, confidence string")).collect()
        assert sorted(tuple(r["a"]) for r in found) == [(-12, 0), (4 + far, 1)]


def test_samples_of_a_shape_are_no_rows(spark):
    _, parts = squares(spark, 30, 90)
    areas = parts.select("ward_id", F.array(F.struct("outer", "holes"), F.struct(geo.rectangle(F.lit(-50), F.lit(-50), F.lit(-20), F.lit(-20)).alias("outer"), F.array(geo.rectangle(F.lit(-40), F.lit(-40), F.lit(-30), F.lit(-30))).alias("holes"))).alias("polygons"))
    shapes = [(i, [(x, z), (x + 60.0, z + 5.0), (x + 10.0, z + 70.0)]) for i, (x, z) in enumerate((float(i * 13 % 150 - 60), float(i * 29 % 150 - 60)) for i in range(25))]
    found = spatial.sampled_share(spark.createDataFrame(shapes, "s long, ring array<struct<x:double,z:double>>"), areas, 40.0, "s", 9)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 4
    box = {r["ward_id"]: [(r["box"]["x0"], r["box"]["z0"], r["box"]["x1"], r["box"]["z1"])] for r in parts.collect()}
    expected = {}
    for s, ring in shapes:
        (x0, z0), (x1, z1) = (tuple(f(c) for c in zip(*ring)) for f in (min, max))
        side = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        at = [(x0 + (i + 0.5) / 9 * (x1 - x0), z0 + (j + 0.5) / 9 * (z1 - z0)) for i in range(9) for j in range(9)]
        at = [p for p in at if all(side(p, a, b) > 0 for a, b in zip(ring, ring[1:] + ring[:1]))]
        for w, ((a, b, c, d),) in box.items():
            n = sum((a <= x < c and b <= z < d) + (-50 <= x < -20 and -50 <= z < -20 and not (-40 <= x < -30 and -40 <= z < -30)) for x, z in at)
            if n:
                expected[s, w] = (n, round(n / len(at), 9))
    assert {(r["s"], r["ward_id"]): (r["n"], round(r["share"], 9)) for r in found.collect()} == expected


def test_touching_without_pairs(spark, monkeypatch):
    """Parts of one group that points as far apart as the radius connect too, and those of another group do not."""
    from quadrille.operators import folds, forest

    rng = random.Random(14)
    rows = [(f"g{i % 3}" if i % 11 else None, i // 2 * 6 + i % 3, float(rng.randrange(40) * 5), float(rng.randrange(40) * 5)) for i in range(400)]
    rows = [(g if (p % 6) == int((g or "g0")[1]) else None, p, x, z) for g, p, x, z in rows]
    root = {r[1]: r[1] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in rows:
        for b in rows:
            if a[0] is not None and a[0] == b[0] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 225:
                low, high = sorted((find(a[1]), find(b[1])))
                root[high] = low
    points = spark.createDataFrame(rows, "grp string, part long, x double, z double")
    monkeypatch.setattr(spatial, "near_pairs", None)
    for block in (1 << 20, 3):
        monkeypatch.setattr(folds, "BLOCK", block)
        assert {r["part"]: r["comp"] for r in forest.touching(points, 15.0).collect()} == {i: find(i) for i in root}


def test_near_lines_are_counted_not_joined(spark, monkeypatch):
    from quadrille.operators import folds, network

    rng = random.Random(15)
    place = lambda: (float(rng.randrange(40) * 5), float(rng.randrange(40) * 5))
    rows = [(f"r{i % 2}", i, [place(), place()]) for i in range(120)]
    lines = spark.createDataFrame(rows, "river string, line_id long, points array<struct<x:double,z:double>>")
    near = lambda p, q: any((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 225 for a in p for b in q)
    expected = {i: n for r, i, p in rows if (n := sum(s == r and i != j and near(p, q) for s, j, q in rows))}
    monkeypatch.setattr(spatial, "near_pairs", None)
    monkeypatch.setattr(network, "near_pairs", None, raising=False)
    ends = lines.select("river", F.col("line_id").alias("id"), F.element_at("points", 1).alias("first"), F.element_at("points", -1).alias("last"))
    for block in (1 << 20, 30):
        monkeypatch.setattr(folds, "BLOCK", block)
        assert {r["id"]: r["n"] for r in folds.near_lines(ends, 15.0, "river").collect()} == expected
    walks = [r for r in network.river_chains(lines, joined=15.0).collect() if r["chain"] is not None]
    assert {r["line_id"] for r in walks} == set(expected)


def test_near_lines_are_counted_by_squares(monkeypatch):
    """Only lines about a radius away are looked at one by one; far ends, single places and missing ends count as they should."""
    import numpy as np

    from quadrille.operators import folds

    rng, looked, within = np.random.default_rng(18), [], folds.within
    monkeypatch.setattr(folds, "within", lambda dx, dz, radius: looked.append(len(dx)) or within(dx, dz, radius))
    for n, span, radius in ((3000, 2400, 300.0), (300, 40, 5.0), (200, 3, 2.0), (1, 5, 1.0), (60, 10**7, 50.0)):
        first = rng.integers(0, span, (n, 2)).astype(float)
        lines = np.hstack([first, first + rng.integers(-20, 20, (n, 2))])
        lines[::50, 2:] += span
        del looked[:]
        found = folds.count_near(lines, lines, radius)
        near = np.zeros((n, n), bool)
        for e in (0, 2):
            for f in (0, 2):
                near |= np.hypot(lines[:, None, e] - lines[:, f], lines[:, None, e + 1] - lines[:, f + 1]) <= radius
        assert (found == near.sum(axis=1)).all()
        if n == 3000:
            assert sum(looked) < 4 * n * n / 3


def test_lines_without_an_end(spark):
    """A line with one known end is near by that one, and is counted once."""
    from quadrille.operators import folds

    place = lambda x: None if x is None else {"x": float(x), "z": 0.0}
    rows = [("r", 1, place(0), place(500)), ("r", 2, None, place(4)), ("r", 3, place(503), None), ("r", 4, None, None), ("s", 5, place(1), place(2)), ("r", 6, place(2), place(3))]
    lines = spark.createDataFrame(rows, "river string, id long, first struct<x:double,z:double>, last struct<x:double,z:double>")
    assert {r["id"]: r["n"] for r in folds.near_lines(lines, 10.0, "river").collect()} == {1: 3, 2: 2, 3: 1, 6: 2}


def test_a_walk_of_many_lines_looks_at_few():
    """As the plain loop walks, and 30,000 lines of one component within seconds."""
    import time

    import numpy as np

    from quadrille.operators import network

    def plain(first, last, degree, joined):
        free, chains = list(range(len(first))), []
        near = lambda i, p: np.hypot(*(first[i] - p)) <= joined or np.hypot(*(last[i] - p)) <= joined
        on = lambda p: next((i for i in free if near(i, p)), None)
        for start in sorted(free, key=lambda i: (degree[i], i)):
            part, chain, came = start if start in free else None, [], None
            while part is not None:
                free.remove(part)
                turned = np.hypot(*(last[part] - came)) < np.hypot(*(first[part] - came)) if came is not None else on(first[part]) is not None and on(last[part]) is None
                chain.append((part, bool(turned)))
                came = first[part] if turned else last[part]
                part = on(came)
            if chain:
                chains.append(chain)
        return chains

    rng = np.random.default_rng(19)
    for n, span, joined in ((150, 300, 30.0), (80, 20, 15.0), (40, 5, 0.0), (60, 10**6, 90_000.0), (1, 1, 5.0)):
        first = rng.integers(0, span, (n, 2)).astype(float)
        last, degree = first + rng.integers(-9, 9, (n, 2)), rng.integers(0, 5, n)
        assert network._walks(first, last, degree, joined) == plain(first, last, degree, joined)
    first = rng.uniform(0, 24_000, (30_000, 2))
    began = time.process_time()
    chains = network._walks(first, first + rng.uniform(-200, 200, first.shape), rng.integers(0, 99, len(first)), 3000.0)
    assert sum(map(len, chains)) == len(first) and time.process_time() - began < 15


def test_nearest_targets_without_pairs(spark, monkeypatch):
    from quadrille.operators import folds, resolve

    rng = random.Random(16)
    points = [(i, float(rng.randrange(60)), float(rng.randrange(60)), rng.choice(["a", "b", "c", None])) for i in range(150)]
    targets = [(i, float(rng.randrange(60)), float(rng.randrange(60)), "abb"[i % 3] if i else "c") for i in range(60)]
    p, t = spark.createDataFrame(points, "point_id long, x double, z double, k string"), spark.createDataFrame(targets, "target_id long, tx double, tz double, k string")
    far = {i: sorted((((x - tx) ** 2 + (z - tz) ** 2) ** 0.5, j, k == q) for j, tx, tz, q in targets) for i, x, z, k in points}
    for block in (1 << 20, 70):
        monkeypatch.setattr(folds, "BLOCK", block)
        found = folds.two_nearest(p, t, ["k"])
        assert no_pairs(found) and sorted((r["point_id"], r["target_id"]) for r in found.collect()) == sorted((i, j) for i, f in far.items() for _, j, _ in [v for v in f if v[2]][:2])
        single = {r["point_id"]: (r["target_id"], r["reason"]) for r in resolve.single_near(p, t, 5.0).collect()}
        near = {i: [j for d, j, _ in f if d <= 5] for i, f in far.items()}
        assert single == {i: (n[0], "unique") if len(n) == 1 else (None, "ambiguous" if n else "none-nearby") for i, n in near.items()}


def test_short_groups_are_rows_of_a_task(spark):
    """Rings of a relation and widths of a river: no group of its own in a Python worker, and dealt over all tasks."""
    from quadrille.plans import catalogue

    for name in ("q_10_16_assembled_rings", "q_6_03_smoothed_widths"):
        found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString() and found.rdd.getNumPartitions() == 4
