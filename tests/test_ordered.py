"""Queries whose result depends on an order, against plain loops over the same rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators import corridors, forest, matching, network, prefixes, rounds, sequential
from quadrille.operators.graph import components
from quadrille.plans import catalogue, views
from quadrille.storage import stored

SF = "/root/testdata/sf0.01"


def test_recovered_duplicates(spark):
    rows = []
    for i, df in enumerate((views.rects(spark, SF), views.rects_b(spark, SF))):
        rows += [(r["rect_id"] * 2 + i, r["x0"], r["z0"], r["x1"], r["z1"], r["area"]) for r in df.collect()]
    score = {k: 4 * (k % 3 == 0) + 2 * (k % 5 == 0) + area / 1e6 for k, *_, area in rows}
    rows.sort()
    lost = set()
    for i, (k, x0, z0, x1, z1, _) in enumerate(rows):
        for k2, a0, b0, a1, b1, _ in rows[i + 1 :]:
            if k in lost:
                break
            if k2 not in lost and min(x1, a1) > max(x0, a0) and min(z1, b1) > max(z0, b0):
                lost.add(k2 if score[k] >= score[k2] else k)
    found = {r["id"] for r in catalogue.QUERIES["q_4_21_recovered_duplicates"](spark, SF).collect()}
    assert found == {k for k, *_ in rows} - lost and 0 < len(lost)


def claims(verdicts):
    used, rejected, out = set(), set(), []
    for a, b, confidence in sorted(verdicts):
        if a in used | rejected or b in used | rejected:
            continue
        (rejected if confidence == "reject" else used).add(a)
        if confidence != "reject":
            used.add(b)
        out.append((a, b, confidence))
    return sorted(out)


def test_edge_claims(spark):
    key = lambda text: tuple(map(int, text.split("#")))
    read = lambda name: sorted((key(r["a"]), key(r["b"]), r["confidence"]) for r in catalogue.QUERIES[name](spark, SF).collect())
    verdicts = read("q_4_37_edge_verdicts")
    assert len({c for *_, c in verdicts}) > 1
    assert read("q_4_37_edge_claims") == claims(verdicts)


def test_edges_across_a_road(spark):
    """Two edges of a road pair up; a third line between them crosses the link; where three lines meet, confidence drops."""
    line = lambda *points: [(float(x), float(z)) for x, z in points]
    schema = "line_id long, points array<struct<x:double,z:double>>"
    road = [(1, line((0, 0), (40, 0))), (2, line((0, 10), (40, 10)))]
    one = lambda rows: {(r["a"]["parent"], r["b"]["parent"]): r["confidence"] for r in matching.edge_verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert one(road) == {(1, 2): "high", (2, 1): "high"}
    assert one([*road, (3, line((15, 2), (25, 8)))])[1, 2] == "reject"
    meet = [(4, line((20, 5), (20, 300))), (5, line((20, 5), (300, 5))), (6, line((20, 5), (-300, -90)))]
    assert set(one([*road, *meet]).values()) <= {"medium", "reject", "low"}
    cut = matching.edge_segments(spark.createDataFrame([(7, line(*((7 * i, 0) for i in range(12)))), (8, line((0, 0), (0, 50))), (9, line((0, 0)))], schema)).collect()
    assert sorted((r["parent"], r["n"], len(r["coords"])) for r in cut) == [(7, 0, 6), (7, 1, 6), (7, 2, 2), (8, 0, 2)]


def test_star_of_a_million_edges(spark, monkeypatch):
    """A hub's edges are not one task's work: the largest task of the join has a small share of them."""
    from quadrille.operators.graph import _with_least

    n = 1_000_000
    edges = spark.range(1, n + 1, numPartitions=16).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        parts = _with_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in parts) == n and max(r["count"] for r in parts) <= n / 16
    found = components(edges)
    assert found.count() == n + 1 and found.where("comp <> 0").isEmpty()


def points_of(spark):
    return sorted((r["point_id"], r["x"], r["z"], r["segment"]) for r in views.pts(spark, SF).collect())


def without_contained(items, radius):
    """The rule as a plain loop: (id, name, category, x, z) in order."""
    gone = set()
    for i, (a, name, kind, x, z) in enumerate(items):
        if a in gone:
            continue
        for b, name2, kind2, x2, z2 in items[i + 1 :]:
            if b in gone or kind != kind2 or not (name in name2 or name2 in name) or ((x - x2) ** 2 + (z - z2) ** 2) ** 0.5 >= radius:
                continue
            gone.add(b if len(name) >= len(name2) else a)  # an item that goes meets its later partners all the same
    return {a for a, *_ in items} - gone


def test_greedy_dedupe_of_the_query(spark):
    stems = ["中央小学校前広場", "みなと図書館分館北", "Kita Park Hall"]
    items = [(a, stems[a % 3][: 2 + a % 7], s, x, z) for a, x, z, s in points_of(spark)]
    found = {r["id"] for r in catalogue.QUERIES["q_4_44_greedy_dedupe"](spark, SF).collect()}
    assert found == without_contained(items, 900) and len(found) < len(items)


def facilities(spark, rows):
    return spark.createDataFrame([(a, a, *r) for a, *r in rows], "id long, ord long, name string, category string, x double, z double")


def test_contained_names(spark):
    """One that goes still takes a later, shorter neighbour with it; what one lost to counts only while it is there."""
    near_it = [(1, "town hall", "c", 0.0, 0.0), (2, "old town hall", "c", 80.0, 0.0), (3, "hall", "c", -80.0, 0.0)]
    assert without_contained(near_it, 100) == {2}
    rng = random.Random(7)
    cases = [near_it, [*near_it, (4, None, "c", 0.0, 0.0), (5, "hall", None, 0.0, 0.0), (6, "hall", "d", 0.0, 0.0)]]
    cases += [[(i, "abcdefgh"[: rng.randrange(1, 9)], rng.choice("cd"), float(rng.randrange(300)), float(rng.randrange(300))) for i in range(60)] for _ in range(2)]
    for rows in cases:
        plain = without_contained([r for r in rows if None not in r], 100) | {r[0] for r in rows if None in r}
        assert {r["id"] for r in sequential.contained_names(facilities(spark, rows)).collect()} == plain


@pytest.mark.parametrize("pairs", [None, 400])
def test_near_items_by_prefixes(spark, monkeypatch, pairs):
    """Many prefixes, few pairs each, decide as one does; null keys are a key of their own."""
    if pairs:
        monkeypatch.setattr(prefixes, "LEAST", pairs)
        monkeypatch.setattr(prefixes, "PAIRS", 1)
    rng = random.Random(11)
    rows = [(i, "abcdefgh"[: rng.randrange(1, 9)], rng.choice("cd"), float(rng.randrange(400)), float(rng.randrange(400))) for i in range(300)]
    assert {r["id"] for r in sequential.contained_names(facilities(spark, rows)).collect()} == without_contained(rows, 100)
    kept = []
    for i, _, kind, x, z in rows:
        if all(k != kind or math.hypot(x - a, z - b) > 50 for _, k, a, b in kept):
            kept.append((i, kind, x, z))
    points = facilities(spark, rows).withColumn("category", F.when(F.col("category") == "c", "c"))
    assert sorted(r["id"] for r in sequential.anchors(points, "category", 50.0).collect()) == [i for i, *_ in kept]


def test_a_crowd_makes_no_row_for_each_pair(spark, monkeypatch):
    """20,000 items within reach of each other: 200 million pairs."""
    crowd = spark.range(20_000).select("id", F.col("id").alias("ord"), F.substring(F.lit("abcdefgh"), 1, 1).alias("name"), F.lit("c").alias("category"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("z"))
    crowd = crowd.withColumn("name", F.when(F.col("id") == 15_000, "ab").otherwise(F.col("name")))
    sizes = []

    def counted(df, label):
        out = stored(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rounds, "stored", counted)
    assert [r["id"] for r in sequential.anchors(crowd, "category", 50.0).collect()] == [0]
    assert [r["id"] for r in sequential.contained_names(crowd, 50.0).collect()] == [15_000]
    assert max(sizes) <= prefixes.LEAST


def test_settle(spark):
    """Random formulas over earlier variables, with literals that can never hold."""
    rng = random.Random(8)
    literals = [(i, rng.randrange(i) if rng.random() < 0.97 else None, rng.random() < 0.5) for i in range(1, 120) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    value = {}
    for i in range(120):
        value[i] = all(on is not None and value[on] == want for k, on, want in literals if k == i)
    found = rounds.settle(spark.range(120), spark.createDataFrame(literals, "id long, on long, want boolean"))
    assert {r["id"]: r["value"] for r in found.collect()} == value and len(set(value.values())) == 2
    with pytest.raises(RuntimeError):
        rounds.settle(spark.range(2), spark.createDataFrame([(0, 1, True), (0, 0, True), (1, 0, True), (1, 1, False)], "id long, on long, want boolean"), rounds=4)


def test_claims_with_a_crowded_segment(spark):
    """Many segments whose best partner is one and the same."""
    rng = random.Random(9)
    for _ in range(2):
        wishes = [(a, b, rng.random() < 0.7) for a in range(80) if (b := rng.choice([5, 5, 40, *range(80)])) != a]
        gone, kept = set(), []
        for a, b, takes in wishes:
            if a not in gone and b not in gone:
                gone |= {a, b} if takes else {a}
                kept.append(a)
        assert sorted(r["a"] for r in rounds.claims(spark.createDataFrame(wishes, "a long, b long, takes boolean")).collect()) == kept


def test_a_chain_of_a_hundred_thousand(spark):
    """Each item hangs on the one before: rounds grow with the logarithm of the chain, and no group is one task's."""
    n = 100_000
    items = spark.range(n).select("id", F.col("id").alias("ord"))
    kept = rounds.first_apart(items, spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    row = kept.agg(F.count("*").alias("n"), F.max(F.col("id") % 2).alias("odd")).first()
    assert (row["n"], row["odd"]) == (n // 2, 0)
    plan = kept._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_greedy_chain(spark):
    """The same for pairs: the earlier one wins, then the later."""
    n = 3_000
    for sign, expected in ((-1, set(range(0, n, 2))), (1, {n - 1})):
        items = spark.range(n).select("id", F.col("id").alias("ord"), (sign * F.col("id")).alias("rank"))
        kept = rounds.greedy_dedupe(items, spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        assert {r["id"] for r in kept.collect()} == expected


def test_anchors_of_the_query(spark):
    kept = {}
    for i, x, z, s in points_of(spark):
        own = kept.setdefault((s, i % 20), [])
        if all(((x - a) ** 2 + (z - b) ** 2) ** 0.5 > 4500 for _, a, b in own):
            own.append((i, x, z))
    found = sorted(r["id"] for r in catalogue.QUERIES["q_6_09_anchors"](spark, SF).collect())
    assert found == sorted(i for own in kept.values() for i, *_ in own)


def test_smoothed_widths_of_the_query(spark):
    import statistics

    raw = {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey", (F.floor(F.col("o_totalprice") / 1000) + 5).cast("double").alias("w")).collect():
        raw.setdefault(r["o_custkey"], []).append((r["o_orderkey"], r["w"]))
    expected = {}
    for key, rows in raw.items():
        rows.sort()
        w = [v for _, v in rows]
        middle, n = statistics.median(w), len(w)
        off = lambda v, by, most: v / by > most or v / by < 1 / most
        for i in range(n if n >= 3 else 0):
            if i in (0, n - 1):
                other = w[1] if i == 0 else w[i - 1]
                w[i] = (w[i] + other) / 2 if off(w[i], other, 2.1) else w[i]
                w[i] = (w[i] + middle) / 2 if off(w[i], middle, 2.6) else w[i]
            else:
                pair = sorted((w[i - 1], w[i + 1]))
                if pair[1] / pair[0] < 1.8 and off(w[i], sum(pair) / 2, 1.8):
                    w[i] = sum(pair) / 2
        expected.update({(key, k): v for (k, _), v in zip(rows, w)})
    found = {(r["river"], r["pos"]): r["width"] for r in catalogue.QUERIES["q_6_03_smoothed_widths"](spark, SF).collect()}
    assert found == pytest.approx(expected)


def lines_of(spark):
    return {r["line_id"]: [(p["x"], p["z"]) for p in r["points"]] for r in views.lines(spark, SF).collect()}


def test_thinned_lines_of_the_query(spark):
    def keep(p):
        if len(p) < 3:
            return p
        (ax, az), (bx, bz) = p[0], p[-1]
        n = max((bx - ax) ** 2 + (bz - az) ** 2, 1e-9)
        far = []
        for x, z in p[1:-1]:
            t = min(1, max(0, ((x - ax) * (bx - ax) + (z - az) * (bz - az)) / n))
            far.append((x - ax - t * (bx - ax)) ** 2 + (z - az - t * (bz - az)) ** 2)
        i = far.index(max(far))
        return keep(p[: i + 2])[:-1] + keep(p[i + 1 :]) if far[i] > 3600 else [p[0], p[-1]]

    found = {r["line_id"]: (r["before"], r["after"]) for r in catalogue.QUERIES["q_10_12_thinned_lines"](spark, SF).collect()}
    assert found == {k: (len(p), len(keep(p))) for k, p in lines_of(spark).items()}


def test_river_gaps_of_the_query(spark):
    """The gaps of a least spanning tree, grown from one line instead of sorted by length."""
    rivers = {}
    for k, p in lines_of(spark).items():
        if len(p) >= 2:
            rivers.setdefault(f"r{k % 120}", []).append((p[0], p[-1]))
    expected = []
    for river, ends in rivers.items():
        dist = lambda a, b: min(((x - u) ** 2 + (z - v) ** 2) ** 0.5 for x, z in a for u, v in b)
        best = {i: dist(ends[0], e) for i, e in enumerate(ends) if i}
        while best:
            i = min(best, key=best.get)
            if (d := best.pop(i)) > 3000:
                expected.append((river, d))
            for j in best:
                best[j] = min(best[j], dist(ends[i], ends[j]))
    found = sorted((r["river"], r["gap"]) for r in catalogue.QUERIES["q_5_17_river_gaps"](spark, SF).collect())
    assert [r for r, _ in found] == [r for r, _ in sorted(expected)] and [g for _, g in found] == pytest.approx([g for _, g in sorted(expected)], abs=1e-3)


def chains_by_the_rule(parts, tol):
    """Chains and single parts of one river: parts (id, first end, last end) by id."""
    gap = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    n = len(parts)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            for e in (0, 1):
                for f in (0, 1):
                    if gap(parts[i][1 + e], parts[j][1 + f]) <= tol:
                        links[i].append((j, e))
                        links[j].append((i, f))
    used, chains, single = set(), [], []
    for start in sorted(range(n), key=lambda i: len({j for j, _ in links[i]})):
        if start in used:
            continue
        if not links[start]:
            used.add(start)
            single.append(parts[start][0])
            continue
        chain, now, out = [], start, None
        while now is not None and now not in used:
            used.add(now)
            _, first, last = parts[now]
            if out is not None:
                flip = gap(last, out) < gap(first, out)
            else:
                flip = any(j not in used and e == 0 for j, e in links[now]) and not any(j not in used and e == 1 for j, e in links[now])
            chain.append((parts[now][0], flip))
            out = first if flip else last
            now = next((j for j, _ in links[now] if j not in used and min(gap(parts[j][1], out), gap(parts[j][2], out)) <= tol), None)
        chains.append(chain)
    return chains, single


def as_chains(rows):
    chains, single = {}, []
    for r in sorted(rows, key=lambda r: (r["chain"] is not None, r["chain"], r["pos"], r["line_id"])):
        if r["chain"] is None:
            single.append(r["line_id"])
        else:
            chains.setdefault(r["chain"], []).append((r["line_id"], r["turned"]))
    return [chains[k] for k in sorted(chains)], sorted(single)


def test_river_chains_of_the_query(spark):
    rivers, found = {}, {}
    for k, p in sorted(lines_of(spark).items()):
        if len(p) >= 2:
            rivers.setdefault(f"r{k % 120}", []).append((k, p[0], p[-1]))
    for r in catalogue.QUERIES["q_6_07_river_chains"](spark, SF).collect():
        found.setdefault(r["river"], []).append(r)
    assert {k: as_chains(v) for k, v in found.items()} == {k: (c, sorted(s)) for k, v in rivers.items() for c, s in [chains_by_the_rule(v, 3000)]}
    assert all([c for c, _ in [as_chains(v)]] for v in found.values())


def test_river_gaps_and_chains(spark):
    """Gaps are the edges of a least spanning tree between the pieces; a line without neighbours is in no chain."""
    line = "line_id long, river string, points array<struct<x:double,z:double>>"
    rivers = spark.createDataFrame([(1, "r", [(0.0, 0.0), (10.0, 0.0)]), (2, "r", [(15.0, 0.0), (30.0, 0.0)]), (3, "r", [(130.0, 0.0), (150.0, 0.0)]), (4, "s", [(0.0, 5.0), (9.0, 5.0)]), (5, None, [(0.0, 5.0), (9.0, 5.0)]), (6, "s", [])], line)
    gaps = network.river_gaps(rivers, joined=60.0)
    assert [(r["river"], r["a"], r["b"], round(r["gap"], 6)) for r in gaps.collect()] == [("r", 2, 3, 100.0)]
    chains = [r.asDict() for r in network.river_chains(rivers, joined=60.0).collect()]
    assert Counter(c["line_id"] for c in chains) == Counter([1, 2, 3, 4, 5]) and {c["line_id"] for c in chains if c["chain"] is None} == {3, 4, 5}
    audit = {r["river"]: (r["segments"], r["components"], r["gaps"], r["max_gap"], r["total_length"]) for r in network.river_continuity(rivers, gaps).collect()}
    assert audit == {"r": (3, 2, 1, 100.0, 45), "s": (1, 1, 0, 0.0, 9), None: (1, 1, 0, 0.0, 9)}
    cause = lambda *v: spark.range(1).select(network.gap_cause(*map(F.lit, v)).alias("c")).first()["c"]
    assert [cause(80.0, True, 5.0), cause(81.0, True, 5.0), cause(81.0, False, 119.0), cause(401.0, False, 120.0), cause(400.0, False, None)] == list("ADCBE")
    fork = spark.createDataFrame([(1, "r", [(0.0, 0.0), (1000.0, 0.0)]), (2, "r", [(1050.0, 0.0), (2000.0, 0.0)]), (3, "r", [(1005.0, 0.0), (1005.0, 900.0)])], line)
    assert as_chains(network.river_chains(fork).collect()) == ([[(1, False), (2, False)], [(3, False)]], [])


def test_spanning_forest(spark):
    """Against a tree grown part by part, with equal distances, several points a part, and far pieces."""
    rng = random.Random(10)
    rows = [(f"g{g}", 100 * g + k, float(rng.randrange(40) * 7 + far), float(rng.randrange(40) * 7)) for g in range(3) for k in range(30) for far in [0 if k < 25 else 90_000] for _ in range(rng.choice([1, 2, 3]))]
    points = spark.createDataFrame([*rows, (None, 999, 0.0, 0.0), ("g0", 7000, None, 1.0)], "grp string, part long, x double, z double")
    own = {}
    for g, k, x, z in rows:
        own.setdefault(g, {}).setdefault(k, []).append((x, z))
    expected = []
    for g, parts in own.items():
        edges = sorted((min((x - u) ** 2 + (z - v) ** 2 for x, z in parts[a] for u, v in parts[b]), b, a) for a in parts for b in parts if a < b)
        up = {k: k for k in parts}
        for d2, b, a in edges:
            ends = [a, b]
            for i in (0, 1):
                while up[ends[i]] != ends[i]:
                    ends[i] = up[ends[i]]
            if ends[0] != ends[1]:
                up[ends[0]] = ends[1]
                if d2 > 25 * 25:
                    expected.append((g, a, b, d2))
    found = forest.spanning_forest(points, forest.touching(points, 25.0), 25.0)
    assert sorted(map(tuple, found.collect())) == sorted(expected) and len(expected) > 10


def test_anchors(spark):
    """Of labels with one name, those within reach of a better one go."""
    rows = [(1, "a", 0.0, 0.0, 5.0), (2, "a", 100.0, 0.0, 9.0), (3, "a", 700.0, 0.0, 1.0), (4, "b", 50.0, 0.0, 1.0)]
    kept = {}
    for i, name, x, z, rank in sorted(rows, key=lambda r: -r[4]):
        if all(((x - a) ** 2 + (z - b) ** 2) ** 0.5 > 450 for a, b in kept.get(name, [])):
            kept.setdefault(name, []).append((x, z))
    items = spark.createDataFrame([(i, name, x, z, -rank) for i, name, x, z, rank in rows], "id long, name string, x double, z double, ord double")
    found = [r["id"] for r in sequential.anchors(items, "name", 450.0).collect()]
    assert sorted(found) == [2, 3, 4] and len(found) == sum(map(len, kept.values()))


@pytest.mark.parametrize("box,expected", [((0, 0, 2, 2), 0.0), ((5, 0, 6, 1), 4.0), ((4, 5, 6, 7), 5.0)])
def test_rings_apart(spark, box, expected):
    a, b = geo.rectangle(*map(F.lit, (0, 0, 1, 1))), geo.rectangle(*map(F.lit, box))
    assert spark.range(1).select(geo.rings_apart(a, b).alias("d")).first()["d"] == expected


def test_request_windows_of_the_query(spark):
    """Per user: a window of an hour opens with the first request after the last one's end and admits two; forty in all."""
    rows = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("long").alias("t"), "ts").collect():
        rows.setdefault(r["user_id"], []).append((r["ts"], r["event_id"], r["t"]))
    expected = {}
    for user, events in rows.items():
        opened, here, done = None, 0, 0
        for _, i, t in sorted(events):
            if opened is None or t >= opened + 3600:
                opened, here = t, 0
            verdict = "session-limit" if done == 40 else "rate-limit" if here == 2 else "executed"
            here, done = here + (verdict == "executed"), done + (verdict == "executed")
            expected[user, i] = verdict
    found = {(r["user_id"], r["event_id"]): r["verdict"] for r in catalogue.QUERIES["q_11_01_request_windows"](spark, SF).collect()}
    assert found == expected


def plain_track(segments):
    """One track as a plain program: segments are lists of (score, seg, partner); returns (partner, seg) by segment."""
    best = [sorted(((-round(score * 1e6), seg, partner) for score, seg, partner in found))[:3] for found in segments]
    met = Counter(partner for found in best for *_, partner in found)
    first = {}
    for found in best:
        for *_, partner in found:
            first.setdefault(partner, len(first))
    states = [None, *sorted(met, key=lambda p: (-met[p], first[p]))[:10]]

    def local(i, state):
        if state is None:
            return -150_000, None
        return next(((-w, seg) for w, seg, partner in best[i] if partner == state), None)

    worth, back = [], []
    for i in range(len(segments)):
        row, come = [], []
        for state in states:
            here = local(i, state)
            before = [] if i == 0 or here is None else [(v - (550_000 if None not in (state, o) and state != o else 0), -k) for k, (v, o) in enumerate(zip(worth[-1], states)) if v is not None]
            row.append(None if here is None else here[0] + (max(before)[0] if before else 0))
            come.append(-max(before)[1] if before else 0)
        worth.append(row)
        back.append(come)
    at = max(range(len(states)), key=lambda k: (worth[-1][k] is not None, worth[-1][k] or 0, -k))
    path = []
    for i in reversed(range(len(segments))):
        path.append((states[at], local(i, states[at])[1]))
        at = back[i][at]
    return path[::-1]


def test_steps_against_all_paths():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        n, states = rng.integers(1, 6), rng.integers(2, 5)
        local = np.where(rng.random((n, states)) < 0.3, corridors.NEVER, rng.integers(0, 10**6, (n, states)))
        local[:, 0] = -150_000
        steps = corridors._segment_steps(list(local))
        enter = np.where(np.arange(states) == 0, 0, corridors.NEVER)
        worth = lambda path: sum(int(local[i, s]) for i, s in enumerate(path)) - 550_000 * sum(1 for a, b in zip(path, path[1:]) if a and b and a != b)
        best = max(map(worth, product(range(states), repeat=int(n))))
        assert corridors.after(enter, corridors.product(steps)).max() == best == worth(corridors.walk_back(enter, steps, None)[1])


@pytest.mark.parametrize("block", [2, 3, 7, 256])
def test_tracks_in_blocks(spark, block):
    """A track cut in blocks, and in blocks of blocks, gives the path of the plain program, equals included."""
    rng = random.Random(11)
    tracks = {t: [[(rng.randrange(10) / 10, seg, rng.randrange(12 if t == 2 else 4)) for seg in range(rng.randrange(5))] for _ in range(n)] for t, n in enumerate((1, 2, 90, 40))}
    rows = [(t, i, p, seg, score) for t, segments in tracks.items() for i, found in enumerate(segments) for score, seg, p in found or [(None, None, None)]]
    found = corridors.track_corridors(spark.createDataFrame(rows, "track long, pos long, partner long, seg long, score double"), block=block).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["track"], r["pos"])):
        got.setdefault(r["track"], []).append(r)
    for t, segments in tracks.items():
        path = plain_track(segments)
        assert [(r["partner"], r["seg"]) for r in got[t]] == path
        assert [r["switched"] for r in got[t]] == [False] + [None not in (a, b) and a != b for (a, _), (b, _) in zip(path, path[1:])]


def test_corridors_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey % 997 AS track", "l_orderkey div 997 AS pos", "l_suppkey % 5 AS partner", "l_linenumber AS seg", "floor(l_discount * 100) / 10 AS score").collect()
    tracks = {}
    for r in rows:
        here = tracks.setdefault(r["track"], {}).setdefault(r["pos"], [])
        if r["seg"] != 4:
            here.append((float(r["score"]), r["seg"], r["partner"]))
    got = {}
    for r in catalogue.QUERIES["q_6_06_corridors"](spark, SF).collect():
        got.setdefault(r["track"], {})[r["pos"]] = (r["partner"], r["seg"])
    assert {t: [p[k] for k in sorted(p)] for t, p in got.items()} == {t: plain_track([p[k] for k in sorted(p)]) for t, p in tracks.items()}


def test_landmarks_are_counted_as_they_are_listed(spark):
    """The same verdicts as from rows of pairs, with seeds and buildings without a height, and no row for a pair."""
    rng = random.Random(12)
    place = lambda: (float(rng.randrange(300)), float(rng.randrange(300)))
    seeds = spark.createDataFrame([(i, rng.choice([None, 20.0, 40.0, 900.0]), *place()) for i in range(60)], "seed_id long, height double, x double, z double")
    buildings = spark.createDataFrame([(i, rng.choice([None, 10.0, 24.0, 25.0, 38.0, 60.0]), *place()) for i in range(150)], "id long, dz double, x double, z double")
    pairs = seeds.select("seed_id", "x", "z").crossJoin(buildings.select("id", "dz", F.col("x").alias("bx"), F.col("z").alias("bz"))).withColumn("d", F.hypot(F.col("x") - F.col("bx"), F.col("z") - F.col("bz")))
    for holds, reach in ((8.0, 25.0), (5.0, 10.0), (30.0, 12.0)):
        listed = matching.landmarks(seeds.select("seed_id", "height"), *(pairs.where(F.col("d") <= far).select("seed_id", "id", "dz") for far in (holds, reach)))
        expected = {r["seed_id"]: (r["method"], len(r["ids"]), r["reason"]) for r in listed.collect()}
        counted = matching.landmark_counts(seeds, buildings, holds, reach)
        assert {r["seed_id"]: (r["method"], r["n"], r["reason"]) for r in counted.collect()} == expected
    assert "bx" not in counted._jdf.queryExecution().toString()
