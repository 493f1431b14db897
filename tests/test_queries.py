"""Every query that has SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from quadrille.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, plain, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(normal(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name not in catalogue.SQL:
        assert rows
        return
    relation = plain.sql(catalogue.SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert rows == sorted((tuple(normal(r[i]) for i in at) for r in relation.fetchall()), key=repr)


def test_nearest_k_far_away(spark):
    from quadrille.operators import spatial

    points, targets = [(i, 7.0 * i, float(i)) for i in range(6)], [(i, 3.0 * i + 900_000.0 * (i > 2), -2.0 * i) for i in range(5)]
    expected = sorted((p, t, rank) for p, x, z in points for rank, (_, t) in enumerate(sorted((((x - tx) ** 2 + (z - tz) ** 2) ** 0.5, t) for t, tx, tz in targets)[:4], 1))
    for k, rounds in ((4, 12), (4, 2), (9, 12)):
        found = spatial.knn(spark.createDataFrame(points, "p long, x double, z double"), spark.createDataFrame(targets, "t long, tx double, tz double"), "p", "t", k, 5.0, rounds)
        assert sorted((r["p"], r["t"], r["rank"]) for r in found.collect() if r["rank"] <= 4) == expected
        assert found.count() == len(points) * min(k, len(targets))
