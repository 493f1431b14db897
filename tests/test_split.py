"""Archives and shapefiles read by several tasks."""

from __future__ import annotations

import random
import struct
import zipfile

import pytest

from quadrille.sources import files, split


def test_one_archive_by_many_tasks(spark, tmp_path):
    rng, contents = random.Random(1), {}
    for i in range(40):
        contents[f"d{i % 3}/e{i}.bin"] = rng.randbytes(rng.choice([0, 1, 900, 5000]))
    contents["d0/large.bin"] = rng.randbytes(70_000)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.mkdir("d9")
        for i, (name, data) in enumerate(contents.items()):
            z.writestr(name, data, (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)[i % 4])
    split.register(spark)
    frame = spark.read.format("zipentries").option("taskbytes", 10_000).option("piecebytes", 4096).load(str(tmp_path / "a.zip"))
    assert frame.rdd.getNumPartitions() > 8
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r["entry"], r["piece"])):
        assert r["file"] == "a.zip" and r["size"] == len(contents[r["entry"]]) and len(r["content"]) <= 4096
        found[r["entry"]] = found.get(r["entry"], b"") + bytes(r["content"])
    assert found == contents
    one = frame.where("entry = 'd0/large.bin'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 18
    assert {r["entry"] for r in frame.where("entry like 'd1/%' and size > 0").collect()} == {n for n, d in contents.items() if n.startswith("d1/") and d}
    assert frame.where("entry = 'none'").count() == 0


def shapefile(folder, name, rows):
    """Polygons of differing lengths with their index and table."""
    shp, shx, dbf = bytes(100), bytes(100), b""
    for i, (code, ring) in enumerate(rows):
        flat = [v for p in ring for v in p]
        body = struct.pack("<i4dii", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<i", 0) + struct.pack(f"<{len(flat)}d", *flat) if ring else struct.pack("<i", 0)
        shx += struct.pack(">ii", len(shp) // 2, len(body) // 2)
        shp += struct.pack(">ii", i + 1, len(body) // 2) + body
        dbf += (b"*" if code is None else b" ") + (code or "").encode("cp932").ljust(10)
    field = b"CODE".ljust(11, b"\x00") + b"C" + bytes(4) + bytes([10]) + bytes(15)
    (folder / f"{name}.shp").write_bytes(shp)
    (folder / f"{name}.shx").write_bytes(shx)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4xIHH20x", len(rows), 32 + len(field) + 1, 11) + field + b"\r" + dbf)


@pytest.mark.parametrize("task", [1, 300, 1 << 20])
def test_one_shapefile_by_many_tasks(spark, tmp_path, task):
    rng = random.Random(2)
    rows = [(None if i % 7 == 3 else f"町{i}", [] if i % 9 == 4 else [(rng.random(), rng.random()) for _ in range(rng.randrange(3, 12))]) for i in range(50)]
    shapefile(tmp_path, "a", rows)
    shapefile(tmp_path, "b", rows[:5])
    split.register(spark)
    frame = spark.read.format("shapefile").option("taskbytes", task).load(str(tmp_path))
    assert frame.rdd.getNumPartitions() == {1: 55, 1 << 20: 2}.get(task, frame.rdd.getNumPartitions())
    found = {(r["stem"], r["record"]): (r["attributes"]["CODE"], r["parts"]) for r in frame.collect()}
    expected = {(stem, i + 1): (code, [[v for p in ring for v in p]] if ring else []) for stem, n in (("a", 50), ("b", 5)) for i, (code, ring) in enumerate(rows[:n]) if code is not None}
    assert found == expected
    whole = {(r["stem"].rsplit("/", 1)[-1], r["record"]): (r["attributes"]["CODE"], r["parts"]) for r in files.read_shapefile(spark, str(tmp_path)).collect()}
    assert whole == expected


def test_small_pieces_are_dealt_to_few_tasks(spark, tmp_path, monkeypatch):
    """A record a piece, but not a task each: a task takes several pieces of one file."""
    rows = [(f"町{i}", [(float(i), 0.0), (i + 1.0, 0.0), (float(i), 1.0)]) for i in range(60)]
    shapefile(tmp_path, "a", rows)
    shapefile(tmp_path, "b", rows[:7])
    monkeypatch.setattr(split, "MOST", 8)
    parts = split.ShapeReader(str(tmp_path), 1, "cp932").partitions()
    assert len(parts) <= 8 + 2 and sum(len(p.items) for p in parts) == 67
    found = [r for p in parts for r in split.ShapeReader(str(tmp_path), 1, "cp932").read(p)]
    assert [(stem, number, values["CODE"]) for stem, number, _, values in found] == [(s, i + 1, f"町{i}") for s, n in (("a", 60), ("b", 7)) for i in range(n)]


def test_polygons_are_nested_once(spark):
    """Many rings in one shape: each is looked at by each other one, and computed once."""
    from pyspark.sql import functions as F

    square = lambda x, r: [v for p in ((x - r, -r), (x - r, r), (x + r, r), (x + r, -r), (x - r, -r)) for v in map(float, p)]
    parts = [square(20 * i, r) for i in range(20) for r in (3, 9, 6)]
    plan = spark.createDataFrame([(parts,)], "parts array<array<double>>").select(files.polygons_of(F.col("parts")).alias("p"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("zip_with") <= 3  # its area, and two tests of a place
    found = plan.first()["p"]
    assert len(found) == 40 and sorted(len(p["holes"]) for p in found) == [0] * 20 + [1] * 20
