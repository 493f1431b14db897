"""Readers and sinks on files made here."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.sources import files, osm, sinks


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="notes" r:id="r1"/><sheet name="data" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>名</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>12</v></c><c r="D3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook_and_archive(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook())
    rows = files.read_workbook(spark, str(tmp_path / "b.xlsx"), "data").orderBy("row_no").collect()
    assert [(r["row_no"], r["cells"]) for r in rows] == [(1, ["名", "", "ab"]), (3, ["", "12", "", "x"])]
    assert files.read_archive(spark, str(tmp_path / "b.xlsx")).count() == 5


def test_charsets(spark, tmp_path):
    (tmp_path / "u").write_bytes("町丁字コード,本町".encode())
    (tmp_path / "s").write_bytes("町丁字コード,髙町".encode("cp932"))
    (tmp_path / "bad").write_bytes(b"\x81\xff\xfe code")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in files.read_text_strictly(spark, str(tmp_path), ["コード"]).collect()}
    assert (rows["u"]["charset"], rows["s"]["charset"]) == ("utf-8", "cp932") and not rows["bad"]["ok"]


def test_lines_and_elements(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[\n{"type":"Feature","properties":{"n":1}},\n{"type":"Feature","properties":{"n":2}}\n]}\n')
    assert [r["properties"]["n"] for r in files.read_feature_lines(spark, str(tmp_path / "f.json"), "type string, properties struct<n:int>").collect()] == [1, 2]
    (tmp_path / "e.json").write_text('{"elements":[{"type":"node","id":7,"tags":{"a":"b"}}]}')
    (tmp_path / "bare.json").write_text('[{"type":"way","id":8}]')
    assert [r["id"] for r in files.read_elements(spark, str(tmp_path / "e.json")).collect()] == [7]
    assert [r["id"] for r in files.read_elements(spark, str(tmp_path / "bare.json")).collect()] == [8]
    (tmp_path / "l.jsonl").write_text('{"id":1}\nbroken\n{"id":2}\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "l.jsonl"), "id long")
    assert good.count() == 2 and bad.count() == 1
    (tmp_path / "c.csv").write_text('a,"b,""c"""\n,1\n')
    assert [r["cells"] for r in files.read_csv_cells(spark, str(tmp_path / "c.csv")).collect()] == [["a", 'b,"c"'], ["", "1"]]


def test_shapefile(spark, tmp_path):
    points = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + struct.pack("<8d", *points)
    (tmp_path / "a.shp").write_bytes(b"\x00" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    field = lambda name, n: name.encode().ljust(11, b"\x00") + b"C\x00\x00\x00\x00" + bytes([n]) + b"\x00" * 15
    head = field("NAME", 6) + field("CODE", 3) + b"\r"
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4xIHH20x", 1, 32 + len(head), 10) + head + b" " + "本町".encode("cp932").ljust(6) + b"012")
    row = files.read_shapefile(spark, str(tmp_path)).first()
    assert row["parts"] == [points] and row["attributes"] == {"NAME": "本町", "CODE": "012"}


def test_buildings(spark, tmp_path):
    polygon = "<bldg:lod0FootPrint><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>34.1 135.1 0 34.1 135.2 0 34.2 135.2 0 34.1 135.1 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0FootPrint>"
    (tmp_path / "b.gml").write_text(f'<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g"><bldg:Building gml:id="x"><bldg:measuredHeight>12.5</bldg:measuredHeight>{polygon}</bldg:Building><bldg:Building gml:id="y"><bldg:storeysAboveGround>4</bldg:storeysAboveGround></bldg:Building></core:CityModel>')
    rows = {r["id"]: r for r in files.read_buildings(spark, str(tmp_path / "b.gml")).collect()}
    assert rows["x"]["height"] == 12.5 and [tuple(p) for p in rows["x"]["ring"]] == [(135.1, 34.1), (135.2, 34.1), (135.2, 34.2)]
    assert rows["y"]["height"] == 12.0 and rows["y"]["ring"] is None


def key(number, kind):
    return vi(number << 3 | kind)


def vi(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zz(n):
    return vi(n << 1 if n >= 0 else (-n << 1) - 1)


def ld(number, data):
    return key(number, 2) + vi(len(data)) + data


def test_osm_extract(spark, tmp_path):
    words = ld(1, b"") + ld(1, b"highway") + ld(1, b"primary") + ld(1, b"outer")
    dense = ld(1, zz(5) + zz(1)) + ld(8, zz(346_000_000) + zz(1000)) + ld(9, zz(1_355_000_000) + zz(-1000)) + ld(10, vi(1) + vi(2) + vi(0) + vi(0))
    way = key(1, 0) + vi(9) + ld(2, vi(1)) + ld(3, vi(2)) + ld(8, zz(5) + zz(1))
    relation = key(1, 0) + vi(11) + ld(8, vi(3)) + ld(9, zz(9)) + ld(10, vi(1))
    block = ld(1, words) + ld(2, ld(2, dense)) + ld(2, ld(3, way)) + ld(2, ld(4, relation))
    blob = lambda kind, data: (lambda body: (lambda head: struct.pack(">I", len(head)) + head + body)(ld(1, kind) + key(3, 0) + vi(len(body))))(ld(3, zlib.compress(data)))
    (tmp_path / "x.pbf").write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", block) + blob(b"OSMData", block))
    osm.register(spark)
    rows = spark.read.format("osmpbf").load(str(tmp_path / "x.pbf")).dropDuplicates(["type", "id"]).orderBy("id").collect()
    assert [(r["type"], r["id"]) for r in rows] == [("node", 5), ("node", 6), ("way", 9), ("relation", 11)]
    assert rows[0]["tags"] == {"highway": "primary"} and rows[1]["lat"] == pytest.approx(34.6001) and rows[1]["lon"] == pytest.approx(135.4999)
    assert rows[2]["refs"] == [5, 6] and [tuple(m) for m in rows[3]["members"]] == [("way", 9, "outer")]


def extract(blocks, order=b"Sort.Type_then_ID", packings=(1, 3, 4, 5, 6, 7)):
    """An extract of one blob a block, each packed in another way."""
    import bz2
    import lzma

    import pyarrow as pa

    pack = {1: bytes, 3: zlib.compress, 4: lzma.compress, 5: bz2.compress, 6: lambda d: pa.Codec("lz4_raw").compress(d, asbytes=True), 7: lambda d: pa.Codec("zstd").compress(d, asbytes=True)}
    out = b""
    for i, (kind, data) in enumerate([(b"OSMHeader", ld(5, order)), *((b"OSMData", b) for b in blocks)]):
        n = packings[i % len(packings)]
        body = key(2, 0) + vi(len(data)) + ld(n, pack[n](data))
        head = ld(1, kind) + key(3, 0) + vi(len(body))
        out += struct.pack(">I", len(head)) + head + body
    return out


def block_of(kind, ids):
    words = ld(1, b"") + ld(1, b"k") + ld(1, b"v")
    deltas = b"".join(zz(b - a) for a, b in zip([0, *ids], ids))
    if kind == "node":
        return ld(1, words) + ld(2, ld(2, ld(1, deltas) + ld(8, zz(0) * len(ids)) + ld(9, zz(0) * len(ids))))
    if kind == "way":
        return ld(1, words) + b"".join(ld(2, ld(3, key(1, 0) + vi(i) + ld(2, vi(1)) + ld(3, vi(2)) + ld(8, zz(i) + zz(1)))) for i in ids)
    return ld(1, words) + b"".join(ld(2, ld(4, key(1, 0) + vi(i) + ld(8, vi(2)) + ld(9, zz(i)) + ld(10, vi(1)))) for i in ids)


def test_osm_filters_skip_blobs(spark, tmp_path):
    """Whatever the filter, the rows are those of the whole extract; a sorted one has no task for blobs that cannot match."""
    parts = [("node", range(1, 40)), ("node", range(40, 90)), ("node", range(90, 120)), ("way", range(3, 30)), ("way", range(30, 60)), ("relation", range(1, 9)), ("relation", range(9, 20))]
    blocks = [block_of(k, list(ids)) for k, ids in parts]
    (tmp_path / "sorted.pbf").write_bytes(extract(blocks))
    (tmp_path / "loose.pbf").write_bytes(extract(blocks, order=b"none"))
    osm.register(spark)
    whole = [(k, i) for k, ids in parts for i in ids]
    cases = {
        "type = 'way'": 3, "type in ('way', 'relation') and id > 25": 5, "type = 'node' and id = 41": 1, "type = 'node' and id >= 100": 1, "id between 5 and 6": 7,
        "type = 'relation' and id < 3": 2, "type = 'way' and id in (4, 59)": 3, "type = 'area'": 0, "type = 'way' and id > 7 and id < 6": 0, "tags['k'] = 'v'": 7, "type <> 'node'": 7,
    }
    for name in ("sorted", "loose"):
        frame = spark.read.format("osmpbf").load(str(tmp_path / f"{name}.pbf"))
        assert sorted((r["type"], r["id"]) for r in frame.collect()) == sorted(whole)
        for condition, tasks in cases.items():
            picked = frame.where(condition)
            expected = [(k, i) for k, i in whole if eval_condition(condition, k, i)]
            assert sorted((r["type"], r["id"]) for r in picked.collect()) == sorted(expected), condition
            if name == "sorted":
                assert picked.rdd.getNumPartitions() <= max(1, tasks), condition
    both = spark.read.format("osmpbf").load(str(tmp_path)).where("type = 'relation'").collect()
    assert len(both) == 38 and all([tuple(m) for m in r["members"]] == [("way", r["id"], "v")] for r in both)


def eval_condition(condition, kind, i):
    return {
        "type = 'way'": kind == "way", "type in ('way', 'relation') and id > 25": kind != "node" and i > 25, "type = 'node' and id = 41": kind == "node" and i == 41,
        "type = 'node' and id >= 100": kind == "node" and i >= 100, "id between 5 and 6": 5 <= i <= 6, "type = 'relation' and id < 3": kind == "relation" and i < 3,
        "type = 'way' and id in (4, 59)": kind == "way" and i in (4, 59), "type = 'area'": False, "type = 'way' and id > 7 and id < 6": False, "tags['k'] = 'v'": kind == "way", "type <> 'node'": kind != "node",
    }[condition]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = f"{tmp_path}/out"
    assert sinks.write_checked(df, path) == 2 and sinks.write_checked(df.limit(1), path) == 1
    assert spark.read.schema(df.schema).json(path).count() == 1
    assert sinks.write_shards(df, "v", 2, f"{tmp_path}/shards").count() == 2
    with pytest.raises(ValueError):
        sinks.write_shards(df, "v", 3, f"{tmp_path}/more")
    with pytest.raises(ValueError):
        sinks.durable(df.withColumn("secret", F.lit("x")), ["id", "v"], "key=", "^[0-9]+$")
    with pytest.raises(ValueError):
        sinks.with_metadata(df, "p", "l", "2020-01-01", "guess", "id")
    text = spark.range(1).select(sinks.geojson(geo.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), F.struct(F.lit(1).alias("n"))).alias("g")).first()["g"]
    assert '"coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,1.0],[0.0,0.0]]]' in text


def test_areas(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    features = spark.createDataFrame([("1", "a", ring), ("1", "a", ring), ("2", "a", ring), ("9", "z", ring)], "code string, name string, outer array<struct<x:double,z:double>>")
    registry = spark.createDataFrame([(1, "a", "1"), (2, "b", "2"), (3, "c", "3")], "ward_id int, name string, code string")
    areas, bad, missing = files.ingest_areas(features, registry)
    assert {r["ward_id"]: len(r["polygons"]) for r in areas.collect()} == {1: 2}
    assert bad.count() == 1 and {r["ward_id"] for r in missing.collect()} == {2, 3}
    assert files.element_query((34.5, 135, 34.7, 135.5), [files.selector("highway"), files.selector("name", 'a"b')]) == '[out:json][timeout:60];(way["highway"](34.5,135,34.7,135.5);way["name"="a\\"b"](34.5,135,34.7,135.5););out tags geom;'


def test_more_readers(spark, tmp_path):
    (tmp_path / "p.html").write_text('<script>\nconst TOWNS = [{"n":"a","v":1},\n{"n":"b","v":2}];\n</script>')
    assert [(r["n"], r["v"]) for r in files.read_embedded(spark, str(tmp_path / "p.html"), "TOWNS", "n string, v int").collect()] == [("a", 1), ("b", 2)]
    (tmp_path / "r.gml").write_text("<D><RdEdg><pos>34.5 135.1 34.6 135.2</pos></RdEdg><RdEdg><pos></pos></RdEdg></D>")
    rows = files.read_gml(spark, str(tmp_path / "r.gml"), "RdEdg", "pos string").select(files.positions(F.col("pos")).alias("p")).collect()
    assert [[tuple(p) for p in r["p"] or []] for r in rows] == [[(34.5, 135.1), (34.6, 135.2)], []]
    entry = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    head = struct.pack("<2sHIH", b"II", 42, 8, 4) + entry(256, 3, 1, struct.pack("<HH", 640, 0)) + entry(257, 3, 1, struct.pack("<HH", 480, 0)) + entry(33550, 12, 3, struct.pack("<I", 100)) + entry(33922, 12, 6, struct.pack("<I", 124))
    (tmp_path / "t.tif").write_bytes(head.ljust(100, b"\x00") + struct.pack("<3d", 0.5, 0.5, 0) + struct.pack("<6d", 0, 0, 0, 100.0, 200.0, 0))
    row = files.read_tiff_headers(spark, str(tmp_path / "t.tif")).first()
    assert (row["width"], row["height"], row["size_x"], row["origin_y"]) == (640, 480, 0.5, 200.0)
    sheet = spark.createDataFrame([(1, ["注記"]), (2, ["", "人口", "", "世帯"]), (3, ["町丁字コード", "総数", "15人", "５人"])], "row_no int, cells array<string>")
    assert files.heading_columns(sheet, {"code": ["町丁字コード"], "population": ["人口総数"], "five": ["5人"]}) == {"code": 0, "population": 1, "five": 3}


def test_polygons_of_odd_shapes(spark):
    square = lambda a, b: [a, a, a, b, b, b, b, a, a, a]
    rows = [(0, [square(0.0, 9.0), square(1.0, 8.0), square(2.0, 7.0), square(20.0, 21.0)]), (1, [[]]), (2, []), (3, [[1.0, 1.0, 2.0, 2.0]]), (4, None)]
    found = spark.createDataFrame(rows, "k int, parts array<array<double>>").select("k", files.polygons_of(F.col("parts")).alias("p")).collect()
    assert {r["k"]: None if r["p"] is None else sorted(len(p["holes"]) for p in r["p"]) for r in found} == {0: [0, 0, 1], 1: [], 2: [], 3: [], 4: None}


def test_synced_folder(spark, tmp_path):
    """Untouched partitions keep their files; an empty table leaves an empty folder."""
    import os

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"{tmp_path}/synced"
    assert {r["action"] for r in sinks.sync_partitions(df, path, "k").collect()} == {"written"}
    before = sorted(os.listdir(f"{path}/k=1"))
    assert {(r["k"], r["action"]) for r in sinks.sync_partitions(df.where("k = 1").unionByName(spark.createDataFrame([(3, "c")], df.schema)), path, "k").collect()} == {(1, "same"), (2, "removed"), (3, "written")}
    assert sorted(os.listdir(f"{path}/k=1")) == before and not os.path.exists(f"{path}/k=2")
    assert {(r["k"], r["v"]) for r in spark.read.schema(df.schema).parquet(path).collect()} == {(1, "a"), (3, "c")}
