"""Readers of binary and marked-up files: files made from the plain tables in tasks, parsed back, one group a file."""

from __future__ import annotations

import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadrille.functions import geo, names
from quadrille.plans import views
from quadrille.plans.registry import query
from quadrille.plans.scalar_queries import pick, sql_pick
from quadrille.plans.views import WITH
from quadrille.sources import files, osm, sinks, split
from quadrille.storage import read_table, scratch


def _packed(rows: DataFrame, key: str, make: Callable[[pd.DataFrame], bytes], ending: str) -> DataFrame:
    """(path, content): one file a key, made by a task from the key's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"/{pdf[key].iloc[0]}{ending}"], "content": [make(pdf)]})

    return rows.groupBy(key).applyInPandas(run, "path string, content binary")


def _supplier(spark, sf) -> DataFrame:
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("file"))


SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _workbook(pdf: pd.DataFrame) -> bytes:
    """A workbook of two sheets: names are shared texts, keys numbers; the second column stays empty."""
    rows = pdf.sort_values("k").to_dict("records")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {SHEET} {RELS}><sheets><sheet name="notes" r:id="r1"/><sheet name="data" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {SHEET}>" + "".join(f"<si><t>{r['name']}</t></si>" for r in rows) + "</sst>")
        z.writestr("xl/worksheets/a.xml", f"<worksheet {SHEET}><sheetData/></worksheet>")
        body = "".join(f'<row r="{2 * i + 1}"><c r="A{2 * i + 1}"><v>{r["k"]}</v></c><c r="C{2 * i + 1}" t="s"><v>{i}</v></c></row>' for i, r in enumerate(rows))
        z.writestr("xl/worksheets/b.xml", f"<worksheet {SHEET}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@query("q_1_04_workbook", "SELECT CAST(s_suppkey AS VARCHAR) AS k, '' AS gap, s_name AS name, CAST(2 * row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS BIGINT) AS row_no FROM supplier")
def workbook(spark, sf):
    c = F.col("cells")
    return files.workbook_rows(_packed(_supplier(spark, sf), "file", _workbook, ".xlsx"), "data").select(c[0].alias("k"), c[1].alias("gap"), c[2].alias("name"), "row_no")


CHARSETS = ["utf-8", "utf-8-sig", "cp932", "utf-16", "broken"]


@query("q_1_06_charsets", f"SELECT 's' || s_suppkey AS id, {sql_pick(['utf-8', 'utf-8-sig', 'cp932', 'utf-16', None], 's_suppkey')} AS charset, s_suppkey % 5 <> 4 AS ok, CASE WHEN s_suppkey % 5 <> 4 THEN '町丁字コード,' || s_name END AS text FROM supplier")
def charsets(spark, sf):
    """The same heading in four charsets; the fifth fits none, and nothing is replaced."""

    def write(batches):
        for pdf in batches:
            texts = ["町丁字コード," + n for n in pdf["name"]]
            codes = [CHARSETS[k % 5] for k in pdf["k"]]
            yield pd.DataFrame({"path": ["s" + str(k) for k in pdf["k"]], "content": [b"\x81\xff\xfe" + t.encode() if c == "broken" else t.encode(c) for t, c in zip(texts, codes)]})

    made = _supplier(spark, sf).mapInPandas(write, "path string, content binary")
    return files.texts_strictly(made, ["コード"]).select(F.col("file").alias("id"), "charset", "ok", "text")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _message(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _steps(numbers) -> bytes:
    return b"".join(_zigzag(int(b) - int(a)) for a, b in zip([0, *numbers], numbers))


def _osm_blob(pdf: pd.DataFrame) -> bytes:
    """A blob with the rows' places as dense nodes with a name, and one way along them."""
    rows = pdf.sort_values("k")
    words = [b"", b"name", b"highway", b"road", *(n.encode() for n in rows["name"])]
    tags = b"".join(_varint(1) + _varint(4 + i) + _varint(0) for i in range(len(rows)))
    dense = _message(1, _steps(rows["k"])) + _message(8, _steps(rows["k"] * 1000)) + _message(9, _steps(rows["k"] * -2000)) + _message(10, tags)
    way = _varint(1 << 3) + _varint(int(rows["file"].iloc[0]) + 1) + _message(2, _varint(2)) + _message(3, _varint(3)) + _message(8, _steps(rows["k"]))
    block = _message(1, b"".join(_message(1, w) for w in words)) + _message(2, _message(2, dense)) + _message(2, _message(3, way))
    return _message(3, zlib.compress(block))


@query("q_1_08_osm_primitives", """
SELECT 'node' AS type, s_suppkey AS id, s_suppkey * 1000 AS lat, s_suppkey * -2000 AS lon, s_name AS tag, NULL AS n_refs, NULL AS last_ref FROM supplier
UNION ALL SELECT 'way', s_nationkey + 1, NULL, NULL, 'road', CAST(count(*) AS INT), max(s_suppkey) FROM supplier GROUP BY s_nationkey""")
def osm_primitives(spark, sf):
    """Blobs of an extract decoded by tasks; degrees are compared in the file's own grain."""
    made = _packed(_supplier(spark, sf), "file", _osm_blob, ".blob")
    grain = lambda c: F.round(F.col(c) * 1e7).cast("long").alias(c)
    tag = F.coalesce(F.col("tags")["name"], F.col("tags")["highway"]).alias("tag")
    return osm.decoded_blobs(made).select("type", "id", grain("lat"), grain("lon"), tag, F.size("refs").alias("n_refs"), F.element_at("refs", -1).alias("last_ref")).withColumn("n_refs", F.when(F.col("n_refs") >= 0, F.col("n_refs")))


def _osm_file(pdf: pd.DataFrame) -> bytes:
    """A sorted extract: a blob of nodes, one with a way along them and one with a relation of the way and the first node,
    packed in a way of its own."""
    rows, file = pdf.sort_values("k"), int(pdf["file"].iloc[0])
    words = [b"", b"name", b"highway", b"road", b"outer", *(n.encode() for n in rows["name"])]
    tags = b"".join(_varint(1) + _varint(5 + i) + _varint(0) for i in range(len(rows)))
    dense = _message(1, _steps(rows["k"])) + _message(8, _steps(rows["k"] * 1000)) + _message(9, _steps(rows["k"] * -2000)) + _message(10, tags)
    way = _varint(1 << 3) + _varint(file + 1) + _message(2, _varint(2)) + _message(3, _varint(3)) + _message(8, _steps(rows["k"]))
    relation = _varint(1 << 3) + _varint(file + 1) + _message(8, _varint(4) + _varint(0)) + _message(9, _steps([file + 1, rows["k"].iloc[0]])) + _message(10, _varint(1) + _varint(0))
    number, pack = {0: (1, bytes), 1: (3, zlib.compress), 2: (4, lzma.compress), 3: (6, lambda data: pa.Codec("lz4_raw").compress(data, asbytes=True)), 4: (7, lambda data: pa.Codec("zstd").compress(data, asbytes=True))}[file % 5]

    def blob(kind: bytes, data: bytes) -> bytes:
        body = _varint(2 << 3) + _varint(len(data)) + _message(number, pack(data))
        head = _message(1, kind) + _varint(3 << 3) + _varint(len(body))
        return struct.pack(">I", len(head)) + head + body

    blocks = [_message(1, b"".join(_message(1, w) for w in words)) + _message(2, _message(n, m)) for n, m in ((2, dense), (3, way), (4, relation))]
    return blob(b"OSMHeader", _message(4, b"DenseNodes") + _message(5, b"Sort.Type_then_ID")) + b"".join(blob(b"OSMData", b) for b in blocks)


def _written(spark, label: str, *packed: DataFrame) -> str:
    """A folder of the files of (path, content) rows, written by tasks to the shared folder."""
    folder = scratch(spark, label)

    def write(batches):
        import pyarrow.fs

        store, at = pyarrow.fs.FileSystem.from_uri(folder)
        for pdf in batches:
            store.create_dir(at)
            for path, content in zip(pdf["path"], pdf["content"]):
                with store.open_output_stream(at + path) as out:
                    out.write(content)
            yield pdf[["path"]]

    for rows in packed:
        rows.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


@query("q_1_08_osm_source", """
SELECT 'way' AS type, s_nationkey + 1 AS id, 'road' AS tag, CAST(count(*) AS INT) AS n_refs, NULL AS members FROM supplier WHERE s_nationkey >= 4 GROUP BY s_nationkey
UNION ALL SELECT 'relation', s_nationkey + 1, NULL, NULL, 'way/' || s_nationkey + 1 || '/outer,node/' || min(s_suppkey) || '/' FROM supplier WHERE s_nationkey >= 4 GROUP BY s_nationkey""")
def osm_source(spark, sf):
    """Ways and relations of a folder of extracts in five packings, from id 5 on: the source makes no task for blobs of
    nodes."""
    osm.register(spark)
    found = spark.read.format("osmpbf").load(_written(spark, "extracts", _packed(_supplier(spark, sf), "file", _osm_file, ".osm.pbf"))).where("type in ('way', 'relation') and id >= 5")
    members = F.array_join(F.transform("members", lambda m: F.concat_ws("/", m["type"], m["ref"].cast("string"), m["role"])), ",")
    return found.select("type", "id", F.col("tags")["highway"].alias("tag"), F.when(F.col("refs").isNotNull(), F.size("refs")).alias("n_refs"), members.alias("members"))


def _shp(pdf: pd.DataFrame) -> bytes:
    """Squares, each with a hole and an island in the hole, in no particular order of rings."""
    out = bytearray(100)
    for i, k in enumerate(sorted(pdf["k"])):
        rings = []
        for low, high, forward in ((30.0, 70.0, False), (0.0, 100.0, True), (40.0, 60.0, True)):
            corners = [(low + k, low), (low + k, high), (high + k, high), (high + k, low), (low + k, low)]
            rings.append(corners if forward else corners[::-1])
        flat = [v for r in rings for p in r for v in p]
        body = struct.pack("<i4dii", 5, k, 0, k + 100, 100, 3, 15) + struct.pack("<3i", 0, 5, 10) + struct.pack(f"<{len(flat)}d", *flat)
        out += struct.pack(">ii", i + 1, len(body) // 2) + body
    return bytes(out)


def _dbf(pdf: pd.DataFrame) -> bytes:
    rows = pdf.sort_values("k")
    field = lambda name, n: name.encode().ljust(11, b"\x00") + b"C" + bytes(4) + bytes([n]) + bytes(15)
    head = field("CODE", 12) + field("NAME", 40) + b"\r"
    body = b"".join(b" " + str(k).encode().ljust(12) + ("町" + n).encode("cp932").ljust(40) for k, n in zip(rows["k"], rows["name"]))
    return struct.pack("<4xIHH20x", len(rows), 32 + len(head), 53) + head + body


@query("q_1_16_shapefile", "SELECT CAST(s_suppkey AS VARCHAR) AS code, '町' || s_name AS name, 2 AS n_polygons, 1 AS n_holes, CAST(8400 + 400 AS DOUBLE) AS area FROM supplier")
def shapefile(spark, sf):
    s = _supplier(spark, sf)
    shapes = files.shapes_with_facts(_packed(s, "file", _shp, ".shp"), _packed(s, "file", _dbf, ".dbf"))
    p = shapes.select("attributes", files.polygons_of(F.col("parts")).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + geo.area_with_holes(x["outer"], x["holes"]))
    return p.select(F.col("attributes")["CODE"].alias("code"), F.col("attributes")["NAME"].alias("name"), F.size("p").alias("n_polygons"), F.aggregate("p", F.lit(0), lambda acc, x: acc + F.size(x["holes"])).alias("n_holes"), total.alias("area"))


def _shx(pdf: pd.DataFrame) -> bytes:
    """The index of _shp's records: place and length of each in words of two bytes."""
    size = (44 + 12 + 8 * 30) // 2
    return bytes(100) + b"".join(struct.pack(">ii", 50 + i * (size + 4), size) for i in range(len(pdf)))


@query("q_1_16_shapefile_source", "SELECT s_nationkey AS file, CAST(s_suppkey AS VARCHAR) AS code, '町' || s_name AS name, 3 AS n_parts FROM supplier")
def shapefile_source(spark, sf):
    """Shapefiles read by their index, a few records a task."""
    split.register(spark)
    s = _supplier(spark, sf)
    folder = _written(spark, "shapes", *(_packed(s, "file", make, ending) for make, ending in ((_shp, ".shp"), (_shx, ".shx"), (_dbf, ".dbf"))))
    found = spark.read.format("shapefile").option("taskbytes", 700).load(folder)
    return found.select(F.col("stem").cast("int").alias("file"), F.col("attributes")["CODE"].alias("code"), F.col("attributes")["NAME"].alias("name"), F.size("parts").alias("n_parts"))


@query("q_1_20_archive_source", "SELECT s_nationkey || '.zip' AS file, 'part/' || s_suppkey || '.txt' AS entry, CAST(40 * length(s_name) AS BIGINT) AS size, CAST(ceil(40 * length(s_name) / 100) AS INTEGER) AS pieces, repeat(s_name, 40) AS text FROM supplier")
def archive_source(spark, sf):
    """Archives read by their directory: entries in pieces of 100 bytes, put together again."""

    def make(pdf: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, name in zip(pdf["k"], pdf["name"]):
                z.writestr(f"part/{k}.txt", name * 40)
            z.writestr("other/note.txt", "not asked for")
        return out.getvalue()

    split.register(spark)
    folder = _written(spark, "archives", _packed(_supplier(spark, sf), "file", make, ".zip"))
    found = spark.read.format("zipentries").option("taskbytes", 2000).option("piecebytes", 100).load(folder).where(F.col("entry").startswith("part/"))
    pieces = F.sort_array(F.collect_list(F.struct("piece", F.decode("content", "UTF-8").alias("text"))))
    return found.groupBy("file", "entry", "size").agg(F.count("*").cast("int").alias("pieces"), pieces.alias("p")).select("file", "entry", "size", "pieces", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


@query("q_1_20_archive", "SELECT s_nationkey || '.zip' AS file, 'part/' || s_suppkey || '.txt' AS entry, CAST(length(s_name) AS BIGINT) AS size, s_name AS text FROM supplier")
def archive(spark, sf):
    def make(pdf: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, name in zip(pdf["k"], pdf["name"]):
                z.writestr(f"part/{k}.txt", name)
        return out.getvalue()

    found = files.archive_entries(_packed(_supplier(spark, sf), "file", make, ".zip"), with_content=True)
    return found.select(F.regexp_replace("file", "^/", "").alias("file"), "entry", "size", F.decode("content", "UTF-8").alias("text"))


@query("q_1_21_tiff_header", "SELECT n_nationkey AS id, CAST(640 + n_nationkey AS BIGINT) AS width, CAST(480 AS BIGINT) AS height, CAST(0.5 + n_nationkey AS DOUBLE) AS size_x, CAST(100 * n_nationkey AS DOUBLE) AS origin_x FROM nation")
def tiff_header(spark, sf):
    def make(pdf: pd.DataFrame) -> bytes:
        k = int(pdf["k"].iloc[0])
        order = "<" if k % 2 else ">"  # both byte orders
        entry = lambda tag, kind, n, value: struct.pack(f"{order}HHI", tag, kind, n) + value.ljust(4, b"\x00")
        head = struct.pack(f"{order}2sHIH", b"II" if k % 2 else b"MM", 42, 8, 4)
        head += entry(256, 3, 1, struct.pack(f"{order}H", 640 + k)) + entry(257, 4, 1, struct.pack(f"{order}I", 480))
        head += entry(33550, 12, 3, struct.pack(f"{order}I", 100)) + entry(33922, 12, 6, struct.pack(f"{order}I", 124))
        return head.ljust(100, b"\x00") + struct.pack(f"{order}3d", 0.5 + k, 0.5, 0) + struct.pack(f"{order}6d", 0, 0, 0, 100.0 * k, 7.0, 0)

    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return files.tiff_rows(_packed(n, "k", make, ".tif")).select(F.regexp_extract("file", r"(\d+)\.tif", 1).cast("int").alias("id"), "width", "height", "size_x", "origin_x")


@query("q_1_22_embedded", "SELECT s_suppkey AS k, s_name AS name FROM supplier")
def embedded(spark, sf):
    """A page a nation, each with the constant that holds its suppliers."""
    rows = F.to_json(F.collect_list(F.struct("k", "name")))
    pages = _supplier(spark, sf).groupBy("file").agg(F.concat(F.lit("<script>\nconst OTHER = [1];\nconst TOWNS = "), rows, F.lit(";\n</script>")).alias("value"))
    return files.embedded_rows(pages, "TOWNS", "k bigint, name string")


@query("q_1_23_tiles", WITH + """, t AS (SELECT rect_id, CAST(floor(x0 / 2000) AS BIGINT) AS tx, CAST(floor(z0 / 2000) AS BIGINT) AS tz FROM rects)
SELECT rect_id AS id, least('tile_' || tx || '_' || tz || '.json', 'tile_' || (tx + 1) || '_' || tz || '.json') AS tile FROM t""")
def tiles(spark, sf):
    """Features stand in two tiles each; the first by file name counts, and a file of another name is passed over."""
    r = views.rects(spark, sf).select("rect_id", geo.cell(F.col("x0"), 2000.0).alias("tx"), geo.cell(F.col("z0"), 2000.0).alias("tz"))
    both = r.withColumn("tx", F.explode(F.array(F.col("tx"), F.col("tx") + 1)))
    path = F.concat(F.lit("/tiles/tile_"), "tx", F.lit("_"), "tz", F.lit(".json"))
    feature = F.struct(F.col("rect_id").alias("id"), F.concat(F.lit("tile_"), "tx", F.lit("_"), "tz", F.lit(".json")).alias("tile"))
    made = both.groupBy(path.alias("path")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))
    odd = made.select(F.lit("/tiles/tile_x_1.json").alias("path"), F.lit('{"features":[{"id":-1,"tile":"odd"}]}').alias("value"))
    return files.tile_features(made.unionByName(odd), "id bigint, tile string")


@query("q_1_01_areas", "SELECT r_name AS id, CAST(34 + r_regionkey AS DOUBLE) AS south, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_wards, true AS has_roads FROM region")
def areas(spark, sf):
    """An area definition a region, whose nations are its wards."""
    k = F.col("r_regionkey")
    wards = read_table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("targetWards"))
    box = F.struct((k + 34.0).alias("south"), F.lit(135.0).alias("west"), (k + 35.0).alias("north"), F.lit(136.0).alias("east"))
    docs = read_table(spark, sf, "region").join(wards, "r_regionkey").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("id"), box.alias("bbox"), F.array(F.lit("roads"), F.lit("parks")).alias("layers"), "targetWards")).alias("value"))
    path = scratch(spark, "areas")
    docs.write.partitionBy("r_regionkey").text(path)
    return files.read_areas(spark, path).select("id", "bbox.south", F.size("targetWards").cast("long").alias("n_wards"), F.array_contains("layers", "roads").alias("has_roads"))


@query("q_1_25_digests", "SELECT s_nationkey || '.txt' AS file, CAST(length(string_agg(s_name, ',' ORDER BY s_suppkey)) AS BIGINT) AS size, sha256(string_agg(s_name, ',' ORDER BY s_suppkey)) AS sha256 FROM supplier GROUP BY s_nationkey")
def file_digests(spark, sf):
    made = _packed(_supplier(spark, sf), "file", lambda pdf: ",".join(pdf.sort_values("k")["name"]).encode(), ".txt")
    return files.digests(made).select(F.regexp_replace("path", "^/", "").alias("file"), "size", "sha256")


@query("q_1_02_catalogue", "SELECT n_name AS id, 'https://data.example/' || n_nationkey AS url, n_regionkey AS n_layers FROM nation")
def catalogue_scan(spark, sf):
    """Data set definitions, one document each, read as one table."""
    n = read_table(spark, sf, "nation")
    layers = F.transform(F.sequence(F.lit(0), F.col("n_regionkey")), lambda i: F.concat(F.lit("layer"), i))
    doc = F.struct(F.col("n_name").alias("id"), F.concat(F.lit("https://data.example/"), "n_nationkey").alias("url"), F.slice(layers, 1, F.col("n_regionkey")).alias("layers"))
    path = scratch(spark, "catalogue")
    n.select("n_nationkey", F.to_json(doc).alias("value")).write.partitionBy("n_nationkey").text(path)
    found = spark.read.schema("id string, url string, layers array<string>").json(path, multiLine=True)
    return found.select("id", "url", F.size("layers").alias("n_layers"))


@query("q_1_03_optional_json", "SELECT n_name AS name, n_nationkey AS k FROM nation")
def optional_json(spark, sf):
    """A document that is there, and one that is not: no rows, no error."""
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("name", StringType()).add("k", LongType())
    path = scratch(spark, "optional")
    read_table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")).write.json(path)
    return spark.read.schema(schema).json(path).unionByName(files.read_optional_json(spark, path + "-missing", schema))


CITY = '<core:CityModel xmlns:core="c" xmlns:bldg="b" xmlns:gml="g" xmlns:tran="t" xmlns:uro="u">'


def _documents(rows: DataFrame, label: str) -> str:
    """A document a file key, of the rows' elements."""
    path = scratch(rows.sparkSession, label)
    document = F.concat(F.lit(CITY), F.array_join(F.collect_list("value"), ""), F.lit("</core:CityModel>"))
    rows.groupBy("file").agg(document.alias("value")).repartition("file").write.partitionBy("file").text(path)
    return path


@query("q_1_11_building_parts", "SELECT 'b' || p_partkey AS id, CAST(p_size AS DOUBLE) AS height FROM part")
def building_parts(spark, sf):
    """Every building has a part of another height within it; parts are no buildings."""
    k = F.col("p_partkey")
    part = F.concat(F.lit('<bldg:consistsOfBuildingPart><bldg:BuildingPart gml:id="p'), k, F.lit('"><bldg:measuredHeight>999</bldg:measuredHeight></bldg:BuildingPart></bldg:consistsOfBuildingPart>'))
    value = F.concat(F.lit('<bldg:Building gml:id="b'), k, F.lit('"><bldg:measuredHeight>'), "p_size", F.lit("</bldg:measuredHeight>"), part, F.lit("</bldg:Building>"))
    path = _documents(read_table(spark, sf, "part").select(F.floor(k / 500).alias("file"), value.alias("value")), "parts")
    return files.read_buildings(spark, path).select("id", "height")


@query("q_1_13_level_audit", """
SELECT count(*) AS buildings, count(*) AS lod1, count(*) FILTER (WHERE p_partkey % 3 = 0) AS lod2, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS n_roof,
  CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_wall, CAST(0 AS BIGINT) AS n_ground, count(*) FILTER (WHERE p_partkey % 5 = 0) AS no_id FROM part""")
def level_audit(spark, sf):
    k = F.col("p_partkey")
    side = lambda kind: f"<bldg:boundedBy><bldg:{kind}Surface><gml:name>x</gml:name></bldg:{kind}Surface></bldg:boundedBy>"
    lod2 = F.lit("<bldg:lod2Solid><gml:name>x</gml:name></bldg:lod2Solid>" + side("Roof") + side("Wall") + side("Roof"))
    head = F.when(k % 5 == 0, "<bldg:Building>").otherwise(F.concat(F.lit('<bldg:Building gml:id="b'), k, F.lit('">')))
    value = F.concat(head, F.lit("<bldg:lod1Solid><gml:name>x</gml:name></bldg:lod1Solid>"), F.when(k % 3 == 0, lod2).otherwise(""), F.lit("</bldg:Building>"))
    path = _documents(read_table(spark, sf, "part").select(F.floor(k / 500).alias("file"), value.alias("value")), "levels")
    return files.level_audit(files.read_building_levels(spark, path))


@query("q_1_14_road_areas", f"""
WITH t AS (SELECT p_partkey AS k, {sql_pick(['1', '4', '12', '77', None], 'p_partkey')} AS f, {sql_pick(['2', '6', None], 'p_partkey')} AS s, p_size AS m FROM part)
SELECT 'r' || k AS id, CASE f WHEN '1' THEN 'expressway' WHEN '4' THEN 'municipal' WHEN '12' THEN 'buildingStandardAct' ELSE 'unknown' END AS admin_class, CASE s WHEN '2' THEN 'elevated' WHEN '6' THEN 'tunnel' ELSE 'unknown' END AS structure,
  coalesce(s = '6', false) AS subsurface, CASE WHEN k % 7 = 0 THEN 'no-exterior-ring' WHEN k % 11 = 0 THEN 'giant-polygon' END AS problem,
  CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 11 = 0 THEN 1e6 ELSE 100.0 * m END END AS area FROM t""")
def road_areas(spark, sf):
    """Level-1 surfaces as triangles of known area; some roads have none, some a giant one."""
    k, degree = F.col("p_partkey"), 1 / 111_320.0
    high = F.when(k % 11 == 0, F.lit(2000.0)).otherwise(F.col("p_size") * 2.0) * degree
    wide = F.when(k % 11 == 0, F.lit(1000.0)).otherwise(F.lit(100.0)) * degree
    pos = F.concat_ws(" ", *(c.cast("string") if not isinstance(c, str) else F.lit(c) for c in ("0", "0", "5", high, "0", "5", "0", wide, "5", "0", "0", "5")))
    surface = F.concat(F.lit("<tran:lod1MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), pos, F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></tran:lod1MultiSurface>"))
    tag = lambda name, v: F.coalesce(F.concat(F.lit(f"<{name}>"), v, F.lit(f"</{name}>")), F.lit(""))
    value = F.concat(F.lit('<tran:Road gml:id="r'), k, F.lit('">'), tag("tran:function", pick(["1", "4", "12", "77", None], k)), tag("uro:sectionType", pick(["2", "6", None], k)), F.when(k % 7 != 0, surface).otherwise("<tran:usage>1</tran:usage>"), F.lit("</tran:Road>"))
    path = _documents(read_table(spark, sf, "part").select(F.floor(k / 500).alias("file"), value.alias("value")), "roads")
    found = files.read_road_areas(spark, path, 0.0, 0.0)
    return found.select("id", "admin_class", "structure", "subsurface", "problem", F.when(F.size("rings") > 0, F.round("area")).alias("area"))


@query("q_1_15_road_edges", "SELECT 'e' || p_partkey AS id, 'fguuid:jgd2011.bl' AS crs, 2 + p_size % 4 AS n, CAST(p_partkey % 90 AS DOUBLE) AS lat, CAST(1.5 + p_partkey % 180 AS DOUBLE) AS lon, CASE WHEN p_partkey % 2 = 0 THEN '真幅道路' ELSE '徒歩道' END AS kind FROM part")
def road_edges(spark, sf):
    k = F.col("p_partkey")
    pairs = F.transform(F.sequence(F.lit(0), 1 + F.col("p_size") % 4), lambda i: F.concat_ws(" ", (k % 90 + i * 0.25).cast("string"), (k % 180 + 1.5 + i * 0.25).cast("string")))
    value = F.concat(F.lit('<RdEdg gml:id="e'), k, F.lit('"><loc><gml:Curve srsName="fguuid:jgd2011.bl"><gml:posList>'), F.array_join(pairs, " "), F.lit("</gml:posList></gml:Curve></loc><type>"), F.when(k % 2 == 0, "真幅道路").otherwise("徒歩道"), F.lit("</type></RdEdg>"))
    path = _documents(read_table(spark, sf, "part").select(F.floor(k / 500).alias("file"), value.alias("value")), "edges")
    e = files.read_gml(spark, path, "RdEdg", "`_gml:id` string, loc struct<`gml:Curve`:struct<`_srsName`:string,`gml:posList`:string>>, type string")
    p = files.positions(F.col("loc.`gml:Curve`.`gml:posList`"))
    return e.select(F.col("`_gml:id`").alias("id"), F.col("loc.`gml:Curve`._srsName").alias("crs"), F.size(p).alias("n"), p[0]["a"].alias("lat"), p[0]["b"].alias("lon"), F.col("type").alias("kind"))


GEOMETRIES = [
    '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0.2,0.2],[0.3,0.2],[0.3,0.3]]]}',
    '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}',
    '{"type":"Point","coordinates":[1,2]}',
    '{"type":"Point","coordinates":[1]}',
    '{"type":"Polygon","coordinates":[[]]}',
    '{"type":"Polygon","coordinates":[[[0,null],[1,0]]]}',
    '{"type":"LineString","coordinates":[[0,0],[1,1]]}',
    '{"type":"Polygon"}',
    None,
]


@query("q_1_19_geometry_check", f"""
SELECT s_suppkey AS id, {sql_pick([None, None, None, 'bad-point', 'bad-ring', 'bad-ring', 'unknown-type', 'no-coordinates', 'no-geometry'], 's_suppkey')} AS problem, CASE s_suppkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS n_rings FROM supplier""")
def geometry_check(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), pick(GEOMETRIES, F.col("s_suppkey")).alias("g"))
    s = s.withColumn("problem", files.geometry_problem(F.col("g"), points=True))
    return s.select("id", "problem", F.when(F.col("problem").isNull(), F.size(files.geometry_rings(F.col("g"), 0.0, 0.0))).alias("n_rings"))


@query("q_1_19_merged_geometry", "SELECT s_nationkey AS area, CAST(sum(CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 2 END) AS INT) AS n_polygons FROM supplier WHERE s_suppkey % 9 < 2 GROUP BY 1")
def merged_geometry(spark, sf):
    """Sound polygons of an area's features become one MultiPolygon."""
    s = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("area"), pick(GEOMETRIES, F.col("s_suppkey")).alias("g"))
    m = s.where(files.geometry_problem(F.col("g")).isNull()).groupBy("area").agg(files.merged_geometry(F.col("g")).alias("g"))
    return m.select("area", F.size(files.geometry_of(F.col("g"))["polygons"]).alias("n_polygons"))


@query("q_1_29_query_bindings", "SELECT 'Q' || s_suppkey AS item, s_name AS name, CAST(135.5 + s_suppkey AS DOUBLE) AS lon, CAST(34.25 AS DOUBLE) AS lat FROM supplier WHERE s_suppkey % 4 <> 3")
def query_bindings(spark, sf):
    k = F.col("k")
    value = lambda c: F.struct(c.alias("value"))
    point = F.when(k % 4 != 3, F.concat(F.lit("Point("), (k + 135.5).cast("string"), F.lit(" 34.25)"))).otherwise("nowhere")
    row = F.struct(value(F.concat(F.lit("http://kb.example/entity/Q"), k)).alias("item"), value(point).alias("coord"), value(F.col("name")).alias("itemLabel"))
    docs = _supplier(spark, sf).groupBy("file").agg(F.to_json(F.struct(F.struct(F.collect_list(row).alias("bindings")).alias("results"))).alias("value"))
    return files.query_bindings(docs)


@query("q_1_29_quarters", WITH + """, b AS (SELECT rect_id, x0, z0, x1, z1, (x0 + x1) / 2 AS mx, (z0 + z1) / 2 AS mz FROM rects)
SELECT rect_id, q AS quarter, CASE WHEN q % 2 = 1 THEN x0 ELSE mx END AS west, CASE WHEN q <= 2 THEN z0 ELSE mz END AS south, CASE WHEN q % 2 = 1 THEN mx ELSE x1 END AS east, CASE WHEN q <= 2 THEN mz ELSE z1 END AS north FROM b, (SELECT unnest([1, 2, 3, 4]) AS q)""")
def quarters(spark, sf):
    box = F.struct(F.col("x0").alias("west"), F.col("z0").alias("south"), F.col("x1").alias("east"), F.col("z1").alias("north"))
    q = views.rects(spark, sf).select("rect_id", F.posexplode(files.quarters(box)).alias("i", "q"))
    return q.select("rect_id", (F.col("i") + 1).alias("quarter"), "q.*")


@query("q_9_14_selectors", """
SELECT p_brand AS brand, '(' || string_agg(DISTINCT 'way["type"="' || replace(p_type || '"', '"', '\\"') || '"];', '' ORDER BY 'way["type"="' || replace(p_type || '"', '"', '\\"') || '"];') || ')' AS query FROM part GROUP BY 1""")
def selectors(spark, sf):
    """The selectors of a brand's types, with quotes escaped, in one text."""
    s = files.selector_text(F.lit("type"), F.concat("p_type", F.lit('"')))
    p = read_table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.concat(s, F.lit(";")).alias("s"))
    return p.groupBy("brand").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_set("s")), ""), F.lit(")")).alias("query"))


HEADINGS = [["注記"], ["", "人口", "", "世帯"], ["町丁字コード", "総数", "15人", "５人"]]


@query("q_3_02_headings", "SELECT CAST(s_suppkey AS VARCHAR) AS code, CAST(s_suppkey * 2 AS VARCHAR) AS population, CAST(s_suppkey * 5 AS VARCHAR) AS five FROM supplier")
def headings(spark, sf):
    """Columns found by a two-row heading in the first rows of a sheet; the rows behind it are the data."""
    k = F.col("s_suppkey")
    head = spark.createDataFrame([(i, c) for i, c in enumerate(HEADINGS)], "row_no long, cells array<string>")
    cells = F.transform(F.array(k, k * 2, k * 3, k * 5), lambda v: v.cast("string"))
    sheet = head.unionByName(read_table(spark, sf, "supplier").select((k + 100).alias("row_no"), cells.alias("cells")))
    at = files.heading_columns(sheet, {"code": ["町丁字コード"], "population": ["人口総数"], "five": ["5人"]})
    return sheet.where(F.col("row_no") >= len(HEADINGS)).select(*(F.col("cells")[i].alias(name) for name, i in at.items()))


@query("q_3_03_filled_headings", "SELECT s_suppkey AS sheet, c AS pos, (CASE WHEN c = 0 THEN '' WHEN c <= 2 THEN 'A' || s_suppkey ELSE 'B' END) || list_extract(['code', 'total', 'men', 'total'], CAST(c + 1 AS INT)) AS heading FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS c)")
def filled_headings(spark, sf):
    """A merged upper heading stands in its first cell only; it holds for the cells to its right."""
    from pyspark.sql import Window

    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet"), F.array(F.lit(""), F.concat(F.lit("A"), "s_suppkey"), F.lit(""), F.lit("B")).alias("upper"), F.array(*map(F.lit, ("code", "total", "men", "total"))).alias("lower"))
    cells = s.select("sheet", F.posexplode(F.arrays_zip("upper", "lower")).alias("pos", "c"))
    w = Window.partitionBy("sheet").orderBy("pos")
    filled = F.coalesce(F.last(F.nullif("c.upper", F.lit("")), ignorenulls=True).over(w), F.lit(""))
    return cells.select("sheet", "pos", F.concat(filled, "c.lower").alias("heading"))


@query("q_3_04_heading_alias", f"SELECT s_suppkey AS id, {sql_pick(['5人', '15人', '5人', '5人以上', '人5', '5人'], 's_suppkey')} AS key, s_suppkey % 6 IN (0, 2, 3, 5) AS holds FROM supplier")
def heading_alias(spark, sf):
    key = names.header_key(pick(["5人", "１５人", "（5 人）", "5人以上", "人5", "５人*2"], F.col("s_suppkey")))
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), key.alias("key"), names.heading_is(key, "5人").alias("holds"))


@query("q_2_02_synced_folder", """
SELECT n_regionkey AS k, CASE WHEN n_regionkey = 1 THEN 'written' ELSE 'same' END AS action FROM nation GROUP BY 1 UNION ALL SELECT 99, 'removed' FROM region WHERE r_regionkey = 0""")
def synced_folder(spark, sf):
    """A folder of five partitions synced again: one has changed, one of the old ones is not wanted any more."""
    n = read_table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    path = scratch(spark, "synced")
    old = n.withColumn("name", F.when(F.col("k") == 1, F.lower("name")).otherwise(F.col("name"))).unionByName(spark.createDataFrame([(99, "stray")], "k int, name string"))
    sinks.sync_partitions(old, path, "k")
    return sinks.sync_partitions(n, path, "k").select("k", "action")


@query("q_2_05_split_tiles", WITH + "SELECT CAST(floor(x0 / 2000) AS BIGINT) AS tx, CAST(floor(z0 / 2000) AS BIGINT) AS tz, count(*) AS n, sum(area) AS area FROM rects GROUP BY 1, 2")
def split_tiles(spark, sf):
    """Features dealt to their tile's folder and read back: a task has one open file at a time, as rows come sorted."""
    r = views.rects(spark, sf).select("rect_id", "area", geo.cell(F.col("x0"), 2000.0).alias("tx"), geo.cell(F.col("z0"), 2000.0).alias("tz"))
    path = scratch(spark, "split")
    r.hint("rebalance", F.col("tx"), F.col("tz")).write.partitionBy("tx", "tz").json(path)
    found = spark.read.schema("rect_id long, area double, tx long, tz long").json(path)
    return found.groupBy("tx", "tz").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("q_10_27_dates", f"SELECT s_suppkey AS id, {sql_pick(['2020-02-29', '2021-02-29', '2020-2-9', None, '2024-12-31'], 's_suppkey')} AS date, coalesce(s_suppkey % 5 IN (0, 4), false) AS valid FROM supplier")
def dates(spark, sf):
    """Reference dates are ISO dates that exist."""
    d = pick(["2020-02-29", "2021-02-29", "2020-2-9", None, "2024-12-31"], F.col("s_suppkey"))
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), d.alias("date"), sinks.is_date(d).alias("valid"))
