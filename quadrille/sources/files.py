"""Readers for the file kinds of the job, as DataFrames.

Text kinds use Spark's own readers. Binary kinds that Spark does not know are read with ``binaryFile`` and
small parsers in tasks, one file a row, so they suit files that a task can hold (Spark's own limit is 2 GB);
rows leave a task in pieces, whatever a file holds. Large OSM extracts have a source of their own (``osm``).
Parsers take (path, content) rows, so they also work on files that come out of archives or tables.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


#: Rows that leave a parser at once.
PIECE = 10_000


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of every file."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(file, ...) rows that ``parse(path, content)`` gives for every (path, content) row."""
    names = [f.split()[0] for f in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = ((file, *row) for row in parse(file, content))
                while piece := list(islice(rows, PIECE)):
                    yield pd.DataFrame(piece, columns=["file", *names])

    return files.select("path", "content").mapInPandas(run, f"file string, {schema}")


def digests(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files, to hold downloads against what their provider states."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


AREA = "id string, name string, bbox struct<south:double,west:double,north:double,east:double>, projection struct<lat0:double,lon0:double>, layers array<string>, targetWards array<string>"


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Area definitions, one document each: id, name, bbox, projection, layers, target wards. A job picks its own by id."""
    return spark.read.schema(AREA).json(path, multiLine=True)


def read_optional_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON document, or no rows where there is no file."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, cells) of a CSV with quoted commas and doubled quotes; blanks are empty texts."""
    df = spark.read.csv(path, header=False, quote='"', escape='"', multiLine=True)
    cells = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in df.columns))
    return df.select(F.monotonically_increasing_id().alias("row_no"), cells.alias("cells"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """OSM elements of query results, {"elements": [...]} or a bare array."""
    element = "struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>"
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<elements:array<{element}>>")["elements"]
    bare = F.from_json("value", f"array<{element}>")
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("e")).select("e.*")


def read_feature_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features of a collection written one a line; a broken feature line raises."""
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace(F.trim("value"), ",$", "")).alias("line"))
    rows = lines.where(F.col("line").startswith('{"type":"Feature"') | F.col("line").startswith('{"type": "Feature"'))
    rows = rows.where(~F.col("line").contains("FeatureCollection"))
    return rows.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("f")).select("f.*")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines): broken lines are counted, not fatal."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_bad")


def read_tiles(spark: SparkSession, path: str, schema: str, id_col: str = "id") -> DataFrame:
    """Features of all tile files, each once: the first by file."""
    text = spark.read.option("pathGlobFilter", "tile_*.json").text(path, wholetext=True)
    return tile_features(text.select(F.input_file_name().alias("path"), "value"), schema, id_col)


def tile_features(tiles: DataFrame, schema: str, id_col: str = "id") -> DataFrame:
    """Features of (path, value) tile documents, each once: the first by path. Files with another name are passed over."""
    named = tiles.where(F.regexp_extract("path", r"(^|/)tile_(-?\d+)_(-?\d+)\.json$", 0) != "")
    rows = named.select("path", F.explode(F.from_json("value", f"struct<features:array<struct<{schema}>>>")["features"]).alias("f"))
    return rows.groupBy(F.col(f"f.{id_col}")).agg(F.min_by("f", "path").alias("f")).select("f.*")


def decode_strictly(content: bytes, tokens: list[str], charset: str | None = None) -> tuple[str, str] | None:
    """(charset, text) of the first charset that decodes without loss and shows all tokens; None for none."""
    marks = [(b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")]
    for name in [*(n for mark, n in marks if content.startswith(mark)), *([charset] if charset else []), "utf-8", "cp932"]:
        try:
            text = content.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        if all(t in text for t in tokens):
            return name, text
    return None


def read_text_strictly(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """(file, charset, text, ok): never a lossy replacement; ok is false where no charset fits."""
    return texts_strictly(contents(spark, path), tokens)


def texts_strictly(files: DataFrame, tokens: list[str]) -> DataFrame:
    def parse(_: str, content: bytes) -> Iterator[tuple]:
        found = decode_strictly(content, tokens)
        yield (*found, True) if found else (None, None, False)

    return parsed(files, parse, "charset string, text string, ok boolean")


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook's sheet; gaps are empty texts."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = [(s.get("name"), s.get(rel)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{m}sheet")]
        name, key = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s[0] == sheet)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{m}si")]
        root = ElementTree.fromstring(book.read("xl/" + targets[key].removeprefix("/xl/")))
    for number, row in enumerate(root.iter(f"{m}row"), 1):
        cells: list[str] = []
        for c in row.iter(f"{m}c"):
            column = 0
            for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                column = column * 26 + ord(letter) - 64
            value, kind = c.findtext(f"{m}v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{m}t")) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value or ""
            cells += [""] * (max(column, len(cells) + 1) - len(cells))
            cells[(column or len(cells)) - 1] = text
        yield name, int(row.get("r", number)), cells


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    return workbook_rows(contents(spark, path), sheet)


def workbook_rows(files: DataFrame, sheet: str | int = 0) -> DataFrame:
    """(file, sheet, row_no, cells) of a sheet of every workbook."""
    return parsed(files, lambda _, content: sheet_rows(content, sheet), "sheet string, row_no long, cells array<string>")


def read_archive(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    return archive_entries(contents(spark, path), with_content)


def archive_entries(files: DataFrame, with_content: bool = False) -> DataFrame:
    """Entries of ZIP files: name, size, and the content on demand."""

    def parse(_: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for e in z.infolist():
                yield e.filename, e.file_size, z.read(e) if with_content else None

    return parsed(files, parse, "entry string, size long, content binary")


def shape_rows(shp: bytes) -> Iterator[tuple[int, list[list[float]]]]:
    """(record number, parts as flat coordinates) of a polygon shapefile; other shapes have no parts."""
    at = 100
    while at + 12 <= len(shp):
        number, words = struct.unpack_from(">ii", shp, at)
        kind = struct.unpack_from("<i", shp, at + 8)[0]
        parts: list[list[float]] = []
        if kind in (5, 15, 25):
            n_parts, n_points = struct.unpack_from("<ii", shp, at + 44)
            starts = [*struct.unpack_from(f"<{n_parts}i", shp, at + 52), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", shp, at + 52 + 4 * n_parts)
            parts = [list(flat[2 * a : 2 * b]) for a, b in zip(starts, starts[1:])]
        yield number, parts
        at += 8 + 2 * words


def dbf_rows(dbf: bytes, charset: str = "cp932") -> Iterator[tuple[int, dict[str, str]]]:
    """(record number, fields as text) of a dBase table; deleted records are left out but keep their number."""
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields = [(dbf[i : i + 11].split(b"\x00")[0].decode(charset), dbf[i + 16]) for i in range(32, head - 1, 32)]
    for number in range(n):
        at = head + number * size
        if dbf[at : at + 1] != b"*":
            at, out = at + 1, {}
            for name, width in fields:
                out[name] = dbf[at : at + width].decode(charset, "strict").strip()
                at += width
            yield number + 1, out


def read_shapefile(spark: SparkSession, path: str, charset: str = "cp932") -> DataFrame:
    """(record, parts, attributes): polygons joined with their table by file stem and record number."""
    return shapes_with_facts(contents(spark, path, "*.shp"), contents(spark, path, "*.dbf"), charset)


def shapes_with_facts(shp: DataFrame, dbf: DataFrame, charset: str = "cp932") -> DataFrame:
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    shapes = parsed(shp, lambda _, c: shape_rows(c), "record long, parts array<array<double>>").withColumn("stem", stem)
    facts = parsed(dbf, lambda _, c: dbf_rows(c, charset), "record long, attributes map<string,string>").withColumn("stem", stem)
    return shapes.join(facts, ["stem", "record"]).select("stem", "record", "parts", "attributes")


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """CityGML buildings: id, height, storeys, usage, footprint (z0 of the lowest ring too); parts stay inside their building.

    Footprint: the level-0 footprint, else the ground surface. Height: measured, else storeys x 3, else 3."""
    schema = """_gml:id string, `bldg:measuredHeight` string, `bldg:storeysAboveGround` string, `bldg:usage` string,
      `bldg:lod0FootPrint` struct<`gml:MultiSurface`:struct<`gml:surfaceMember`:struct<`gml:Polygon`:struct<`gml:exterior`:struct<`gml:LinearRing`:struct<`gml:posList`:string>>>>>>"""
    df = spark.read.format("xml").option("rowTag", "bldg:Building").schema(schema.replace("_gml:id", "`_gml:id`")).load(path)
    pos = F.col("`bldg:lod0FootPrint`.`gml:MultiSurface`.`gml:surfaceMember`.`gml:Polygon`.`gml:exterior`.`gml:LinearRing`.`gml:posList`")
    numbers = F.transform(F.split(F.trim(pos), r"\s+"), lambda v: v.try_cast("double"))
    n = (F.size(numbers) / 3).cast("int")
    ring = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.element_at(numbers, i * 3 + 2).alias("lon"), F.element_at(numbers, i * 3 + 1).alias("lat"))))
    measured, storeys = F.col("`bldg:measuredHeight`").try_cast("double"), F.col("`bldg:storeysAboveGround`").try_cast("double")
    height = F.when(measured > 0, measured).when(storeys > 0, storeys * 3.0).otherwise(3.0)
    return df.select(F.col("`_gml:id`").alias("id"), height.alias("height"), storeys.alias("storeys"), F.col("`bldg:usage`").alias("usage"), ring.alias("ring"))


def small_area_code(code: str = "KEY_CODE"):
    """An 11-digit key as struct<municipality, town>; null for another form."""
    c = F.col(code)
    return F.when(c.rlike("^[0-9]{11}$"), F.struct(F.substring(c, 1, 5).alias("municipality"), F.substring(c, 6, 6).alias("town")))


def ingest_areas(features: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(areas, disagreements, missing wards): features joined to a registry by code and by name; several
    features of a ward become its polygons. ``features``: code, name, outer; ``registry``: ward_id, name, code."""
    by_code = registry.select("code", F.col("ward_id").alias("id_by_code"))
    by_name = registry.select("name", F.col("ward_id").alias("id_by_name"))
    found = features.join(by_code, "code", "left").join(by_name, "name", "left")  # Spark broadcasts a side by its size
    good = F.col("id_by_code").eqNullSafe(F.col("id_by_name")) & F.col("id_by_code").isNotNull()
    none = F.array().cast("array<array<struct<x:double,z:double>>>")
    areas = found.where(good).groupBy(F.col("id_by_code").alias("ward_id")).agg(F.collect_list(F.struct("outer", none.alias("holes"))).alias("polygons"))
    return areas, found.where(~good & (F.col("id_by_code").isNotNull() | F.col("id_by_name").isNotNull())), registry.join(areas.select("ward_id"), "ward_id", "left_anti")


def selector(key: str, value: str | None = None, kind: str = "way") -> str:
    """One selector of an element query; quotes and backslashes in values are escaped."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return f"{kind}[{quote(key)}]" if value is None else f"{kind}[{quote(key)}={quote(value)}]"


def element_query(box: tuple[float, float, float, float], selectors: list[str], timeout: int = 60) -> str:
    """The query text for elements in a (south, west, north, east) box."""
    area = ",".join(f"{v:g}" for v in box)
    return f"[out:json][timeout:{timeout}];({''.join(f'{s}({area});' for s in selectors)});out tags geom;"


def read_embedded(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a JSON array that a page assigns to a constant (``const NAME = [...];``)."""
    return embedded_rows(spark.read.text(path, wholetext=True), name, schema)


def embedded_rows(pages: DataFrame, name: str, schema: str) -> DataFrame:
    found = F.regexp_extract("value", rf"(?s)\b{name}\s*=\s*(\[.*?\])\s*;", 1)
    return pages.select(F.explode(F.from_json(found, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def read_gml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one kind of a GML document (roads, road edges, building outlines), one row each."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def positions(text: Column, width: int = 2) -> Column:
    """A position list as ARRAY<STRUCT<a, b>>: the first two numbers of every ``width``."""
    numbers = F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))
    n = (F.size(numbers) / width).cast("int")
    indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(indices, lambda i: F.struct(F.element_at(numbers, i * width + 1).alias("a"), F.element_at(numbers, i * width + 2).alias("b")))


def tiff_header(content: bytes) -> Iterator[tuple]:
    """(width, height, pixel size x, y, origin x, y) of a GeoTIFF's first directory; missing values are null."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(f"{order}H", content, 2)[0] != 42:
        return
    at = struct.unpack_from(f"{order}I", content, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(f"{order}H", content, at)[0]):
        tag, kind, n = struct.unpack_from(f"{order}HHI", content, at + 2 + 12 * i)
        letter, size = {3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}.get(kind, ("B", 1))
        place = at + 10 + 12 * i if n * size <= 4 else struct.unpack_from(f"{order}I", content, at + 10 + 12 * i)[0]
        tags[tag] = struct.unpack_from(f"{order}{n}{letter}", content, place)
    scale, tie = tags.get(33550, (None, None)), tags.get(33922, (None,) * 6)
    yield int(tags[256][0]), int(tags[257][0]), scale[0], scale[1], tie[3], tie[4]


def read_tiff_headers(spark: SparkSession, path: str) -> DataFrame:
    return tiff_rows(contents(spark, path))


def tiff_rows(files: DataFrame) -> DataFrame:
    return parsed(files, lambda _, content: tiff_header(content), "width long, height long, size_x double, size_y double, origin_x double, origin_y double")


def heading_columns(cells: DataFrame, wanted: dict[str, list[str]], row_no: str = "row_no") -> dict[str, int]:
    """Column numbers of headings in the first 20 rows of a sheet: names in ``wanted`` to the first column whose
    one- or two-row heading holds an alias that no digit runs into. Twenty rows are read, whatever the sheet has."""
    rows = [r["cells"] for r in cells.orderBy(row_no).limit(20).collect()]
    clean = lambda s: re.sub(r"[\s　（）()〔〕\[\]【】\-－―~〜・]|[*※]\d*|注\d*", "", (s or "").translate(str.maketrans("０１２３４５６７８９", "0123456789")))
    holds = lambda text, alias: re.search((r"(?<!\d)" if alias[:1].isdigit() else "") + re.escape(alias) + (r"(?!\d)" if alias[-1:].isdigit() else ""), text)
    found: dict[str, int] = {}
    for upper, lower in zip([[]] + rows, rows):
        last, spread = "", []
        for i in range(len(lower)):  # a merged heading stands in its first cell only
            last = clean(upper[i]) if i < len(upper) and upper[i] else last
            spread.append(last)
        for name, aliases in wanted.items():
            for i, cell in enumerate(lower):
                if name not in found and any(holds(clean(cell), a) or holds(spread[i] + clean(cell), a) for a in aliases):
                    found[name] = i
    return found


def polygons_of(parts: Column) -> Column:
    """Rings (flat coordinates) of one shape as ARRAY<STRUCT<outer, holes>>: a ring within an even number of larger
    ones is an outline, one within an odd number is a hole of the smallest outline around it. Rings of no area go.
    A ring's place is that of its first point, and what touches an edge from within counts as inside."""
    from quadrille.functions import geo

    numbers = lambda flat: F.when(F.size(flat) >= 2, F.sequence(F.lit(1), (F.size(flat) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    ring = lambda flat: F.transform(numbers(flat), lambda i: geo.point(F.element_at(flat, i * 2 - 1), F.element_at(flat, i * 2)))
    open_ = lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    # What is used more than once is a variable: written out, it would be computed anew for every ring that looks at it.
    let = lambda value, of: F.element_at(F.transform(F.array(value), of), 1)
    rings = F.transform(F.transform(parts, ring), open_)
    sized = F.filter(F.transform(rings, lambda r: F.struct(geo.area(r).alias("area"), r.alias("ring"))), lambda r: (F.size(r["ring"]) >= 3) & (r["area"] > 0))
    around = lambda r, rows: F.transform(F.filter(rows, lambda o: (o["area"] > r["area"]) & geo.in_ring(r["ring"][0]["x"], r["ring"][0]["z"], o["ring"])), lambda o: o["area"])
    deep = lambda rows: F.transform(rows, lambda r: let(around(r, rows), lambda sizes: F.struct(r["ring"].alias("ring"), F.size(sizes).alias("depth"), F.array_min(sizes).alias("parent"), r["area"].alias("area"))))
    holes = lambda o, rows: F.transform(F.filter(rows, lambda r: (r["depth"] == o["depth"] + 1) & (r["parent"] == o["area"]) & geo.in_ring(r["ring"][0]["x"], r["ring"][0]["z"], o["ring"])), lambda r: r["ring"])
    nested = lambda rows: F.transform(F.filter(rows, lambda r: r["depth"] % 2 == 0), lambda o: F.struct(o["ring"].alias("outer"), holes(o, rows).alias("holes")))
    return let(sized, lambda rows: let(deep(rows), nested))


# ---- GeoJSON ---------------------------------------------------------------------------------------


def geometry_of(text: Column) -> Column:
    """A geometry's text as struct<type, point, polygons>; the coordinates of a polygon are one polygon."""
    rings = "array<array<array<double>>>"
    kind = F.get_json_object(text, "$.type")
    at = F.get_json_object(text, "$.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(at, rings))).when(kind == "MultiPolygon", F.from_json(at, f"array<{rings}>"))
    return F.struct(kind.alias("type"), F.when(kind == "Point", F.from_json(at, "array<double>")).alias("point"), polygons.alias("polygons"), F.coalesce(at.startswith("["), F.lit(False)).alias("listed"))


def geometry_problem(text: Column, points: bool = False) -> Column:
    """What is wrong with a geometry's structure; null for nothing. points: whether a single point will do."""
    g = geometry_of(text)
    bad_point = lambda p: p.isNull() | (F.size(p) < 2) | F.exists(F.slice(p, 1, 2), lambda v: v.isNull() | F.isnan(v))
    bad_ring = lambda r: r.isNull() | (F.size(r) == 0) | F.exists(r, bad_point)
    empty = F.exists(g["polygons"], lambda p: p.isNull())
    return (
        F.when(g["type"].isNull() & ~g["listed"], "no-geometry")
        .when(~g["listed"], "no-coordinates")
        .when((g["type"] == "Point") & F.lit(not points), "point-not-allowed")
        .when((g["type"] == "Point") & bad_point(g["point"]), "bad-point")
        .when(g["type"] == "Point", None)
        .when(~F.coalesce(g["type"].isin("Polygon", "MultiPolygon"), F.lit(False)), "unknown-type")
        .when(g["polygons"].isNull() | empty, "no-coordinates")
        .when(F.exists(g["polygons"], lambda p: F.exists(p, bad_ring)), "bad-ring")
    )


def geometry_rings(text: Column, lat0: float, lon0: float) -> Column:
    """All rings of a sound geometry in metres, outlines and holes in one list; a point is a ring of one."""
    from quadrille.functions import geo

    g = geometry_of(text)
    local = lambda p: geo.to_local(p[1], p[0], lat0, lon0)
    return F.when(g["type"] == "Point", F.array(F.array(local(g["point"])))).otherwise(F.transform(F.flatten(g["polygons"]), lambda r: F.transform(r, local)))


def merged_geometry(text: Column) -> Column:
    """An aggregate: the polygons of a group's sound geometries as one MultiPolygon. A group is one area's features."""
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.flatten(F.collect_list(geometry_of(text)["polygons"])).alias("coordinates")))


# ---- road areas, building levels, knowledge base -----------------------------------------------------

# Codes of the published lists.
ROAD_CLASSES = {
    "1": "expressway", "2": "national", "3": "prefectural", "4": "municipal", "10": "buildingStandardAct", "11": "buildingStandardAct", "12": "buildingStandardAct",
    "13": "buildingStandardAct", "14": "buildingStandardAct", "15": "buildingStandardAct", "9000": "unsurveyed", "9010": "outOfScope", "9020": "unknown",
}
ROAD_STRUCTURES = {"1": "ground", "2": "elevated", "3": "bridge", "4": "intersection", "5": "underpass", "6": "tunnel", "7": "elevated", "9": "unknown"}
LEAST_ROAD, MOST_ROAD = 1.0, 600_000.0


def read_road_areas(spark: SparkSession, path: str, lat0: float, lon0: float) -> DataFrame:
    """Roads of a CityGML document: id, admin_class, structure, subsurface, rings (outlines of the level-1 surface,
    metres), area, problem (null: usable). Three numbers a position: latitude, longitude, height."""
    from quadrille.functions import geo
    from quadrille.functions.classify import lookup

    ring = "struct<`gml:LinearRing`:struct<`gml:posList`:string>>"
    member = f"struct<`gml:Polygon`:struct<`gml:exterior`:{ring}>>"
    schema = f"`_gml:id` string, `tran:function` string, `uro:sectionType` string, `tran:lod1MultiSurface` struct<`gml:MultiSurface`:struct<`gml:surfaceMember`:array<{member}>>>"
    df = read_gml(spark, path, "tran:Road", schema)
    lists = F.transform(F.col("`tran:lod1MultiSurface`.`gml:MultiSurface`.`gml:surfaceMember`"), lambda m: m["gml:Polygon"]["gml:exterior"]["gml:LinearRing"]["gml:posList"])
    df = df.select(
        F.col("`_gml:id`").alias("id"), F.trim("`tran:function`").alias("f"), F.trim("`uro:sectionType`").alias("s"),
        F.filter(F.transform(lists, lambda t: F.transform(positions(t, 3), lambda p: geo.to_local(p["a"], p["b"], lat0, lon0, south=True))), lambda r: F.size(r) >= 3).alias("rings"),
    )
    areas = F.transform("rings", geo.area)
    structure = F.when(F.col("s").isNull(), "unknown").otherwise(lookup(F.col("s"), ROAD_STRUCTURES, "unknown"))
    odd = F.exists("rings", lambda r: F.exists(r, lambda p: p["x"].isNull() | p["z"].isNull()))
    problem = (
        F.when(F.coalesce(F.size("rings"), F.lit(-1)) <= 0, "no-exterior-ring")
        .when(odd, "non-finite")
        .when(F.exists(areas, lambda a: a < LEAST_ROAD), "zero-area")
        .when(F.exists(areas, lambda a: a > MOST_ROAD), "giant-polygon")
    )
    return df.select(
        "id", F.when(F.col("f").isNull(), "unknown").otherwise(lookup(F.col("f"), ROAD_CLASSES, "unknown")).alias("admin_class"), structure.alias("structure"), (structure == "tunnel").alias("subsurface"),
        "rings", F.aggregate(areas, F.lit(0.0), lambda acc, a: acc + a).alias("area"), problem.alias("problem"),
    )


def read_building_levels(spark: SparkSession, path: str) -> DataFrame:
    """Buildings of a CityGML document with the levels of detail they have: id, lod1, lod2, n_roof, n_wall, n_ground."""
    any_ = "struct<`gml:name`:string,`_x`:string,`_VALUE`:string>"
    bounded = f"array<struct<`bldg:RoofSurface`:{any_},`bldg:WallSurface`:{any_},`bldg:GroundSurface`:{any_}>>"
    df = read_gml(spark, path, "bldg:Building", f"`_gml:id` string, `bldg:lod1Solid` {any_}, `bldg:lod2Solid` {any_}, `bldg:lod2MultiSurface` {any_}, `bldg:boundedBy` {bounded}")
    there = lambda c: F.col(f"`bldg:{c}`").isNotNull()
    count = lambda kind: F.size(F.filter(F.coalesce(F.col("`bldg:boundedBy`"), F.array().cast(bounded)), lambda s: s[f"bldg:{kind}Surface"].isNotNull()))
    return df.select(F.col("`_gml:id`").alias("id"), there("lod1Solid").alias("lod1"), (there("lod2Solid") | there("lod2MultiSurface")).alias("lod2"), *(count(k).alias(f"n_{k.lower()}") for k in ("Roof", "Wall", "Ground")))


def level_audit(levels: DataFrame) -> DataFrame:
    """One row: buildings, those of each level, surfaces by kind, and buildings without an id."""
    return levels.agg(F.count("*").alias("buildings"), *(F.count_if(c).alias(c) for c in ("lod1", "lod2")), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_roof", "n_wall", "n_ground")), F.count_if(F.col("id").isNull()).alias("no_id"))


def query_bindings(texts: DataFrame, column: str = "value") -> DataFrame:
    """(item, name, lon, lat) of a knowledge base's query results; rows without an item or a point go."""
    field = lambda f: f"{f}:struct<value:string>"
    schema = f"struct<results:struct<bindings:array<struct<{','.join(map(field, ('item', 'coord', 'itemLabel')))}>>>>"
    b = texts.select(F.explode(F.from_json(column, schema)["results"]["bindings"]).alias("b"))
    number = lambda i: F.regexp_extract("b.coord.value", r"Point\(([-\d.]+) ([-\d.]+)\)", i).try_cast("double")
    out = b.select(F.element_at(F.split("b.item.value", "/"), -1).alias("item"), F.col("b.itemLabel.value").alias("name"), number(1).alias("lon"), number(2).alias("lat"))
    return out.where("item <> '' and lon is not null and lat is not null")


def quarters(box: Column) -> Column:
    """A (west, south, east, north) box as its four quarters, to be asked for one by one."""
    x, z = (box["west"] + box["east"]) / 2, (box["south"] + box["north"]) / 2
    one = lambda w, s, e, n: F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    return F.array(one(box["west"], box["south"], x, z), one(x, box["south"], box["east"], z), one(box["west"], z, x, box["north"]), one(x, z, box["east"], box["north"]))


def selector_text(key: Column, value: Column, kind: str = "way") -> Column:
    """One selector of an element query from columns; a null value asks for the key only."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit(f"{kind}["), quoted(key), F.coalesce(F.concat(F.lit("="), quoted(value)), F.lit("")), F.lit("]"))
