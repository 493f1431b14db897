"""OSM extracts in protocol-buffer form, as a Spark data source: one partition a blob.

The driver walks the blob headers only; tasks unpack and decode their own byte ranges, so an extract is read
by as many tasks as it has blobs, and no task holds more than one blob. Filters on type and id are pushed down: where an
extract says that it is sorted, the driver finds the blobs that can hold a match by bisection, unpacking a few of them,
and no task is made for the others; within a blob, groups of other types are not decoded.
"""

from __future__ import annotations

import bisect
import bz2
import lzma
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "type string, id long, lat double, lon double, refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
NAMES = ("type", "id", "lat", "lon", "refs", "members", "tags")
KINDS = ("node", "way", "relation")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields: ints, or bytes for length-delimited ones."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            value, at = varint(data, at)
        elif key & 7 == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def numbers(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n >> 1 ^ -(n & 1) if signed else n)
    return out


def running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def tags_of(keys: list[int], values: list[int], words: list[str]) -> dict[str, str]:
    return {words[k]: words[v] for k, v in zip(keys, values)}


#: How a blob's bytes are packed, by the number of the field that holds them; LZ4 and Zstandard need the size.
UNPACK = {
    1: lambda data, size: data, 3: lambda data, size: zlib.decompress(data), 4: lambda data, size: lzma.decompress(data), 5: lambda data, size: bz2.decompress(data),
    6: lambda data, size: pa.Codec("lz4_raw").decompress(data, size, asbytes=True), 7: lambda data, size: pa.Codec("zstd").decompress(data, size, asbytes=True),
}


def unpacked(blob: bytes) -> bytes:
    """What a blob holds."""
    own = dict(fields(blob))
    number = next((n for n in own if n in UNPACK), None)
    if number is None:
        raise ValueError(f"a blob of unknown packing: fields {sorted(own)}")
    return UNPACK[number](own[number], own.get(2))


#: The type of a group's field.
GROUPS = {1: "node", 2: "node", 3: "way", 4: "relation"}


def primitives(block: bytes, kinds: Iterable[str] = KINDS) -> Iterator[tuple]:
    """Rows of one primitive block, of the kinds asked for."""
    parts: dict[int, list] = {}
    for number, value in fields(block):
        parts.setdefault(number, []).append(value)
    words = [w.decode() for n, w in fields(parts[1][0]) if n == 1]
    grain, lat0, lon0 = (parts.get(n, [d])[0] for n, d in ((17, 100), (19, 0), (20, 0)))
    degrees = lambda v, o: 1e-9 * (o + grain * v)
    for group in parts.get(2, ()):
        for kind, message in fields(group):
            if GROUPS.get(kind) not in kinds:
                continue
            own = dict(fields(message)) if kind in (1, 2, 3, 4) else {}
            if kind == 2:
                mixed = numbers(own.get(10, b""))
                at = 0
                for id_, lat, lon in zip(running(numbers(own[1], True)), running(numbers(own[8], True)), running(numbers(own[9], True))):
                    found = {}
                    while at < len(mixed) and mixed[at]:
                        found[words[mixed[at]]] = words[mixed[at + 1]]
                        at += 2
                    at += 1
                    yield "node", id_, degrees(lat, lat0), degrees(lon, lon0), None, None, found
            elif kind == 1:
                zig = lambda n: n >> 1 ^ -(n & 1)
                yield "node", zig(own[1]), degrees(zig(own[8]), lat0), degrees(zig(own[9]), lon0), None, None, tags_of(numbers(own.get(2, b"")), numbers(own.get(3, b"")), words)
            elif kind == 3:
                yield "way", own[1], None, None, running(numbers(own.get(8, b""), True)), None, tags_of(numbers(own.get(2, b"")), numbers(own.get(3, b"")), words)
            elif kind == 4:
                members = [(KINDS[t], r, words[s]) for s, r, t in zip(numbers(own.get(8, b"")), running(numbers(own.get(9, b""), True)), numbers(own.get(10, b"")))]
                yield "relation", own[1], None, None, None, members, tags_of(numbers(own.get(2, b"")), numbers(own.get(3, b"")), words)


def decoded_blobs(blobs: DataFrame) -> DataFrame:
    """Primitives of (path, content) rows that each hold one blob of an extract."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = primitives(unpacked(content))
                while piece := list(islice(rows, 10_000)):
                    yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(NAMES, zip(*piece))})

    return blobs.select("path", "content").mapInPandas(run, SCHEMA)


class Blob(InputPartition):
    def __init__(self, path: str, offset: int, size: int):
        super().__init__((path, offset, size))
        self.path, self.offset, self.size = path, offset, size


class OsmReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.kinds, self.low, self.high = set(KINDS), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Types and bounds of ids; Spark applies all filters again to what is read."""
        for f in filters:
            name, value = f.attribute if hasattr(f, "attribute") else (), getattr(f, "value", None)
            if name == ("type",) and isinstance(f, (EqualTo, In)):
                self.kinds &= {value} if isinstance(f, EqualTo) else set(value)
            elif name == ("id",) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                values = [v for v in (value if isinstance(f, In) else [value]) if v is not None]
                low, high = (min(values, default=1), max(values, default=0)) if isinstance(f, (EqualTo, In)) else (values[0] if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else None, values[0] if isinstance(f, (LessThan, LessThanOrEqual)) else None)
                self.low = low if self.low is None else self.low if low is None else max(self.low, low)
                self.high = high if self.high is None else self.high if high is None else min(self.high, high)
            yield f

    def _files(self) -> list[str]:
        """The extract, or all extracts of a folder."""
        import pyarrow.fs

        store, at = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.path)
        if store.get_file_info(at).type != pyarrow.fs.FileType.Directory:
            return [self.path]
        found = sorted(i.path for i in store.get_file_info(pyarrow.fs.FileSelector(at)) if i.base_name.endswith(".pbf"))
        return [self.path.rstrip("/") + p[len(at.rstrip("/")) :] for p in found]

    def _open(self, path: str):
        import pyarrow.fs

        if "://" in path or path.startswith("file:"):
            store, at = pyarrow.fs.FileSystem.from_uri(path)
            return store.open_input_file(at)
        return open(path, "rb")

    def _block(self, blob: Blob) -> bytes:
        with self._open(blob.path) as file:
            file.seek(blob.offset)
            return unpacked(file.read(blob.size))

    def _of_file(self, path: str) -> list[Blob]:
        found, is_sorted = [], False
        with self._open(path) as file:
            file.seek(0)
            while len(head := file.read(4)) == 4:
                own = dict(fields(file.read(struct.unpack(">I", head)[0])))
                at = file.tell()
                if own[1] == b"OSMData":
                    found.append(Blob(path, at, own[3]))
                elif own[3]:  # the extract's header: field 5 has what a reader may rely on
                    is_sorted |= any(n == 5 and v == b"Sort.Type_then_ID" for n, v in fields(unpacked(file.read(own[3]))))
                file.seek(at + own[3])
        return self._between(found) if is_sorted else found

    def _between(self, blobs: list[Blob]) -> list[Blob]:
        """The blobs of a sorted extract from the first one that can hold a match to the last."""
        kinds = sorted(KINDS.index(k) for k in self.kinds)
        one = len(kinds) == 1
        first = (kinds[0], self.low if one and self.low is not None else float("-inf"))
        last = (kinds[-1], self.high if one and self.high is not None else float("inf"))

        def begins(blob: Blob) -> tuple[int, int]:
            kind, id_, *_ = next(primitives(self._block(blob)), (KINDS[0], 0))
            return KINDS.index(kind), id_

        start = max(0, bisect.bisect_left(blobs, first, key=begins) - 1)
        return blobs[start : bisect.bisect_right(blobs, last, lo=start, key=begins)]

    def partitions(self) -> list[Blob]:
        if not self.kinds & set(KINDS) or (self.low is not None and self.high is not None and self.low > self.high):
            return []
        return [blob for path in self._files() for blob in self._of_file(path)]

    def read(self, partition: Blob | None) -> Iterator[tuple]:
        if partition is None:  # no blob can hold a match: Spark asks once all the same
            return
        low, high = self.low, self.high
        for row in primitives(self._block(partition), self.kinds):
            if (low is None or row[1] >= low) and (high is None or row[1] <= high):
                yield row


class OsmSource(DataSource):
    """``spark.read.format("osmpbf").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OsmReader:
        return OsmReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OsmSource)
