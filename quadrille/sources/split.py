"""Sources that read one large file by many tasks: archives by their central directory, shapefiles by their index.

The driver reads the directory or index only; a task opens the file at its own place. Rows are pieces of bounded size, so
an entry of any size can be read. Paths are of any file system that Arrow opens; a folder stands for its files.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Bytes of a task, if no single entry or record has more, and of a piece of an entry.
TASK, PIECE = 32 << 20, 8 << 20


def opened(path: str):
    if "://" in path or path.startswith("file:"):
        store, at = pyarrow.fs.FileSystem.from_uri(path)
        return store.open_input_file(at)
    return open(path, "rb")


def files_at(path: str, ending: str) -> list[str]:
    """The file, or the files of a folder that end so."""
    store, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    if store.get_file_info(at).type != pyarrow.fs.FileType.Directory:
        return [path]
    found = sorted(i.path for i in store.get_file_info(pyarrow.fs.FileSelector(at)) if i.base_name.lower().endswith(ending))
    return [path.rstrip("/") + p[len(at.rstrip("/")) :] for p in found]


def grouped(items: Iterable, size_of, most: int) -> Iterator[list]:
    """Neighbours put together while they have ``most`` bytes or less."""
    group, size = [], 0
    for item in items:
        if group and size + size_of(item) > most:
            yield group
            group, size = [], 0
        group.append(item)
        size += size_of(item)
    if group:
        yield group


class Part(InputPartition):
    def __init__(self, path: str, items: list):
        super().__init__((path, items))
        self.path, self.items = path, items


#: Tasks of a read: more pieces than that are dealt to them, so small pieces do not make a task each.
MOST = 1024


def dealt(parts: list[Part]) -> list[Part]:
    """Neighbours of one file put together, if there are more than ``MOST``; a task takes its pieces one after the other."""
    if len(parts) <= MOST:
        return parts
    each, out = -(-len(parts) // MOST), []
    for part in parts:
        if out and out[-1][0].path == part.path and len(out[-1]) < each:
            out[-1].append(part)
        else:
            out.append([part])
    return [Part(many[0].path, [item for part in many for item in part.items]) for many in out]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, task: int, piece: int):
        self.path, self.task, self.piece, self.wanted = path, task, piece, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Names of entries; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("entry",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.wanted.append(f)
            yield f

    def _wants(self, name: str) -> bool:
        test = lambda f: name.startswith(f.value) if isinstance(f, StringStartsWith) else name in f.value if isinstance(f, In) else name == f.value
        return all(map(test, self.wanted))

    def partitions(self) -> list[Part]:
        out = []
        for path in files_at(self.path, ".zip"):
            with opened(path) as file, zipfile.ZipFile(file) as z:
                entries = [(e.header_offset, e.filename, e.file_size, e.compress_size) for e in z.infolist() if not e.is_dir() and self._wants(e.filename)]
            out += [Part(path, [e[1] for e in group]) for group in grouped(sorted(entries), lambda e: max(e[2], e[3]), self.task)]
        return dealt(out)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:
            return
        with opened(partition.path) as file, zipfile.ZipFile(file) as z:
            for name in partition.items:
                size, number = z.getinfo(name).file_size, 0
                with z.open(name) as entry:  # its checksum is verified when the last piece is read
                    while (piece := entry.read(self.piece)) or number == 0:
                        yield partition.path.rsplit("/", 1)[-1], name, size, number, piece
                        number += 1


class ArchiveSource(DataSource):
    """``spark.read.format("zipentries").load(path)``: file, entry, size, piece (from 0), content. Options: taskbytes,
    piecebytes."""

    @classmethod
    def name(cls) -> str:
        return "zipentries"

    def schema(self) -> str:
        return "file string, entry string, size long, piece int, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("taskbytes", TASK)), int(self.options.get("piecebytes", PIECE)))


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, task: int, charset: str):
        self.path, self.task, self.charset = path, task, charset

    def partitions(self) -> list[Part]:
        out = []
        for path in files_at(self.path, ".shp"):
            with opened(f"{path[:-4]}.shx") as file:
                index = file.read()
            places = [(n + 1, 2 * at, 8 + 2 * size) for n, (at, size) in enumerate(struct.iter_unpack(">ii", index[100 : 100 + (len(index) - 100) // 8 * 8]))]
            out += [Part(path, [(g[0][0], len(g), min(x[1] for x in g), max(x[1] + x[2] for x in g))]) for g in grouped(places, lambda x: x[2], self.task)]
        return dealt(out)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        from quadrille.sources.files import shape_rows

        if partition is None:
            return
        stem = partition.path.rsplit("/", 1)[-1][:-4]
        with opened(f"{partition.path[:-4]}.dbf") as table, opened(partition.path) as file:
            total, start, width = struct.unpack_from("<IHH", table.read(32), 4)
            names = table.read(start - 32)
            fields = [(names[i : i + 11].split(b"\x00")[0].decode(self.charset), names[i + 16]) for i in range(0, len(names) - 1, 32)]
            for first, count, low, high in partition.items:
                table.seek(start + (first - 1) * width)
                facts = table.read(count * width)
                file.seek(low)
                for number, parts in shape_rows(bytes(100) + file.read(high - low)):
                    row = facts[(number - first) * width :][:width]
                    if first <= number < first + count and number <= total and row[:1] != b"*":
                        at, values = 1, {}
                        for name, n in fields:
                            values[name] = row[at : at + n].decode(self.charset, "strict").strip()
                            at += n
                        yield stem, number, parts, values


class ShapeSource(DataSource):
    """``spark.read.format("shapefile").load(path)``: stem, record, parts, attributes; deleted records are left out.
    Options: taskbytes, charset (cp932 if none is given)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "stem string, record long, parts array<array<double>>, attributes map<string,string>"

    def reader(self, schema) -> ShapeReader:
        return ShapeReader(self.options["path"], int(self.options.get("taskbytes", TASK)), self.options.get("charset", "cp932"))


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(ShapeSource)
