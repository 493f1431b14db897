"""Tables of committed folders: a log of numbered entries, each put there in one step, says which folders count.

A writer writes a folder of its own first; the entry that names it appears by one rename, or not at all. Readers take the
log as it is: of a table that is replaced the last entry, of one that grows all of them. Nothing that a reader may be
reading is moved or changed; ``vacuum`` removes what no entry to be kept names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has put this entry into the log."""


class Log:
    """The entries of one table: number and the folder it names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), f"{path.rstrip('/')}/_log"
        jvm = spark.sparkContext._jvm
        self.at = jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> dict[int, str]:
        """Folders by number, in order. The name of an entry's file holds both, so one listing is one state."""
        if not self.fs.exists(self.at(self.folder)):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(self.folder))]
        return dict(sorted((int(n.split(".")[0]), n.split(".", 1)[1]) for n in names if n[:1].isdigit()))

    def new_folder(self, number: int) -> str:
        return f"{self.path}/d{number:012d}-{uuid.uuid4().hex}"

    def commit(self, number: int, folder: str) -> None:
        """Put an entry into the log, in one step. One writer at a time is the rule (a stream's query, a nightly job); a
        second one of the same number is told so."""
        if number in self.entries():
            raise Conflict(f"{self.path}: entry {number} is there")
        self.fs.mkdirs(self.at(self.folder))
        if not self.fs.createNewFile(self.at(f"{self.folder}/{number:012d}.{folder.rsplit('/', 1)[1]}")):
            raise Conflict(f"{self.path}: entry {number} is there")

    def remove(self, folders: list[str]) -> None:
        for name in folders:
            self.fs.delete(self.at(f"{self.path}/{name}"), True)


def _look(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def publish(df: DataFrame, path: str, format: str = "parquet") -> int:
    """Replace a table: write a folder, read it back, and commit it if rows and content agree. Returns the rows. Readers see
    the table before or after it, and a failure leaves it as it was."""
    log = Log(df.sparkSession, path)
    number = max(log.entries(), default=0) + 1
    folder = log.new_folder(number)
    df.write.format(format).save(folder)
    wrote, found = _look(df), _look(df.sparkSession.read.schema(df.schema).format(format).load(folder))
    if wrote != found:
        log.remove([folder.rsplit("/", 1)[1]])
        raise RuntimeError(f"read back {found}, wrote {wrote}")
    log.commit(number, folder)
    return wrote[0]


def current(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet") -> DataFrame:
    """The table as last published; empty before that."""
    entries = Log(spark, path).entries()
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(format).load(f"{path.rstrip('/')}/{entries[max(entries)]}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove folders that none of the last ``keep`` entries names, with their entries; returns how many. Run it when no
    writer is at work and no reader is older than those entries."""
    log = Log(spark, path)
    entries = log.entries()
    kept = {entries[n] for n in sorted(entries)[-keep:]}
    old = [s.getPath().getName() for s in log.fs.listStatus(log.at(log.path)) if s.getPath().getName().startswith("d")]
    gone = [name for name in old if name not in kept]
    for number, name in entries.items():
        if name not in kept:
            log.fs.delete(log.at(f"{log.folder}/{number:012d}.{name}"), False)
    log.remove(gone)
    return len(gone)


def append_batch(batch: DataFrame, number: int, path: str) -> bool:
    """Add a batch of a stream to a table that grows, once: a batch whose number is in the log is not taken again, and what
    a try left that did not come to its entry is not read. Returns whether it was added."""
    log = Log(batch.sparkSession, path)
    if number in log.entries():
        return False
    folder = log.new_folder(number)
    batch.write.parquet(folder)
    log.commit(number, folder)
    return True


def appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All batches of a table that grows."""
    entries = Log(spark, path).entries()
    folders = [f"{path.rstrip('/')}/{name}" for name in entries.values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
