"""Helpers that the corpus operators share: Arrow batches in, Arrow batches out.

Texts travel as UTF-8 bytes: ``bytes.split()`` splits at exactly ``[\\x20\\x09-\\x0D]`` and
``bytes.lower()`` folds exactly A-Z, which is what the word rules of this package ask for.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.storage import read_table, scratch, shared_dir, stored  # noqa: F401

#: Bytes that ``[\x20\x09-\x0D]`` names.
BLANKS = b" \t\n\x0b\x0c\r"


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about ``limit`` bytes of ``column``; a longer text stays whole."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and the next one shares its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blobs(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null becomes an empty text."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null becomes an empty text."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: where the session still has Spark's default of 10,000 rows in an Arrow batch, take 1,000.
    A batch is held by the JVM and by Python at once, for every task of an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names, so no extra column of the input can clash."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, by which shuffles are sized: one pass that sums up lengths."""
    return docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def keep_rows(docs: DataFrame, text_col: str, verdicts) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text passes. ``verdicts()`` is called once in a task and
    gives a function from texts (bytes; null is empty) to booleans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = verdicts()
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(judge(blobs(batch, text_col)), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
