"""Benchmark decontamination with one Aho-Corasick automaton over normalised test windows.

Texts are normalised to lower-case words joined by single spaces; every window of ten consecutive
item words (or a shorter item as a whole) is one pattern " w1 ... w10 ". Each document is scanned
once per block of items, and hits are mapped back to words and to code points of the original.

The automaton goes to the executors by broadcast, so its patterns come in blocks of a bounded
number of item bytes (``block_bytes``): a usual benchmark is one block, a larger one takes a job for each
block and a merge by document. Items are read block by block, never whole.

Defined results: null or empty text has no words; an item without words has no window; equal
item_ids count once; a null item_id finds words but is not listed; repeated document rows each get
their row; a benchmark without rows leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.llm.text import blobs, id_text, read_table, rows, scratch, slices, stored

#: Lower-cases A-Z and turns every byte outside [0-9a-z] and 0x80-0xFF into a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", SPANS)])
FOUND_DDL = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
HITS = pa.schema([("key", pa.int64()), ("mask", pa.binary()), ("items", pa.list_(pa.string()))])
HITS_DDL = "key long, mask binary, items array<string>"


def patterns(items: list[tuple[str | None, bytes]], window: int) -> dict[bytes, tuple[int, set[str]]]:
    """Each window's text, with its number of words and the items that have it."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        words = text.translate(FOLD).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            ids = found.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1]
            if item_id is not None:
                ids.add(item_id)
    return found


def automaton(items: list[tuple[str | None, bytes]], window: int) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for text, (n, ids) in patterns(items, window).items():
        out.add_word(text.decode("latin1"), (n, tuple(ids)))
    if not len(out):
        return None
    out.make_automaton()
    return out


def scan_text(text: bytes, found_by: ahocorasick.Automaton | None) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, mask of hit words (None: none), items found."""
    words = text.translate(FOLD).split()
    if found_by is None or not words:
        return len(words), None, set()
    ends, mask, items = None, None, set()
    for end, (n, ids) in found_by.iter((b" " + b" ".join(words) + b" ").decode("latin1")):
        if ends is None:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            mask = np.zeros(len(words), bool)
        last = int(np.searchsorted(ends, end))
        mask[last - n + 1 : last + 1] = True
        items.update(ids)
    return len(words), mask, items


def spans_of(text: bytes, mask: np.ndarray) -> list[dict]:
    """Runs of hit words as code-point spans of the original text, end exclusive."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    code = lambda byte: int(points[byte - 1]) if byte else 0
    return [{"start": code(at[a][0]), "end": code(at[b - 1][1])} for a, b in zip(edges[::2], edges[1::2])]


def _scan(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    """The findings of one block of items that is the only one."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = automaton(sent.value, window)
        for batch in slices(batches, "text"):
            out = []
            for text in blobs(batch, "text"):
                n, mask, ids = scan_text(text, found_by)
                out.append((n, 0 if mask is None else int(mask.sum()), sorted(ids), [] if mask is None else spans_of(text, mask)))
            yield rows(FOUND, batch.column("doc_id"), *zip(*out))

    return docs.mapInArrow(run, FOUND_DDL)


def _scan_in_blocks(docs: DataFrame, blocks: Iterator[list[tuple[str | None, bytes]]], window: int) -> DataFrame:
    """The findings of several blocks. The texts are written once, with a key; each block is a job of its own, which
    writes the masks of the texts that it hits, so one automaton is alive in a task and one block is sent at a time. Then
    a text meets its masks, one from a block at most."""
    spark = docs.sparkSession
    keyed = stored(docs.withColumn("key", F.monotonically_increasing_id()), "texts")
    folder, count = scratch(spark, "hits"), 0
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found_by = automaton(sent.value, window)
            for batch in slices(batches, "text"):
                scanned = [(key, *scan_text(text, found_by)[1:]) for key, text in zip(batch.column("key").to_pylist(), blobs(batch, "text"))]
                if hit := [(key, np.packbits(mask).tobytes(), sorted(ids)) for key, mask, ids in scanned if mask is not None]:
                    yield rows(HITS, *zip(*hit))

        keyed.mapInArrow(run, HITS_DDL).write.parquet(f"{folder}/{count}")
        sent.destroy()
        count += 1
    hits = spark.read.schema(HITS_DDL).parquet(f"{folder}/*").groupBy("key").agg(F.collect_list("mask").alias("masks"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, masks, ids in zip(blobs(batch, "text"), batch.column("masks").to_pylist(), batch.column("items").to_pylist()):
                n, mask = len(text.translate(FOLD).split()), None
                if masks:
                    mask = np.unpackbits(np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in masks]), count=n).astype(bool)
                out.append((n, 0 if mask is None else int(mask.sum()), sorted(ids or []), [] if mask is None else spans_of(text, mask)))
            yield rows(FOUND, batch.column("doc_id"), *zip(*out))

    return keyed.join(hits, "key", "left").select("doc_id", "text", "masks", "items").mapInArrow(merge, FOUND_DDL)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of about ``block_bytes``; the driver holds one partition of items and one block at a time."""
    block, size, some = [], 0, False
    for row in benchmark.toLocalIterator():
        text = (row["text"] or "").encode()
        block.append((row["item_id"], text))
        size += len(text) * 10
        if size > block_bytes:
            yield block
            block, size, some = [], 0, True
    if block or not some:
        yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted as strings), spans (code points of the original)."""
    texts = id_text(docs, id_col, text_col)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
    blocks = _blocks(items, block_bytes)
    first, second = next(blocks), next(blocks, None)
    return _scan(texts, first, window) if second is None else _scan_in_blocks(texts, chain([first, second], blocks), window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """The document rows, all columns kept, in which no window of the benchmark occurs. What a block leaves is written
    before the next one is scanned for."""
    from quadrille.llm.text import keep_rows

    def clean(items: list, window: int):
        def verdicts() -> Callable[[list[bytes]], list[bool]]:
            found_by = automaton(items.value, window)
            return lambda texts: [scan_text(text, found_by)[1] is None for text in texts]

        return verdicts

    out = None
    for block in _blocks(benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")), block_bytes):
        out = keep_rows(docs if out is None else stored(out, "clean"), text_col, clean(docs.sparkSession.sparkContext.broadcast(block), window))
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")
