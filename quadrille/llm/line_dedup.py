"""Line dedup with two Bloom filters: lines seen once and lines seen twice.

Three passes over the documents, each streaming in Arrow batches:

1. every task folds its lines' hashes into two filters (seen once, seen twice); the filters are cut in
   chunks of a fixed size, merged chunk by chunk after one small shuffle (a line once here and once there is
   seen twice), and the twice-filter is broadcast;
2. only lines that the twice-filter suspects are counted: pre-aggregated in the task, shuffled as 16-byte
   digests, and confirmed by exact document counts, with their first document;
3. documents are rewritten by the confirmed digests: broadcast while there are at most ``broadcast_keys``;
   beyond, the ``broadcast_keys`` commonest are broadcast, and suspected lines meet the others by a join.

The filter has 16 bits a line of the input, counted first, but 2**30 (128 MB) at most: what is broadcast is
bounded. A fuller filter only sends more lines to the exact count; results do not change. Lines are told
apart by 128-bit xxh3 digests of their keys.

Defined results: null or empty text is one empty line; a line without a key (blank) always stays; rows with
the same id count as one document, and each row without an id as one; an empty table gives an empty result.
With keep="first" the first occurrence of a repeated key stays, by (doc_id, position); null ids come last,
and rows that tie keep theirs.
"""

from __future__ import annotations

import hashlib
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.llm.text import BLANKS, blobs, id_text, read_table, rows, slices, stored

#: Bytes of a filter that one merge takes.
CHUNK = 1 << 17
MOST_BITS = 1 << 30
PROBES = 3
#: Bytes of filters that all tasks together send to be merged: with more, tasks fold several partitions each.
SENT_BYTES = 1 << 40
#: Stands for a null doc_id where the first document of a line is chosen.
LAST = (1 << 63) - 1
FILTERS = pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
SUSPECTS = pa.schema([("digest", pa.binary()), ("again_id", pa.int64()), ("n_docs", pa.int64()), ("first_id", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


def keys_of(lines: list[bytes]) -> list[bytes | None]:
    """Digest of each line's key; None for a line without one."""
    digest = xxhash.xxh3_128_digest
    return [digest(key) if (key := line.strip(BLANKS)) else None for line in map(bytes.lower, lines)]


def bits_for(keys: int, each: int = 16, least: int = 1 << 20, most: int = MOST_BITS) -> int:
    """A power of two with ``each`` bits a key, within bounds."""
    return max(least, min(most, 1 << (max(1, keys) * each - 1).bit_length()))


def words64(digests: list[bytes]) -> np.ndarray:
    """Digests as an array of two 64-bit numbers each."""
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit numbers of each probe, by double hashing."""
    for i in range(PROBES):
        yield ((hashes[:, 0] + np.uint64(i) * (hashes[:, 1] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def present(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        found &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def put(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for at in places(hashes, bits):
        np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def fold(once: np.ndarray, twice: np.ndarray, digests: list[bytes], bits: int) -> None:
    """Note one occurrence of each digest (a digest may repeat)."""
    if not digests:
        return
    hashes, counts = np.unique(words64(digests), axis=0, return_counts=True) if len(digests) > 1 else (words64(digests), np.ones(1, int))
    put(twice, hashes[present(once, hashes, bits) | (counts > 1)], bits)
    put(once, hashes, bits)


def line_keys(text: bytes) -> set[bytes]:
    return {k for k in keys_of(text.split(b"\n")) if k}


def _chunks(bitmap: np.ndarray) -> list[np.ndarray]:
    return [bitmap[i : i + CHUNK] for i in range(0, len(bitmap), CHUNK)]


def in_fewer_tasks(docs: DataFrame, bits: int, most: int = SENT_BYTES) -> DataFrame:
    """The rows in so many tasks that two filters of each are not more than ``most`` bytes in all, nothing shuffled; in four
    a core at least."""
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, most // (bits // 4))
    return docs.coalesce(tasks) if docs.rdd.getNumPartitions() > tasks else docs


def twice_filter(docs: DataFrame, bits: int, keys: Callable[[bytes], Iterable[bytes]] = line_keys) -> np.ndarray:
    """The filter of keys that may occur twice or more; ``keys(text)``: by default a text's lines, each once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in slices(batches, "text"):
            digests: list[bytes] = []
            for text in blobs(batch, "text"):
                digests.extend(keys(text))
            fold(once, twice, digests, bits)
        pack = zstandard.ZstdCompressor(1).compress
        for i, (a, b) in enumerate(zip(_chunks(once), _chunks(twice))):
            if a.any():
                yield rows(FILTERS, [i], [pack(a.tobytes())], [pack(b.tobytes())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = np.frombuffer(unpack(once), np.uint8), np.frombuffer(unpack(twice), np.uint8)
                if chunk in held:
                    had_once, had_twice = held[chunk]
                    once, twice = had_once | once, had_twice | twice | (had_once & once)
                held[chunk] = once, twice
        for chunk, (once, twice) in held.items():
            yield rows(FILTERS, [chunk], [b""], [zstandard.compress(twice.tobytes(), 1)])

    ddl = "chunk int, once binary, twice binary"
    out = np.zeros(bits // 8, np.uint8)
    merged = in_fewer_tasks(docs, bits).mapInArrow(build, ddl).repartition(max(1, bits // 8 // CHUNK), "chunk").mapInArrow(merge, ddl)
    for row in merged.select("chunk", "twice").collect():  # at most MOST_BITS bits, whatever the input
        part = np.frombuffer(zstandard.decompress(row["twice"]), np.uint8)
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return out


def sent_filter(docs: DataFrame, filter_bits: int | None):
    """The broadcast filter of lines that may repeat, sized by the number of lines where no size is given."""
    if filter_bits is None:
        breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
        filter_bits = bits_for(docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0)
    return docs.sparkSession.sparkContext.broadcast(twice_filter(docs, filter_bits))


def suspected(bitmap: np.ndarray, digests: list[bytes]) -> list[int]:
    """Numbers of the digests that the filter knows."""
    return np.flatnonzero(present(bitmap, words64(digests), 8 * len(bitmap))).tolist() if digests else []


def repeated_keys(docs: DataFrame, min_docs: int, sent) -> DataFrame:
    """Digests of the keys that at least ``min_docs`` (2 or more) documents have: digest, n_docs, first_id.

    Ids that stand in several rows travel with their digests and count once; they are known by a filter, so one
    that only looks repeated counts once too. All others are summed up in the task."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("short"))
    again = docs.sparkSession.sparkContext.broadcast(filter_of(stored(ids, "ids")))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int | None], list[int]] = {}

        def flushed() -> pa.RecordBatch:
            out = rows(SUSPECTS, *zip(*held), *zip(*held.values()))
            held.clear()
            return out

        for batch in slices(batches, "text"):
            twice = known(again.value, batch.column("doc_id")) if again.value is not None else np.zeros(batch.num_rows, bool)
            digests, owners = [], []
            for doc_id, many, text in zip(batch.column("doc_id").to_pylist(), twice.tolist(), blobs(batch, "text")):
                own = line_keys(text)
                digests.extend(own)
                owners.extend([(LAST if doc_id is None else doc_id, doc_id if many else None)] * len(own))
            for i in suspected(sent.value, digests):
                doc_id, own_id = owners[i]
                seen = held.setdefault((digests[i], own_id), [0, LAST])
                seen[0] += 1
                seen[1] = min(seen[1], doc_id)
            if len(held) > 100_000:
                yield flushed()
        if held:
            yield flushed()

    found = docs.mapInArrow(suspects, "digest binary, again_id long, n_docs long, first_id long")
    n_docs = F.when(F.col("again_id").isNull(), F.sum("n_docs")).otherwise(1)
    each = found.groupBy("digest", "again_id").agg(n_docs.alias("n_docs"), F.min("first_id").alias("first_id"))
    return each.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.min("first_id").alias("first_id")).where(F.col("n_docs") >= min_docs)


def _numbers(column: pa.Array) -> np.ndarray:
    """Numbers as the filters take them: two 64-bit hashes each."""
    x = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(np.uint64)
    return np.stack([x * np.uint64(0x9E3779B97F4A7C15), (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)], axis=1)


def known(bitmap: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which numbers a filter knows; null is never known."""
    return present(bitmap, _numbers(column), 8 * len(bitmap)) & column.is_valid().to_numpy(zero_copy_only=False)


def filter_of(members: DataFrame) -> np.ndarray | None:
    """A filter that knows every number of the column ``short``, sized by their count (128 MB at most); None if there is none."""
    count = members.count()
    if not count:
        return None
    bits, schema = bits_for(count), pa.schema([("chunk", pa.int32()), ("bitmap", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            put(bitmap, _numbers(batch.column("short")), bits)
        for i, part in enumerate(_chunks(bitmap)):
            if part.any():
                yield rows(schema, [i], [zstandard.compress(part.tobytes(), 1)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("chunk").to_pylist(), batch.column("bitmap").to_pylist()):
                part = np.frombuffer(zstandard.decompress(part), np.uint8)
                held[i] = held[i] | part if i in held else part
        for i, part in held.items():
            yield rows(schema, [i], [part.tobytes()])

    out, ddl = np.zeros(bits // 8, np.uint8), "chunk int, bitmap binary"
    for row in members.select("short").mapInArrow(build, ddl).repartition(max(1, bits // 8 // CHUNK), "chunk").mapInArrow(merge, ddl).collect():
        part = np.frombuffer(row["bitmap"], np.uint8)
        out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return out


def cut(text: bytes, doc_id: int | None, drops: dict[bytes, int], keep_first: bool) -> tuple[int, int, bytes]:
    """Number of lines, number dropped, the rest joined. drops: digest to first document."""
    lines = text.split(b"\n")
    kept, seen = [], set()
    for line, key in zip(lines, keys_of(lines)):
        if key in drops:
            if keep_first and key not in seen and drops[key] == (LAST if doc_id is None else doc_id):
                seen.add(key)
            else:
                continue
        kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _fresh(name: str, taken: list[str]) -> str:
    """A column name that the input does not have."""
    while name in taken:
        name += "_"
    return name


def _apply(docs: DataFrame, min_docs: int, keep: str, id_col: str, text_col: str, filter_bits: int | None, broadcast_keys: int, finish, schema) -> DataFrame:
    """Cut every row's text by the repeated keys; ``finish(batch, cuts)`` makes the output rows."""
    plain, first = id_text(docs, id_col, text_col), keep == "first"
    suspects = sent_filter(plain, filter_bits)
    keys = stored(repeated_keys(plain, min_docs, suspects), "lines")
    few = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    common = keys if few else keys.orderBy(F.desc("n_docs"), "digest").limit(broadcast_keys)
    sent = docs.sparkSession.sparkContext.broadcast({bytes(r["digest"]): r["first_id"] for r in common.select("digest", "first_id").collect()})
    lists_col = _fresh("drops", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            own = None if few else batch.column(lists_col).to_pylist()
            cuts = []
            for i, (doc_id, text) in enumerate(zip(batch.column(id_col).to_pylist(), blobs(batch, text_col))):
                rare = {x["digest"]: x["first_id"] for x in own[i]} if own and own[i] else {}
                cuts.append(cut(text, doc_id, ChainMap(rare, sent.value) if rare else sent.value, first))
            yield finish(batch if few else batch.drop_columns([lists_col]), cuts)

    if few:
        return docs.mapInArrow(run, schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in blobs(batch, "text"):
                own = [k for k in line_keys(text) if k not in sent.value]
                at = suspected(suspects.value, own)
                if at:
                    sha = hashlib.sha256(text).digest()
                    out += [(sha, own[i]) for i in at]
            if out:
                yield rows(pa.schema([("sha", pa.binary()), ("digest", pa.binary())]), *zip(*out))

    # One row per distinct text and suspected key: copies of a text share their list.
    sha = _fresh("sha", docs.columns)
    lines = plain.mapInArrow(digests, "sha binary, digest binary").distinct().join(keys, "digest")
    lists = lines.groupBy(F.col("sha").alias(sha)).agg(F.collect_list(F.struct("digest", "first_id")).alias(lists_col))
    keyed = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)))
    return keyed.join(lists, sha, "left").select(*docs.columns, lists_col).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None, broadcast_keys: int = 1 << 18) -> DataFrame:
    """Per document row: doc_id, n_lines, n_dropped, kept (the text left). keep: "first" or "none"."""

    def finish(batch: pa.RecordBatch, cuts: list) -> pa.RecordBatch:
        n, dropped, kept = zip(*cuts)
        return rows(KEPT, batch.column("doc_id"), n, dropped, pa.array(kept, pa.binary()))

    return _apply(id_text(docs, id_col, text_col), min_docs, keep, "doc_id", "text", filter_bits, broadcast_keys, finish, "doc_id long, n_lines long, n_dropped long, kept string")


def rewrite_lines(docs: DataFrame, min_docs: int = 2, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, drop_emptied: bool = True, filter_bits: int | None = None, broadcast_keys: int = 1 << 18) -> DataFrame:
    """The rows with all their columns and the text that is left; ``chars_col`` gets its number of characters.
    drop_emptied: rows that lose lines and have no words left go; rows that lose nothing stay as they are."""

    def finish(batch: pa.RecordBatch, cuts: list) -> pa.RecordBatch:
        texts = pa.array([None if not d and not t else t for _, d, t in cuts], pa.binary()).cast(pa.string())
        texts = pc.if_else(pa.array([d > 0 for _, d, _ in cuts]), texts, batch.column(text_col).cast(pa.string()))
        at = batch.schema.get_field_index(text_col)
        out = batch.set_column(at, batch.schema.field(at), texts.cast(batch.schema.field(at).type))
        if chars_col:
            at = out.schema.get_field_index(chars_col)
            changed = pc.if_else(pa.array([d > 0 for _, d, _ in cuts]), pc.utf8_length(texts).cast(out.schema.field(at).type), out.column(at))
            out = out.set_column(at, out.schema.field(at), changed)
        return out.filter(pa.array([not (drop_emptied and d and not t.strip()) for _, d, t in cuts]))

    return _apply(docs, min_docs, keep, id_col, text_col, filter_bits, broadcast_keys, finish, docs.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read_table(spark, sf_dir, "documents"), min_docs=10, keep="none")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in SQL; chr(11) and chr(12) are the vertical tab and the form feed.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
drops AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE d.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE d.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN drops d ON k.key = d.key GROUP BY doc_id
"""
