"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

1. Every task cuts its documents into blocks of bounded size, splits them into pre-tokens and numbers
   the block's distinct words. A block gives one row with the word number of every position (delivered
   to the block), and for each word bucket one row with the block's words of that bucket.
2. One shuffle brings all blocks' words of a bucket to one task, which encodes each distinct word once.
3. A second shuffle joins the ids back to their block, which is reassembled by position.

What is shuffled is a few bytes a position and one entry a block and word, never a row a pre-token, so
a very common word costs no more than a rare one, whatever its share of the rows. Blocks are bounded by
``block_bytes`` of text (a longer document is a block of its own). Buckets and the tasks of both shuffles grow
with the bytes of the texts; a bucket is streamed, and the words a task remembers are bounded.

Decoding is a map-side join with the token-byte table, whose size is the vocabulary's.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows each get their
row; null ids of documents stay null; an id outside the vocabulary raises.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quadrille.llm.pretokens import pretokens
from quadrille.llm.text import give_back, id_text, read_table, rows, slices, text_bytes

#: key: where the first shuffle sends a row; block rows have doc_ids and counts, word rows local numbers and words.
PARTS = pa.schema([("key", pa.int64()), ("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("local", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary())])
PARTS_DDL = "key long, block string, doc_ids array<long>, counts array<int>, local binary, lengths binary, payload binary"
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
TOKENS_DDL = "doc_id long, ids array<int>"
DECODED = TOKENS.append(pa.field("decoded", pa.binary()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32, byte plane by byte plane, compressed."""
    data = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4)
    used = 4 if len(data) == 0 else max(1, 4 - int(np.argmax(data.any(axis=0)[::-1]))) if data.any() else 1
    return bytes([used]) + zstandard.compress(np.ascontiguousarray(data[:, :used].T).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u4").reshape(-1)


#: Text bytes a bucket of words has, and a task of a shuffle; most buckets there are; words a task remembers.
BUCKET_BYTES, TASK_BYTES, MOST_BUCKETS, KNOWN_WORDS = 256 << 20, 64 << 20, 1 << 14, 1_000_000
#: Codes that one byte and two bytes hold in packed positions; a frequent word's code is one of these.
ONE, TWO = 192, 192 + 62 * 256


def pack_positions(numbers: np.ndarray) -> bytes:
    """Word numbers of all positions. Words are numbered as they first occur, so a first occurrence is code 0;
    the most frequent words have the next codes, any other word follows them by its number. Codes are written
    in one, two or five bytes, place by place, compressed."""
    numbers = numbers.astype(np.int32)
    first = np.ones(len(numbers), bool)
    first[1:] = numbers[1:] > np.maximum.accumulate(numbers)[:-1]
    first &= numbers > 0
    counts = np.bincount(numbers[~first], minlength=1)
    top = np.argsort(-counts, kind="stable")[: TWO - 1]
    top = top[counts[top] > 0]
    code = np.arange(TWO, TWO + int(numbers.max(initial=0)) + 1, dtype=np.int32)
    code[top] = np.arange(1, len(top) + 1)
    codes = code[numbers]
    codes[first] = 0
    long = codes[codes >= ONE] - ONE
    high = long >> 8
    longest = high[high >= 62] - 62
    planes = (np.where(codes < ONE, codes, ONE + np.minimum((codes - ONE) >> 8, 62)), long & 255, longest & 255, longest >> 8 & 255, longest >> 16 & 255)
    parts = [packed(top), *(zstandard.compress(x.astype(np.uint8).tobytes(), 3) for x in planes)]
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def unpack_positions(data: bytes) -> np.ndarray:
    """What ``pack_positions`` was given."""
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    top = unpacked(parts[0]).astype(np.int32)
    one, two, *more = (np.frombuffer(zstandard.decompress(x), np.uint8) for x in parts[1:])
    high = one[one >= ONE].astype(np.int32) - ONE
    high[high == 62] += sum(x.astype(np.int32) << 8 * i for i, x in enumerate(more))
    codes = one.astype(np.int32)
    codes[one >= ONE] = ONE + (high << 8 | two)
    first, frequent = codes == 0, (codes > 0) & (codes < TWO)
    out = codes - TWO
    out[frequent] = top[codes[frequent] - 1]
    out[first] = np.arange(1, first.sum() + 1)
    return out


class Block:
    """Documents of one block while they are gathered."""

    def __init__(self, name: str, buckets: int):
        self.name, self.buckets, self.size = name, buckets, 0
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[b""] = 0
        self.ids: list[int | None] = []
        self.numbers: list[np.ndarray] = []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.numbers.append(np.array(list(map(self.known.__getitem__, words)), np.uint32))

    def rows(self) -> pa.RecordBatch:
        words, where = list(self.known)[1:], defaultdict(list)
        for number, word in enumerate(words, 1):
            where[zlib.crc32(word) % self.buckets].append(number)
        counts = [len(x) for x in self.numbers]
        out = [(zlib.crc32(self.name.encode()), self.name, self.ids, counts, None, None, pack_positions(np.concatenate(self.numbers)))]
        for bucket, numbers in where.items():
            mine = [words[n - 1] for n in numbers]
            out.append((bucket, self.name, None, None, packed(np.diff(numbers, prepend=0)), packed(np.fromiter(map(len, mine), np.uint32, len(mine))), zstandard.compress(b"".join(mine), 3)))
        return rows(PARTS, *zip(*out))


def _split(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    block = Block(f"{part}-{n}", buckets)
    for batch in slices(batches, "text", 1 << 20):
        size = batch.column("text").nbytes
        if block.ids and block.size + size > block_bytes:
            yield block.rows()
            n += 1
            block = Block(f"{part}-{n}", buckets)
            give_back()
        block.size += size
        for doc_id, words in zip(batch.column("doc_id").to_pylist(), pretokens(batch.column("text"), pattern)):
            block.add(doc_id, words)
    if block.ids:
        yield block.rows()


def _encode_words(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.RecordBatch]:
    """Word rows get their ids in place of the words; block rows pass."""
    encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        if len(known) > KNOWN_WORDS:
            known.clear()
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if row.column("doc_ids")[0].is_valid:
                yield row
                continue
            text, at, ids, lengths = zstandard.decompress(row.column("payload")[0].as_py()), 0, [], []
            for n in unpacked(row.column("lengths")[0].as_py()).tolist():
                word = text[at : at + n]
                at += n
                if (found := known.get(word)) is None:
                    found = known[word] = encode(word.decode())
                ids += found
                lengths.append(len(found))
            yield rows(PARTS, [None], row.column("block"), [None], [None], row.column("local"), [packed(np.array(lengths))], [packed(np.array(ids))])


def joined_bytes(ids: np.ndarray, ends: np.ndarray, table: dict[int, bytes]) -> list[bytes]:
    """The join with the token-byte table: bytes of ids[ends[i]:ends[i + 1]] for every i."""
    token = table.__getitem__
    return [b"".join(map(token, ids[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]


def _assemble(parts: pa.Table, table: dict[int, bytes] | None) -> pa.Table:
    """One block: its position row and its word rows give the ids of its documents, and the bytes of those ids."""
    own, words = None, []
    for row in parts.select(["doc_ids", "counts", "local", "lengths", "payload"]).to_pylist():
        if row["doc_ids"] is not None:
            own = row
        else:
            words.append((np.cumsum(unpacked(row["local"])), unpacked(row["lengths"]), unpacked(row["payload"])))
    size = 1 + max((int(w[0][-1]) for w in words), default=0)
    starts, lengths, at = np.zeros(size, np.int32), np.zeros(size, np.int32), 0  # a block has fewer than 2**31 ids
    for local, n, ids in words:
        lengths[local] = n
        starts[local] = at + np.cumsum(n) - n
        at += len(ids)
    flat = np.concatenate([w[2] for w in words]).astype(np.int32) if words else np.zeros(0, np.int32)
    positions = unpack_positions(own["payload"])
    n = lengths[positions]
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)))
    shift = starts[positions] - ends[:-1]
    del positions
    take = np.repeat(shift, n)
    del shift, n
    take += np.arange(len(take), dtype=np.int32)
    offsets = ends[np.concatenate(([0], np.cumsum(own["counts"])))]
    ids = flat[take]
    del take
    columns = [pa.array(own["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
    if table is not None:
        columns.append(pa.array(joined_bytes(ids, offsets, table), pa.binary()))
    del ids
    give_back()
    return pa.table(columns, schema=TOKENS if table is None else DECODED)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, block_bytes: int = 16 << 20, decoded: bool = False) -> DataFrame:
    """Per document row: doc_id, ids. path: the rank file; buckets: by default from the bytes of the texts;
    decoded: add the bytes the ids decode to, as ``decode`` does, by the task that has the ids at hand."""
    spark = docs.sparkSession
    vocabulary = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = spark.sparkContext.broadcast(vocabulary)
    table = spark.sparkContext.broadcast({rank: token for token, rank in vocabulary.items()} if decoded else None)
    plain, usual = id_text(docs, id_col, text_col), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(plain)
    buckets = buckets or max(2 * usual, min(MOST_BUCKETS, size // BUCKET_BYTES))
    tasks = size // TASK_BYTES
    dealt = lambda df, key: df.repartition(tasks, key) if tasks > usual else df.repartition(key)
    parts = plain.mapInArrow(lambda batches: _split(batches, pattern, buckets, block_bytes), PARTS_DDL)
    coded = dealt(parts, "key").mapInArrow(lambda batches: _encode_words(batches, ranks.value, pattern), PARTS_DDL)
    if tasks > usual:
        coded = coded.repartition(tasks, "block")
    return coded.groupBy("block").applyInArrow(lambda parts: _assemble(parts, table.value), TOKENS_DDL + (", decoded binary" if decoded else ""))


def decode(tokens: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with ``out_col``: the bytes of their ids (null ids: nothing)."""
    table = {rank: token for token, rank in read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    sent = tokens.sparkSession.sparkContext.broadcast(table)
    kept = tokens.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                column = part.column(ids_col)
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0))))
                found = joined_bytes(column.flatten().to_numpy(zero_copy_only=False), ends, sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, out_col])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add(out_col, "binary"))


def digests(tokens: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and more columns) of rows with doc_id, ids, decoded."""
    return tokens.select("doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(read_table(spark, sf_dir, "documents"), decoded=True))
