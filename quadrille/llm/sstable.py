"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending id order:

    data blocks   entries (shared key bytes, other key bytes, value bytes, key rest, value), zstd
    index block   first key, offset and length of every data block, zstd
    bloom filter  of the keys
    footer        offsets and lengths of index and filter, counts, width of an id, magic

Keys are ids as nine sortable bytes (null sorts first), prefix-compressed against the key before. A
lookup asks the filter, finds the block by binary search in the sparse index, and scans one block.

Documents go to shards by id ranges. Bounds come from approximate quantiles of the ids alone; an id that
fills several ranges by itself is dealt over all of them, so no shard grows with a repeated id. The number of
shards grows with the bytes of the texts. Every
task writes whole files under a temporary name and renames them, so a task that runs again replaces its
own files. Files are written and read with pyarrow's file systems, in the shared folder.

Tokenizing: pre-tokens are looked up in a bounded table a worker keeps; what is missing is encoded by the
tokenizers library, words that start with a blank many at a time. A text that holds an added token's
string goes to the library whole.

Defined results: null and empty texts have the end id alone; rows with the same id are neighbours, in
the order of their encoded bytes; a null id sorts first and looks up as None; an empty table writes no
file and returns no row.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from quadrille.llm.pretokens import pretokens
from quadrille.llm.text import id_text, read_table, rows, scratch, slices, stored, text_bytes

MAGIC = b"QSST0001"
FOOTER = struct.Struct("<QQQQQQB8s")
BLOCK_BYTES = 64 << 10
#: Text bytes that one shard holds about, once there is more than the session's partitions have.
SHARD_BYTES = 512 << 20
BLOOM_BITS_A_KEY, BLOOM_PROBES = 10, 7
CODED = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary())])
MANIFEST = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def bloom_bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % size for i in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard; keys must not descend."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.n_docs = self.n_tokens = 0
        self.pack = zstandard.ZstdCompressor(3).compress

    def put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.block += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
        self.size += len(key) + len(value)
        self.last = key
        self.n_docs += 1
        self.n_tokens += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append((self.first, *self.put(self.pack(b"".join(self.block)))))
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.put(self.pack(b"".join(key + struct.pack("<QQ", at, n) for key, at, n in self.index)))
        size = max(64, len(self.keys) * BLOOM_BITS_A_KEY + 7 & ~7)
        bits = np.zeros(size // 8, np.uint8)
        for key in self.keys:
            for bit in bloom_bits(key, size):
                bits[bit >> 3] |= 1 << (bit & 7)
        bloom = self.put(bits.tobytes())
        self.put(FOOTER.pack(*index, *bloom, self.n_docs, self.n_tokens, self.width, MAGIC))
        self.sink.close()


class Table:
    """Reads one shard."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        *places, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(self.bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        index = zstandard.decompress(self.bytes(*places[:2]))
        self.index = [(index[i : i + 9], *struct.unpack_from("<QQ", index, i + 9)) for i in range(0, len(index), 25)]
        self.firsts = [x[0] for x in self.index]
        self.bloom = self.bytes(*places[2:])

    def bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = zstandard.decompress(self.bytes(*self.index[i][1:])), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, value in self.block(i):
                yield id_of(key), self.ids(value)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this doc_id."""
        key = key_of(doc_id)
        if not all(self.bloom[bit >> 3] >> (bit & 7) & 1 for bit in bloom_bits(key, len(self.bloom) * 8)):
            return []
        found, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.index) and self.firsts[i] <= key:
            found += [self.ids(value) for k, value in self.block(i) if k == key]
            i += 1
        return found


class Numbers(dict):
    """Word to number; a new word gets the next one and is noted."""

    def __init__(self):
        super().__init__({b"": 0})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        found = self[word] = len(self)
        return found


class Encoder:
    """Texts to token bytes by the tokenizers library, each different pre-token once while the table holds it."""

    def __init__(self, spec: str, width: int, most: int = 800_000):
        self.library = Tokenizer.from_str(spec)
        self.width, self.most = width, most
        self.special = "|".join(map(_quoted, (t.content for t in self.library.get_added_tokens_decoder().values()))) or None
        self.blank_first = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.blank_first[i] = token.startswith("Ġ")
        self.reset()

    def reset(self) -> None:
        """Forget all words. Word n has the ids flat[starts[n] : starts[n] + lengths[n]]."""
        self.numbers = Numbers()
        self.flat = np.zeros(0, f"<u{self.width}")
        self.starts, self.lengths = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Encode the words that got the next numbers. Words of a blank and letters, put one after another, are
        split again just there, and only their first token starts with the blank."""
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pieces, at = [self.flat], len(self.flat)
        alike = np.array([w[:1] == b" " and w[1:].decode().isalpha() for w in words], bool)
        many = np.flatnonzero(alike)
        odd = []
        for part in np.split(many, range(4096, len(many), 4096)) if len(many) else ():
            joined = b"".join(words[i] for i in part.tolist()).decode()
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.flat.dtype)
            first = np.flatnonzero(self.blank_first[ids])
            if len(first) != len(part):  # not split where they were joined: encoded one by one
                odd += part.tolist()
                continue
            starts[part], lengths[part] = at + first, np.diff(first, append=len(ids))
            pieces.append(ids)
            at += len(ids)
        rest = np.flatnonzero(~alike).tolist() + odd
        for i, found in zip(rest, self.library.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
            pieces.append(np.array(found.ids, self.flat.dtype))
            starts[i], lengths[i] = at, len(found.ids)
            at += len(found.ids)
        self.flat = np.concatenate(pieces)
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def __call__(self, column: pa.Array, pattern: str) -> list[bytes]:
        column = pc.fill_null(column, "")
        split = pretokens(column, pattern)
        if len(self.numbers) > self.most:
            self.reset()
        number = self.numbers.__getitem__
        own = [np.array(list(map(number, words)), np.int32) for words in split]
        if self.numbers.new:
            self.learn(self.numbers.new)
            self.numbers.new = []
        words = np.concatenate(own)
        n = self.lengths[words]
        ends = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(self.starts[words] - ends[:-1], n)
        take += np.arange(len(take))
        data = self.flat[take].tobytes()
        cuts = (ends[np.concatenate(([0], np.cumsum(list(map(len, own)))))] * self.width).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        if self.special and (found := pc.match_substring_regex(column, self.special)).true_count:
            for i in np.flatnonzero(found.to_numpy(zero_copy_only=False)):
                ids = self.library.encode(column[i].as_py(), add_special_tokens=False).ids
                out[i] = np.array(ids, self.flat.dtype).tobytes()
        return out


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


_encoders: dict[tuple, Encoder] = {}


def encoder(spec: str, width: int) -> Encoder:
    """One encoder a worker: its table outlives a task."""
    key = (hash(spec), width)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = Encoder(spec, width)
    return _encoders[key]


def shard_of(ids: pa.Array, salts: list[int], bounds: np.ndarray) -> np.ndarray:
    """Shard numbers: ranges of ids; an id equal to several bounds is dealt over their shards by its salt."""
    known = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
    return low + np.array(salts, np.int64) % (high - low + 1)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, pattern: str = public_tokenizers.PATTERN, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode, append ``end_id`` to every document, write shard files to ``folder``; the manifest:
    shard (in id order), path, n_docs, n_tokens."""
    spark = docs.sparkSession
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    width = 2 if max(end_id, Tokenizer.from_str(spec).get_vocab_size()) < 1 << 16 else 4
    sent = spark.sparkContext.broadcast(spec)
    docs = id_text(docs, id_col, text_col)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) // SHARD_BYTES)
    quantiles = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], max(10_000, 10 * shards))).first()[0] if shards > 1 else []
    bounds = np.array(quantiles or [], np.int64)
    schema, end = pa.schema([("shard", pa.int64()), *CODED]), np.array([end_id], f"<u{width}").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, width)
        for batch in slices(batches, "text", 1 << 20):
            coded = [x + end for x in encode(batch.column("text"), pattern)]
            where = shard_of(batch.column("doc_id"), [zlib.crc32(x) for x in coded], bounds)
            yield rows(schema, where, batch.column("doc_id"), [zstandard.compress(x, 1) for x in coded])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        shard, out, names = None, None, ("", "")

        def closed() -> pa.RecordBatch:
            out.close()
            store.move(*names)
            return rows(MANIFEST, [shard], [names[1]], [out.n_docs], [out.n_tokens])

        for batch in batches:
            for number, doc_id, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if number != shard:
                    if out:
                        yield closed()
                    shard, names = number, (f"{top}/.{number:08d}-{uuid.uuid4().hex}", f"{top}/{number:08d}.sst")
                    out = Writer(store.open_output_stream(names[0]), width)
                out.add(key_of(doc_id), zstandard.decompress(tokens))
        if out:
            yield closed()

    coded = docs.mapInArrow(code, "shard long, doc_id long, tokens binary").repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tokens")
    return stored(coded.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "tokens-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    totals, starts, before = manifest.select("shard", "n_tokens").orderBy("shard").collect(), {}, 0  # one row a file
    for row in totals:
        starts[row["shard"]] = before
        before += row["n_tokens"]
    sent = manifest.sparkSession.sparkContext.broadcast(starts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                at, out = sent.value[shard], []
                with store.open_input_file(path) as source:
                    for doc_id, ids in Table(source):
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield rows(READ, *zip(*out))
                            out = []
                if out:
                    yield rows(READ, *zip(*out))

    files = manifest.repartition(max(1, len(totals)), "shard")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), folder), folder)
