"""Substring dedup by hashed units: sentences within lines, grouped globally by digest.

Units are stretches up to a line end or a sentence mark (of four words or more), normalised to lower-case words. Two filters of fixed
size (seen once, seen twice) leave the units that may occur again; those are written with their offsets,
their digests are counted exactly, and every occurrence but the earliest, by (doc_id, position), is a
repeat. Consecutive repeats of a document make a run; a run of ``min_words`` words or more is removed, so a
short sentence that two clean documents happen to share stays. Spans are code points of the original.

A very common unit is counted by a pre-aggregated sum and met by a join that can split its key; runs are
windows over one document's own units.

Defined results: null and empty texts have no units; units without words are passed over and do not part a
run; repeated rows count once; null ids come last in rank; an empty table gives no spans.

``passage_spans`` finds passages wherever they begin and end: its units are windows of ``WINDOW`` words, chosen by
winnowing (the smallest hash of every ``WINDOW`` windows in a row), which depends on no mark and on nothing outside.
Any passage of ``2 * WINDOW - 1`` words that occurred before holds a chosen window; chosen windows of one passage
meet or overlap. The passage's edges lie less than ``WINDOW`` words beyond; there it is extended word by word
against its unit's earliest occurrence. Parts of a document at most ``gap`` words apart are put together, and
what has ``min_words`` repeated words goes. Words are compared by 64-bit hashes, at the edges by 32 bits of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quadrille.llm.line_dedup import LAST, bits_for, present, twice_filter, words64
from quadrille.llm.text import BLANKS, blobs, id_text, read_table, rows, slices, stored, text_bytes

UNIT = re.compile(rb"[^.!?\n]+[.!?]*")
UNITS = pa.schema([("doc_id", pa.int64()), ("rank", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("words", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary())])
UNITS_DDL = "doc_id long, rank long, text_key long, pos int, words int, start long, end long, digest binary"


def units(text: bytes, least: int = 4) -> list[tuple[int, int, int, bytes]]:
    """(start byte, end byte, words, digest) of the units of a text. Sentences of a line are put together until a
    unit has ``least`` words, as shorter ones repeat by chance; ends leave out blanks."""
    out, words, a, b, last = [], [], 0, 0, 0

    def flush() -> None:
        if words:
            out.append((a, b, len(words), xxhash.xxh3_128_digest(b" ".join(words))))
            words.clear()

    for m in UNIT.finditer(text):
        if m.start() != last and b"\n" in text[last : m.start()]:
            flush()
        last, body = m.end(), m.group()
        own = body.lower().split()
        if own:
            if not words:
                a = last - len(body.lstrip())
            words += own
            b = m.start() + len(body.rstrip())
            if len(words) >= least:
                flush()
    flush()
    return out


def repeated_units(docs: DataFrame, bits: int) -> DataFrame:
    """All occurrences of units that may occur again, with their offsets."""
    sent = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bits, lambda text: [u[3] for u in units(text)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), blobs(batch, "text")):
                found = units(text)
                if not found:
                    continue
                kept = np.flatnonzero(present(sent.value, words64([u[3] for u in found]), bits))
                if len(kept):
                    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    key = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    for i in kept.tolist():
                        a, b, n, digest = found[i]
                        out.append((doc_id, LAST if doc_id is None else doc_id, key, i, n, int(points[a - 1]) if a else 0, int(points[b - 1]), digest))
            if out:
                yield rows(UNITS, *zip(*out))

    return docs.mapInArrow(run, UNITS_DDL)


def repeated_spans(docs: DataFrame, min_words: int = 30, filter_bits: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of repeats to remove: doc_id, text_key, start, end, n_units, n_words, first_doc_id (of the run's first unit)."""
    docs = id_text(docs, id_col, text_col)
    found = stored(repeated_units(docs, filter_bits), "units")
    place = F.struct("rank", "text_key", "pos")
    first = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first")
    first = stored(first, "first")  # a join of its own can split a very common unit
    again = found.join(first, "digest").where(place != F.col("first"))
    again = again.select("doc_id", "rank", "text_key", "pos", "words", "start", "end", F.col("first.rank").alias("first_rank")).dropDuplicates(["rank", "text_key", "pos"])
    own = Window.partitionBy("rank", "text_key").orderBy("pos")
    runs = again.withColumn("run", F.col("pos") - F.row_number().over(own)).groupBy("rank", "text_key", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min_by("first_rank", "pos").alias("f"))
    return runs.where(F.col("n_words") >= min_words).select("doc_id", "text_key", "start", "end", "n_units", "n_words", F.when(F.col("f") != LAST, F.col("f")).alias("first_doc_id"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every row, without its spans; blanks around a cut stay as they are."""
    lists = spans.groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("_rank"), "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("text_key", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield rows(schema, batch.column("doc_id"), batch.column("text"), [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in blobs(batch, "text")])

    own = id_text(docs, id_col, text_col).mapInArrow(keyed, "doc_id long, text string, text_key long").withColumn("_rank", F.coalesce("doc_id", F.lit(LAST)))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate("spans", start, lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("kept"), s["end"].alias("at")))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(cut["kept"], F.substring(F.col("text"), (cut["at"] + 1).cast("int"), F.length("text"))))
    return own.join(lists, ["_rank", "text_key"], "left").select("doc_id", text.alias("text"))


WINDOW = 10
#: Bytes of text for every chosen window, about: 6 a word, and 2 windows in WINDOW + 1 are chosen.
SEED_BYTES = 33
SEEDS = pa.schema([("rank", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("digest", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
SEEDS_DDL = "rank long, text_key long, pos int, digest long, left binary, right binary"
CUT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "n_units", "n_words", "first_doc_id")]))), ("kept", pa.string())])
CUT_DDL = "doc_id long, text_key long, spans array<struct<start:long,end:long,n_units:long,n_words:long,first_doc_id:long>>, kept string"
#: Lower-case ASCII letters, and one kind of blank.
PLAIN = bytes(32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(POWERS[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            POWERS[i] = np.cumprod(steps)
    return POWERS[0][:n], POWERS[1][:n]


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and hash of every word."""
    plain = np.frombuffer(text.translate(PLAIN), np.uint8)
    edges = np.flatnonzero(np.diff(plain != 32, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(plain) + 1)
    sums = np.zeros(len(plain) + 1, np.uint64)
    np.cumsum((plain.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts])


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen windows of a text's words."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        grams = grams * np.uint64(BASE) + words[i : i + n]
    grams = mixed(grams)
    near = np.lib.stride_tricks.sliding_window_view(grams, min(WINDOW, n))
    at = np.unique(near.argmin(axis=1) + np.arange(len(near)))
    return at, grams[at]


def wide(hashes: np.ndarray) -> list[bytes]:
    """Hashes as the 16 bytes that filters take."""
    both = np.stack([hashes, mixed(hashes + np.uint64(BASE))], axis=1).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def repeated_seeds(docs: DataFrame, bits: int) -> DataFrame:
    """All chosen windows that may occur again, with hashes of the words beside them, nearest first."""
    sent = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bits, lambda text: wide(seeds(hashed_words(text)[2])[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), blobs(batch, "text")):
                words = hashed_words(text)[2]
                at, hashes = seeds(words)
                kept = np.flatnonzero(present(sent.value, words64(wide(hashes)), bits)) if len(at) else at
                if len(kept):
                    rank, key = LAST if doc_id is None else doc_id, xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    after = words.astype(np.uint32)
                    before, ahead, n = after[::-1].tobytes(), after.tobytes(), len(words)
                    for i, h in zip(at[kept].tolist(), hashes[kept].view(np.int64).tolist()):
                        out.append((rank, key, i, h, before[4 * (n - i) :][: 4 * WINDOW - 4], ahead[4 * (i + WINDOW) :][: 4 * WINDOW - 4]))
            if out:
                yield rows(SEEDS, *zip(*out))

    return docs.mapInArrow(run, SEEDS_DDL)


def reach(own: np.ndarray, other: bytes) -> int:
    """Number of leading words that agree."""
    other = np.frombuffer(other, np.uint32)
    n = min(len(own), len(other))
    differ = np.flatnonzero(own[:n] != other[:n])
    return int(differ[0]) if len(differ) else n


def passages(words: np.ndarray, parts: list[dict], gap: int, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(first word, word after the last, units, repeated words, rank of the first part's earliest) to remove."""
    low, out = words.astype(np.uint32), []
    for part in sorted(parts, key=lambda p: p["lo"]):
        a, b = part["lo"], part["hi"]
        a -= reach(low[max(0, a - WINDOW + 1) : a][::-1], part["left"])
        b += reach(low[b : b + WINDOW - 1], part["right"])
        if out and a - out[-1][1] <= gap:
            last = out[-1]
            last[3] += max(0, b - max(a, last[1]))
            last[1], last[2] = max(b, last[1]), last[2] + part["n"]
        else:
            out.append([a, b, part["n"], b - a, part["first_rank"]])
    return [tuple(x) for x in out if x[3] >= min_words]


def cut_passages(docs: DataFrame, min_words: int = 30, gap: int = 3, filter_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that lose passages: doc_id, text_key, spans (start, end, n_units, n_words that repeat, first_doc_id of
    the first unit), and the text that is kept. Rows of the same id and text are one; other documents do not appear."""
    docs = id_text(docs, id_col, text_col)
    filter_bits = filter_bits or bits_for(text_bytes(docs) // SEED_BYTES, each=8)
    found = stored(repeated_seeds(docs, filter_bits), "seeds")
    place = F.struct("rank", "text_key", "pos")
    first = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("rank", "text_key", "pos", "left", "right")).alias("first")).where("n > 1")
    first = stored(first.select("digest", F.struct("first.rank", "first.text_key", "first.pos").alias("first"), "first.left", "first.right"), "first")  # a join of its own can split a very common unit
    again = found.select("rank", "text_key", "pos", "digest").join(first.select("digest", "first"), "digest").where(place != F.col("first"))
    again = again.select("rank", "text_key", "pos", "digest", F.col("first.rank").alias("first_rank")).dropDuplicates(["rank", "text_key", "pos"])
    own = Window.partitionBy("rank", "text_key").orderBy("pos")
    again = again.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(own) > WINDOW).cast("int"), F.lit(0)))
    parts = again.withColumn("part", F.sum("new").over(own)).groupBy("rank", "text_key", "part").agg(
        F.min("pos").alias("lo"), (F.max("pos") + WINDOW).alias("hi"), F.count("*").alias("n"),
        F.min_by("first_rank", "pos").alias("first_rank"), F.min_by("digest", "pos").alias("d_lo"), F.max_by("digest", "pos").alias("d_hi"),
    )
    # A small part can still be joined to others, so all go on.
    parts = stored(parts.drop("part"), "parts")
    parts = stored(parts.join(first.select(F.col("digest").alias("d_lo"), "left"), "d_lo"), "lefts")
    parts = stored(parts.join(first.select(F.col("digest").alias("d_hi"), "right"), "d_hi"), "rights")
    lists = parts.groupBy("rank", "text_key").agg(F.collect_list(F.struct("lo", "hi", "n", "first_rank", "left", "right")).alias("parts"))
    keyed_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("text_key", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield rows(keyed_schema, batch.column("doc_id"), batch.column("text"), [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in blobs(batch, "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for doc_id, key, text, own_parts in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), blobs(batch, "text"), batch.column("parts").to_pylist()):
                starts, ends, words = hashed_words(text)
                spans = passages(words, own_parts, gap, min_words)
                if spans:
                    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    gone, kept, at = [], [], 0
                    for a, b, n, n_words, rank in spans:
                        low, high = int(starts[a]), int(ends[b - 1])
                        gone.append({"start": int(points[low - 1]) if low else 0, "end": int(points[high - 1]), "n_units": n, "n_words": n_words, "first_doc_id": None if rank == LAST else rank})
                        kept.append(text[at:low])
                        at = high
                    out.append((doc_id, key, gone, (b"".join(kept) + text[at:]).decode()))
            if out:
                yield rows(CUT, *zip(*out))

    texts = docs.mapInArrow(keyed, "doc_id long, text string, text_key long").withColumn("rank", F.coalesce("doc_id", F.lit(LAST)))
    once = texts.join(lists, ["rank", "text_key"]).dropDuplicates(["rank", "text_key"])
    return once.select("doc_id", "text_key", "text", "parts").mapInArrow(run, CUT_DDL)


def passage_spans(docs: DataFrame, **how) -> DataFrame:
    """Passages to remove, one row each: doc_id, text_key, start, end, n_units, n_words (repeated ones), first_doc_id."""
    return cut_passages(docs, **how).select("doc_id", "text_key", F.explode("spans").alias("s")).select("doc_id", "text_key", "s.*")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose passages: how many and how many repeated words, where (start:end:first document, empty if
    that has no id), and the digest of what is kept. Other documents do not appear."""
    cut = cut_passages(read_table(spark, sf_dir, "documents"))
    places = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], F.coalesce(s["first_doc_id"].cast("string"), F.lit(""))))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["n_words"])
    return cut.select("doc_id", F.size("spans").cast("long").alias("n_spans"), words.alias("n_words"), F.array_join(places, ",").alias("spans"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
