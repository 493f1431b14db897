"""Fill-in-the-middle transformation by a parallel automaton scan.

Units of a text are told by a byte automaton. A text is dealt into lanes, and each lane gives, for every state it
may be entered in, the state it is left in and the number of units that end in it. These functions compose
associatively, so a prefix composition tells every lane's entry state and the units before it; the lane that holds a
wanted unit is then looked up, and only that lane is walked. A second automaton finds the sentinels in the same way.

Texts of up to ``chunk_bytes`` are done within one task. A longer text is dealt into chunks that any task may scan:
their functions are composed per text, the chunks that hold a cut are selected by a join, and the cuts come back to
the text.

Defined results: a null text is empty; the decimal of a null doc_id is the empty string; repeated rows each get
their row; an empty table gives an empty result; extra columns of the input are not read. Cuts do not depend on how
a text is dealt into lanes and chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.llm.text import blobs, id_text, read_table, rows, slices
from quadrille.storage import stored

#: Bytes of a lane: the number of steps that all lanes take together.
LANE = 64
#: The byte class of what fills a text's last lane: no automaton moves on it.
FILL = 256
SENTINELS = (b"<P>", b"<S>", b"<M>")


@dataclass(frozen=True)
class Automaton:
    """``moves[state, byte]`` is the next state, ``ends[state, byte]`` whether a unit ends with the byte; byte FILL
    stays in its state."""

    moves: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, table: list[list[tuple[int, int]]]) -> Automaton:
        """From rows of (next state, units that end), one row a state, one pair a byte."""
        flat = np.array(table, np.int64)
        fill = np.arange(len(table))[:, None]
        return cls(np.hstack([flat[:, :, 0], fill]).astype(np.uint8), np.hstack([flat[:, :, 1], 0 * fill]).astype(np.uint8))


def code_points() -> Automaton:
    """A state for each number of continuation bytes still to come. A byte that cannot continue starts anew."""

    def step(state: int, byte: int) -> tuple[int, int]:
        if 0x80 <= byte < 0xC0:
            return (max(state - 1, 0), int(state <= 1))
        more = 0 if byte < 0x80 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
        return (more, int(more == 0))

    return Automaton.of([[step(s, b) for b in range(256)] for s in range(4)])


def occurrences(words: tuple[bytes, ...]) -> Automaton:
    """Counts the places where one of ``words`` ends: states are the words' beginnings, as in string matching."""
    heads = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda h: (len(h), h))
    at = {h: i for i, h in enumerate(heads)}

    def step(head: bytes, byte: int) -> tuple[int, int]:
        read = head + bytes([byte])
        return (at[next(read[i:] for i in range(len(read) + 1) if read[i:] in at)], int(any(read.endswith(w) for w in words)))

    return Automaton.of([[step(h, b) for b in range(256)] for h in heads])


CODE_POINTS, MARKS = code_points(), occurrences(SENTINELS)


@dataclass
class Functions:
    """One function a row: ``left[i, s]`` the state behind row i entered in s, ``units[i, s]`` the units in between."""

    left: np.ndarray
    units: np.ndarray

    def then(self, other: Functions) -> Functions:
        """Row by row, self first."""
        return Functions(np.take_along_axis(other.left, self.left, 1), self.units + np.take_along_axis(other.units, self.left, 1))


def lanes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in lanes, and each text's first lane, with the number of lanes behind the last one. An
    empty text has one lane."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.concatenate(([0], np.cumsum(np.maximum(1, -(-sizes // LANE)))))
    out = np.full(firsts[-1] * LANE, FILL, np.int16)
    for text, first in zip(texts, firsts):
        out[first * LANE : first * LANE + len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(-1, LANE), firsts


def run_lanes(lanes: np.ndarray, automaton: Automaton) -> Functions:
    """The function of every lane: all lanes take a step together, from every state."""
    states = automaton.moves.shape[0]
    left = np.tile(np.arange(states, dtype=np.int64), (len(lanes), 1))
    units = np.zeros(left.shape, np.int64)
    moves, ends, width = automaton.moves.astype(np.int64).ravel(), automaton.ends.ravel(), automaton.moves.shape[1]
    for column in np.ascontiguousarray(lanes.T):
        at = left * width + column[:, None]
        units += ends[at]
        left = moves[at]
    return Functions(left, units)


def composed(each: Functions, firsts: np.ndarray) -> Functions:
    """For every row the composition of all rows of its text up to it, by doubling strides."""
    n = len(each.left)
    place = np.arange(n) - np.repeat(firsts[:-1], np.diff(firsts))
    left, units, stride = each.left, each.units, 1
    while n and stride <= place.max():
        late = np.flatnonzero(place >= stride)
        both = Functions(left[late - stride], units[late - stride]).then(Functions(left[late], units[late]))
        left, units = left.copy(), units.copy()
        left[late], units[late] = both.left, both.units
        stride *= 2
    return Functions(left, units)


def before(done: Functions, firsts: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row its entry state and the units before it, where text i is entered in ``entry[i]``."""
    start = np.repeat(entry, np.diff(firsts))
    rows_ = np.arange(len(start))
    state = np.concatenate(([0], done.left[rows_, start][:-1])) if len(start) else start
    units = np.concatenate(([0], done.units[rows_, start][:-1])) if len(start) else start
    state[firsts[:-1]], units[firsts[:-1]] = entry, 0
    return state, units


def totals(texts: list[bytes], automaton: Automaton) -> Functions:
    """The function of each text as a whole."""
    lanes, firsts = lanes_of(texts)
    done = composed(run_lanes(lanes, automaton), firsts)
    return Functions(done.left[firsts[1:] - 1], done.units[firsts[1:] - 1])


def places(texts: list[bytes], automaton: Automaton, wanted: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
    """Bytes up to the end of unit ``wanted[i, j]`` of text i; 0 units end at 0. Units are 1 to the text's number."""
    lanes, firsts = lanes_of(texts)
    entry = np.zeros(len(texts), np.int64) if entry is None else entry
    state, units = before(composed(run_lanes(lanes, automaton), firsts), firsts, entry)
    text = np.repeat(np.arange(len(texts)), wanted.shape[1])
    goal, lane = wanted.ravel(), np.empty(wanted.size, np.int64)
    for i, (t, k) in enumerate(zip(text, goal)):  # the last lane with fewer units before it
        lane[i] = firsts[t] + max(0, np.searchsorted(units[firsts[t] : firsts[t + 1]], k, side="left") - 1)
    at, seen, now = np.zeros(len(goal), np.int64), units[lane], state[lane]
    for j in range(LANE):
        byte = lanes[lane, j]
        seen = seen + automaton.ends[now, byte]
        now = automaton.moves[now, byte].astype(np.int64)
        at[(seen == goal) & (at == 0)] = j + 1
    found = (lane - firsts[text]) * LANE + at
    return np.where(goal == 0, 0, found).reshape(wanted.shape)


def draws(seed: int) -> list[Column]:
    """h1 to h4: 8-digit groups of the hex SHA-256 of the seed, a colon and the decimal doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def form_of(n: int, marks: int, h3: int, h4: int, keep_percent: int, spm_percent: int) -> str:
    if n == 0 or marks or h3 % 100 >= 100 - keep_percent:
        return "plain"
    return "spm" if h4 % 100 < spm_percent else "psm"


def output_of(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text cut at bytes a and b, with its sentinels."""
    if form == "plain":
        return text
    head, middle, tail = text[:a], text[a:b], text[b:]
    parts = (SENTINELS[0], head, SENTINELS[1], tail) if form == "psm" else (SENTINELS[1], tail, SENTINELS[0], head)
    return b"".join((*parts, SENTINELS[2], middle))


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.string())])
OUT_DDL = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"
CHUNKS = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("bytes", pa.binary())])
CHUNKS_DDL = "key string, doc_id long, chunk long, bytes binary"
MAPS = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int64()), *((name, pa.list_(pa.int64())) for name in ("unit_left", "unit_count", "mark_left", "mark_count"))])
MAPS_DDL = "key string, doc_id long, chunk long, unit_left array<long>, unit_count array<long>, mark_left array<long>, mark_count array<long>"
CUTS = pa.schema([(x, pa.string() if x in ("key", "form") else pa.int64()) for x in ("key", "n", "form", "cut", "units", "chunk", "state", "wanted")])
CUTS_DDL = "key string, n long, form string, cut long, units long, chunk long, state long, wanted long"
FOUND = pa.schema([("key", pa.string()), ("cut", pa.int64()), ("at", pa.int64())])


def _whole_texts(texts: DataFrame, automaton: Automaton, keep_percent: int, spm_percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            own, h = blobs(batch, "text"), [np.asarray(batch.column(f"h{i}")) for i in (1, 2, 3, 4)]
            n, marks = totals(own, automaton).units[:, 0], totals(own, MARKS).units[:, 0]
            cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)], 1), 1)
            form = [form_of(*map(int, x), keep_percent, spm_percent) for x in zip(n, marks, h[2], h[3])]
            at = places(own, automaton, cuts)
            plain = np.array([f == "plain" for f in form])
            units = [pa.array(x, mask=plain) for x in (cuts[:, 0], cuts[:, 1] - cuts[:, 0])]
            yield rows(OUT, batch.column("doc_id"), n, form, *units, pa.array([output_of(t, f, a, b) for t, f, (a, b) in zip(own, form, at)], pa.binary()))

    return texts.mapInArrow(run, OUT_DDL)


def _chunks(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """A text's chunks, cut anywhere, also within a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1):
            for key, doc_id, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), blobs(batch, "text")):
                for start in range(0, len(text), chunk_bytes << 4):
                    part = [text[i : i + chunk_bytes] for i in range(start, min(len(text), start + (chunk_bytes << 4)), chunk_bytes)]
                    yield rows(CHUNKS, [key] * len(part), [doc_id] * len(part), range(start // chunk_bytes, start // chunk_bytes + len(part)), part)

    return texts.mapInArrow(run, CHUNKS_DDL)


def _long_texts(texts: DataFrame, seed: int, automaton: Automaton, keep_percent: int, spm_percent: int, chunk_bytes: int) -> DataFrame:
    """Chunks give their functions wherever they lie; a text's functions are composed; a join selects the chunks that
    hold a cut; the text meets its cuts again by its key, so copies of a row share one scan."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    chunks = stored(_chunks(keyed.select("key", "doc_id", "text"), chunk_bytes).dropDuplicates(["key", "chunk"]), "chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            own = blobs(batch, "bytes")
            units, marks = totals(own, automaton), totals(own, MARKS)
            yield rows(MAPS, *(batch.column(c) for c in ("key", "doc_id", "chunk")), *(list(x) for x in (units.left, units.units, marks.left, marks.units)))

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        maps = lambda a, b: composed(Functions(*(np.array(table.column(x).to_pylist(), np.int64) for x in (a, b))), np.array([0, table.num_rows]))
        units, marks = maps("unit_left", "unit_count"), maps("mark_left", "mark_count")
        n, first = int(units.units[-1, 0]), {c: table.column(c)[0].as_py() for c in ("key", "h1", "h2", "h3", "h4")}
        form = form_of(n, int(marks.units[-1, 0]), first["h3"], first["h4"], keep_percent, spm_percent)
        states, seen = before(units, np.array([0, table.num_rows]), np.zeros(1, np.int64))
        out = []
        for cut, goal in enumerate(sorted((first["h1"] % (n + 1), first["h2"] % (n + 1)))):
            chunk = max(0, int(np.searchsorted(seen, goal, side="left")) - 1)
            out.append((first["key"], n, form, cut, goal, chunk, int(states[chunk]), goal - int(seen[chunk])))
        return pa.Table.from_batches([rows(CUTS, *zip(*out))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 20):
            wanted, chunk = (np.asarray(batch.column(c)) for c in ("wanted", "chunk"))
            at = places(blobs(batch, "bytes"), automaton, wanted[:, None], np.asarray(batch.column("state")))
            yield rows(FOUND, batch.column("key"), batch.column("cut"), at[:, 0] + chunk * chunk_bytes)

    maps = chunks.mapInArrow(scan, MAPS_DDL).select("*", *draws(seed))
    cuts = stored(maps.groupBy("key").applyInArrow(compose, CUTS_DDL), "cuts")
    found = cuts.select("key", "chunk", "cut", "state", "wanted").join(chunks, ["key", "chunk"]).mapInArrow(find, "key string, cut long, at long")
    side = lambda c, i: F.max(F.when(F.col("cut") == i, F.col(c)))
    ends = cuts.join(found, ["key", "cut"]).groupBy("key").agg(F.first("n").alias("n"), F.first("form").alias("form"), *(side(c, i).alias(f"{c}{i}") for c in ("units", "at") for i in (0, 1)))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            form, a, b = (batch.column(c).to_pylist() for c in ("form", "at0", "at1"))
            out = [output_of(t, *x) for t, *x in zip(blobs(batch, "text"), form, a, b)]
            yield rows(OUT, *(batch.column(c) for c in ("doc_id", "n", "form", "prefix_units", "middle_units")), pa.array(out, pa.binary()))

    cut = lambda c: F.when(F.col("form") != "plain", c)
    back = keyed.select("doc_id", "text", "key").join(ends, "key")
    return back.select("doc_id", "text", "n", "form", cut(F.col("units0")).alias("prefix_units"), cut(F.col("units1") - F.col("units0")).alias("middle_units"), "at0", "at1").mapInArrow(assemble, OUT_DDL)


def fill_in_middle(docs: DataFrame, seed: int = 1, keep_percent: int = 10, spm_percent: int = 20, automaton: Automaton = CODE_POINTS, chunk_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain), output."""
    texts = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    long = F.octet_length("text") > chunk_bytes
    short = _whole_texts(texts.where(~long).select("*", *draws(seed)), automaton, keep_percent, spm_percent)
    return short.unionByName(_long_texts(texts.where(long), seed, automaton, keep_percent, spm_percent, chunk_bytes))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone."""
    part = F.split(output, "<[PSM]>", -1)
    joined = lambda *order: F.concat(*(part[i] for i in order))
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, a, b, substring(text, 1, a) AS f, substring(text, a + 1, b - a) AS m, substring(text, b + 1) AS l FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || f || '<S>' || l || '<M>' || m ELSE '<S>' || l || '<P>' || f || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
