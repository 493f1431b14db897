"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands. Then every layer put on the worklist is unwrapped: lines with URL or
Unicode escapes are decoded in place, base64 runs become layers of their own, and so do compressed
streams that they or escaped bytes carry: streams in streams, all members, and what stands behind them. Each new layer is scanned again and unwrapped again until nothing new appears. A layer
already seen at the same place is not taken up again, so cycles end. Every character of a layer knows
the span of the original it came from; findings are reported as spans of the original, in code points.

Nothing is left out: a stream that unpacks to more than ``PIECE`` bytes is read piece by piece, each a layer of
its own, and the next piece is unpacked when the one before is done with. Pieces end where neither a secret nor a
coded run can cross: at the end of a line that no base64 block goes on from, or, where lines do not end, at a
punctuation mark, with the 64 KB before it read twice. A caller may set ``max_layer``: streams beyond it are then
counted in ``n_unopened`` instead. Defined results: null and empty texts have no findings; repeated rows each get
their row.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.text import id_text, read_table, rows, slices, strings

#: The kinds in their order, their patterns, the group whose length counts, and the least length.
KINDS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
ORDER = {kind: i for i, (kind, *_) in enumerate(KINDS)}
#: A text without any of these cannot have a finding of the kind (wider than the pattern itself).
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}"}
WRAPPED = r"%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#|[A-Za-z0-9+/_-]{16}"
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: Base64 in one run, or over full lines of equal length as mail and key files have it.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{76}\r?\n|[A-Za-z0-9+/]{64}\r?\n)+[A-Za-z0-9+/]{0,76}={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
#: Compressed bytes spelled with escapes: how the streams begin, and what stands for one byte.
PERCENT_MAGIC = re.compile(r"%1[fF]%8[bB]|(?:B|%42)(?:Z|%5[aA])(?:h|%68)|(?:x|%78)(?:%01|\^|%5[eE]|%9[cC]|%[dD][aA])|%[fF][dD](?:7|%37)|(?:\(|%28)%[bB]5")
PERCENT_TOKEN = re.compile(r"%[0-9A-Fa-f]{2}|[!-$&-~]")
HEX_MAGIC = re.compile(r"\\x1[fF]\\x8[bB]|(?:B|\\x42)(?:Z|\\x5[aA])(?:h|\\x68)|(?:x|\\x78)(?:\\x01|\^|\\x5[eE]|\\x9[cC]|\\x[dD][aA])|\\x[fF][dD](?:7|\\x37)|(?:\(|\\x28)\\x[bB]5")
HEX_TOKEN = re.compile(r"\\x[0-9A-Fa-f]{2}|\\[!-~]|[\x20-\x5b\x5d-\x7e]")
PLAIN_ESCAPES = {"n": 10, "r": 13, "t": 9, "0": 0, "a": 7, "b": 8, "f": 12, "v": 11}
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("n_unopened", pa.int64())])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_unopened long"
Span = tuple[int, int, str]


def scan(text: str, kinds=KINDS) -> list[Span]:
    """(start, end, kind) of every match that counts."""
    return [(m.start(), m.end(), kind) for kind, pattern, group, least in kinds for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def ordered(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], ORDER[s[2]], s[1])))


def unescape(found: str) -> str | None:
    """The characters of one Unicode escape run; None if it stands for none."""
    try:
        if found.startswith("\\u{"):
            return chr(int(found[3:-1], 16))
        if found.startswith("\\u"):
            units = b"".join(int(found[i + 2 : i + 6], 16).to_bytes(2, "little") for i in range(0, len(found), 6))
            return units.decode("utf-16-le", "replace")
        if found.startswith("\\U"):
            return chr(int(found[2:], 16))
        if found.startswith("\\x"):
            return bytes.fromhex(found.replace("\\x", "")).decode("utf-8", "replace")
        return chr(int(found[3:-1], 16) if found[2] in "xX" else int(found[2:-1]))
    except (ValueError, OverflowError):
        return None


def opener_of(data: bytes):
    """What opens the compressed stream that data starts with; None if it starts with none."""
    if bytes(data[:1]) == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj
    return {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"BZ": bz2.BZ2Decompressor, b"\xfd7": lzma.LZMADecompressor, b"\x28\xb5": lambda: zstandard.ZstdDecompressor().decompressobj()}.get(bytes(data[:2]))


ERRORS = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)


def bytewise(stream, data: bytes, had: int) -> Iterator[bytes]:
    """What a damaged stream gives before the damage, without the first ``had`` bytes."""
    for i in range(len(data)):
        try:
            got = stream.decompress(data[i : i + 1])
        except ERRORS:
            return
        yield got[had:]
        had = max(0, had - len(got))


def unpack(data: bytes | memoryview, limit: int) -> tuple[list[bytes] | None, bytes, int, bool]:
    """The contents of the members of the stream that data starts with, the bytes behind them, how many bytes were read
    as a stream, and whether the last member is damaged; no contents beyond the limit. Behind a damaged member nothing
    is left, and reading ends there."""
    members: list[bytes] = []
    size, used, damaged = 0, 0, False
    while (opener := opener_of(data)) is not None:
        out, stream, rest, read = [], opener(), b"", len(data)
        try:
            for i in range(0, len(data), 1024):  # small steps bound what one step can unpack to
                out.append(stream.decompress(data[i : i + 1024]))
                size += len(out[-1])
                if size > limit:
                    return None, b"", used + len(data), False
                if stream.eof:
                    rest = stream.unused_data + bytes(data[i + 1024 :])
                    read = len(data) - len(rest)
                    break
        except ERRORS:
            again = opener()  # up to the damaged step as before, then byte by byte
            for k in range(0, i, 1024):
                again.decompress(data[k : k + 1024])
            for k in range(i, min(len(data), i + 1024)):
                try:
                    out.append(again.decompress(data[k : k + 1]))
                except ERRORS:
                    break
            if not any(out):
                break  # no stream after all
            read, damaged = k + 1, True
        members.append(b"".join(out))
        used += read
        data = rest
    return members, bytes(data) if members else b"", used, damaged


#: Bytes of a large stream that are held as one layer, and bytes read twice where a piece ends within a line.
PIECE, OVERLAP = 4 << 20, 64 << 10
#: The end of a line that a base64 block of several lines can have; marks that no secret has.
BLOCK_LINE = re.compile(rb"[A-Za-z0-9+/=_-]{64}\r?\Z")
MARKS = re.compile(rb"[,;{}()<>]")


class Feed:
    """Bytes that are taken step by step, and may be given back."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.whole = chunks, b"", False

    def take(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.chunks, None)) is not None:
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        return out

    def peek(self, n: int) -> bytes:
        out = self.take(n)
        self.held = out + self.held
        return out


def member(feed: Feed, opener) -> Iterator[bytes]:
    """What one member gives. Then the feed stands behind it (``whole``), at its end where the member is damaged, or
    where it was if nothing came out."""
    stream, taken = opener(), []
    while not stream.eof and (data := feed.take(256)):
        before = stream.copy() if hasattr(stream, "copy") else None
        try:
            got = stream.decompress(data)
        except ERRORS:
            got = b"".join(bytewise(before, data, 0)) if before else b""
            if taken is not None and not got:
                feed.held = b"".join(taken) + data + feed.held
                return
            yield got
            while feed.take(1 << 16):
                pass
            return
        if got:
            taken = None
            yield got
        elif taken is not None:
            taken.append(data)
    feed.whole = stream.eof
    feed.held = stream.unused_data + feed.held if stream.eof else b"".join(taken or []) + feed.held


def opened(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes with the streams at their start opened, members and streams in them too; what stands behind comes last,
    after a line end."""
    feed, found = Feed(chunks), False
    while (opener := opener_of(feed.peek(6))) is not None:
        feed.whole, inner = False, member(feed, opener)
        if (first := next(inner, None)) is None and not feed.whole:
            break
        found = True
        if first is not None:
            yield from opened(chain([first], inner))
    if found and feed.peek(1):
        yield b"\n"
    yield from iter(lambda: feed.take(1 << 16), b"")


def cut_of(held: bytes) -> tuple[int, int]:
    """(end of the piece, start of the next one): after the last line that no base64 block goes on from; in one long
    line at its last mark; 0 for no such place yet."""
    end = held.rfind(b"\n")
    while end >= 0:
        if not BLOCK_LINE.search(held[max(0, end - 65) : end]):
            return end + 1, end + 1
        end = held.rfind(b"\n", 0, end)
    if len(held) < 4 * PIECE:
        return 0, 0
    marks = [m.end() for m in MARKS.finditer(held, len(held) - PIECE)]
    return (marks[-1], max(0, marks[-1] - OVERLAP)) if marks else (0, 0)


def pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes in pieces of about PIECE, or as long as the longest run that cannot be cut."""
    held, look = bytearray(), PIECE
    for chunk in chunks:
        held += chunk
        if len(held) >= look:
            end, start = cut_of(bytes(held))
            if end:
                yield bytes(held[:end])
                del held[:start]
            look = max(PIECE, 2 * len(held))
    if held:
        yield bytes(held)


def decoded(data: bytes) -> str:
    """data as text, without a character that its end cuts; empty if it is none."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        return data[: e.start].decode("utf-8") if e.reason == "unexpected end of data" else ""


def contents(data: bytes, limit: int | None) -> Iterator[str | None]:
    """The texts that data holds, through any number of compressed streams; None for a stream beyond a stated limit.
    What comes out of a stream and is no UTF-8 is read byte by byte, so text among binary data is found."""
    seen, work = {data}, [(data, False)]
    while work:
        data, packed = work.pop()
        members, rest, *_ = unpack(data, PIECE if limit is None else limit)
        if members is None:
            if limit is None:
                yield from (decoded(piece) or piece.decode("latin-1") for piece in pieces(opened(iter([data]))))
            else:
                yield None
            continue
        if not members:
            if text := decoded(data) or (data.decode("latin-1") if packed else ""):
                yield text
            continue
        # Members of one stream are one content; each is also taken alone, as one may be binary or packed again.
        for part in [b"".join(members), *(members if len(members) > 1 else []), rest]:
            if part and part not in seen:
                seen.add(part)
                work.append((part, True))


class Layer:
    """A decoded text; its character i comes from [starts[i], ends[i]) of the original. fresh: decoded here."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, fresh: np.ndarray):
        self.text, self.starts, self.ends, self.fresh = text, starts, ends, fresh

    def part(self, start: int, end: int) -> Layer:
        return Layer(self.text[start:end], self.starts[start:end], self.ends[start:end], self.fresh[start:end])

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())


def whole(text: str, offset: int = 0) -> Layer:
    at = np.arange(offset, offset + len(text))
    return Layer(text, at, at + 1, np.zeros(len(text), bool))


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run that decodes put in place; None if there is none."""
    texts, starts, ends, fresh, last = [], [], [], [], 0
    for m in pattern.finditer(layer.text):
        new = decode(m.group())
        if not new or new == m.group():
            continue
        keep = layer.part(last, m.start())
        a, b = layer.origin(*m.span())
        texts += [keep.text, new]
        starts += [keep.starts, np.full(len(new), a)]
        ends += [keep.ends, np.full(len(new), b)]
        fresh += [keep.fresh, np.ones(len(new), bool)]
        last = m.end()
    if not texts:
        return None
    rest = layer.part(last, len(layer.text))
    return Layer("".join([*texts, rest.text]), np.concatenate([*starts, rest.starts]), np.concatenate([*ends, rest.ends]), np.concatenate([*fresh, rest.fresh]))


def percent(found: str) -> str:
    return unquote_to_bytes(found).decode("utf-8", "replace")


def lines_with(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """The lines that hold a match; no secret pattern crosses a line end."""
    done = 0
    for m in pattern.finditer(text):
        if m.start() >= done:
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            done = end if end >= 0 else len(text)
            yield start, done


def spelled(text: str, start: int, token: re.Pattern) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes that the escapes and characters from ``start`` on stand for, where each one ends, and which are a +."""
    out, ends, at = bytearray(), [], start
    while m := token.match(text, at):
        at, found = m.end(), m.group()
        if len(found) == 1:
            out.append(ord(found))
        elif found[0] == "%":
            out.append(int(found[1:], 16))
        elif len(found) == 4:
            out.append(int(found[2:], 16))
        else:
            out.append(PLAIN_ESCAPES.get(found[1], ord(found[1])))
        ends.append(at)
    ends = np.array(ends, np.int64)
    return bytes(out), ends, np.flatnonzero((np.frombuffer(bytes(out), np.uint8) == 43) & (np.diff(ends, prepend=start) == 1))


#: How compressed streams begin; a bzip2 stream goes on with a block or its end.
HEADS = re.compile(rb"\x1f\x8b|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|x[\x01\x5e\x9c\xda]|\xfd7|\(\xb5")


def streams_in(form: bytes, limit: int | None) -> Iterator[tuple[int, int, bool]]:
    """(start, end, open) of the streams among the bytes of a run, each looked for behind the one before. A damaged one
    may reach to the end of the run; others are looked for behind the damage all the same."""
    done, view = 0, memoryview(form)
    for m in HEADS.finditer(form):
        if m.start() >= done:
            members, _, used, damaged = unpack(view[m.start() :], PIECE if limit is None else limit)
            if members is None or any(members):
                done = m.start() + used
                yield m.start(), len(form) if damaged else done, members is not None or limit is None


def spelled_streams(layer: Layer, limit: int | None) -> Iterator[Layer | None]:
    """The contents of compressed streams whose bytes are spelled with URL or \\x escapes and plain characters. A run is
    spelled once, and the streams are looked for among its bytes."""
    for sign, magic, token, blank in (("%", PERCENT_MAGIC, PERCENT_TOKEN, True), ("\\x", HEX_MAGIC, HEX_TOKEN, False)):  # forms write a blank as +
        done = 0
        for m in magic.finditer(layer.text) if sign in layer.text else ():
            if m.start() < done:
                continue
            form, ends, plus = spelled(layer.text, m.start(), token)
            done = int(ends[-1])
            forms = [form]
            if blank and len(plus):
                other = np.frombuffer(form, np.uint8).copy()
                other[plus] = 32
                forms.append(other.tobytes())
            for form in forms:
                for a, b, is_open in streams_in(form, limit):
                    if not is_open:
                        yield None
                        continue
                    yield from whole_at(contents(form[a:b], limit), *layer.origin(int(ends[a - 1]) if a else m.start(), int(ends[b - 1])))


def whole_at(texts: Iterator[str | None], a: int, b: int) -> Iterator[Layer | None]:
    for text in texts:
        yield text if text is None else Layer(text, np.full(len(text), a), np.full(len(text), b), np.ones(len(text), bool))


def inner_layers(layer: Layer, limit: int | None) -> Iterator[Layer | None]:
    """The layers one step further in; None for one that is not opened."""
    yield from spelled_streams(layer, limit)
    for pattern, decode in ((PERCENT, percent), (ESCAPE, unescape)):
        for start, end in lines_with(layer.text, pattern):
            if (new := replaced(layer.part(start, end), pattern, decode)) is not None:
                yield new
    for m in BASE64.finditer(layer.text):
        run = "".join(m.group().split()).translate({45: 43, 95: 47}).rstrip("=")
        if (data := from_base64(run)) is not None and len(run) % 4 != 1:
            yield from whole_at(contents(data, limit), *layer.origin(*m.span()))
        yield from whole_at(behind_prefixes("".join(m.group().split()), limit), *layer.origin(*m.span()))


def from_base64(run: str) -> bytes | None:
    """The bytes of a run in the plain alphabet; a last character that stands for no byte is left out."""
    run = run[:-1] if len(run) % 4 == 1 else run
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: What may stand before base64 in one run.
JOINT = re.compile(r"[-_/+]")
WORTH = re.compile("|".join([*HINTS.values(), WRAPPED]))


def behind_prefixes(run: str, limit: int | None) -> Iterator[str | None]:
    """What a run holds if base64 begins later in it, behind a name or a path. A place in the run can begin base64 in one
    of four alignments, so four decodings hold them all: text among the bytes is taken where it could hold anything,
    streams where they begin behind a joint or with the alignment."""
    plain = run.translate({45: 43, 95: 47}).rstrip("=")
    joints = [m.end() for m in JOINT.finditer(run)]
    for shift in range(4):
        if (data := from_base64(plain[shift:])) is None or len(data) < 6:
            continue
        text = data.decode("utf-8", "replace")
        if WORTH.search(text) and (shift or "\ufffd" in text or len(plain) % 4 == 1):
            yield text
        done, view = 0, memoryview(data)
        for at in dict.fromkeys([0] * (shift > 0) + [(p - shift) // 4 * 3 for p in joints if p > shift and (p - shift) % 4 == 0]):
            if done <= at < len(data) and opener_of(view[at : at + 6]):
                members, _, used, _ = unpack(view[at:], PIECE if limit is None else limit)
                if members is None or any(members):
                    done = at + used
                    yield from contents(data[at:done], limit)


def unwrap(text: str, limit: int | None) -> tuple[set[Span], int, int]:
    """Findings in the layers below the text itself, number of layers, number not opened. The worklist is a stack of
    layers that are being unwrapped, so of a large stream one piece at a time is held."""
    found: set[Span] = set()
    seen: set[tuple[int, int, bytes]] = set()
    layers = unopened = 0
    worklist = [inner_layers(whole(text), limit)]
    while worklist:
        new = next(worklist[-1], False)
        if new is False:
            worklist.pop()
        elif new is None:
            unopened += 1
        else:
            key = (*new.origin(0, len(new.text)), hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest())
            if key not in seen:
                seen.add(key)
                layers += 1
                found.update((*new.origin(start, end), kind) for start, end, kind in scan(new.text) if new.fresh[start:end].any())
                worklist.append(inner_layers(new, limit))
    return found, layers, unopened


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int | None = None) -> DataFrame:
    """Per document row: doc_id, counts and digest of the findings in the text itself, and ``spans`` of all findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = pc.fill_null(batch.column("text"), "")
            hints = zip(*(pc.match_substring_regex(column, HINTS[k]).to_pylist() for k, *_ in KINDS))
            wrapped = pc.match_substring_regex(column, WRAPPED).to_pylist()
            out = []
            for text, hint, deep in zip(strings(batch, "text"), hints, wrapped):
                base = scan(text, [k for k, is_on in zip(KINDS, hint) if is_on])
                more, layers, unopened = unwrap(text, max_layer) if deep else (set(), 0, 0)
                counts = [sum(kind == k for _, _, kind in base) for k, *_ in KINDS]
                out.append((*counts, hashlib.sha256(ordered(base).encode()).hexdigest(), ordered(more.union(base)), layers, unopened))
            yield rows(SCHEMA, batch.column("doc_id"), *zip(*out))

    return id_text(docs, id_col, text_col).mapInArrow(run, DDL)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))
