"""Splitting texts into pre-tokens: the matches of a byte-level BPE's pattern, as UTF-8 bytes."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Texts of these characters alone are split by Arrow's RE2; their classes are the same in every Unicode version.
PLAIN = r"^[\t-\r\x20-\x7E\x{A1}-\x{24F}\x{2010}-\x{2027}]*$"
#: RE2 has no look-ahead: a mark first parts the last of several blanks from those before it.
LAST_BLANK = r"([\t-\r\x20])([\t-\r\x20][^\t-\r\x20])"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r\x20\p{L}\p{N}\x00]+|[\t-\r\x20]+"
#: Unicode's White_Space, spelt out: libraries differ in what \s takes in besides.
BLANK = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_compiled: dict[str, regex.Pattern] = {}


def compiled(pattern: str) -> regex.Pattern:
    """The pattern for the general way, with \\s and \\S spelt out."""
    if pattern not in _compiled:
        spelt = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{BLANK}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]")
        _compiled[pattern] = regex.compile(spelt)
    return _compiled[pattern]


def pretokens(column: pa.Array, pattern: str) -> list[list[bytes]]:
    """The pre-tokens of each text in order; an empty one may stand between them and means nothing."""
    column = pc.fill_null(column, "")
    if pattern != public_tokenizers.PATTERN:
        return [[m.encode() for m in compiled(pattern).findall(text)] for text in column.to_pylist()]
    plain = pc.match_substring_regex(column, PLAIN)
    parted = pc.replace_substring_regex(column.filter(plain), pattern=LAST_BLANK, replacement="\\1\x00\\2")
    marked = iter(pc.replace_substring_regex(parted, pattern=PIECE, replacement="\\0\x00").cast(pa.binary()).to_pylist())
    if len(parted) == len(column):
        return [x.split(b"\x00") for x in marked]
    general = compiled(pattern)
    texts = iter(column.filter(pc.invert(plain)).to_pylist())
    return [next(marked).split(b"\x00") if is_plain else [m.encode() for m in general.findall(next(texts))] for is_plain in plain.to_pylist()]
