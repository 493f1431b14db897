"""Names and codes: keys under which differently written names agree."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
FULL_LETTERS = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
# Numerals of block names, variants of one sound, and old characters with their new ones.
NUMERALS = "一二三四五六七八九"
SAME_SOUND = "ヶゕガケが"
OLD, NEW = "澤廣髙﨑", "沢広高崎"


def _numeral(one: Column) -> Column:
    """Value of a numeral, 0 for the empty text."""
    return F.when(one == "", 0).otherwise(F.instr(F.lit(NUMERALS), one))


def half_width(name: Column) -> Column:
    """Full-width letters and digits as ASCII."""
    return F.translate(name, FULL_LETTERS + FULL_DIGITS, LETTERS + DIGITS)


def town_key(name: Column) -> Column:
    """Key of a town-block name: ASCII digits, block numerals 1-99 as digits, one character for the
    variants of "ke", no white space, four old characters renewed. Null becomes the empty key.
    A name that has several two-digit blocks gets the first one's number in all of them."""
    out = F.translate(F.coalesce(name, F.lit("")), FULL_DIGITS, DIGITS)
    pair = f"([{NUMERALS}]?)十([{NUMERALS}]?)丁目"
    tens, ones = F.regexp_extract(out, pair, 1), F.regexp_extract(out, pair, 2)
    number = F.when(tens == "", F.lit(10)).otherwise(_numeral(tens) * 10) + _numeral(ones)
    out = F.regexp_replace(out, F.lit(pair), F.concat(number.cast("string"), F.lit("丁目")))
    for i, numeral in enumerate(NUMERALS, 1):
        out = F.regexp_replace(out, f"{numeral}丁目", f"{i}丁目")
    out = F.translate(out, SAME_SOUND, "ケ" * len(SAME_SOUND))
    return F.translate(F.regexp_replace(out, "[\\s　]", ""), OLD, NEW)


def padded_code(code: Column, width: int = 6) -> Column:
    """All-digit codes padded with zeros; longer and other codes stay, blank is null."""
    text = F.trim(code)
    return F.when(text != "", F.when(text.rlike("^[0-9]+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text))


def composite_code(municipality: Column, town: Column) -> Column:
    """"municipality:town"; null unless both are there."""
    return F.when((municipality != "") & (town != ""), F.concat_ws(":", municipality, town))


def ward_of(municipality: Column, city: str = "大阪市") -> Column:
    """The ward at the end of a municipality's name; null outside the city."""
    return F.nullif(F.regexp_extract(municipality, f"{city}(.+区)$", 1), F.lit(""))


def header_key(text: Column) -> Column:
    """Key of a table heading: ASCII digits kept, blanks, brackets, dashes and footnote marks gone."""
    out = F.translate(F.coalesce(text, F.lit("")), FULL_DIGITS, DIGITS)
    out = F.regexp_replace(out, "[\\s　]", "")
    out = F.regexp_replace(out, "[（）()〔〕\\[\\]【】]", "")
    out = F.regexp_replace(out, "[\\-－―~〜・]", "")
    return F.regexp_replace(F.regexp_replace(out, "[*※][0-9]*", ""), "注[0-9]*", "")


def heading_is(key: Column, alias: str) -> Column:
    """Whether a heading's key holds an alias that no digit runs into ("15人" does not hold "5人")."""
    quoted = "".join(c if c.isalnum() else "\\" + c for c in alias)
    before = r"(?<![0-9])" if alias[:1].isdigit() else ""
    after = r"(?![0-9])" if alias[-1:].isdigit() else ""
    return key.rlike(before + quoted + after)


def building_key(name: Column) -> Column:
    """Key of a building name: half width, no blanks or middle dots, lower case."""
    return F.lower(F.regexp_replace(half_width(F.coalesce(name, F.lit(""))), "[\\s　・･]", ""))


def place_key(name: Column) -> Column:
    """Key of a photo's or a listed place's name: a building's key without brackets."""
    return F.regexp_replace(building_key(name), "[（）()「」【】]", "")


def names_agree(a: Column, b: Column, least: int = 3) -> Column:
    """Equal keys, or one within the other where both have ``least`` characters; empty keys never agree."""
    both = (F.length(a) >= least) & (F.length(b) >= least)
    return (a != "") & (b != "") & ((a == b) | (both & (a.contains(b) | b.contains(a))))


def hiragana(name: Column) -> Column:
    return F.translate(name, KATAKANA, HIRAGANA)


def core_name(name: Column, prefixes: list[str]) -> Column:
    """The name without its leading prefixes, as many as there are; the name itself if nothing would stay."""
    quoted = "|".join("".join(c if c.isalnum() else "\\" + c for c in p) for p in prefixes)
    rest = F.regexp_replace(name, f"^(?:{quoted})+", "")
    return F.when(rest == "", name).otherwise(rest)


def base_town(name: Column) -> Column:
    """The town of a block: the name without its block number."""
    return F.regexp_replace(name, f"[0-9０-９{NUMERALS}十]+丁目$", "")


def river_key(name: Column) -> Column:
    """Key of a river name: no bracketed parts, no blanks, no dots at the ends."""
    out = F.regexp_replace(half_width(F.coalesce(name, F.lit(""))), "[（(][^（()）]*[)）]", "")
    return F.regexp_replace(F.regexp_replace(out, "[\\s　]", ""), "^[・.]+|[・.]+$", "")


@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Unicode's compatibility form; Spark has no built-in for it."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def stable_id(prefix: str, *columns: Column, digits: int = 12) -> Column:
    """An id from the row's own content: the prefix and the start of a SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, digits))


def same_in_both(ja: Column, en: Column, places: dict[str, str], kinds: dict[str, list[str]], prefixes: list[str] = ()) -> Column:
    """Whether a Japanese and an English name say the same by a lexicon: every part of the Japanese one is a known
    prefix, kind or place; there is a place; every place's romanisation and one word of every kind stand in the
    English one as whole words. Longer entries are taken first."""
    rest = F.regexp_replace(F.coalesce(ja, F.lit("")), "[\\s　・()（）]", "")
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(en, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    says = lambda w: words.contains(f" {w} ")
    good, some = F.lit(True), F.lit(False)
    for p in sorted(prefixes, key=len, reverse=True):
        rest = F.replace(rest, F.lit(p), F.lit("|"))
    for table, is_place in ((kinds, False), (places, True)):
        for key in sorted(table, key=len, reverse=True):
            there = rest.contains(key)
            spoken = says(table[key]) if is_place else F.lit(False)
            if not is_place:
                for w in table[key]:
                    spoken = spoken | says(w)
            good = good & (~there | spoken)
            some = some | (there & F.lit(is_place))
            rest = F.replace(rest, F.lit(key), F.lit("|"))
    left = F.regexp_replace(F.regexp_replace(rest, "\\|", ""), "店$", "")
    return good & some & (left == "")


def variant_evidence(a: Column, b: Column, alike: list[str], stem: int = 4, aliases: dict[str, str] = {}) -> Column:
    """How two variant keys agree: "exact"; "rename" (one stem of ``stem`` characters or more with two of the
    ``alike`` endings); "alias" (a stated short form and a name that starts with the long one); null for not."""
    ending = f"^(.*?)({'|'.join(alike)})$"
    sa, sb = F.regexp_extract(a, ending, 1), F.regexp_extract(b, ending, 1)
    alias = F.lit(False)
    for short, long in aliases.items():
        alias = alias | ((a == short) & b.startswith(long)) | ((b == short) & a.startswith(long))
    return F.when((a == "") | (b == ""), F.lit(None)).when(a == b, "exact").when((F.length(sa) >= stem) & (sa == sb), "rename").when(alias, "alias")
