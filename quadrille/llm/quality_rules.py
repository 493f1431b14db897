"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one failure bit a
rule. Policies are versioned masks over those bits: applying a policy or an ablation never looks at a
text again, and an ablation is a bitwise aggregation over the ledger's masks.

Defined results: null or empty text has no words, and every measure that divides by a count of 0 is 0;
repeated rows each get their row; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.llm.text import blobs, id_text, read_table, rows, slices

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
NOT_LETTERS = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
CONTINUED = bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_letters", "n_upper", "longest_word")
LEDGER = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])


def repeat_words(numbers: np.ndarray) -> int:
    """Words inside 3-word windows that the text has twice or more; numbers: one for each word."""
    if len(numbers) < 4:
        return 0
    span = int(numbers.max()) + 1
    if span < 1 << 21:
        windows = (numbers[:-2] * span + numbers[1:-1]) * span + numbers[2:]
    else:  # pairs first, so that the product stays below 2**63
        pairs = np.unique(numbers[:-1] * span + numbers[1:], return_inverse=True)[1]
        windows = pairs[:-1] * span + numbers[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == len(windows):
        return 0
    hit = np.zeros(len(numbers), bool)
    again = counts[which] > 1
    for i in range(3):
        hit[i : i + len(again)] |= again
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    joined = b"".join(words).translate(None, CONTINUED)
    return (
        len(words),
        len(joined),
        len(text.translate(None, NOT_SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(numbers),
        len(known),
        len(joined.translate(None, NOT_LETTERS)),
        len(joined.translate(None, NOT_UPPER)),
        max(map(len, known), default=0),
    )


def per(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column | None
    text: str


def rules() -> list[Rule]:
    """The rules in bit order; a rule's bit never changes, new rules are appended."""
    return [
        Rule("few_words", F.col("n_words") < 50, "fewer than 50 words"),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"), "over half of the words in repeated 3-word windows"),
        Rule("many_words", F.col("n_words") > 1_000_000, "over a million words"),
        Rule("short_words", (F.col("n_words") > 0) & (per("word_chars", "n_words") < 2), "mean word under 2 characters"),
        Rule("long_words", per("word_chars", "n_words") > 25, "mean word over 25 characters"),
        Rule("symbols", per("n_symbols", "n_words") > 0.5, "over one symbol for two words"),
        Rule("dup_lines", (F.col("n_lines") >= 10) & (per("n_dup_lines", "n_lines") > 0.7), "over 70 % of the lines repeat an earlier one"),
        Rule("few_letters", (F.col("n_words") > 0) & (per("n_letters", "word_chars") < 0.3), "under 30 % letters"),
        Rule("few_distinct_words", (F.col("n_words") >= 50) & (F.col("n_distinct_words") < 8), "under 8 different words"),
        Rule("shouting", (F.col("n_words") >= 50) & (per("n_upper", "n_letters") > 0.7), "over 70 % capitals"),
        Rule("giant_word", F.col("longest_word") > 20_000, "a word of over 20,000 bytes"),
    ]


#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_words", "short_words", "long_words", "symbols", "dup_lines", "few_letters", "few_distinct_words", "shouting", "giant_word"),
}


def mask(names: tuple[str, ...]) -> int:
    at = {r.name: i for i, r in enumerate(rules())}
    return sum(1 << at[n] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, the measurements, and ``failed``, one bit a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield rows(LEDGER, batch.column("doc_id"), *zip(*map(measure, blobs(batch, "text"))))

    measured = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: rule, n_failed, n_only (rejected by it alone), n_kept_without; one row a rule.

    Masks are counted first, so the shuffle has a row for each combination of failures and task."""
    names = POLICIES[policy]
    counted = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(names))).alias("failed")).agg(F.count("*").alias("n"))
    table = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in names))
    joined = counted.select("failed", "n", F.inline(table))
    has, rest = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.bitwise_not("bit"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return joined.groupBy("rule").agg(total(has).alias("n_failed"), total(has & (rest == 0)).alias("n_only"), total(rest == 0).alias("n_kept_without"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(read_table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed")


#: The measures and the two policies in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3),
tri AS (SELECT doc_id, p, words[p] || chr(32) || words[p + 1] || chr(32) || words[p + 2] AS t FROM pos),
rep AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
         len(list_distinct(words)) AS n_distinct_words, coalesce(list_max(list_transform(words, lambda x: strlen(x))), 0) AS longest_word,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(array_to_string(words, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM w LEFT JOIN hits h ON w.doc_id = h.doc_id),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END) + (CASE WHEN n_words > 0 AND word_chars / n_words < 2 THEN 8 ELSE 0 END)
         + (CASE WHEN n_words > 0 AND word_chars / n_words > 25 THEN 16 ELSE 0 END)
         + (CASE WHEN n_words > 0 AND n_symbols / n_words > 0.5 THEN 32 ELSE 0 END)
         + (CASE WHEN n_lines >= 10 AND n_dup_lines / n_lines > 0.7 THEN 64 ELSE 0 END)
         + (CASE WHEN n_words > 0 AND n_letters / word_chars < 0.3 THEN 128 ELSE 0 END)
         + (CASE WHEN n_words >= 50 AND n_distinct_words < 8 THEN 256 ELSE 0 END)
         + (CASE WHEN n_words >= 50 AND n_letters > 0 AND n_upper / n_letters > 0.7 THEN 512 ELSE 0 END)
         + (CASE WHEN longest_word > 20000 THEN 1024 ELSE 0 END) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM f
"""
