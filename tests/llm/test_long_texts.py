"""Texts on which a scan could take time beyond their length, layers behind prefixes, occurrences against brute force, and
benchmarks of many blocks."""

from __future__ import annotations

import base64
import bz2
import gzip
import random
import time
from urllib.parse import quote_from_bytes

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import brute_hits, fuzz, table, words

from quadrille.llm import decontaminate, licenses, secrets

PASSWORD = base64.b64encode(b"password=hunter22x").decode()
SIZE = 1_000_000


@pytest.mark.parametrize("text", ["%20 " + "BZh" * (SIZE // 3), "%20" + "x%9Cabcdefgh" * (SIZE // 12), "\\x20 " + "BZh see " * (SIZE // 8), "ab/" * (SIZE // 3) + PASSWORD, "A" * SIZE, "%1F%8B" * (SIZE // 6)], ids=["heads", "headers", "hex", "path", "run", "magic"])
def test_secrets_in_time(text):
    start = time.process_time()
    found, *_ = secrets.unwrap(text, None)
    assert time.process_time() - start < 15 and bool(found) == (PASSWORD in text)


def test_licenses_in_time():
    ready = licenses.prepared(licenses.TEMPLATES | licenses.whole_texts())
    text = b"page text here All rights reserved. " * (SIZE // 36)
    start = time.process_time()
    found = licenses.find_in(text, ready, 0.9, 1.5, every=True)
    assert time.process_time() - start < 15 and len(found) == SIZE // 36


def test_layers_behind_prefixes(spark):
    streams = [PASSWORD, PASSWORD.rstrip("="), base64.urlsafe_b64encode(gzip.compress(b"token = abcdefgh \xc3\xbf")).decode(), base64.b64encode(bz2.compress(b"secret: zzzzzzzz")).decode(), base64.b64encode(PASSWORD.encode()).decode()]
    texts = [f"see {prefix}{stream}" for stream in streams for prefix in ("", "x", "ab-", "path/", "id_", "id=", "/etc/some/path/", "a-b_c/", "Bearer.")]
    for r in secrets.find_secrets(table(spark, texts)).collect():
        assert "assign:" in r["spans"], texts[r["doc_id"]]
        a, b = map(int, r["spans"].split(",")[0].split(":")[1:])
        assert 4 <= a <= len(texts[r["doc_id"]]) - 20 and b >= len(texts[r["doc_id"]]) - 3
    plain = [words(random.Random(1), 40), "a/long/path/of/plain/words/and/names", "deadbeef" * 2, "x" * 50]
    assert not any(r["spans"] for r in secrets.find_secrets(table(spark, plain)).collect())


def test_streams_behind_damage():
    """A head that opens nothing, or a stream that is damaged in a run, does not hide the streams behind it."""
    good = quote_from_bytes(bz2.compress(b"secret: zzzzzzzz"))
    packed = bytearray(bz2.compress(random.Random(2).randbytes(400)))
    packed[100:110] = bytes(10)
    for before in ("x%9Cabcd" * 10, "BZh9" * 7, quote_from_bytes(bytes(packed))):
        text = f"see %20{before}{good} end"
        assert any(kind == "assign" for *_, kind in secrets.unwrap(text, None)[0]), before


# ---- licenses --------------------------------------------------------------------------------------


def occurrences(words_, template, need, slack):
    """The best stretch of all, then the best ones left and right of it, over every window of the text."""
    if len(words_) < need:
        return []
    best, room = None, int(len(template) * slack)
    for low, high in [(low, low + n) for low in range(len(words_)) for n in (len(template), room)]:
        pairs = licenses.densest(licenses.aligned(words_[low:high], template), need, room)
        if pairs and licenses.named(words_[low:high], pairs, template):
            here = (len(pairs), -(pairs[-1][0] - pairs[0][0]), -(low + pairs[0][0]))
            if best is None or here > best[0]:
                best = here, low + pairs[0][0], low + pairs[-1][0], len(pairs)
    if best is None:
        return []
    _, a, b, n = best
    return [*occurrences(words_[:a], template, need, slack), (a, b, n), *((b + 1 + x, b + 1 + y, k) for x, y, k in occurrences(words_[b + 1 :], template, need, slack))]


def test_licenses_against_brute_force():
    rng, some = random.Random(3), 0
    for case in range(40):
        template = [f"t{rng.randrange(8 if case % 2 else 30)}".encode() for _ in range(rng.randrange(4, 16))]
        text = []
        for _ in range(rng.randrange(1, 8)):
            part = list(template)
            for _ in range(rng.choice([0, 0, 1, 2])):
                part[rng.randrange(len(part))] = b"zz"
            text += part + [rng.choice([*template, b"other"]) for _ in range(rng.randrange(6))]
        expected = occurrences(text, template, int(np.ceil(0.9 * len(template))), 1.5)
        ready = licenses.prepared({"own": b" ".join(template).decode()})
        found = licenses.all_in(text, ready[0][1], ready[0][2], 0.9, 1.5)
        spans = sorted((p[0][0], p[-1][0], len(p)) for p in found)
        # Each of them is found; where words repeat, another window may align a word more or less at an end.
        assert len(spans) >= len(expected) and all(any(a <= d and c <= b for a, b, _ in spans) for c, d, _ in expected), (case, spans, expected)
        assert all(n >= np.ceil(0.9 * len(template)) for *_, n in spans)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        some += len(spans)
    assert some > 60


def test_licenses_inside_longer_ones():
    rng = random.Random(4)
    for _ in range(200):
        found = [{"start": (s := rng.randrange(60)), "end": s + rng.randrange(1, 30), "n": rng.randrange(1, 6)} for _ in range(rng.randrange(12))]
        plain = [x for x in found if not any(y["start"] <= x["start"] and x["end"] <= y["end"] and y["n"] > x["n"] for y in found)]
        assert sorted(map(str, licenses.not_inside(found))) == sorted(map(str, plain))


def test_long_texts_of_three_scans(spark):
    """Over two million characters in one text: secrets behind escapes, many licenses, and a benchmark passage."""
    rng = random.Random(5)
    body = words(rng, 300_000, 50_000)
    text = body + " %20" + "BZh" * 20_000 + " password = hunter22x " + " All rights reserved." * 5_000 + " " + words(random.Random(6), 30)
    docs = table(spark, [text, None, ""])
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    at = text.index("password")
    assert spans == {0: f"assign:{at}:{at + 20}", 1: "", 2: ""}
    found = {r["doc_id"]: len(r["found"]) for r in licenses.find_licenses(docs, every=True).collect()}
    assert found == {0: 5_000, 1: 0, 2: 0}
    items = spark.createDataFrame([(1, words(random.Random(6), 30))], "item_id long, text string")
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_benchmark(docs, items).collect()}
    assert hit == {0: 30, 1: 0, 2: 0}


# ---- benchmarks of many blocks ---------------------------------------------------------------------


def test_blocks_one_at_a_time(spark):
    rng = random.Random(7)
    items = [(i, words(rng, n, 90)) for i, n in enumerate([25, 12, 10, 4, 30, 11, 18, 40, 10, 9, 16, 22])] + [(50, None), (None, words(rng, 14, 90))]
    texts = [None, "", *fuzz(8, 20)] + [" ".join([words(rng, 5, 90), items[i % 12][1].upper(), words(rng, 5, 90), items[(i + 5) % 12][1]]) for i in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    docs = table(spark, [*texts, texts[-1]], [*range(len(texts)), len(texts) - 1])
    found = decontaminate.find_benchmark(docs, bench, block_bytes=300)
    assert len(list(decontaminate._blocks(bench.select(F.col("item_id").cast("string"), "text"), 300))) >= 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    expected = {at: (n_words, n_hit, sorted(map(str, ids))) for at, n_words, n_hit, ids in brute_hits(texts, items)}
    rows = found.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["items"]) == expected[r["doc_id"]]
    whole = {r["doc_id"]: r["spans"] for r in decontaminate.find_benchmark(docs, bench).collect()}
    assert {r["doc_id"]: r["spans"] for r in rows} == whole
    clean = decontaminate.decontaminate(docs, bench, block_bytes=300)
    assert clean._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(at for at, (_, n_hit, _) in expected.items() if not n_hit)


def test_filters_of_many_tasks(spark):
    """Filters of very many partitions are folded in fewer tasks; the filter is the same."""
    from quadrille.llm import line_dedup

    docs = table(spark, [f"line {i % 40}\nown {i}" for i in range(200)]).select("doc_id", "text").repartition(60)
    few = line_dedup.in_fewer_tasks(docs, 1 << 20, most=1 << 20)
    assert few.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism < 60 == line_dedup.in_fewer_tasks(docs, 1 << 20).rdd.getNumPartitions()
    assert (line_dedup.twice_filter(few, 1 << 20) == line_dedup.twice_filter(docs, 1 << 20)).all()


def test_spans_of_a_document_without_id(spark, tmp_path):
    """A passage whose first document has no id is printed with an empty third field."""
    from quadrille.llm import queries

    passage = words(random.Random(9), 60, 90_000)
    spark.createDataFrame([(None, passage, "en", "s", 1), (None, "own " + passage, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spans = [r["spans"] for r in queries.QUERIES["op1_substring_dedup"](spark, str(tmp_path)).collect()]
    assert spans and all(s.count(":") == 2 and s.endswith(":") for s in spans)


def test_long_texts_of_the_classifier_and_the_files(spark, tmp_path):
    """The same for the classifier and the token files: whole texts count."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from quadrille.llm import queries

    rng = random.Random(11)
    texts = [words(rng, 80, 3000).replace(" ", "### " if i % 2 else " ") for i in range(60)] + [words(rng, 300_000, 50_000), None]
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in queries.QUERIES["op3_quality_model"](spark, str(tmp_path)).collect()}
    assert set(scores) == set(range(len(texts))) and all(0 <= s <= 1 for s in scores.values())
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in queries.QUERIES["op9_token_files"](spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_licenses_that_tie(spark):
    """Two templates of the same words are both found, at the same place; the first by name is the best."""
    notice = "permission is granted to anyone to use this made up notice for any purpose"
    found = licenses.find_licenses(table(spark, [f"see {notice} end", None]), {"second": notice, "first": notice.upper()}, every=True).collect()
    assert {r["doc_id"]: [(x["license"], x["coverage"], x["start"], x["end"]) for x in r["found"]] for r in found} == {0: [("first", 1.0, 4, 4 + len(notice)), ("second", 1.0, 4, 4 + len(notice))], 1: []}
