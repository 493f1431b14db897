"""Every query of the corpus operators over one small set of tables, column by column against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_corpus import ODD, brute_base, brute_groups, brute_hits, brute_lines, encoding, fuzz, words
from tokenizers import Tokenizer

import corpus_pipeline
from quadrille.llm import minhash, quality_model, quality_rules, queries
from quadrille.llm.text import read_table

sha = lambda text: hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark: odd texts, copies, near copies, repeated lines and passages, secrets, benchmark words."""
    rng, folder = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    items = [(i, words(rng, n, 60)) for i, n in enumerate([30, 12, 10, 4, 25])] + [(5, None)]
    passage = words(rng, 60, 90_000)
    texts = [t for t in ODD if t is None or len(t) < 5000] + fuzz(22, 20)
    lines = [f" Shared line {i} é" for i in range(4)]
    for i in range(110):
        body = words(rng, rng.randrange(55, 90), 3000)
        if i % 4 == 0:
            body = body.replace(" ", "### ")
        if i % 3 == 0:
            body = "\n".join([lines[i % 4], body, lines[i % 4].upper() if i % 2 else "own"])
        if i % 11 == 5:
            body = body + " " + passage + " " + words(rng, 5, 3000)
        if i % 13 == 2:
            body += " " + items[i % 3][1].upper().replace(" ", ", ") + "."
        if i % 17 == 3:
            body += " password = hunter22x " + "0a" * 13
        texts.append(body)
    for t in texts[40:52]:
        copy = t.split(" ")
        texts += [t, " ".join([*copy[:20], "changed", *copy[21:]])]
    ids = rng.sample(range(5000), len(texts))
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("###" not in (t or "")), 0) for i, t, *_ in docs if i % 8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: t for i, t, *_ in docs}, items, {i: q for i, q, _ in labels}


def run(spark, tables, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, tables[0]).collect()}


def test_op1(spark, tables):
    found, docs = run(spark, tables, "op1_substring_dedup"), tables[1]
    first, hit = {}, {}
    for i in sorted(docs):  # every 30-word window against all earlier places
        w = (docs[i] or "").lower().split()
        for j in range(len(w) - 29):
            key = tuple(w[j : j + 30])
            if key in first:
                hit.setdefault(i, set()).update(range(j, j + 30))
            first.setdefault(key, (i, j))
    assert set(hit) <= set(found)
    for i, r in found.items():
        kept, at = "", 0
        for span in r["spans"].split(","):
            a, b, origin = map(int, span.split(":"))
            assert a >= at and origin <= i
            kept, at = kept + docs[i][at:a], b
        kept += docs[i][at:]
        assert r["kept_sha256"] == sha(kept) and r["n_spans"] == r["spans"].count(",") + 1
        assert len(docs[i].split()) - len(kept.split()) >= max(30, len(hit.get(i, ())) - 2)


def test_op2(spark, tables):
    found, docs = run(spark, tables, "op2_secret_scan"), tables[1]
    assert set(found) == set(docs)
    for i, r in found.items():
        base = brute_base(docs[i] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (*(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")), sha(",".join(base)))
        assert set(base) <= set(r["spans"].split(",")) | {""}
    assert sum(r["n_assign"] for r in found.values()) > 3


def test_op3(spark, tables):
    found, again = run(spark, tables, "op3_quality_model"), run(spark, tables, "op3_quality_model")
    assert set(found) == set(tables[1])
    for i, r in found.items():
        assert (r["held_out"], r["predicted"]) == (held_out(i), int(r["score"] >= 0.3)) and 0 <= r["score"] <= 1 and r["score"] == again[i]["score"]
    unseen = [(i, q) for i, q in tables[3].items() if held_out(i)]
    assert len(unseen) > 15 and np.mean([found[i]["predicted"] == q for i, q in unseen]) > 0.9


def test_op4(spark, tables):
    found, enc = run(spark, tables, "op4_bpe"), encoding()
    assert set(found) == set(tables[1])
    for i, t in tables[1].items():
        ids = enc.encode_ordinary(t or "")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))


def test_op5(spark, tables):
    found = run(spark, tables, "op5_license_scan")
    assert set(found) == set(tables[1]) and not any(r["licenses"] for r in found.values())


def test_op6(spark, tables):
    found, docs = run(spark, tables, "op6_near_dedup"), tables[1]
    expected = {i: (n, c) for i, n, c in brute_groups(list(docs.values()), list(docs), 2, 80)}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items()) and sum(not r["kept"] for r in found.values()) >= 20


def test_op7(spark, tables):
    found = run(spark, tables, "op7_decontamination")
    expected = brute_hits(list(tables[1].values()), tables[2])
    ids = list(tables[1])
    for at, n_words, n_hit, items in expected:
        r = found[ids[at]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n_words, n_hit, len(items), sha(",".join(items)), n_hit > 0)
    assert sum(r["contaminated"] for r in found.values()) >= 5


def test_op8(spark, tables):
    found = run(spark, tables, "op8_line_dedup")
    for i, n, dropped, kept in brute_lines(list(tables[1].items()), 10, "none"):
        assert (found[i]["n_lines"], found[i]["n_dropped"], found[i]["kept_sha256"]) == (n, dropped, sha(kept))
    assert sum(r["n_dropped"] for r in found.values()) > 10


def test_op9(spark, tables):
    found, library, at = run(spark, tables, "op9_token_files"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i in sorted(tables[1]):
        ids = [*library.encode(tables[1][i] or "", add_special_tokens=False).ids, 2]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op10(spark, tables):
    found = run(spark, tables, "op10_quality_rules")
    for i, t in tables[1].items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        many = {x for x in tri if tri.count(x) > 1}
        hit = len({k for j, x in enumerate(tri) if x in many for k in range(j, j + 3)})
        rows = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r, failed = found[i], len(w) < 50 or 100 * hit > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(rows) - len(set(rows)), hit, failed)
        assert not (r["kept"] and failed)
    book = quality_rules.ledger(read_table(spark, tables[0], "documents"))
    assert {r["doc_id"] for r in book.where(quality_rules.passes("v1")).collect()} == {i for i, r in found.items() if r["kept"]}


def test_pipeline(spark, tables):
    """The stages in order by brute force; the classifier's own scores decide the first."""
    docs = read_table(spark, tables[0], "documents")
    scores = {r["doc_id"]: r["score"] for r in quality_model.score(docs, quality_model.train(docs, read_table(spark, tables[0], "labels"))).collect()}
    left = {i: t for i, t in tables[1].items() if scores[i] >= 0.3}
    cut = {i: (t, d) for i, _, d, t in brute_lines(list(left.items()), 10, "first")}
    left = {i: t for i, (t, d) in cut.items() if not (d and not t.encode().strip())}
    groups = brute_groups(list(left.values()), list(left), 5, 80)
    left = {i: left[i] for i, _, c in groups if c in (i, None)}
    hits = {list(left)[at]: n_hit for at, _, n_hit, _ in brute_hits(list(left.values()), tables[2])}
    left = {i: t for i, t in left.items() if not hits[i]}
    enc, found = encoding(), {r["doc_id"]: r for r in corpus_pipeline.run(spark, tables[0]).collect()}
    assert set(found) == set(left) and 20 < len(left) < len(tables[1]) - 40
    for i, t in left.items():
        ids = enc.encode_ordinary(t)
        assert (found[i]["n_tokens"], found[i]["ids_sha256"], found[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


def test_recall_of_near_duplicates(spark):
    """Pairs planted at 0.80 to 0.85 of their shingles are linked."""
    rng, texts, wanted = random.Random(23), [], []
    for _ in range(300):
        base = [f"u{rng.randrange(10**9)}" for _ in range(200)]
        for n in range(1, 40):
            copy = [*base[:-n], *(f"v{rng.randrange(10**9)}" for _ in range(n))]
            both = 199 - n
            share = both / (2 * 199 - both)
            if share < 0.85:
                break
        assert 0.80 <= share
        wanted.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    comp = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, width=2).collect()}
    assert np.mean([comp[a] == comp[b] for a, b in wanted]) >= 0.9
    assert len(set(comp.values())) == 300


def test_repeated_ids(spark):
    """Rows with one id are one document where documents are counted; every row has its own result."""
    from quadrille.llm import line_dedup

    rows = [(7, "same\nown a"), (7, "same\nown b"), (8, "same"), (None, "same"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dropped = lambda n: sorted(r["n_dropped"] for r in line_dedup.dedup_lines(docs, min_docs=n, keep="none").collect())
    assert dropped(3) == [0, 1, 1, 1, 1] and dropped(4) == [0, 0, 0, 0, 0]


def test_very_long_texts(spark, tmp_path):
    """Three million characters in one text, and a near copy: whole texts count, in one task each."""
    rng = random.Random(24)
    body = words(rng, 400_000, 90_000)
    lines = body.replace(" w", "\nw", 3000)
    texts = {1: lines + " token = abcdefgh", 2: lines.replace("\n", "\nx", 1), 3: "small"}
    folder = str(tmp_path)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    run = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, folder).collect()}
    assert len(texts[1]) > 2_500_000
    found, enc = run("op4_bpe"), encoding()
    assert {i: found[i]["n_tokens"] for i in texts} == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}
    assert all(found[i]["decoded_sha256"] == sha(t) for i, t in texts.items())
    found = run("op8_line_dedup")
    assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in found.items()} == {i: (t.count("\n") + 1, 0, sha(t)) for i, t in texts.items()}
    assert {i: r["component_id"] for i, r in run("op6_near_dedup").items()} == {1: 1, 2: 1, 3: 3}
    found = run("op2_secret_scan")
    assert found[1]["base_sha256"] == sha(",".join(brute_base(texts[1]))) and found[1]["n_assign"] == 1
    found = run("op1_substring_dedup")
    assert set(found) == {2} and found[2]["n_words"] > 390_000
    found = run("op10_quality_rules")
    assert {i: r["n_words"] for i, r in found.items()} == {i: len(t.split()) for i, t in texts.items()}
