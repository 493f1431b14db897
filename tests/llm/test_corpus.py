"""Corpus operators against brute force on small fixtures with nulls, empties, long texts, ties and clashing names."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quadrille.llm import bpe, decontaminate, line_dedup, minhash, quality_model, quality_rules, secrets, sstable
from quadrille.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_ string, score string, n_words string, drops string, sha string"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, "s", None if t is None else len(t), "x", None, "w", None, "h") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng, n, top=400):
    return " ".join("w" + "".join(chr(97 + int(d)) for d in str(rng.randrange(top))) for _ in range(n))


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


ODD = [None, "", " \n\t ", "a", "É é x y \u0085z", "\x00\x1c\x1d mixed \x0b\x0c", "日本語のテキスト。 123 ½", "x" * 70_000 + " end", "it's we'll  go\n\n\n now  ", "<|endoftext|> tail"]


# ---- secrets -------------------------------------------------------------------------------------


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def test_secrets(spark):
    inner = base64.b64encode(gzip.compress(b"secret='zzzzzzzzz'")).decode()
    twice = base64.b64encode(base64.b64encode(b"password%253Dqwerty99")).decode()
    texts = [*ODD, "é password = 'hunter22x' AKIA" + "B" * 16 + " " + "0a" * 15, "TOKEN:abc", "ſecret=abcdefgh api_key=zz.zz-zz", "x p%61ssword%3Dhunter2abc y", "\\u0070assword: \\u0061bcdefgh", inner, twice, "secret:" + "deadbeef" * 4, "tokentoken==abcdef"]
    found = {r["doc_id"]: r for r in secrets.find_secrets(table(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        base = brute_base(text or "")
        r = found[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(r["spans"].split(",")) | {""} and (base or i in range(len(ODD), len(texts)) or not r["spans"])
    at = {t: i for i, t in enumerate(texts)}
    assert found[at["x p%61ssword%3Dhunter2abc y"]]["spans"] == "assign:2:25"
    assert found[at[inner]]["spans"] == f"assign:0:{len(inner)}"
    assert f"assign:0:{len(twice)}" in found[at[twice]]["spans"]
    assert found[at["\\u0070assword: \\u0061bcdefgh"]]["spans"].startswith("assign:0:")


def test_secrets_bound_and_cycles(spark):
    bomb = base64.b64encode(gzip.compress(b"password=abcdefgh " * 100_000)).decode()
    row = secrets.find_secrets(table(spark, [bomb]), max_layer=10_000).first()
    assert (row["spans"], row["n_unopened"]) == ("", 1)
    assert secrets.unwrap("%25%32%35%2541", 1 << 20)[1] >= 2  # nested, and it ends


def test_secrets_to_the_fixpoint(spark):
    import bz2
    import lzma
    from urllib.parse import quote, quote_plus

    plain = "secret='zzzzzzzzz'".encode()
    b64 = lambda data: base64.b64encode(data).decode()
    noise = random.Random(15).randbytes(300)
    packed = gzip.compress(plain + noise)
    texts = [
        b64(gzip.compress(gzip.compress(plain))), b64(bz2.compress(zlib.compress(lzma.compress(plain)))),
        b64(gzip.compress(b"first ") + gzip.compress(plain)), b64(bz2.compress(b"first ") + bz2.compress(plain)), b64(gzip.compress(plain[:12]) + gzip.compress(plain[12:])),
        b64(gzip.compress(noise) + bz2.compress(gzip.compress(plain))), b64(gzip.compress(b"first ") + plain), b64(packed), b64(packed[:200]), b64(packed[:200] + bytes(200)), b64(gzip.compress(plain)[:-8] + bytes(8)),
        *(b64(c.encode() + b" " + plain) for c in "\u00a0\u3000\u200b\ufeff\x0c\x00"),
        quote(packed), quote_plus(packed), "".join(f"%{c:02x}" for c in packed), repr(packed)[2:-1], "".join(f"\\x{c:02X}" for c in packed), quote(zlib.compress(plain)), repr(bz2.compress(plain))[2:-1],
    ]
    before = "É see "
    found = dict(by_id(secrets.find_secrets(table(spark, [before + t + " end" for t in texts])), "doc_id", "spans"))
    for i, text in enumerate(texts):
        assert found[i], (i, text)
        a, b = map(int, found[i].split(",")[0].split(":")[1:])
        assert a == len(before) and len(before) + len(text) - 3 <= b <= len(before) + len(text), (i, text, found[i])


def test_secrets_in_large_streams(monkeypatch):
    """Streams are read piece by piece: what small ones give is found in the midst of large ones too."""
    import bz2
    import lzma

    rng = random.Random(17)
    b64 = lambda data: base64.b64encode(data).decode()
    filler = ("plain words and nothing else, line %d\n" * 400) % tuple(range(400))
    wide = "a,b;" * 9000
    secret = "secret='zzzzzzzzz'"
    nested = b64(gzip.compress(secret.encode() + b" " + rng.randbytes(40)))
    coded = b64(zlib.compress((filler[:900] + secret + words(rng, 200)).encode()))
    mail = "\n".join(coded[i : i + 76] for i in range(0, len(coded), 76)) + "\n"
    bodies = {"plain": secret, "nested": nested, "escaped": "p%61ssword%3Dhunter2abc", "mail": mail, "none": "nothing"}
    pack = [gzip.compress, bz2.compress, lambda d: gzip.compress(bz2.compress(d)), lambda d: lzma.compress(d), lambda d: gzip.compress(d[:7000]) + gzip.compress(d[7000:]), lambda d: zlib.compress(d) + d]
    monkeypatch.setattr(secrets, "PIECE", 1 << 12)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 8)
    for name, body in bodies.items():
        for around in (filler, wide):
            for p in pack:
                text = "see " + b64(p((around + body + "\n" + around).encode())) + " end"
                found, layers, unopened = secrets.unwrap(text, None)
                assert not unopened and {(a, b, k) for a, b, k in found} == (set() if name == "none" else {(4, len(text) - 4, "assign")}), (name, around[:5], layers)
    big = (filler + secret + "\n").encode() * 3
    for damaged in (gzip.compress(big)[:-200], gzip.compress(big)[:-8] + bytes(8), b"x^" + filler.encode()):
        assert not secrets.unwrap(b64(damaged), None)[2]
    assert b"".join(secrets.opened(iter([gzip.compress(b"") + gzip.compress(b"abc") + b"rest"]))) == b"abc\nrest"


# ---- quality model and rules ---------------------------------------------------------------------


def test_quality_model(spark):
    rng = random.Random(1)
    good = [words(rng, rng.randrange(60, 200)) for _ in range(150)]
    bad = [" ".join(w + "###" for w in words(rng, 80).split()) for _ in range(150)]
    docs = table(spark, [*good, *bad, *ODD])
    labels = spark.createDataFrame([*((i, int(i < 150), 0) for i in range(300)), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    trees = quality_model.train(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality_model.score(docs, trees).collect()}
    assert len(rows) == 300 + len(ODD) and all(0 <= s <= 1 for s in rows.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(rows[i] >= 0.3) == (i < 150) for i in held]) > 0.97
    kept = quality_model.keep_good(docs, trees)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in rows.items() if s >= 0.3}


def test_quality_model_without_labels(spark):
    docs = table(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_model.score(docs, quality_model.train(docs, none)).collect()] == [0.5, 0.5]
    assert quality_model.score(docs.limit(0), quality_model.train(docs, none)).count() == 0


def test_trees_follow_a_plain_traversal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality_model.fit(x, y, trees=20, depth=3)
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.95
    for row, raw in zip(x[:20], trees.raw(x[:20])):
        total = trees.bias
        for f, t, leaves in zip(trees.features, trees.thresholds, trees.leaves):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaves[node - len(f)]
        assert total == pytest.approx(raw)


def test_rules(spark):
    rng = random.Random(2)
    texts = [*ODD, "same words here " * 30, "a b c d a b c", "line one\nline one\n\nline one\n x", words(rng, 80), " ".join(w + "***" for w in words(rng, 80).split()), words(rng, 60).upper()]
    book = quality_rules.ledger(table(spark, texts)).collect()
    for r in book:
        text = texts[r["doc_id"]] or ""
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        tri = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        hit = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(i, i + 3)} if len(tri) < 500 else set()
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
    passed = {r["doc_id"] for r in quality_rules.ledger(table(spark, texts)).where(quality_rules.passes("v1")).collect()}
    assert passed == {len(ODD) + 3}
    done = {r["rule"]: r for r in quality_rules.ablations(quality_rules.ledger(table(spark, texts)), "base").collect()}
    failed = [r["failed"] & 3 for r in book]
    assert done["few_words"]["n_failed"] == sum(f & 1 for f in failed) and done["few_words"]["n_only"] == failed.count(1)
    assert done["repeated_words"]["n_kept_without"] == sum(f & ~2 == 0 for f in failed)


# ---- tokens --------------------------------------------------------------------------------------


def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(seed, n):
    rng = random.Random(seed)
    chars = "ab Z  '' s t re é ñ ß 1 2½² \n\t\r\x0b\x0c\x1c\u0085  　 .,!#日本́😀‍\x00ªº"
    return ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe(spark):
    texts = [*ODD, *fuzz(3, 300), *["the same line"] * 20]
    enc = encoding()
    tokens = bpe.encode(table(spark, texts), block_bytes=20_000, buckets=5)
    found = {r["doc_id"]: r for r in bpe.decode(tokens).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        assert list(found[i]["ids"]) == enc.encode_ordinary(text or ""), repr(text)
        assert bytes(found[i]["decoded"]) == (text or "").encode()
    both = bpe.encode(table(spark, texts), block_bytes=20_000, decoded=True)
    assert by_id(both, "doc_id", "ids", "decoded") == by_id(bpe.decode(tokens), "doc_id", "ids", "decoded")
    assert bpe.encode(table(spark, ["x"]).limit(0)).count() == 0
    twice = bpe.encode(table(spark, ["b c", "b c", "d"], [7, 7, None]))
    assert by_id(twice, "doc_id") == [(7,), (7,), (None,)]


def test_positions_round_trip():
    rng = np.random.default_rng(3)
    for numbers in ([], [0], [1, 2, 1, 0, 3, 3, 2, 4], [1, 1, 1], rng.zipf(1.2, 200_000) % 90_000):
        seen: dict[int, int] = {0: 0}
        numbered = np.array([seen.setdefault(int(n), len(seen)) for n in numbers], np.uint32)
        assert bpe.unpack_positions(bpe.pack_positions(numbered)).tolist() == numbered.tolist()
    assert bpe.unpacked(bpe.packed(np.zeros(0, np.uint32))).tolist() == []
    assert bpe.unpacked(bpe.packed(np.array([0, 1 << 31, 5]))).tolist() == [0, 1 << 31, 5]


def test_token_files(spark, tmp_path):
    texts, rng = [*ODD, *fuzz(4, 200)], random.Random(5)
    ids = rng.sample(range(-500, 10_000), len(texts) - 8) + [77_777] * 6 + [None, 10**15]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder = f"file://{tmp_path}/tokens"
    manifest = sstable.write_tokens(table(spark, texts, ids), folder, shards=5)
    found = sstable.read_tokens(manifest, folder).orderBy("start").collect()
    expected = {}
    for i, t in zip(ids, texts):
        expected.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in found] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in found) == sorted((i is not None, i or 0, zlib.crc32(np.array(x, "<u4").tobytes())) for i, many in expected.items() for x in many)
    tables = [sstable.Table(pyarrow_file(r["path"])) for r in manifest.collect()]
    for i in [*ids[:20], 77_777, None, 123_456]:
        assert sorted(x.tolist() for t in tables for x in t.lookup(i)) == sorted(expected.get(i, []))
    empty = sstable.write_tokens(table(spark, ["x"]).limit(0), folder + "2")
    assert sstable.read_tokens(empty, folder + "2").count() == 0


def pyarrow_file(path):
    import pyarrow.fs

    return pyarrow.fs.LocalFileSystem().open_input_file(path)


# ---- duplicates ----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 4)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    found = dict(by_id(components(spark.createDataFrame(edges, "a long, b long")), "node", "comp"))
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert found == {i: root(i) for i in linked}


def brute_groups(texts, ids, width, percent):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(s), least.get(root(i))) for i, s in enumerate(sets)]


@pytest.mark.parametrize("family_size", [256, 4])
def test_near_duplicates(spark, family_size):
    rng = random.Random(7)
    texts = list(ODD)
    for _ in range(6):
        base = words(rng, 60, 3000).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(7)):
                copy[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base)]
    texts += ["one", "One", "two words", "TWO  words", words(rng, 40, 3000)]
    ids = [10 * i + 3 for i in rng.sample(range(1000), len(texts))]
    found = minhash.near_duplicates(table(spark, texts, ids), width=2, family_size=family_size, pivots=2, block_bytes=3000)
    assert by_id(found, "doc_id", "n_shingles", "component_id") == sorted(brute_groups(texts, ids, 2, 80), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def test_near_duplicates_odd_ids(spark):
    docs = table(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "z"], [4, 4, None, None, None])
    rows = by_id(minhash.near_duplicates(docs), "doc_id", "component_id", "kept")
    assert rows == [(4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (None, None, True)]
    kept = minhash.drop_near_duplicates(table(spark, ["a b c d e f", "a b c d e f", "q"], [4, 2, 9]))
    assert kept.columns == docs.columns and by_id(kept, "doc_id") == [(2,), (9,)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def brute_lines(docs, min_docs, keep):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    where = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            where.setdefault(k, []).append(i)
    drops = {k: min(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for i, text in docs:
        lines, kept, seen = (text or "").split("\n"), [], set()
        for x in lines:
            if key(x) in drops and not (keep == "first" and drops[key(x)] == i and key(x) not in seen):
                continue
            seen.add(key(x))
            kept.append(x)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 2}, {"filter_bits": 1 << 10}])
def test_lines(spark, keep, how):
    rng = random.Random(8)
    pool = [f" Line {i} é" for i in range(12)] + ["", "  ", "ONLY", "only\r"]
    texts = [*ODD, *("\n".join([rng.choice(pool) for _ in range(rng.randrange(7))] + [f"own {i}"]) for i in range(60))]
    docs = list(enumerate(texts))
    found = line_dedup.dedup_lines(table(spark, texts), min_docs=3, keep=keep, **how)
    assert by_id(found, "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(docs, 3, keep)
    wide = line_dedup.rewrite_lines(table(spark, texts), min_docs=3, keep=keep, chars_col="n_chars", **how)
    assert wide.columns == table(spark, texts).columns
    expected = {i: (t, d) for i, _, d, t in brute_lines(docs, 3, keep) if not (d and not t.encode().strip())}
    rows = {r["doc_id"]: r for r in wide.collect()}
    assert set(rows) == set(expected)
    for i, (text, dropped) in expected.items():
        assert (rows[i]["text"] or "") == text and (rows[i]["text"] is None) == (texts[i] is None)
        assert rows[i]["n_chars"] == (None if texts[i] is None else len(text))
    assert line_dedup.dedup_lines(table(spark, texts).limit(0)).count() == 0


# ---- decontamination -----------------------------------------------------------------------------


def brute_hits(texts, items, window=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    out = []
    for i, text in enumerate(texts):
        own, hit, found = split(text), set(), set()
        for item, body in items:
            w = split(body)
            for j in range(max(1, len(w) - window + 1) if w else 0):
                part = w[j : j + window]
                for k in range(len(own) - len(part) + 1):
                    if own[k : k + len(part)] == part:
                        hit.update(range(k, k + len(part)))
                        found.add(str(item))
        out.append((i, len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [32 << 20, 200])
def test_decontamination(spark, block_bytes):
    rng = random.Random(9)
    items = [(i, words(rng, n, 50)) for i, n in enumerate([30, 12, 10, 9, 1, 25])] + [(6, None), (7, "..."), (11, "É x ünïcode"), (1, "second text of item one")]
    texts = [*ODD[:7], *(words(rng, 40, 50) + " " + " ".join(rng.choice(items)[1:] if rng.random() < 0.1 else [(rng.choice(items)[1] or "").upper().replace(" ", " - ")]) for _ in range(25)), "éx É,x;ünïcode y", "wb"]
    texts = [t for t in texts if t is None or len(t) < 5000]
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    found = decontaminate.find_benchmark(table(spark, texts), bench, block_bytes=block_bytes)
    assert by_id(found, "doc_id", "n_words", "n_hit", "items") == brute_hits(texts, items)
    for r in found.collect():
        for span in r["spans"]:
            part = texts[r["doc_id"]][span["start"] : span["end"]]
            assert part == part.strip() and re.search(r"\w", part)
    clean = decontaminate.decontaminate(table(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _, n, _ in brute_hits(texts, items) if not n}
    assert clean.columns == table(spark, texts).columns
    none = decontaminate.find_benchmark(table(spark, texts), bench.limit(0))
    assert {r["n_hit"] for r in none.collect()} == {0}


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.cache()
        assert 0 < docs.count() <= 200
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()


# ---- repeated passages ---------------------------------------------------------------------------


def brute_spans(docs, least):
    """Removed spans by a plain dictionary over all units."""
    units, first = [], {}
    low, strip = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), " \t\n\x0b\x0c\r"
    for i, text in docs:
        at = 0
        for line in (text or "").split("\n"):
            held = []
            for m in [*re.finditer(r"[^.!?]+[.!?]*", line), None]:
                if m is not None:
                    own = [w.translate(low) for w in re.split(r"[\x20\x09-\x0D]+", m.group()) if w]
                    if own:
                        held.append((at + m.start() + len(m.group()) - len(m.group().lstrip(strip)), at + m.start() + len(m.group().rstrip(strip)), own))
                if held and (m is None or sum(len(h[2]) for h in held) >= 4):
                    own = [w for h in held for w in h[2]]
                    units.append((i, held[0][0], held[-1][1], len(own), " ".join(own)))
                    held = []
            at += len(line) + 1
    for i, a, _, _, key in sorted(units, key=lambda u: (u[0], u[1])):
        first.setdefault(key, (i, a))
    out, run = [], []
    for u in [*units, (None, 0, 0, 0, "")]:
        again = u[0] is not None and first[u[4]] != (u[0], u[1])
        if run and (not again or u[0] != run[-1][0]):
            if sum(r[3] for r in run) >= least:
                out.append((run[0][0], run[0][1], run[-1][2], len(run), sum(r[3] for r in run), first[run[0][4]][0]))
            run = []
        if again:
            run.append(u)
    return sorted(out)


def test_substrings(spark):
    from quadrille.llm import substring_dedup

    rng = random.Random(11)
    say = lambda n: words(rng, n, 4000).capitalize() + rng.choice(".!?")
    passages = [" ".join(say(12) for _ in range(5)) for _ in range(3)]
    texts = [t for t in ODD if t is None or len(t) < 5000]
    for i in range(40):
        parts = [say(rng.randrange(1, 14)) for _ in range(6)] + (["É of. the. of."] if i % 3 == 0 else [])
        if i % 4 == 1:
            parts.insert(rng.randrange(7), rng.choice(passages).upper() if i % 8 == 1 else rng.choice(passages))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[-1], texts[-2]]
    docs = list(enumerate(texts))
    found = substring_dedup.repeated_spans(table(spark, texts), min_words=20)
    assert by_id(found, "doc_id", "start", "end", "n_units", "n_words", "first_doc_id") == brute_spans(docs, 20)
    assert by_id(substring_dedup.repeated_spans(table(spark, texts), min_words=20, filter_bits=1 << 10), "doc_id", "start") == by_id(found, "doc_id", "start")
    cut = dict(by_id(substring_dedup.remove_spans(table(spark, texts), found), "doc_id", "text"))
    for i, text in docs:
        rest, at = "", 0
        for _, a, b, *_ in [s for s in brute_spans(docs, 20) if s[0] == i]:
            rest, at = rest + text[at:a], b
        assert cut[i] == (None if text is None else rest + text[at:])
    assert substring_dedup.repeated_spans(table(spark, texts).limit(0)).count() == 0
    assert substring_dedup.repeated_spans(table(spark, [passages[0], passages[0], None], [None, 4, None])).first()["doc_id"] is None


def test_passages_cut_anywhere(spark):
    from quadrille.llm import substring_dedup

    rng = random.Random(14)
    say = lambda n: words(rng, n, 90_000).capitalize() + "."
    passage = " ".join(say(13) for _ in range(8)).split()[5:60]  # begins and ends in mid-sentence
    edited = passage[:21] + ["otherword"] + passage[22:]
    bare = words(rng, 55, 90_000).split()  # no sentence mark
    texts = [t for t in ODD if t is None or len(t) < 5000] + [say(200) + " " + " ".join(passage) + " " + say(30)]
    texts.append("É " + words(rng, 40, 90_000) + " " + " ".join(bare) + " " + words(rng, 9, 90_000))
    expected = []
    for body, n in ((passage, 55), (edited, 54), ([w.upper() for w in bare], 55), (passage, 55), (bare[:30], 30), (bare[:29], 0)):
        before = "É " + words(rng, rng.randrange(1, 40), 90_000) + " "
        body = " \n".join(body)
        if n:
            expected.append((len(texts), len(before), len(before) + len(body), n))
        texts.append(before + body + " " + words(rng, 25, 90_000) + ". " + say(4))
    texts += [None, ""]
    for bits in (1 << 20, 1 << 10):
        found = substring_dedup.passage_spans(table(spark, texts), filter_bits=bits)
        assert by_id(found, "doc_id", "start", "end", "n_words") == expected
    assert substring_dedup.passage_spans(table(spark, texts).limit(0)).count() == 0
    rows = substring_dedup.passage_spans(table(spark, [texts[-8], texts[-8], texts[-8]], [None, 4, 4])).collect()
    assert [(r["doc_id"], r["first_doc_id"]) for r in rows] == [(None, 4)]


# ---- licenses ------------------------------------------------------------------------------------


def test_patience():
    from quadrille.llm.licenses import aligned, rising

    assert rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    rng = random.Random(12)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(aligned(list("xaybzc"), list("abc"))) == 3


def test_licenses(spark):
    from quadrille.llm.licenses import TEMPLATES, find_licenses

    rng = random.Random(13)
    texts, expected = [*ODD, *(words(rng, 60, 3000) for _ in range(5))], {}
    for name, text in TEMPLATES.items():
        changed = text.split()
        if len(changed) > 30:
            changed[7], changed[20] = "other", "words"
        for body in (text.upper().replace(" ", "  \n"), " ".join(changed), text + " " + text):
            before = "É " + words(rng, rng.randrange(80), 3000) + "\n"
            expected[len(texts)] = (name, len(before))
            texts.append(before + body + " " + words(rng, 30, 3000))
    found = {r["doc_id"]: r["found"] for r in find_licenses(table(spark, texts)).collect()}
    for i in range(len(texts)):
        if i in expected:
            assert [x["license"] for x in found[i]] == [expected[i][0]], (expected[i], texts[i])
            assert found[i][0]["coverage"] >= 0.9 and found[i][0]["start"] == expected[i][1]
        else:
            assert found[i] == []
    assert find_licenses(table(spark, texts).limit(0)).count() == 0


def test_licenses_by_their_names(spark):
    from quadrille.llm.licenses import TEMPLATES, find_licenses

    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    rest = "This work is licensed under the GNU General Public License, version 4."
    cases = {gnu.format("Lesser ", "3"): ["LGPL-3.0"], gnu.format("Affero ", "3"): ["AGPL-3.0"], gnu.format("", "2"): ["GPL-2.0"], gnu.format("", "3"): ["GPL-3.0"], gnu.format("Library ", "3"): [], rest: []}
    cases |= {"Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"], "Licensed under CC BY 4.0.": ["CC-BY-4.0"], TEMPLATES["MIT-text"]: ["MIT-text"]}
    assert [[x["license"] for x in found] for _, found in by_id(find_licenses(table(spark, list(cases))), "doc_id", "found")] == list(cases.values())
    rng = random.Random(16)
    for name in ("MIT", "GPL-3.0", "MIT-text"):
        gaps = [words(rng, n, 3000) for n in (0, 4, 60, 2)]
        text = " ".join(f"{g} {TEMPLATES[name]}".strip() for g in gaps)
        starts = [m.start() for m in re.finditer(re.escape(TEMPLATES[name]), text)]
        found = find_licenses(table(spark, [text]), every=True).first()["found"]
        assert [(x["license"], x["start"]) for x in found] == [(name, a) for a in starts]


def test_whole_license_texts():
    """Whole texts are found with words changed, twice in a text, and where a shorter notice stands within."""
    from quadrille.llm import licenses

    ready, rng = licenses.prepared(licenses.TEMPLATES | licenses.whole_texts()), random.Random(18)
    texts = licenses.whole_texts()
    assert len(texts) >= 9
    for name, body in texts.items():
        changed = body.split()
        for _ in range(len(changed) // 40):
            changed[rng.randrange(40, len(changed))] = "other"
        before = "É " + words(rng, 50, 3000) + "\n"
        text = before + " ".join(changed) + "\n" + words(rng, 30, 3000) + "\n" + body + " end"
        found = [x for x in licenses.find_in(text.encode(), ready, 0.9, 1.5, every=True) if x["license"].endswith("-text") and x["license"] in texts]
        assert [x["license"] for x in found] == [name, name], (name, found)
        low, high = sorted((x["start"], x["end"]) for x in found)
        assert low[0] >= len(before) - 1 and low[1] <= high[0] and all(x["coverage"] >= 0.9 for x in found)
        half = " ".join(body.split()[: len(body.split()) // 2])
        assert not [x for x in licenses.find_in(half.encode(), ready, 0.9, 1.5, every=True) if x["license"] == name]
