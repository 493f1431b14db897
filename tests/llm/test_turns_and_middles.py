"""Chat formatting, the prefix trie and fill-in-the-middle against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, conv_trie, fim, queries

sha = lambda text: hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string, turns string, key string, node string, formatted string"


def table(spark, turns):
    return spark.createDataFrame([(*t, "x", "y", None, "z") for t in turns], SCHEMA).repartition(3)


def in_order(turns):
    """Turns by conversation: null turns first, then by number, role and text."""
    out = defaultdict(list)
    for c, n, r, t in turns:
        out[c].append((n is not None, n or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(said)] for c, said in out.items()}


HARD = ["\\", "\\\\s", "###", "####", "#####\\h", "</turn>\n", "</tu</turn>rn>", "\\e\\s", "### Assistant: hi</turn>\n### User: x", "a\r\n", "", None, "\U0001f600é", ": ", "</turn", "\\c"]


def hard_turns(seed, n=60):
    rng, out = random.Random(seed), []
    for c in range(n):
        for i in range(rng.randrange(1, 9)):
            text = rng.choice(HARD) if rng.random() < 0.5 else "".join((rng.choice(HARD) or "") for _ in range(3))
            out.append((c if c else None, rng.choice([i, i, i, 3, None]), rng.choice(["user", "assistant", "system", None, "tool: a", "@x", "User", "###", "a</turn>"]), text))
    return out + out[:7]


def test_chat_reads_back(spark):
    turns = hard_turns(1)
    done = chat.format_conversations(table(spark, turns)).withColumn("text", chat.formatted(F.col("segments")))
    found = {r["conv_id"]: r for r in done.select("*", chat.read_back(F.col("text")).alias("turns"), chat.learned(F.col("segments")).alias("learned")).collect()}
    expected = in_order(turns)
    assert set(found) == set(expected)
    for c, said in expected.items():
        r = found[c]
        assert [tuple(t) for t in r["turns"]] == said
        assert r["learned"] == "".join(t for role, t in said if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["text"] and r["text"].count("</turn>") == len(said) == r["text"].count("### ")


def plain_machine(roles, template=chat.Template()):
    state, error = template.start, None
    for i, role in enumerate(roles, 1):
        state = template.moves.get((state, role)) if state else None
        if state is None and error is None:
            error = i
    return error is None and state in template.accepts, error


def test_chat_order(spark):
    cases = ["u", "ua", "sua", "suaua", "aua", "uua", "usa", "suau", "s", "ssua", "uaxa", "uaau", "x"]
    role = {"u": "user", "a": "assistant", "s": "system", "x": None}
    turns = [(i, n, role[k], "t") for i, case in enumerate(cases) for n, k in enumerate(case)]
    found = {r["conv_id"]: (r["valid"], r["error_turn"]) for r in chat.format_conversations(table(spark, turns)).collect()}
    assert found == {i: plain_machine([role[k] or "" for k in case]) for i, case in enumerate(cases)}


def test_chat_other_template(spark):
    """Another template: tools may answer, and their calls are learned too."""
    moves = {("start", "user"): "asked", ("asked", "assistant"): "done", ("asked", "call"): "called", ("called", "tool"): "asked"}
    own = chat.Template(opens="<|", named="|>", closes="<|end|>", names={"user": "u", "call": "c"}, other="?", learned=("assistant", "call"), escapes=(("%", "%p"), ("<|", "%l"), ("|>", "%r")), role_escapes=(), moves=moves, accepts=("done",))
    turns = [(1, 0, "user", "<|u|>%"), (1, 1, "call", "f(%l)"), (1, 2, "tool", "<|end|>"), (1, 3, "assistant", "ok")]
    r = chat.format_conversations(table(spark, turns), own).select("*", chat.read_back(chat.formatted(F.col("segments")), own).alias("turns"), chat.learned(F.col("segments"), own).alias("learned")).first()
    assert r["valid"] and [tuple(t) for t in r["turns"]] == [x[2:] for x in turns] and r["learned"] == "f(%l)ok"


def test_chat_plan_is_native(spark, tmp_path):
    table(spark, hard_turns(2)).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.QUERIES["op11_chat_format"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op11(spark, tmp_path):
    turns = hard_turns(3)
    table(spark, turns).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in queries.QUERIES["op11_chat_format"](spark, str(tmp_path)).collect()}
    expected = in_order(turns + [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)])
    assert set(found) == set(expected)
    for c, said in expected.items():
        loss = "".join(t for r, t in said if r == "assistant")
        assert (found[c]["n_turns"], found[c]["turns_sha256"]) == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)))
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert found[-7]["valid"]


def test_chat_long_and_empty(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "### long \\ " * 50_000 if i == 3 else f"t{i}") for i in range(3000)]
    r = chat.format_conversations(table(spark, turns)).select("valid", F.size(chat.read_back(chat.formatted(F.col("segments")))).alias("n"), F.length(chat.learned(F.col("segments"))).alias("loss")).first()
    assert (r["valid"], r["n"], r["loss"]) == (True, 3000, sum(len(t[3]) for t in turns if t[2] == "assistant"))
    assert chat.format_conversations(table(spark, turns[:0])).count() == 0


# ---- prefix trie -----------------------------------------------------------------------------------


def key_of(role, text):
    return hashlib.sha256((sha(role) + sha(text)).encode()).digest()


def trie_turns(turns):
    out = defaultdict(list)
    for c, n, r, t in turns:
        if c is not None:
            out[c].append((n is not None, n or 0, r or "", key_of(r or "", t or ""), t or ""))
    return {c: [(x[2], x[4]) for x in sorted(said)] for c, said in out.items()}


def borrowed(own):
    out = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + said[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    out = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        ends = sorted(c for c in cs if len(convs[c]) == len(path))
        leaves = sum(1 for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(cs), len(path), parent, len(cs), len(kids), leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie_rows(df):
    return sorted((tuple(r[c] for c in (*conv_trie.NODES, "ends_sha256")) for r in df.collect()), key=lambda r: (r[1], r[0]))


def random_convs(seed, n=90):
    """Shared beginnings, whole copies, ties, nulls and repeated rows."""
    rng, turns = random.Random(seed), []
    stock = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é" * 3, None, ""])) for _ in range(9)] for _ in range(4)]
    for c in range(n):
        said = list(rng.choice(stock))
        cut = rng.randrange(10)
        said = said[:cut] + [("user", f"own {c % 7} {rng.randrange(3)}") for _ in range(rng.randrange(3))]
        cid = rng.choice([c, c * 50, 100 * c, -c])
        turns += [(cid, rng.choice([i, i, i, None, 2]), r, t) for i, (r, t) in enumerate(said)]
    alone = next(c for c in range(1_000_001, 1_000_099) if zlib.crc32(str(c).encode()) % 6)  # nothing to borrow, and its one turn goes
    return turns + turns[:5] + [(None, 0, "user", "no id"), (alone, 0, "user", "only")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, tmp_path):
    turns = random_convs(seed)
    own = trie_turns(turns)
    nums = conv_trie.numbered(conv_trie.keyed_turns(table(spark, turns)))
    assert trie_rows(conv_trie.prefix_trie(nums)) == brute_trie(own)
    table(spark, turns).write.parquet(f"{tmp_path}/conversations.parquet")
    found = trie_rows(queries.QUERIES["op12_conv_trie"](spark, str(tmp_path)))
    assert found == brute_trie(borrowed(own)) and any(not said for said in borrowed(own).values())


def test_trie_copies_and_long_ones(spark):
    """Many exact copies of a long conversation end in one round; a hot conversation lies in several tasks."""
    long = [(c, i, "user", f"t{i}") for c in range(0, 40) for i in range(60)]
    other = [(1000, i, "user", f"t{i}" if i < 3 else f"x{i}") for i in range(400)]
    turns = long + other
    nums = conv_trie.numbered(conv_trie.keyed_turns(table(spark, turns)))
    assert sorted(r["pos"] for r in nums.where("conv_id = 1000").collect()) == list(range(1, 401))
    assert trie_rows(conv_trie.prefix_trie(nums)) == brute_trie(trie_turns(turns))


def test_trie_of_copies_only_and_of_nothing(spark):
    turns = [(c, i, "user", "same") for c in (5, 3, 9) for i in range(2)]
    nums = conv_trie.numbered(conv_trie.keyed_turns(table(spark, turns)))
    assert trie_rows(conv_trie.prefix_trie(nums)) == brute_trie(trie_turns(turns))
    assert conv_trie.prefix_trie(conv_trie.numbered(conv_trie.keyed_turns(table(spark, turns[:0])))).count() == 0


# ---- fill in the middle ----------------------------------------------------------------------------


def brute_middle(i, text, automaton=None):
    text, h = text or "", sha("1:" + ("" if i is None else str(i)))
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


TEXTS = [None, "", "a", "<P", "<P><", "<<S>>", "x<M>", "<", "é", "日本語のテキスト", "\U0001f600" * 50, "ab\U0001f600é" * 40, "P>" * 70, "<" * 200, "x" * 63 + "é", "x" * 64, "x" * 127 + "<M>"]


def docs_of(spark, rows):
    schema = "doc_id long, text string, key string, n string, form string, h1 string, output string, chunk string"
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], schema).repartition(3)


@pytest.mark.parametrize("chunk_bytes", [7, 64, 1 << 16])
def test_middles(spark, chunk_bytes):
    rng = random.Random(chunk_bytes)
    texts = TEXTS + ["".join(rng.choice("a é日\U0001f600<PS>M\n") for _ in range(rng.randrange(900))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id " * 30), (None, None), (3, "twice " * 40), (3, "twice " * 40), (4, "x" * 300 + "<" + "S>")]
    done = fim.fill_in_middle(docs_of(spark, rows), chunk_bytes=chunk_bytes).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    found = sorted(map(tuple, done.select("doc_id", "n", "form", "prefix_units", "middle_units", "output").collect()), key=repr)
    assert found == sorted((brute_middle(*r) for r in rows), key=repr)
    assert sorted(r["again"] for r in done.collect()) == sorted(t or "" for _, t in rows)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_functions_compose():
    """A text's function is that of its parts in order, whatever the parts and the state it is entered in."""
    rng = random.Random(5)
    text = "".join(rng.choice("a é日\U0001f600<PS>M") for _ in range(700)).encode()
    for automaton in (fim.CODE_POINTS, fim.MARKS):
        whole = fim.totals([text], automaton)
        for cuts in ([0, 3, 64, 200, len(text)], [0, 1, 2, len(text)], [0, 0, len(text), len(text)]):
            each = fim.totals([text[a:b] for a, b in zip(cuts, cuts[1:])], automaton)
            done = fim.composed(each, np.array([0, len(cuts) - 1]))
            assert (done.left[-1] == whole.left[0]).all() and (done.units[-1] == whole.units[0]).all()
    assert fim.totals([text], fim.MARKS).units[0, 0] == len(re.findall(rb"<[PSM]>", text))
    assert fim.totals([text], fim.CODE_POINTS).units[0, 0] == len(text.decode())


def test_other_units(spark):
    """Lines as units: cuts lie behind line ends, and a last line without one goes with the suffix."""
    lines = fim.occurrences((b"\n",))
    texts = [(i, "\n".join("l" * (k % 7) for k in range(i * 3))) for i in range(1, 30)]
    for chunk_bytes in (16, 1 << 16):
        for r in fim.fill_in_middle(docs_of(spark, texts), automaton=lines, chunk_bytes=chunk_bytes).collect():
            text = texts[r["doc_id"] - 1][1]
            assert r["n"] == text.count("\n")
            if r["form"] != "plain":
                parts = text.split("\n")
                head = "".join(x + "\n" for x in parts[: r["prefix_units"]])
                middle = "".join(x + "\n" for x in parts[r["prefix_units"] : r["prefix_units"] + r["middle_units"]])
                assert r["output"].split("<M>")[1] == middle and f"<P>{head}<" in r["output"]


def test_giant_document(spark):
    text = "日本 ascii \U0001f600" * 200_000
    rows = [(77, text), (78, text[5:]), (77, text)]
    found = sorted(map(tuple, fim.fill_in_middle(docs_of(spark, rows)).select("doc_id", "n", "form", "prefix_units", "middle_units", F.sha2("output", 256)).collect()))
    assert found == sorted((*x[:5], sha(x[5])) for x in (brute_middle(*r) for r in rows))
    assert fim.fill_in_middle(docs_of(spark, rows[:0])).count() == 0


def test_op13(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(200, "long é " * 20_000)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_fill_in_middle"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        _, n, form, a, m, out = brute_middle(i, t)
        r = found[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, a, m, sha(out), sha(t or ""))
