"""MinHash near-dedup with min-max signatures, confirmed on full shingle sets.

1. Every text becomes its set of hashed word shingles. Equal sets are one node. Under each permutation
   both the minimum and the maximum are kept, so ``bands * rows`` signature values take half as many
   hash evaluations; they are banded into bucket keys.
2. Nodes that share a bucket belong to one family (connected components over bucket stars, a superset
   of the wanted groups). A task links nodes of a bucket to the first one it saw and shuffles only that
   one, so a bucket with a large share of all rows reaches a task as one row for each other task.
3. Families are confirmed on full sets. A family of bounded size goes to one task, which compares all its
   sets. In a larger family, pivots are compared with all members, and then every member outside the
   family's largest confirmed component is a query against all members. Queries of up to ``block_bytes``
   together are broadcast, and members stay where they are; beyond, queries and members are cut into blocks
   and slices of that size, and every block meets every slice of its family in a task of its own. A task
   returns only the links that join something new. By the components so found no link between different
   sets is lost.

A pair of similarity 0.8 shares no bucket with a probability of (1 - 0.8**rows)**bands, 4e-8 by default,
and less for more similar pairs.

Defined results: null and empty texts, and texts without words, have an empty set and link with nothing;
a null id belongs to its component but never names it (alone it has none); rows that repeat an id have
its fate; texts shorter than a shingle are one shingle of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille.llm.components import components
from quadrille.llm.line_dedup import filter_of, known
from quadrille.llm.text import blobs, id_text, read_table, rows, slices, stored

MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SIGNED = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("short", pa.int64()), ("keys", pa.list_(pa.int64())), ("same", pa.list_(pa.int64()))])
SETS = pa.schema([("short", pa.int64()), ("node", pa.binary()), ("shingles", pa.binary())])
LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


class Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: bytes, width: int, hashes: Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > 200_000:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * MULTIPLY
        out ^= out >> np.uint64(29)
        out *= MIX
    return np.unique(out ^ (out >> np.uint64(32)))


class Hasher:
    """Bucket keys of a set by min-max hashing."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self.bands, self.rows = bands, rows
        self.salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def keys(self, found: np.ndarray) -> list[int]:
        x = found.astype(np.uint32)
        low, high = np.full(len(self.a), 0xFFFFFFFF, np.uint32), np.zeros(len(self.a), np.uint32)
        for i in range(0, len(x), 1024):  # a piece stays in the cache
            y = x[i : i + 1024] * self.a
            y += self.b
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        values = np.concatenate([low, high])[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        key = self.salt.copy()
        for i in range(self.rows):
            key = (key ^ values[:, i]) * MULTIPLY
            key ^= key >> np.uint64(31)
        return key.view(np.int64).tolist()


def _sign(docs: DataFrame, width: int, bands: int, rows_a_band: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, hashes, nodes, first = Hasher(bands, rows_a_band), Words(), set(), {}
        for batch in slices(batches, "text"):
            out = []
            for text in blobs(batch, "text"):
                found = shingles(text, width, hashes)
                if not len(found):
                    out.append((None, 0, None, [], []))
                    continue
                node = xxhash.xxh3_128_digest(found.tobytes())
                short = int.from_bytes(node[:8], "little", signed=True)
                new, same = [], set()
                if short not in nodes:
                    nodes.add(short)
                    for key in hasher.keys(found):
                        if (had := first.setdefault(key, short)) == short:
                            new.append(key)
                        else:
                            same.add(had)
                out.append((node, len(found), short, new, list(same)))
            if len(first) > 400_000:
                first.clear()
                nodes.clear()
            yield rows(SIGNED, batch.column("doc_id"), *zip(*out))

    return docs.mapInArrow(run, "doc_id long, node binary, n long, short long, keys array<long>, same array<long>")


def _families(signed: DataFrame) -> DataFrame:
    """(short, family) of the nodes that share a bucket with another one."""
    from pyspark.sql import Window

    buckets = signed.select("short", F.explode("keys").alias("key"))
    stars = buckets.select("short", F.min("short").over(Window.partitionBy("key")).alias("hub"))
    edges = stars.where("short <> hub").select(F.col("short").alias("a"), F.col("hub").alias("b"))
    local = signed.select(F.col("short").alias("a"), F.explode("same").alias("b"))
    return components(edges.unionByName(local).distinct()).select(F.col("node").alias("short"), F.col("comp").alias("family"))


def _sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(family, node, shingles) of every member node, once."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, nodes = Words(), set()
        for batch in slices(batches, "text"):
            out = []
            for text in blobs(batch, "text"):
                found = shingles(text, width, hashes)
                if len(found):
                    node = xxhash.xxh3_128_digest(found.tobytes())
                    if node not in nodes:
                        out.append((int.from_bytes(node[:8], "little", signed=True), node, found.tobytes()))
                        nodes.add(node)
            if len(nodes) > 200_000:
                nodes.clear()
            if out and sent.value is not None:
                made = rows(SETS, *zip(*out))
                mask = known(sent.value, made.column("short"))
                if mask.any():
                    yield made.filter(pa.array(mask))

    found = docs.mapInArrow(run, "short long, node binary, shingles binary").join(members, "short")
    return found.groupBy("family", "node").agg(F.first("shingles").alias("shingles"))


class Union:
    """Disjoint sets of small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _confirm(percent: int):
    """The groups of one small family: (node, comp) of the nodes that are not alone."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes = table.column("node").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array(list(map(len, sets)))
        universe, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        groups = Union(len(nodes))
        for i in range(len(nodes) - 1):
            mark = np.zeros(len(universe), np.int64)
            mark[codes[starts[i] : starts[i] + sizes[i]]] = 1
            shared = np.add.reduceat(mark[codes[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
            for j in np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes[i + 1 :] - shared)):
                groups.join(i, i + 1 + int(j))
        roots = [groups.root(i) for i in range(len(nodes))]
        return pa.table({"node": pa.array(nodes, pa.binary()), "comp": pa.array([nodes[r] for r in roots], pa.binary())})

    return run


class Queries:
    """A block of query sets of one family, indexed by shingle."""

    def __init__(self, nodes: list[bytes], sets: list[np.ndarray]):
        self.nodes, self.sizes = nodes, np.array(list(map(len, sets)))
        flat, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owners = owners[order]
        self.shingles, self.starts, self.counts = np.unique(flat[order], return_index=True, return_counts=True)

    def linked(self, found: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the queries that a set is linked with."""
        at = np.searchsorted(self.shingles, found)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == found]
        n = self.counts[at]
        where = np.repeat(self.starts[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        shared = np.bincount(self.owners[where], minlength=len(self.nodes))
        return np.flatnonzero((shared > 0) & (100 * shared >= percent * (self.sizes + len(found) - shared)))


def _links(members: DataFrame, queries: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links between queries and members of their families, as many as join something new in a task."""
    size = queries.agg(F.sum(F.length("shingles"))).first()[0] or 0
    links = _links_by_broadcast if size <= block_bytes else _links_by_blocks
    return stored(links(members, queries, percent, block_bytes), "links")


def _links_by_broadcast(members: DataFrame, queries: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Queries of ``block_bytes`` at most: every task has them all, and its own members."""
    sent = members.sparkSession.sparkContext.broadcast([(r["family"], bytes(r["node"]), bytes(r["shingles"])) for r in queries.select("family", "node", "shingles").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[list[bytes], list[np.ndarray]]] = {}
        for family, node, found in sent.value:
            own = by.setdefault(family, ([], []))
            own[0].append(node)
            own[1].append(np.frombuffer(found, np.uint64))
        index = {family: (Queries(*own), Union(len(own[0]))) for family, own in by.items()}
        for batch in batches:
            out = []
            for family, node, found in zip(*(batch.column(c).to_pylist() for c in ("family", "node", "shingles"))):
                if family in index:
                    out += new_links(*index[family], node, found, percent)
            if out:
                yield rows(LINKS, *zip(*out))

    return members.mapInArrow(run, "a binary, b binary")


def _links_by_blocks(members: DataFrame, queries: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Any number of queries: a family's queries in blocks, its members in slices, each pair of them in a task."""
    parts = lambda df, name: df.groupBy("family").agg(F.ceil(F.sum(F.length("shingles")) / block_bytes).alias(name))
    plan = stored(parts(members, "slices").join(parts(queries, "blocks"), "family"), "plan")  # a row a family
    dealt = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = members.join(plan, "family").select("family", "node", "shingles", dealt("slices").alias("slice"), every("blocks").alias("block"))
    right = queries.join(plan, "family").select(F.col("family").alias("q_family"), F.col("node").alias("q_node"), F.col("shingles").alias("q_shingles"), dealt("blocks").alias("q_block"), every("slices").alias("q_slice"))

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asked.num_rows:
            nodes = asked.column("q_node").to_pylist()
            index, groups = Queries(nodes, [np.frombuffer(x, np.uint64) for x in asked.column("q_shingles").to_pylist()]), Union(len(nodes))
            for node, found in zip(own.column("node").to_pylist(), own.column("shingles").to_pylist()):
                out += new_links(index, groups, node, found, percent)
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return left.groupBy("family", "slice", "block").cogroup(right.groupBy("q_family", "q_slice", "q_block")).applyInArrow(run, "a binary, b binary")


def new_links(queries: Queries, groups: Union, node: bytes, found: bytes, percent: int) -> list[tuple[bytes, bytes]]:
    """The member's links with queries, without those between queries that it has joined before."""
    out, last = [], None
    for j in queries.linked(np.frombuffer(found, np.uint64), percent).tolist():
        if queries.nodes[j] != node and (last is None or groups.join(last, j)):
            out.append((node, queries.nodes[j]))
        last = j
    return out


def _large(sets: DataFrame, percent: int, pivots: int, block_bytes: int) -> DataFrame:
    """(node, comp) within families that are too large for one task."""
    members = stored(sets, "large")
    if members.isEmpty():
        return members.select("node", F.col("node").alias("comp"))
    first = _links(members, members.where(F.pmod(F.xxhash64("node"), F.col("size")) < pivots), percent, block_bytes)
    placed = members.select("family", "node").join(components(first), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    main = placed.groupBy("family", "comp").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    rest = stored(placed.join(main, "family").where("comp <> main").select("node"), "rest")
    queries = stored(members.join(rest, "node", "left_semi"), "queries")
    return components(first.unionByName(_links(members, queries, percent, block_bytes)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 56, rows_a_band: int = 6, id_col: str = "doc_id", text_col: str = "text", family_size: int = 256, family_shingles: int = 1_000_000, pivots: int = 24, block_bytes: int = 24 << 20) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id of its group), kept.

    width: words a shingle; percent: least similarity; families of up to family_size nodes and
    family_shingles shingles are confirmed by one task."""
    docs = id_text(docs, id_col, text_col)
    signed = stored(_sign(docs, width, bands, rows_a_band), "signed")
    families = stored(_families(signed), "families")
    sizes = families.groupBy("family").agg(F.count("*").alias("size"))
    sets = _sets(docs, families, width)
    sets = stored(sets, "sets")
    room = sets.groupBy("family").agg(F.sum(F.length("shingles") / 8).alias("n")).join(sizes, "family")
    fits = (F.col("size") <= family_size) & (F.col("n") <= family_shingles)
    wide = stored(room.where(~fits).select("family", "size"), "wide")
    small = sets.join(wide, "family", "left_anti").groupBy("family").applyInArrow(_confirm(percent), "node binary, comp binary")
    groups = stored(small.unionByName(_large(sets.join(wide, "family"), percent, pivots, block_bytes)), "groups")
    # The smallest id of every node, then of every group; both are pre-aggregated.
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = nodes.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = stored(placed.groupBy("comp").agg(F.min("first").alias("component_id")), "names")  # a join of its own can split a large group
    named = placed.join(names, "comp").select("node", "component_id")
    out = signed.select("doc_id", "node", "n").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows, all columns kept, whose id names its group; rows without an id stay.

    Only rows that a filter of the dropped ids suspects are shuffled for the exact test."""
    dropped = near_duplicates(docs, id_col=id_col, **how).where("not kept and doc_id is not null").select(F.col("doc_id").alias("short")).distinct()
    dropped = stored(dropped, "dropped")
    bitmap = filter_of(dropped)
    if bitmap is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def suspected(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(known(sent.value, batch.column(id_col)) == wanted))

        return docs.mapInArrow(run, docs.schema)

    doubtful = suspected(True)
    return suspected(False).unionByName(doubtful.join(dropped, doubtful[id_col] == dropped["short"], "left_anti"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=2, percent=80)


#: Exact in SQL: all pairs that share a shingle, then the smallest id reachable.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
         ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || chr(32) || words[i + 1])) END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(list_sort(shingles), chr(10))) AS node, shingles FROM s),
rep AS (SELECT node, min(doc_id) AS id, any_value(n) AS n, any_value(shingles) AS shingles FROM e WHERE n > 0 GROUP BY node),
x AS (SELECT id, n, unnest(shingles) AS shingle FROM rep),
pairs AS (SELECT p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS shared
          FROM x p JOIN x q ON p.shingle = q.shingle AND p.id < q.id AND p.n * 100 >= q.n * 80 AND q.n * 100 >= p.n * 80 GROUP BY p.id, q.id),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a AS id, min(least(a, b)) AS component_id FROM reach GROUP BY a)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_shingles, coalesce(l.component_id, r.id, e.doc_id) AS component_id,
       e.doc_id = coalesce(l.component_id, r.id, e.doc_id) AS kept
FROM e LEFT JOIN rep r ON e.node = r.node AND e.n > 0 LEFT JOIN least l ON r.id = l.id
"""
