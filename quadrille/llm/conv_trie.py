"""Prefix trie of conversations, built level by level.

Depth by depth, the live conversations are grouped by (parent node, next turn); the least conv_id of a group names
its node. Then the levels are joined in reverse, each into the one above, and roll up leaves and savings. Turns
travel as SHA-256 digests of role and text with the text's length; texts themselves are read once and not shuffled.

A group whose members are all the same conversation (a single one, or exact copies) is retired at once: what
follows is a chain, whose nodes are the turns of its least member. So the number of rounds is the depth at which
different conversations still share a node, whatever the length of the longest one.

Turns are taken by turn (null first), those of one number by role and then by the text's digest. A null role or text
is empty; rows without conv_id belong to no conversation; repeated rows each are a turn; an empty table has no trie
and gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quadrille.llm.text import rows
from quadrille.storage import read_table, scratch, stored

#: Hex digits of a digest that one sum takes: 60 bits, so that sums stay exact in a decimal.
PART_HEX = 15
#: Keys over which the members of one group are dealt.
SALTS = 256
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def turn_key(role: Column, text: Column) -> Column:
    """The same for equal turns only: the digest of the two parts' digests."""
    return F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256))


def keyed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, key, chars) of every row with a conv_id."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    return turns.select(turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.length(text).cast("long").alias("chars")).where(F.col("conv_id").isNotNull())


def numbered(keyed: DataFrame) -> DataFrame:
    """(conv_id, pos, key, chars), pos from 1. The rows are sorted over all tasks and numbered within their task; a
    conversation that lies in several tasks is put together from its counts, so none is one task's work."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key"]
    ranked = stored(keyed.orderBy(*order).select("conv_id", "key", "chars", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("n")), "ranked")
    parts = ranked.groupBy("conv_id", "task").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "task", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return ranked.join(parts, ["conv_id", "task"]).select("conv_id", (F.col("n") + F.col("shift")).alias("pos"), "key", "chars")


def with_borrowed_heads(own: DataFrame, spread: int = 6, family: int = 100) -> DataFrame:
    """Every conversation c anew: the first h turns of conversation c - c % family (all if it has fewer), then c's own
    turns behind its first h, where h is crc32 of the decimal c, modulo ``spread``. A conversation that has neither
    is a row with a null pos."""
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread, F.col("conv_id") - F.col("conv_id") % family
    convs = own.select("conv_id").distinct().select("conv_id", base.alias("base"), h.alias("h"))
    heads = own.where((F.col("conv_id") % family == 0) & (F.col("pos") < spread)).select(F.col("conv_id").alias("base"), "pos", "key", "chars")
    shared = convs.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "key", "chars")
    sizes = convs.join(heads.groupBy("base").agg(F.max("pos").alias("has")), "base", "left").select("conv_id", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("has"))
    rest = own.join(sizes, "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("has")).alias("pos"), "key", "chars")
    none = F.lit(None)
    empty = convs.select("conv_id", none.cast("long").alias("pos"), none.cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))
    return shared.unionByName(rest).unionByName(empty)


def _prints(turns: DataFrame) -> DataFrame:
    """Per conversation: length and a digest of all (pos, key), a sum, so that it is aggregated before the shuffle."""
    mixed = F.when(F.col("pos").isNotNull(), F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), "key"), 256))
    part = lambda i: F.conv(F.substring(mixed, 1 + i * PART_HEX, PART_HEX), 16, 10).cast("decimal(19,0)")
    return turns.groupBy("conv_id").agg(F.count("pos").alias("length"), *(F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(29,0)").alias(f"p{i}") for i in range(4)))


def _grouped(step: DataFrame, depth: int) -> DataFrame:
    """A level: every member of step's groups by (parent, key) with its node, the node's members, and whether they
    are all the same conversation. A group is aggregated before its members meet it over SALTS keys, so a turn that
    very many conversations share is not one task's work."""
    same = reduce(lambda x, y: x & y, (F.min(c) == F.max(c) for c in ("length", "p0", "p1", "p2", "p3")))
    salted = step.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), same.alias("retired"), F.collect_set("salt").alias("salts"))
    dealt = groups.select("parent", "key", "node", "n", "retired", F.explode("salts").alias("salt"))
    return salted.join(dealt, ["parent", "key", "salt"]).drop("key", "salt").withColumn("depth", F.lit(depth).cast("long"))


def _levels(turns: DataFrame) -> DataFrame:
    """(conv_id, parent, node, n, retired, chars, length, p0 to p3, depth) of every conversation that is live at a
    depth; one folder a depth. The root's level has the parent 0, which is no node."""
    folder, depth = scratch(turns.sparkSession, "levels"), 0
    read = lambda path: turns.sparkSession.read.parquet(path)
    step = _prints(turns).select("*", F.lit(0).cast("long").alias("parent"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("chars"))
    while True:
        _grouped(step, depth).write.parquet(f"{folder}/{depth}")
        live = read(f"{folder}/{depth}").where(~F.col("retired"))
        depth += 1
        if live.isEmpty():
            return read(f"{folder}/*"), depth
        following = turns.where(F.col("pos") == depth).select("conv_id", "key", "chars")
        step = live.select("conv_id", "length", "p0", "p1", "p2", "p3", F.col("node").alias("parent")).join(following, "conv_id")


def _rolled(levels: DataFrame, count: int) -> DataFrame:
    """Reverse joins: every node of the levels with its children, leaves and savings. A retired node has one leaf,
    and ``after`` characters follow it in each member."""
    folder, below = scratch(levels.sparkSession, "rolled"), None
    for depth in reversed(range(count)):
        own = levels.where(F.col("depth") == depth)
        if below is None:
            none = F.lit(0).cast("long")
            joined = own.select("*", none.alias("children"), none.alias("leaves"), none.alias("saved"))
        else:
            up = below.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            joined = own.join(up, "node", "left")
        cut, mine = F.col("retired"), (F.col("n") - 1) * (F.col("chars") + F.col("after"))
        whole = joined.select(
            F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(cut, (F.col("length") > F.col("depth")).cast("long")).otherwise(F.col("children")).alias("n_children"),
            F.when(cut, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"), F.when(cut, mine).otherwise(mine + F.col("saved")).alias("saved_tokens"),
        )
        whole.write.parquet(f"{folder}/{depth}")
        below = levels.sparkSession.read.parquet(f"{folder}/{depth}")
    return levels.sparkSession.read.parquet(f"{folder}/*")


DIGESTS = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, conv_id of the node, ends_sha256): the members' ids come sorted and are digested as they stream by, so
    a node of any size takes no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for depth, node, member in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "member"))):
                if (depth, node) != at:
                    if at:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (depth, node), hashlib.sha256(b"%d" % member)
                else:
                    digest.update(b",%d" % member)
            if done:
                yield rows(DIGESTS, *zip(*done))
        if at:
            yield rows(DIGESTS, [at[0]], [at[1]], [digest.hexdigest()])

    dealt = ends.repartition("depth", "node").sortWithinPartitions("depth", "node", "member")
    return dealt.mapInArrow(run, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """From (conv_id, pos, key, chars), positions from 1 without gaps and a null pos for a conversation without turns:
    per node conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored(turns.repartition("conv_id", "pos").sortWithinPartitions("pos", "conv_id"), "turns")  # a long conversation is several tasks' too
    levels, count = _levels(turns)
    tops = levels.where(F.col("conv_id") == F.col("node")).drop("conv_id", "p0", "p1", "p2", "p3")
    told = turns.where(F.col("pos").isNotNull())
    chains = tops.where("retired").select(F.col("node").alias("conv_id"), F.col("depth").alias("top"), "n", "length")
    # Savings along a chain: running sums, needed for copies only.
    later = Window.partitionBy("conv_id").orderBy(F.desc("pos"))
    copied = told.join(chains.where("n > 1"), "conv_id").where("pos > top").select("conv_id", "pos", "n", "length", F.sum("chars").over(later).alias("after"), F.col("top"))
    single = told.join(chains.where("n = 1"), "conv_id").where("pos > top").select("conv_id", "pos", "n", "length", F.lit(0).cast("long").alias("after"), "top")
    chain = stored(copied.unionByName(single), "chain")
    follows = chain.where((F.col("pos") == F.col("top") + 1) & (F.col("n") > 1)).select(F.col("conv_id").alias("node"), F.col("top").alias("depth"), "after")
    rolled = _rolled(tops.join(follows, ["node", "depth"], "left").withColumn("after", F.coalesce("after", F.lit(0))), count)
    one, last = F.lit(1).cast("long"), F.col("pos") == F.col("length")
    links = chain.select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), ((F.col("n") - 1) * F.col("after")).alias("saved_tokens"))
    ends = levels.where(F.col("retired") | (F.col("length") == F.col("depth"))).select(F.col("length").alias("depth"), "node", F.col("conv_id").alias("member"))
    nodes = rolled.unionByName(links).join(_digests(ends), ["depth", "conv_id"], "left")
    return nodes.select(*NODES, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12_conv_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_borrowed_heads(numbered(keyed_turns(read_table(spark, sf_dir, "conversations")))))


#: DuckDB has no crc32: a table of 256 values and a fold over the bytes of the decimal.
SQL = """
WITH bits AS (SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, '')))) AS pos,
               coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
                 xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT),
                     lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT) % 6 AS h
          FROM (SELECT DISTINCT conv_id FROM own), crc),
sizes AS (SELECT c.conv_id, c.base, CAST(c.h AS BIGINT) AS h, (SELECT count(*) FROM own o WHERE o.conv_id = c.base AND o.pos <= c.h) AS has FROM convs c),
turns AS (
  SELECT s.conv_id, o.pos, o.role, o.text FROM sizes s JOIN own o ON o.conv_id = s.base AND o.pos <= s.h
  UNION ALL SELECT s.conv_id, o.pos - s.h + s.has, o.role, o.text FROM sizes s JOIN own o ON o.conv_id = s.conv_id AND o.pos > s.h),
paths AS (
  SELECT conv_id, 0 AS depth, []::STRUCT(r VARCHAR, t VARCHAR)[] AS path, 0 AS chars FROM convs
  UNION ALL SELECT conv_id, pos, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos), length(text) FROM turns),
lens AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
node AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY depth, path),
lies AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM paths p JOIN node n ON p.depth = n.depth AND p.path = n.path),
linked AS (SELECT n.depth, n.conv_id, n.n_convs, n.chars, a.conv_id AS parent_conv_id FROM node n LEFT JOIN lies a ON a.member = n.conv_id AND a.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT a.depth, a.conv_id, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((l.n_convs - 1) * l.chars) AS saved
  FROM linked l JOIN lies a ON a.member = l.conv_id AND a.depth <= l.depth LEFT JOIN kids k ON k.conv_id = l.conv_id AND k.depth = l.depth GROUP BY 1, 2),
ends AS (SELECT a.depth, a.conv_id, string_agg(CAST(a.member AS VARCHAR), ',' ORDER BY a.member) AS ids FROM lies a JOIN lens s ON s.conv_id = a.member AND s.length = a.depth GROUP BY 1, 2)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, CAST(l.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM linked l JOIN below b ON b.depth = l.depth AND b.conv_id = l.conv_id LEFT JOIN kids k ON k.depth = l.depth AND k.conv_id = l.conv_id LEFT JOIN ends e ON e.depth = l.depth AND e.conv_id = l.conv_id
"""
