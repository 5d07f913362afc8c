"""The trie of conversations' prefixes, with totals of subtrees by a rollup over bands of depth.

A node is a distinct sequence of first turns.  Its key is the exclusive-or of two 64-bit hashes of its turns and their places, so
prefixes of one conversation are running aggregates, and a long conversation is worked on in blocks whose aggregates combine.

Totals go up in bands of BAND depths.  Each node knows its ancestors inside its band and adds its value to these only.  The roots of
all bands but the first form a tree of their own, BAND times less high, which is rolled up in the same way; what a root has in total
then goes to its ancestors in the band above.  So a node is repeated at most 2 * BAND times whatever the height, and the number of
steps is the logarithm of the height.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Depths of a band, and of a block of one conversation: a number of whole bands.
BAND, BLOCK_BANDS = 8, 512
#: A block of ids has this many bits of them: 4,096 ids.
ID_BITS = 12


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, d, hash, chars): the turns of each conversation, numbered from 1.

    Null turns come first, and turns of one number go by the MD5 of their role, a line feed and their text; null roles and texts are
    empty.  Repeated rows are turns of their own, and rows of no conversation are passed over.  Rows are dealt by ranges,
    so that a conversation of any length may lie in many partitions; each partition numbers its own, and the numbers at which the
    conversations that partitions begin with go on are a table of at most one row a partition.
    """
    said = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    chars = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    slim = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.md5(said.cast("binary")).alias("hash"), chars.alias("chars"))
    dealt = common.cut(slim.repartitionByRange(F.col("c"), F.col("turn").asc_nulls_first(), F.col("hash")).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    later = counts.withColumn("before", before).where("before IS NOT NULL").drop("n")
    number = F.row_number().over(W.partitionBy("c", "part").orderBy(F.col("turn").asc_nulls_first(), "hash"))
    numbered = dealt.withColumn("nth", number).join(F.broadcast(later), ["c", "part"], "left")  # one row a partition at most
    return common.cut(numbered.select("c", (F.col("nth") + F.coalesce("before", F.lit(0))).cast("long").alias("d"), "hash", "chars"))


def rebuilt(own: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: rows (c, d, hash, chars, n) and conversations (c, n), of n turns.

    The first h = crc32(c) % most turns are those of conversation c - c % group, as many as it has; after its own first h the turns
    of c follow.
    """
    base = own.where((F.col("c") % group == 0) & (F.col("d") < most)).groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("d", "hash", "chars"))).alias("head"))
    ids = own.groupBy("c").agg(F.max("d").alias("own")).withColumn("base", F.col("c") - F.col("c") % group).withColumn("h", F.crc32(F.col("c").cast("string")) % most)
    ids = ids.join(base, "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h").cast("int"))))
    taken = F.coalesce(F.when(F.col("head").isNotNull(), F.size("head")), F.lit(0))
    ids = common.cut(ids.select("c", "h", "head", taken.cast("long").alias("taken"), (taken + F.greatest(F.lit(0), F.col("own") - F.col("h"))).cast("long").alias("n")))
    first = ids.select("c", F.explode("head").alias("t"), "n").select("c", "t.d", "t.hash", "t.chars", "n")
    rest = own.join(ids.select("c", "h", "taken", "n"), "c").where("d > h").select("c", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "hash", "chars", "n")
    return first.unionByName(rest), ids.select("c", "n")


def _key(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _banded(rows: DataFrame, band: int) -> DataFrame:
    """Rows (c, d, key) of whole paths with `up`, the keys of the path from the top of the band down to the row's own."""
    block = F.floor(F.col("d") / (band * BLOCK_BANDS))
    recent = F.collect_list("key").over(W.partitionBy("c", block).orderBy("d").rowsBetween(1 - band, 0))
    return rows.withColumn("recent", recent).withColumn("up", F.slice("recent", -1 - (F.col("d") % band).cast("int"), band)).drop("recent")


def prefixes(rows: DataFrame, conversations: DataFrame, band: int = BAND) -> DataFrame:
    """(c, d, key, parent, chars, last): the path of each conversation through the trie, from the root at d = 0 on."""
    path = rows.select("c", "d", "hash", "chars", "n").unionByName(conversations.select("c", F.lit(0).cast("long").alias("d"), F.lit("").alias("hash"), F.lit(0).cast("long").alias("chars"), "n"))
    size = band * BLOCK_BANDS
    root = F.col("d") == 0
    a, b = (F.when(root, F.lit(0)).otherwise(F.xxhash64(F.lit(salt), "hash", "d")) for salt in (1, 2))
    path = common.cut(path.withColumns({"a": a, "b": b, "block": F.floor(F.col("d") / size)}))
    w = W.partitionBy("c", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    run = path.withColumns({"x": F.bit_xor("a").over(w), "y": F.bit_xor("b").over(w)})
    # Only conversations of more than one block need what earlier blocks come to.
    blocks = path.where(F.col("n") >= size).groupBy("c", "block").agg(F.bit_xor("a").alias("p"), F.bit_xor("b").alias("q"))
    earlier = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offset = blocks.select("c", "block", F.bit_xor("p").over(earlier).alias("p"), F.bit_xor("q").over(earlier).alias("q")).where("block > 0")
    short = run.where("block = 0")
    long = run.where("block > 0").join(offset, ["c", "block"]).withColumns({"x": F.expr("x ^ p"), "y": F.expr("y ^ q")})
    both = short.unionByName(long.select(short.columns))
    return both.select("c", "d", _key(F.col("x"), F.col("y")).alias("key"), F.when(~root, _key(F.expr("x ^ a"), F.expr("y ^ b"))).alias("parent"), "chars", (F.col("d") == F.col("n")).alias("last"))


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """(key, values): the sums of `values` over each node's subtree, itself included.

    `nodes` has (key, parent, depth, values), and `paths` (c, d, key) the path of at least one conversation through each node.
    """
    sums = [F.sum(v).alias(v) for v in values]
    each = common.cut(_banded(paths.select("c", "d", "key"), band).groupBy("key").agg(F.min_by("up", "c").alias("up")).join(nodes, "key"))
    inside = each.select(F.explode("up").alias("at"), *values).groupBy("at").agg(*sums).withColumnRenamed("at", "key")
    if each.where(F.col("depth") >= band).isEmpty():
        return inside
    inside = common.cut(inside)
    tops = common.cut(each.where((F.col("depth") % band == 0)).select("key", "parent", "depth"))
    # The band above a root is what its parent has for ancestors; the first of these is the root of that band.
    above = each.join(tops.where("depth > 0").select(F.col("parent").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("parent"), F.col("up").alias("above"))
    upper = tops.join(above, "parent", "left").select("key", F.try_element_at("above", F.lit(1)).alias("parent"), (F.col("depth") / band).cast("long").alias("depth"))
    total = common.cut(rollup(upper.join(inside, "key"), paths.where(F.col("d") % band == 0).select("c", (F.col("d") / band).cast("long").alias("d"), "key"), values, band))
    below = total.join(tops.where("depth > 0").select("key", "parent"), "key").groupBy("parent").agg(*sums)
    passed = below.join(above, "parent").select(F.explode("above").alias("key"), *values)
    return inside.unionByName(passed).groupBy("key").agg(*sums)


def _listed(ends: DataFrame) -> DataFrame:
    """(key, ids_sha256) of rows (key, c): the hash of all c of a key in order, joined by commas.

    Ids are joined in blocks of 2^ID_BITS consecutive numbers; blocks of a key stream through its hash in order, none being kept.
    """
    block = F.shiftright("c", ID_BITS)
    parts = common.cut(ends.groupBy("key", block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("ids")))
    counted = parts.groupBy("key").agg(F.count("*").alias("blocks"), F.first("ids").alias("ids"))
    single = counted.where("blocks = 1").select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"))
    several = parts.join(counted.where("blocks > 1").select("key"), "key").select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), "block", "ids")

    def hashed(batches):
        at, state = None, None
        for batch in batches:
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (a, b) != at:
                    if at:
                        yield _row(at, state)
                    at, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if at:
            yield _row(at, state)

    def _row(at, state):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], names=["a", "b", "ids_sha256"])

    streamed = several.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(hashed, "a long, b long, ids_sha256 string")
    return single.unionByName(streamed.select(_key(F.col("a"), F.col("b")).alias("key"), "ids_sha256"))


def trie(rows: DataFrame, conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie of conversations (c, n), whose turns are `rows` (c, d, hash, chars, n).

    One row a node: conv_id, its smallest member; depth; parent_conv_id, the parent's conv_id (null for the root); n_convs, its
    members; n_children; n_leaves, the childless nodes of its subtree; saved_tokens, the characters that its subtree's nodes need not
    repeat, (n_convs - 1) times those of a node's last turn each; ends_sha256, of the ids of conversations that end here.

    Conversations without turns end at the root; repeated conversations share all nodes; without conversations there are no nodes.
    """
    if band < 2:
        raise ValueError("a band has two depths at least")
    paths = common.cut(prefixes(rows, conversations, band))
    found = common.cut(paths.groupBy("key").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("d").alias("depth"), F.max("chars").alias("chars"), F.min("parent").alias("parent")))
    children = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = common.cut(found.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    valued = nodes.select("key", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    # The smallest member's path is enough for a node's ancestors.
    own = paths.select("c", "d", "key")
    totals = rollup(valued, own, ["n_leaves", "saved_tokens"], band)
    ends = _listed(paths.where("last").select("key", "c"))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(totals, "key").join(ends, "key", "left").join(parents, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ids_sha256", none).alias("ends_sha256"))
    )


SQL = r"""
WITH steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 6 AS h
  FROM (SELECT DISTINCT c FROM own), steps),
sized AS (SELECT c, base, h, (SELECT count(*) FROM own WHERE own.c = ids.base AND own.d <= ids.h) AS taken FROM ids),
rows AS (
  SELECT s.c, o.d, o.role, o.text FROM sized s JOIN own o ON o.c = s.base AND o.d <= s.h
  UNION ALL SELECT s.c, o.d - s.h + s.taken, o.role, o.text FROM sized s JOIN own o ON o.c = s.c AND o.d > s.h
  UNION ALL SELECT c, 0, '', '' FROM sized),
paths AS (
  SELECT c, d, length(text) AS chars,
         md5(string_agg(CASE WHEN d = 0 THEN '' ELSE md5(role) || md5(text) END, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key,
         d = max(d) OVER (PARTITION BY c) AS last
  FROM rows),
linked AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent FROM paths),
nodes AS (
  SELECT key, any_value(parent) AS parent, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM linked GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
totals AS (
  SELECT p.key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens
  FROM counted n JOIN paths p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN totals USING (key) LEFT JOIN counted p ON p.key = n.parent
"""
