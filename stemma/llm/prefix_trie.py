"""Prefix trie of conversations: blocks of turns first, turn boundaries only where blocks part ways.

Each conversation is cut into blocks of BLOCK turns. A block's digest covers all turns up to its end (two 64-bit lanes,
each the exclusive or of hashes of turns with their depths), so equal digests are equal prefixes. Conversations are
first grouped by block digests, one row for BLOCK turns, combined before the shuffle. A prefix that goes on in one block
alone has the same members at every turn of it: its nodes are read off one of them. Only where a prefix goes on in
several blocks are these cut into turns and grouped again, and then one row stands for all conversations of a block.

Each node belongs to its smallest member, so a conversation owns one chain of nodes, down to its end, that hangs below
a node of another chain. Sums over subtrees go along chains by windows, and between chains by doubling: after j steps a
chain knows its sum over 2**j - 1 chains below it and the chain 2**j above. Grouped sums are combined before their
shuffle; no subtree is gathered. Conversations that end at a node are joined to texts of up to 4,096 neighbouring ids,
and these are digested in order as they stream by.

Turns come by turn number (null first), then role, then the MD5 of the text. A null role or text is empty. Rows
without conv_id belong to no conversation; repeated rows are turns of their own. A very long text is only hashed and
counted; a very long conversation's turns are numbered in one task, as rows of some dozen bytes. An empty table has no
node. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import WORD, saved

#: Turns in a block.
BLOCK = 4
#: Conversations of so many neighbouring ids share a row of ends.
ENDS_BITS = 12
KEY = ("depth", "x1", "x2")


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, i, role, digest, words): turns in order, numbered from 0."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    told = rows.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), F.md5(text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return told.select("conv_id", (F.row_number().over(order) - 1).cast("bigint").alias("i"), "role", "digest", "words")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations(conv_id), turns(conv_id, i, role, digest, words)): conversations that begin as the first of their group does.

    Conversation c takes the first h turns of c - c % group, all if there are fewer, then its own after its first h;
    h is the CRC-32 of c in decimal, modulo heads.
    """
    own = saved(turns, "turns")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads).withColumn("source", F.col("conv_id") - F.col("conv_id") % group)
    first = own.where((F.col("conv_id") % group == 0) & (F.col("i") < heads - 1)).withColumnRenamed("conv_id", "source")
    had = first.groupBy("source").agg(F.count("*").alias("had"))
    convs = saved(convs.join(had, "source", "left").select("conv_id", "source", "h", F.least("h", F.coalesce("had", F.lit(0))).alias("taken")), "conversations")
    head = convs.join(first, "source").where("i < h").select("conv_id", "i", "role", "digest", "words")
    rest = own.join(convs, "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "role", "digest", "words")
    return convs.select("conv_id"), head.unionByName(rest)


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, k, turns, q1, q2, x1, x2, depth, last): blocks with the digests before and after them."""
    d = F.col("i") + 1
    lanes = turns.select("conv_id", d.alias("d"), F.xxhash64(d, "role", "digest").alias("a"), F.xxhash64("digest", "role", d).alias("b"), "words")
    cut = lanes.groupBy("conv_id", F.floor((F.col("d") - 1) / size).alias("k")).agg(F.sort_array(F.collect_list(F.struct("d", "a", "b", "words"))).alias("turns"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max("d").alias("depth"))
    order = Window.partitionBy("conv_id").orderBy("k")
    before = lambda c: F.coalesce(F.bit_xor(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = cut.select("conv_id", "k", "turns", "depth", "a", "b", before("a").alias("q1"), before("b").alias("q2"), F.lead("k").over(order).isNull().alias("last"))
    return out.select("conv_id", "k", "turns", "depth", "q1", "q2", F.col("q1").bitwiseXOR(F.col("a")).alias("x1"), F.col("q2").bitwiseXOR(F.col("b")).alias("x2"), "last")


def block_nodes(cut: DataFrame) -> DataFrame:
    """(k, turns, q1, q2, n_convs, conv_id, parted): distinct blocks; parted where their prefix goes on in others too."""
    own = cut.groupBy("k", *KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min_by(F.struct("turns", "q1", "q2"), "conv_id").alias("s"))
    own = saved(own.select("k", "s.turns", "s.q1", "s.q2", "n_convs", "conv_id"), "blocks")
    ways = own.where("k > 0").groupBy("k", "q1", "q2").agg(F.count("*").alias("ways")).where("ways > 1")
    # all first blocks have the empty prefix before them: they are always cut, without a join
    later = own.where("k > 0").join(ways, ["k", "q1", "q2"], "left").withColumn("parted", F.col("ways").isNotNull()).drop("ways")
    return own.where("k = 0").withColumn("parted", F.lit(True)).unionByName(later)


def turn_nodes(found: DataFrame) -> DataFrame:
    """(depth, x1, x2, p1, p2, conv_id, n_convs, words) of all nodes but the root; p1, p2 are the parent's digest."""
    each = found.select("n_convs", "conv_id", "parted", "q1", "q2", "turns", F.posexplode("turns").alias("j", "t"))
    lane = lambda start, x: F.aggregate(F.slice("turns", 1, F.col("j")), F.col(start), lambda acc, t: acc.bitwiseXOR(t[x]))
    each = each.select("parted", F.col("t.d").alias("depth"), lane("q1", "a").alias("p1"), lane("q2", "b").alias("p2"), "t.a", "t.b", "conv_id", "n_convs", F.col("t.words").alias("words"))
    each = each.select("parted", "depth", F.col("p1").bitwiseXOR(F.col("a")).alias("x1"), F.col("p2").bitwiseXOR(F.col("b")).alias("x2"), "p1", "p2", "conv_id", "n_convs", "words")
    again = each.where("parted").groupBy(*KEY, "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"))
    return each.where("not parted").drop("parted").unionByName(again)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): SHA-256 of the ids of conversations that end at a node, ascending, joined by commas."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy(*KEY, F.shiftright("conv_id", ENDS_BITS).alias("part")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == at:
                    digest.update(b",")
                else:
                    if at:
                        done.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
                done = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*at, digest.hexdigest())], names=[*KEY, "ends_sha256"])

    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInArrow(run, "depth bigint, x1 bigint, x2 bigint, ends_sha256 string")


def _subtrees(chains: DataFrame, first: int) -> DataFrame:
    """(conv_id, p, pd, leaves, tokens): chains with their sums over all chains at or below them."""
    now = saved(chains.withColumn("above", F.col("p")), "chains")
    while not now.where("above is not null").isEmpty():
        below = now.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("tokens").alias("spared"))
        up = now.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        # nothing is above the first chain, where most others hang
        ways = now.where(F.col("above") != first).select("conv_id", "above").join(up, "above").select("conv_id", "next")
        grown = now.drop("above").join(below, "conv_id", "left").join(ways, "conv_id", "left")
        now = saved(grown.select("conv_id", "p", "pd", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("tokens") + F.coalesce("spared", F.lit(0))).alias("tokens"), F.col("next").alias("above")), "chains")
    return now.drop("above")


def trie(convs: DataFrame, turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """All nodes of the trie of convs(conv_id) with turns(conv_id, i, role, digest, words)."""
    cut = saved(blocks(turns, size), "cut")
    found = turn_nodes(block_nodes(cut))
    first, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    none = F.lit(None).cast("bigint")
    root = convs.limit(1).select(*[F.lit(0).cast("bigint").alias(c) for c in KEY], none.alias("p1"), none.alias("p2"), F.lit(first).cast("bigint").alias("conv_id"), F.lit(n).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("words"))
    chain = Window.partitionBy("conv_id").orderBy("depth")
    nodes = found.unionByName(root).withColumns({"top": F.row_number().over(chain) == 1, "last": F.lead("depth").over(chain).isNull()})
    nodes = saved(nodes, "nodes")
    tops = nodes.where("top and depth > 0").select("conv_id", (F.col("depth") - 1).alias("pd"), "p1", "p2")
    owner = nodes.select(F.col("depth").alias("pd"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("p"))
    hung = tops.where("pd = 0").select("conv_id", "pd", F.lit(first).cast("bigint").alias("p")).unionByName(tops.where("pd > 0").join(owner, ["pd", "p1", "p2"]).select("conv_id", "pd", "p"))
    hung = saved(hung, "hung")
    branches = hung.groupBy(F.col("p").alias("conv_id"), F.col("pd").alias("depth")).agg(F.count("*").alias("branches"))
    told = nodes.join(branches, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("branches", F.lit(0)) + F.when(F.col("last"), 0).otherwise(1)).drop("branches")
    told = saved(told.withColumn("tokens", (F.col("n_convs") - 1) * F.col("words")), "told")
    chains = told.groupBy("conv_id").agg(F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.sum("tokens").alias("tokens"))
    sums = _subtrees(chains.join(hung, "conv_id", "left").select("conv_id", "p", "pd", "leaves", "tokens"), first)
    below = sums.where("p is not null").groupBy(F.col("p").alias("conv_id"), F.col("pd").alias("depth")).agg(F.sum("leaves").alias("more"), F.sum("tokens").alias("spared"))
    under = chain.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leaves = F.coalesce("more", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)
    full = told.join(below, ["conv_id", "depth"], "left").withColumns({"n_leaves": F.sum(leaves).over(under), "saved_tokens": F.sum(F.col("tokens") + F.coalesce("spared", F.lit(0))).over(under)})
    full = full.join(hung.select("conv_id", "p"), "conv_id", "left").withColumn("parent_conv_id", F.when(F.col("top"), F.col("p")).otherwise(F.col("conv_id")))
    ended = cut.where("last").select(*KEY, "conv_id")
    bare = convs.join(cut.where("k = 0").select("conv_id"), "conv_id", "left_anti").select(*[F.lit(0).cast("bigint").alias(c) for c in KEY], "conv_id")
    out = full.join(end_digests(ended.unionByName(bare)), list(KEY), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "x1", "x2")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(convs, turns).drop("x1", "x2")


#: CRC-32 of a decimal number: its characters and eight shifts each, one after the other.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda a: [CAST(ascii(a) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295)"""
OP13_SQL = rf"""
WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, turns, {_CRC} % 4 AS h FROM own),
built AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 20),
steps AS (SELECT c, len(turns) AS n, unnest(range(len(turns) + 1)) AS d, turns FROM built),
prefixes AS (SELECT c, n, d, turns[1:d] AS p, turns[1:d - 1] AS q, CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '{WORD}')) ELSE 0 END AS words FROM steps),
nodes AS (SELECT d, p, any_value(q) AS q, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(c, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM prefixes GROUP BY d, p),
kids AS (SELECT q AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY q, d),
told AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p),
below AS (SELECT a.d, a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens FROM told a JOIN told b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY a.d, a.p)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(t.n_convs AS BIGINT) AS n_convs, CAST(t.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN below b ON b.d = t.d AND b.p = t.p LEFT JOIN nodes u ON t.d > 0 AND u.d = t.d - 1 AND u.p = t.q
"""
