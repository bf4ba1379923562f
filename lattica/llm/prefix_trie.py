"""Operator 13, the prefix trie of conversations.

A turn is a 128-bit digest and a length, so texts travel no further than the scan. Conversations with the same turns are
one sequence with a count before any trie is built. Sequences are dealt by the digest of their first turn, several first
turns to a bucket, and each bucket's tries are dictionaries of pointers inside ``applyInPandas``: a node is made after its
parent, so going through the nodes backwards is the postorder that adds up subtrees.

A first turn with more than ``limit`` turns below it is opened instead: what all its sequences share becomes a chain of
nodes by one aggregate, and the rest is dealt anew by the next turn, again and again until every subtree fits. Totals of
opened subtrees are added up on the way back. The root is the first subtree to be opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import crc_mod, forget, written

#: Turns below one digest that one Python call may take; a bucket holds about as many more.
LIMIT = 50_000
#: Conversations share the first turns of the one whose id ends in two zeros, up to so many less one.
EVERY, HEADS = 100, 6

NODE = "gid string, parent string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_sid long"


def turns(conversations: DataFrame) -> DataFrame:
    """(c, rn, key, chars): the turns of each conversation, numbered from 1 by turn, null first, ties by digest.

    A null role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.length(text).cast("long").alias("chars"),
    )
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("c", F.row_number().over(order).alias("rn"), "key", "chars")


def rebuilt(numbered: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """(c, depth, key, chars): conversations that begin with turns of another, and a row of depth 0 for each of them."""
    c = F.col("c")
    tops = numbered.filter((c % every == 0) & (F.col("rn") < heads)).groupBy(c.alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("rn", "key", "chars"))).alias("top")  # fewer than ``heads`` turns
    )
    own = numbered.withColumn("base", c - c % every).withColumn("h", crc_mod(c, heads).cast("int"))
    both = own.join(tops, "base", "left").withColumn("top", F.slice(F.coalesce("top", F.array().cast("array<struct<rn:int,key:string,chars:bigint>>")), F.lit(1), F.col("h")))
    root = F.struct(F.lit(0).alias("rn"), F.lit("").alias("key"), F.lit(0).cast("long").alias("chars"))
    turn = F.struct((F.size("top") + F.col("rn") - F.col("h")).alias("rn"), "key", "chars")
    first = F.when(F.col("rn") == 1, F.concat(F.array(root), "top")).otherwise(F.slice(F.array(root), 1, 0))
    later = F.when(F.col("rn") > F.col("h"), F.array(turn)).otherwise(F.slice(F.array(turn), 1, 0))
    return both.select("c", F.inline(F.concat(first, later))).withColumnRenamed("rn", "depth")


def sequences(rows: DataFrame) -> DataFrame:
    """(sid, n, size, ends_sha256) for each distinct sequence of turns: smallest conversation, how many, turns, digest of ids.

    Ids of a sequence's conversations stream through one digest in their order; memory holds a batch and the digest.
    """
    marks = rows.groupBy("c").agg(
        F.bit_xor(F.xxhash64(F.lit(1), "depth", "key")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(2), "depth", "key")).alias("y"),
        F.max("depth").alias("size"),
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, sid, n = None, None, None, 0
        for pdf in batches:
            out = []
            for (x, y, size), ids in pdf.groupby(["x", "y", "size"], sort=False)["c"]:
                if (x, y, size) != at:
                    if at is not None:
                        out.append((sid, n, at[2], state.hexdigest()))
                    at, state, sid, n = (x, y, size), hashlib.sha256(), int(ids.iloc[0]), 0
                state.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
            if out:
                yield pd.DataFrame(out, columns=["sid", "n", "size", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(sid, n, at[2], state.hexdigest())], columns=["sid", "n", "size", "ends_sha256"])

    by_key = marks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y", "size")
    return by_key.sortWithinPartitions("x", "y", "size", "c").mapInPandas(digest, "sid long, n long, size int, ends_sha256 string")


def bucket_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's tries; rows are turns (gid, parent, up, sid, n, size, depth, key, chars) of whole subtrees."""
    pdf = pdf.sort_values(["sid", "depth"], kind="stable")
    tops: dict[str, int] = {}
    kids: list[dict[str, int]] = []
    above, name, depths, chars, low, count, end = [], [], [], [], [], [], []
    node, last = -1, None
    for gid, parent, up, sid, n, size, depth, key, length in zip(*(pdf[x].tolist() for x in ("gid", "parent", "up", "sid", "n", "size", "depth", "key", "chars")), strict=True):
        known, mother = (tops, -1) if sid != last else (kids[node], node)
        node, last = known.setdefault(gid if sid != last or mother < 0 else key, len(kids)), sid
        if node == len(kids):
            kids.append({})
            above.append(mother)
            name.append((gid, parent, up))
            depths.append(depth)
            chars.append(length)
            low.append(sid)  # sequences come by their smallest conversation
            count.append(0)
            end.append(None)
        count[node] += n
        if size == depth:
            end[node] = sid
    leaves = [0] * len(kids)
    saved = [0] * len(kids)
    for i in range(len(kids) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (count[i] - 1) * chars[i]
        if above[i] >= 0:
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    top = [a < 0 for a in above]
    return pd.DataFrame({
        "gid": [x[0] if t else None for x, t in zip(name, top, strict=True)],
        "parent": [x[1] if t else None for x, t in zip(name, top, strict=True)],
        "conv_id": low,
        "depth": depths,
        "parent_conv_id": [x[2] if a < 0 else low[a] for x, a in zip(name, above, strict=True)],
        "n_convs": count,
        "n_children": [len(k) for k in kids],
        "n_leaves": leaves,
        "saved_tokens": saved,
        "end_sid": pd.array(end, dtype="Int64"),
    })


def open_groups(big: DataFrame) -> DataFrame:
    """(gid, parent, up, depth, chars, low, n, end_sid): the turns that all sequences of a group share, in a row a turn."""
    per = big.groupBy("gid", "depth").agg(
        F.count(F.lit(1)).alias("seqs"),
        (F.min("key") == F.max("key")).alias("one"),
        F.min("chars").alias("chars"),
        F.min("sid").alias("low"),
        F.sum("n").alias("n"),
        F.max(F.when(F.col("size") == F.col("depth"), F.col("sid"))).alias("end_sid"),
        F.min("parent").alias("parent"),
        F.min("up").alias("up"),
    )
    down = Window.partitionBy("gid").orderBy("depth")
    apart = ~F.col("one") | (F.col("seqs") < F.first("seqs").over(down))
    return per.withColumn("apart", apart).withColumn("apart", F.max("apart").over(down)).filter("NOT apart").drop("apart", "one", "seqs")


def closed_chains(chain: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of opened groups, from what the groups below them add up to; the first node of each has its gid and parent."""
    kids = below.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("gid")).agg(
        F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("kid_leaves"), F.sum("saved_tokens").alias("kid_saved")
    )
    down = Window.partitionBy("gid").orderBy("depth")
    onward = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = F.row_number().over(down) == 1
    final = F.lead("depth").over(down).isNull()
    none = F.lit(0).cast("long")
    return chain.join(kids, "gid", "left").select(
        F.when(first, F.col("gid")).alias("gid"),
        F.when(first, F.col("parent")).alias("parent"),
        F.col("low").alias("conv_id"),
        "depth",
        F.when(first, F.col("up")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(final, F.coalesce("kids", none)).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.coalesce("kid_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        (F.sum((F.col("n") - 1) * F.col("chars")).over(onward) + F.coalesce("kid_saved", none)).alias("saved_tokens"),
        "end_sid",
    )


def nodes(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes of the trie over ``rows`` (sid, n, size, depth, key, chars), every sequence with a row of depth 0."""
    spark = rows.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nothing = F.lit(None)
    big = written(rows.select(F.lit("").alias("gid"), nothing.cast("string").alias("parent"), nothing.cast("long").alias("up"), "sid", "n", "size", "depth", "key", "chars"), "trie")
    chains, built = [], []
    while True:
        chain = written(open_groups(big), "chains")
        chains.append(chain)
        ends = chain.groupBy("gid").agg(F.max("depth").alias("last"), F.min("low").alias("low"))
        rest = big.join(ends, "gid").filter("depth > last")
        named = rest.filter("depth = last + 1").select("sid", F.md5(F.concat_ws(":", "gid", F.col("last").cast("string"), "key").cast("binary")).alias("next"))
        moved = written(rest.join(named, "sid").select(F.col("next").alias("gid"), F.col("gid").alias("parent"), F.col("low").alias("up"), "sid", "n", "size", "depth", "key", "chars"), "trie")
        forget(big)
        sizes = written(moved.groupBy("gid").agg(F.count(F.lit(1)).alias("turns")), "sizes")
        large = sizes.filter(F.col("turns") > limit).select("gid")
        buckets = max(shuffle, -(-moved.count() // limit) * 2)
        small = moved.join(large, "gid", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
        built.append(written(small.groupBy("bucket").applyInPandas(bucket_nodes, NODE), "nodes"))
        if large.isEmpty():
            break
        big = written(moved.join(large, "gid", "left_semi").select(*big.columns), "trie")
        forget(moved)
    out, above = None, None
    for chain, done in zip(reversed(chains), reversed(built), strict=True):
        below = done if above is None else done.unionByName(above)
        above = written(closed_chains(chain, below), "nodes")
        out = done.unionByName(above) if out is None else out.unionByName(done).unionByName(above)
    return out


def trie(conversations: DataFrame, limit: int = LIMIT, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Needs conv_id, turn, role and text; other columns are ignored. Empty tables have no node, not even a root. Repeated
    rows are turns of their own, and turns with one number stand by digest. A conversation may be left without turns; it is
    a member of the root then. Very long texts cost their digest alone, very long conversations a row a turn.
    """
    numbered = written(turns(conversations), "turns")
    whole = written(rebuilt(numbered, every, heads), "rebuilt")
    seqs = written(sequences(whole), "sequences")
    rows = whole.withColumnRenamed("c", "sid").join(seqs.select("sid", "n", "size"), "sid")
    out = nodes(rows, limit).join(seqs.select(F.col("sid").alias("end_sid"), "ends_sha256"), "end_sid", "left")
    forget(numbered)
    forget(whole)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt on the first turns of the one whose id ends in two zeros."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = """
WITH given AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'key': key, 'chars': chars} ORDER BY turn NULLS FIRST, key) AS turns FROM given GROUP BY c),
cut AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 6 AS h FROM own),
whole AS (SELECT cut.c, coalesce(list_slice(base.turns, 1, cut.h), []) || list_slice(cut.turns, cut.h + 1, len(cut.turns)) AS turns
  FROM cut LEFT JOIN own base ON base.c = cut.c - cut.c % 100),
steps AS (SELECT c, len(turns) AS size, unnest(range(len(turns) + 1)) AS depth, turns FROM whole),
prefixes AS (SELECT c, size, depth, md5(array_to_string(list_transform(list_slice(turns, 1, depth), lambda t: t.key), ',')) || depth AS node,
    CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(list_slice(turns, 1, depth - 1), lambda t: t.key), ',')) || (depth - 1) END AS mother,
    CASE WHEN depth > 0 THEN turns[depth].chars ELSE 0 END AS chars FROM steps),
nodes AS (SELECT node, any_value(mother) AS mother, min(c) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
    coalesce(string_agg(CASE WHEN size = depth THEN c::VARCHAR END, ',' ORDER BY c), '') AS ids FROM prefixes GROUP BY node),
kids AS (SELECT mother AS node, count(*) AS n_children FROM nodes WHERE mother IS NOT NULL GROUP BY mother),
sums AS (SELECT up.node, sum(down.saved) AS saved_tokens, count(*) FILTER (WHERE kids.n_children IS NULL) AS n_leaves
  FROM nodes down JOIN prefixes up ON up.c = down.conv_id AND up.depth <= down.depth LEFT JOIN kids ON kids.node = down.node GROUP BY up.node)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes m ON m.node = n.mother
"""
