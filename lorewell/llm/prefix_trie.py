"""The trie of what conversations begin with, named by prefix doubling: no task follows a conversation turn by turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, fold

#: A conversation takes its first turns from that of the next smaller multiple of GROUP: as many as its checksum modulo TURNS.
GROUP, TURNS = 5, 9
#: Names given out in one task, about.
BUCKET = 1 << 14
NOBODY = hashlib.sha256(b"").hexdigest()


def dense_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and name for each different value of the keys: whole numbers that stay below their number but for how evenly
    hashes fall. Numbers are given within hash buckets, in proportion to the values, so no task sorts them all."""
    different = cut(rows.select(*keys).distinct(), "different")
    buckets = different.count() // BUCKET + 32
    within = Window.partitionBy("bucket").orderBy(*keys)
    bucketed = different.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return bucketed.select(*keys, ((F.row_number().over(within) - 1) * F.lit(buckets) + F.col("bucket")).alias("name"))


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: the role's length, the role, the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), name, bytes of every turn that has a conv_id; equal turns, in role and text, have equal names.

    Turns are numbered after a sort by range, so a conversation with very many of them is many tasks; what comes
    before a task's part of a conversation follows from the counts of the parts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    slim = cut(slim, "digests")
    order = ["conv_id", "turn", "digest", "row"]
    lined = slim.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    lined = cut(lined.select("conv_id", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "lined")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lined.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = cut(lined.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "digest", "bytes"), "placed")
    return cut(placed.join(dense_names(slim, ["digest"]), "digest").select("conv_id", "pos", "name", "bytes"), "turns")


def rebuilt(turns: DataFrame, group: int = GROUP, most: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length of every rebuilt conversation; conv_id, idx, name, bytes of its turns)."""
    sizes = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes").withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = fold(F.col("conv_id"), most)
    convs = sizes.join(bases, "base", "left").withColumn("h", head).withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("idx"), "name", "bytes")
    heads = turns.where(F.col("pos") < most - 1).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos < taken").select("conv_id", F.col("pos").alias("idx"), "name", "bytes")
    return convs.select("conv_id", "length"), cut(own.unionByName(heads), "rebuilt")


def blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """conv_id, idx, name, bytes of the blocks of 1, 2, 4 ... turns that begin at multiples of their length: a block's name
    is that of the pair of its halves' names. Half as many in each round; `bytes` is its last turn's."""
    levels = [turns]
    while 2 ** len(levels) <= longest:
        of = lambda c, odd: F.max(F.when(F.col("idx") % 2 == odd, F.col(c)))
        halves = levels[-1].groupBy("conv_id", F.floor(F.col("idx") / 2).alias("up")).agg(of("name", 0).alias("left"), of("name", 1).alias("right"), of("bytes", 1).alias("bytes"))
        pairs = cut(halves.where("right IS NOT NULL").withColumnRenamed("up", "idx"), "pairs")
        levels.append(cut(pairs.join(dense_names(pairs, ["left", "right"]), ["left", "right"]).select("conv_id", "idx", "name", "bytes"), "blocks"))
    return levels


def prefixes(levels: list[DataFrame]) -> tuple[DataFrame | None, DataFrame | None]:
    """(depth, conv_id, n_convs, bytes of every node below the root; conv_id, depth, node of every conversation's prefixes).

    A prefix of d turns is the one without the lowest bit of d, followed by one block as long as that bit. So all
    lengths are composed in one round for each bit, highest first, each prefix once. Its name is the smallest
    conversation that begins with it.
    """
    nodes, places = [], []
    for bit in reversed(range(len(levels))):
        size = 1 << bit
        ends = levels[bit].where("idx % 2 = 0").select("conv_id", (F.col("idx") * size).alias("prev"), ((F.col("idx") + 1) * size).alias("depth"), "name", "bytes")
        if places:
            known = reduce(DataFrame.unionByName, places).select("conv_id", F.col("depth").alias("prev"), F.col("node").alias("before"))
            ends = ends.join(known, ["conv_id", "prev"], "left")
        else:
            ends = ends.withColumn("before", F.lit(None).cast("long"))
        # all prefixes of one depth have the root before them, or none
        ends = cut(ends.select("conv_id", "depth", F.coalesce("before", F.lit(0)).alias("before"), "name", "bytes"), "ends")
        key = ["depth", "before", "name"]
        found = cut(ends.groupBy(*key).agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "nodes")
        nodes.append(found.select("depth", F.col("node").alias("conv_id"), "n_convs", "bytes"))
        places.append(cut(ends.join(found.select(*key, "node"), key).select("conv_id", "depth", "node"), "places"))
    return (reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, places)) if nodes else (None, None)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of sorted members of one node in a batch, as one row: the first, and all with commas between."""
    for b in batches:
        if len(b):
            run = ((b["depth"].diff() != 0) | (b["node"].diff() != 0)).cumsum()
            by = b.assign(text=b["conv_id"].astype(str)).groupby(run.to_numpy(), sort=False)
            yield by.agg(depth=("depth", "first"), node=("node", "first"), first=("conv_id", "first"), ids=("text", ",".join))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """depth, node, ends: the hash over a node's runs, one after the other; only its state is kept between them."""
    key, state = None, None
    for b in batches:
        out = []
        for depth, node, ids in zip(b["depth"], b["node"], b["ids"], strict=True):
            if (depth, node) == key:
                state.update(b"," + ids.encode())
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, node), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["depth", "node", "ends"])
    if key:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "node", "ends"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, node, ends: SHA-256 of the ascending conv_ids that end at the node.

    Members are sorted by range and packed into runs of a batch, so that a node where very many end costs the one
    task that must hash them in order a row for each run, read as a stream.
    """
    order = ["depth", "node", "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_packed, "depth long, node long, first long, ids string")
    return runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInPandas(_hashed, "depth long, node long, ends string")


def subtree_sums(shared: DataFrame) -> DataFrame:
    """depth, conv_id, leaves, saved of nodes (depth, conv_id, parent, leaves, saved), each summed over its subtree.

    Every round hands what is summed so far to the ancestor twice as far up, so the number of rounds grows with the
    logarithm of the depth. With a node all its ancestors must be there.
    """
    now = cut(shared.withColumnRenamed("parent", "above"), "shared")
    deepest, step = now.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        sent = now.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        farther = now.where(F.col("depth") >= step).select((F.col("depth") + step).alias("depth"), F.col("conv_id").alias("above"), F.col("above").alias("farther"))
        joined = now.join(farther, ["depth", "above"], "left").join(sent, ["depth", "conv_id"], "left")
        more = lambda c: F.col(c) + F.coalesce("more_" + c, F.lit(0))
        now = cut(joined.select("depth", "conv_id", F.col("farther").alias("above"), more("leaves").alias("leaves"), more("saved").alias("saved")), "shared")
        step *= 2
    return now.select("depth", "conv_id", "leaves", "saved")


SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_nodes(conversations: DataFrame, group: int = GROUP, most: int = TURNS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by `turn`, null first; turns of equal number go by the SHA-256 of role and text, and repeated rows are
    turns of their own. A null role or text is empty. Rows without a conv_id belong to no conversation and take no
    part. Ids below zero take their first turns from the next multiple towards zero. A conversation without turns
    of its own left ends at the root. No conversations give no nodes, not even a root. Further columns are ignored.

    Turns become numbers, blocks of 2, 4, 8 ... turns become numbers by joins on the pair of halves, prefixes are
    composed of blocks; a key that very many rows share is counted before it is shuffled and joined in a join that
    Spark can split. Nodes with one member have one leaf below and save nothing, so subtrees are summed over the
    shared ones only.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(ordered_turns(conversations), group, most)
    root, all_convs, longest = convs.agg(F.min("conv_id"), F.count("*"), F.max("length")).first()
    if not all_convs:
        return spark.createDataFrame([], SCHEMA)
    below, places = prefixes(blocks(turns, longest) if longest else [])
    top = spark.createDataFrame([(0, root, all_convs, 0, None)], "depth long, conv_id long, n_convs long, bytes long, parent long")
    if below is None:
        tree, ends = top, convs.select(F.lit(0).cast("long").alias("depth"), F.lit(root).alias("node"), "conv_id")
    else:
        over = places.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
        parent = F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("parent"))
        tree = cut(below.join(over, ["conv_id", "depth"], "left").withColumn("parent", parent).unionByName(top), "tree")
        at = places.withColumnRenamed("depth", "length")
        ends = convs.join(at, ["conv_id", "length"], "left").select(F.col("length").alias("depth"), F.coalesce("node", F.lit(root)).alias("node"), "conv_id")
    kids = tree.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    known = cut(tree.join(kids, ["depth", "conv_id"], "left").fillna(0, ["n_children", "single"]), "known")
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("single"))
    sums = subtree_sums(known.where("n_convs > 1").select("depth", "conv_id", "parent", leaves.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    hashes = end_hashes(ends).withColumnRenamed("node", "conv_id")
    out = known.join(sums, ["depth", "conv_id"], "left").join(hashes, ["depth", "conv_id"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )


ORACLE = """
WITH RECURSIVE table_of AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_of WHERE k < 8),
bytewise AS (SELECT i, c FROM table_of WHERE k = 8),
digits AS (
  SELECT DISTINCT conv_id, 4294967295::BIGINT AS crc, conv_id::VARCHAR AS rest FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT d.conv_id, xor(d.crc >> 8, b.c), substr(d.rest, 2) FROM digits d JOIN bytewise b ON b.i = xor(d.crc % 256, ascii(d.rest)) WHERE d.rest <> ''),
heads AS (SELECT conv_id, xor(crc, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM digits WHERE rest = ''),
turns AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS what, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
rows_of AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.what, t.bytes FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos < h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, t.what, t.bytes FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos >= h.h),
placed AS (SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(what, '') OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS prefix
  FROM rows_of WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (SELECT conv_id, depth, prefix, bytes FROM placed UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
lengths AS (SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members JOIN lengths USING (conv_id) GROUP BY depth, prefix),
spots AS (SELECT m.conv_id, m.depth, n.node FROM members m JOIN nodes n ON n.depth = m.depth AND n.prefix = m.prefix),
up AS (SELECT n.*, a.node AS parent FROM nodes n LEFT JOIN spots a ON a.conv_id = n.node AND a.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n FROM up WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM up u LEFT JOIN kids k ON k.depth = u.depth AND k.node = u.node),
below AS (
  SELECT a.depth, a.node, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM full_nodes n JOIN spots a ON a.conv_id = n.node AND a.depth <= n.depth GROUP BY a.depth, a.node)
SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.depth = f.depth AND b.node = f.node
"""
