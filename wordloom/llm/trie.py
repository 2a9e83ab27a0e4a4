"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a sequence of first turns. Its key is a running 160-bit sum of digests of (place, turn), so keys of whole
conversations come from windows over blocks of turns, however long a conversation is. The least member of a node and its
depth name it as well: the members' own rows (conversation, depth) -> key say which node is whose ancestor.

Sums over subtrees never walk the tree level by level. A component is split at its weighted centroid, the deepest node
that holds half of its rows: the total below the centroid is added to the centroid and to its ancestors up to the top of
the component, the parts below become components of their own. Components of more than ``PART`` rows are split by Spark
joins, a round for all of them at a time (at most log2 of the rows); smaller ones are dealt to tasks, where the same
splitting runs on arrays. Neither a chain nor a node with very many children is ever one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.layout import number_rows
from wordloom.llm.common import cut, rows_in
from wordloom.llm.skew import skew_join

#: Conversations of a family share first turns: at most HEADS - 1 of them.
FAMILY, HEADS = 5, 9
#: Digests are summed in LIMBS numbers of LIMB_BITS bits, in blocks of 2 ** BLOCK_BITS turns.
LIMBS, LIMB_BITS, BLOCK_BITS = 4, 40, 12
ROOT = bytes(LIMBS * LIMB_BITS // 8)
#: Rows of a component that one task splits, and nodes that are dealt to one task.
PART, TASK_NODES = 1 << 14, 1 << 16
#: Bytes of ids hashed as one row.
CHUNK = 1 << 16


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns after rebuilding (conv_id, d, length, turn_sha, bytes), d from 1.

    Conversation c is the first h turns of conversation c - c % 5, then its own after its first h; h is the CRC-32 of
    its decimal id modulo 9. Turns are in the order of ``turn``, nulls first; equal numbers are ordered by role and then
    by a digest of role and text, repeated rows stay. Null roles and texts are empty. Rows without conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_sha"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    numbered = number_rows(turns, ["conv_id", F.col("turn").asc_nulls_first(), "role", "turn_sha"], "at").drop("turn", "role")
    own = numbered.groupBy("conv_id").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    )
    given = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = cut(
        own.join(given, "base", "left")
        .withColumn("head", head)
        .withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .drop("n", "n_base")
    )
    placed = skew_join(numbered, convs, ["conv_id"], ["at"]).withColumn("i", F.col("at") - F.col("begin"))
    kept = placed.where(F.col("i") >= F.col("h")).select(
        "conv_id", (F.col("head") + F.col("i") - F.col("h") + 1).alias("d"), "length", "turn_sha", "bytes"
    )
    heads = placed.where(F.col("i") < HEADS - 1).select(F.col("conv_id").alias("base"), "i", "turn_sha", "bytes")
    begun = heads.join(convs, "base").where(F.col("i") < F.col("h"))
    begun = begun.select("conv_id", (F.col("i") + 1).alias("d"), "length", "turn_sha", "bytes")
    return convs.select("conv_id", "length"), kept.unionByName(begun)


def _limb(digits: Column, k: int) -> Column:
    width = LIMB_BITS // 4
    return F.conv(F.substring(digits, 1 + width * k, width), 16, 10).cast("long")


def _key(limbs: list[Column]) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(x), LIMB_BITS // 4, "0") for x in limbs)))


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, d, length, bytes, key, parent): the node at every depth of every conversation, the root at depth 0."""
    names, mask = range(LIMBS), F.lit((1 << LIMB_BITS) - 1)
    digits = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("turn_sha")), 256)
    own = turns.withColumn("_digits", digits).select(
        "*", *(_limb(F.col("_digits"), k).alias(f"own{k}") for k in names), F.shiftright("d", BLOCK_BITS).alias("block")
    )
    inside = W.partitionBy("conv_id", "block").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        own.where(F.col("length") >= 1 << BLOCK_BITS)
        .groupBy("conv_id", "block")
        .agg(*(F.sum(f"own{k}").bitwiseAND(mask).alias(f"sum{k}") for k in names))
        .select("conv_id", "block", *(F.sum(f"sum{k}").over(before).alias(f"before{k}") for k in names))
    )
    summed = own.select("*", *(F.sum(f"own{k}").over(inside).alias(f"run{k}") for k in names)).join(
        totals, ["conv_id", "block"], "left"
    )
    run = [(F.col(f"run{k}") + F.coalesce(f"before{k}", F.lit(0))).bitwiseAND(mask) for k in names]
    above = [(F.col(f"run{k}") + F.coalesce(f"before{k}", F.lit(0)) - F.col(f"own{k}")).bitwiseAND(mask) for k in names]
    rows = summed.select("conv_id", "d", "length", "bytes", _key(run).alias("key"), _key(above).alias("parent"))
    root = convs.select(
        "conv_id",
        F.lit(0).cast("long").alias("d"),
        "length",
        F.lit(0).cast("long").alias("bytes"),
        F.lit(ROOT).alias("key"),
        F.lit(None).cast("binary").alias("parent"),
    )
    return rows.unionByName(root)


# ---------------------------------------------------------------- centroid decomposition


def subtree_sums(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (nodes x columns) over all subtrees of a forest, by centroid decomposition.

    ``parent`` has the parent's index or -1; a parent is one level higher than its children. All components are split at
    once, each at the deepest node with half of its nodes, until none is left: at most log2 of the nodes rounds.
    """
    n = len(parent)
    order = np.lexsort((parent, depth))
    back = np.empty(n + 1, np.int64)
    back[order], back[-1] = np.arange(n), -1
    up, depth, values = back[parent[order]], depth[order], values[order]
    levels = np.flatnonzero(np.diff(depth, prepend=depth[:1] - 1)).tolist() + [n]
    size = np.ones(n, np.int64)
    for a, b in zip(levels[-2::-1], levels[:0:-1]):
        inner = up[a:b] >= 0
        np.add.at(size, up[a:b][inner], size[a:b][inner])
    # place in preorder: a subtree is a range of places
    place, top = np.zeros(n, np.int64), np.arange(n)
    roots = up < 0
    place[roots] = np.cumsum(size[roots]) - size[roots]
    for a, b in zip(levels, levels[1:]):
        child = np.arange(a, b)[up[a:b] >= 0]
        if len(child):
            above, own = up[child], size[child]
            before = np.cumsum(own) - own
            first = np.flatnonzero(np.diff(above, prepend=-1))
            before -= np.repeat(before[first], np.diff(first, append=len(child)))
            place[child], top[child] = place[above] + 1 + before, top[above]
    weight, sums, live = size.copy(), np.zeros_like(values), np.arange(n)
    centre = np.zeros(n, np.int64)
    while len(live):
        own_top = top[live]
        heavy = live[2 * weight[live] >= weight[own_top]]
        centre[top[heavy]] = heavy  # by depth, so the deepest stays
        c = centre[own_top]
        below = (place[live] >= place[c]) & (place[live] < place[c] + size[c])
        above = (place[live] <= place[c]) & (place[c] < place[live] + size[live])
        total = np.zeros_like(values)
        np.add.at(total, own_top[below], values[live[below]])
        sums[live[above]] += total[own_top[above]]
        lost = weight[c]
        weight[live[above]] -= lost[above]
        inner = below & (live != c)
        new = inner & (up[live] == c)
        if new.any():
            # the child of the centroid a node is under: the last one before it in its component
            found, starts = live[inner], live[new]
            marks = own_top[new] * n + place[starts]
            by_mark = np.argsort(marks)
            at = np.searchsorted(marks[by_mark], own_top[inner] * n + place[found], "right") - 1
            top[found] = starts[by_mark][at]
        live = live[live != c]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], part: int = PART, task: int = TASK_NODES) -> DataFrame:
    """(key, <values>) with the sum of every value over each node's subtree, the node included.

    ``nodes`` has key, parent (null at a top), top (key of its tree's highest node), conv_id and d, a conversation that
    passes through the node and its depth, weight (the sum over its subtree of any positive weight) and the values.
    ``paths`` has conv_id, d, key and parent of every node of these conversations. Both should be written tables.
    """
    sums = [f"sum_{v}" for v in values]
    live = nodes.select(
        "key", "parent", F.col("top").alias("comp"), "conv_id", "d", "weight", *values, *(F.lit(0).cast("long").alias(s) for s in sums)
    )
    ready, done = [], []
    while True:
        tops = live.groupBy("comp").agg(F.max("weight").alias("total")).where(F.col("total") > part)
        if tops.isEmpty():
            break
        sized = skew_join(live, tops, ["comp"], ["key"], "left")
        ready.append(sized.where(F.col("total").isNull()).drop("total"))
        large = cut(sized.where(F.col("total").isNotNull()))
        half = large.where(2 * F.col("weight") >= F.col("total"))
        centre = half.groupBy("comp").agg(F.max_by(F.struct("key", "conv_id", "d", "weight"), "d").alias("c"))
        asked = cut(
            skew_join(large.drop("total"), centre, ["comp"], ["key"])
            # below the centroid's level: the own ancestor next below it; else the centroid's ancestor at the own level
            .withColumn("at_conv", F.when(F.col("d") > F.col("c.d"), F.col("conv_id")).otherwise(F.col("c.conv_id")))
            .withColumn("at_d", F.when(F.col("d") > F.col("c.d"), F.col("c.d") + 1).otherwise(F.col("d")))
        )
        known = paths.select(
            F.col("conv_id").alias("at_conv"), F.col("d").alias("at_d"), F.col("key").alias("at_key"), F.col("parent").alias("at_parent")
        )
        deeper = F.col("d") > F.col("c.d")
        seen = cut(
            skew_join(asked, known, ["at_conv", "at_d"], ["key"])
            .withColumn("under", deeper & (F.col("at_parent") == F.col("c.key")))
            .withColumn("over", ~deeper & (F.col("at_key") == F.col("key")))
            .drop("at_conv", "at_d", "at_parent")
        )
        inside = F.col("under") | (F.col("key") == F.col("c.key"))
        totals = seen.where(inside).groupBy("comp").agg(*(F.sum(v).alias(f"of_{v}") for v in values))
        told = skew_join(seen, totals, ["comp"], ["key"])
        moved = told.select(
            "key",
            "parent",
            F.when(F.col("under"), F.col("at_key")).otherwise(F.col("comp")).alias("comp"),
            "conv_id",
            "d",
            F.when(F.col("over"), F.col("weight") - F.col("c.weight")).otherwise(F.col("weight")).alias("weight"),
            *values,
            *(F.when(F.col("over"), F.col(s) + F.col(f"of_{v}")).otherwise(F.col(s)).alias(s) for s, v in zip(sums, values)),
            (F.col("key") == F.col("c.key")).alias("is_centre"),
        )
        moved = cut(moved)
        done.append(moved.where("is_centre").select("key", *sums))
        live = moved.where(~F.col("is_centre")).drop("is_centre")
    for more in ready:
        live = live.unionByName(more)
    out = _in_tasks(live, values, sums, task)
    for more in done:
        out = out.unionByName(more)
    return out.select("key", *(F.col(s).alias(v) for s, v in zip(sums, values)))


def _in_tasks(live: DataFrame, values: list[str], sums: list[str], task: int) -> DataFrame:
    """The rest of ``rollup``: whole components, dealt to tasks by their top."""
    dealt = max(1, -(-live.count() // task))

    def work(group: pa.Table) -> pa.Table:
        keys = group["key"].to_pylist()
        at = {k: i for i, k in enumerate(keys)}
        _, comp = np.unique(np.array([c.hex() for c in group["comp"].to_pylist()]), return_inverse=True)
        parent = np.array([at.get(p, -1) for p in group["parent"].to_pylist()], np.int64)
        parent[(parent >= 0) & (comp[parent] != comp)] = -1
        own = np.stack([group[v].to_numpy() for v in values], 1)
        found = subtree_sums(parent, group["d"].to_numpy(), own)
        made = [group[s].to_numpy() + found[:, i] for i, s in enumerate(sums)]
        return pa.table([pa.array(keys, pa.binary()), *map(pa.array, made)], names=["key", *sums])

    schema = "key binary, " + ", ".join(f"{s} bigint" for s in sums)
    narrow = live.select("key", "parent", "comp", "d", *values, *sums)
    return narrow.groupBy(F.pmod(F.xxhash64("comp"), F.lit(dealt)).alias("deal")).applyInArrow(work, schema)


# ---------------------------------------------------------------- digests of members


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, conv_id) in order to rows (key, first, ids) with up to CHUNK bytes of ids."""
    key, first, ids, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["key", "first", "ids"]
        )

    for batch in rows_in(batches):
        made = []
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != key or size > CHUNK:
                if ids:
                    made.append(row())
                key, first, ids, size = own, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, first, ids) in order to rows (key, ends_sha256), holding one row of ids at a time."""
    key, state = None, None
    for batch in rows_in(batches):
        keys, digests = [], []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if own != key:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"]
        )


def digests_of_ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the conversations that end at a node, ids in numerical order.

    Ids are sorted over range partitions and joined to long strings there, so a node where a third of all conversations
    end reaches the one task that hashes it as few rows, read one after the other.
    """
    ends = rows.where(F.col("d") == F.col("length")).select("key", "conv_id")
    joined = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = joined.mapInArrow(_joined_ids, "key binary, first bigint, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, part: int = PART, task: int = TASK_NODES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root (depth 0) has every conversation, also those without turns. An empty table has no nodes. Columns beside
    conv_id, turn, role and text are not read.
    """
    convs, turns = rebuilt(conversations)
    rows = cut(prefixes(convs, turns))
    nodes = cut(
        rows.groupBy("key", "parent", "d").agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.max("bytes").alias("bytes"),
            F.sum(F.col("length") - F.col("d") + 1).alias("weight"),
        )
    )
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    own = cut(
        nodes.join(children, "key", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
        .withColumn("top", F.lit(ROOT))
    )
    sums = rollup(own, rows.drop("length", "bytes"), ["n_leaves", "saved_tokens"], part, task)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = skew_join(own.drop("n_leaves", "saved_tokens", "weight", "bytes", "top"), above, ["parent"], ["key"], "left")
    return (
        named.join(sums, "key")
        .join(digests_of_ends(rows), "key", "left")
        .select(
            "conv_id",
            F.col("d").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


DIGEST_SQL = f"""
WITH crcs AS (
  SELECT list(list_reduce(list_transform(range(9), lambda i: b), lambda c, x:
         CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY b) AS crc
  FROM range(256) AS r(b)
),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (
  SELECT o.conv_id, o.conv_id - o.conv_id % {FAMILY} AS base, coalesce(b.n, 0) AS n_base,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(regexp_extract_all(hex(encode(o.conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) % {HEADS} AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}, crcs
),
again AS (
  SELECT c.conv_id, t.i + 1 AS d, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE t.i < c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, c.n_base) + t.i - c.h + 1, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.i >= c.h
  UNION ALL SELECT conv_id, 0, '', '' FROM convs
),
pathed AS (
  SELECT conv_id, d, strlen(text) AS bytes, max(d) OVER (PARTITION BY conv_id) AS len,
         sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY d)) AS key
  FROM again
),
placed AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM pathed),
nodes AS (
  SELECT key, d, any_value(parent) AS parent, count(*) AS n_convs, min(conv_id) AS conv_id, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = len), '')) AS ends_sha256
  FROM placed GROUP BY key, d
),
sized AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children
  FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes GROUP BY parent) k ON k.parent = n.key
),
sums AS (
  SELECT p.key, sum((s.n_children = 0)::BIGINT) AS n_leaves, sum((s.n_convs - 1) * s.bytes) AS saved_tokens
  FROM sized s JOIN placed p ON p.conv_id = s.conv_id AND p.d <= s.d GROUP BY p.key
)
SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n_convs::BIGINT AS n_convs,
       s.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens,
       s.ends_sha256
FROM sized s JOIN sums u ON u.key = s.key LEFT JOIN nodes p ON p.key = s.parent
"""
