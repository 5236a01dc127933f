"""The prefix trie of conversations, by partition refinement.

A node is a distinct sequence of first turns (role and text); its members are the
conversations that begin with it.

1. Order.  Turns are range-sorted by (conversation, turn), so one conversation may
   span many tasks, and counted by running sums over tasks.
2. Refinement.  All conversations begin in one class, the root.  A round splits
   every active class by the next turn, and by as many further turns as its stride
   says (1, then ``GROWTH`` times as many each round, at most ``STRIDE``, so that
   long equal conversations take few rounds).  A class is named by the chained
   128-bit SHA-256 of its turns, so splitting needs no shared numbering: members
   derive their class's name on their own, and one aggregation counts it.
3. Retirement.  Classes of one member leave after the round; the turns that follow
   are a unary chain, emitted from the turn table as they are.
4. Fold.  Sums over subtrees are taken without walking up level by level: a
   conversation that shares a node first seen at depth d with a smaller member
   adds its shared texts, from d to where it is the smallest member, to every node
   above, and one leaf if it is the smallest member of a childless node.  So one
   join by conversation and one aggregation by node fold all levels.

Ties of turn are ordered by the hash of role and text.  Null turns come first, null
roles and texts are empty, rows without a conversation id belong to no conversation.  Repeated
rows are turns of their own.  An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmatch.llm.common import int64, tidy, write_table

#: Turns by which classes are split in one round: at first, growth, at most.
FIRST, GROWTH, STRIDE = 1, 8, 4096
_ROOT = bytes(16)
_NEVER = (1 << 63) - 1


# ------------------------------------------------------------------- turns
def turns_in_order(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, nth from 0, hash, chars): the turns of each conversation in order."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    body = F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("conv"), F.col(turn).alias("turn"), F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("hash"), F.length(t).cast("bigint").alias("chars"))
    rows = rows.repartitionByRange("conv", "turn", "hash").sortWithinPartitions("conv", "turn", "hash")
    rows = write_table(rows.select("conv", "hash", "chars", F.monotonically_increasing_id().alias("id")), "turns")
    rows = rows.withColumn("task", F.shiftright("id", 33))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv", "task").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    runs = runs.select("conv", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(runs, ["conv", "task"]).select("conv", (F.col("id") + F.col("shift")).alias("nth"), "hash", "chars")


def share_beginnings(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) rebuilt: the first h turns of conversation c - c % group, then c's own after its first h; h = crc32(c) % most."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % F.lit(most)
    heads = turns.where((F.col("conv") % group == 0) & (F.col("nth") < most - 1)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("nth", "hash", "chars"))).alias("head"))
    convs = turns.select("conv").distinct()
    taken = convs.withColumn("base", F.col("conv") - F.col("conv") % group).join(heads, "base", "left")
    none = F.array().cast("array<struct<nth: bigint, hash: binary, chars: bigint>>")
    taken = write_table(taken.select("conv", h.alias("h"), F.slice(F.coalesce("head", none), F.lit(1), h.cast("int")).alias("head")), "heads")
    copied = taken.select("conv", F.explode("head").alias("t")).select("conv", (F.col("t.nth") + 1).alias("depth"), "t.hash", "t.chars")
    own = turns.join(taken.select("conv", "h", F.size("head").alias("n")), "conv").where(F.col("nth") >= F.col("h"))
    return taken.select("conv"), copied.unionByName(own.select("conv", (F.col("n") + F.col("nth") - F.col("h") + 1).alias("depth"), "hash", "chars"))


# --------------------------------------------------------------------- trie
def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of members at the depths of a round, from (conv, length, key, sum, turns)."""
    for b in batches:
        turns = b.column(4)
        flat, many = turns.flatten(), np.diff(turns.offsets.to_numpy())
        hashes = flat.field(1).to_pylist()
        chars = flat.field(2).to_numpy()
        total = np.cumsum(chars)
        at, of = np.cumsum(many) - many, np.repeat(np.arange(len(b)), many)
        names: list[bytes] = []
        above: list[bytes] = []
        sha = hashlib.sha256
        for name, i, n in zip(b.column(2).to_pylist(), at.tolist(), many.tolist()):
            for h in hashes[i : i + n]:
                above.append(name)
                name = sha(name + h).digest()[:16]
                names.append(name)
        before = np.repeat(np.where(at > 0, total[at - 1], 0), many) if len(of) else of
        sums = b.column(3).to_numpy()[of] + total - chars - before
        index = pa.array(of)
        yield pa.RecordBatch.from_arrays([b.column(0).take(index), b.column(1).take(index), flat.field(0), pa.array(names, pa.binary()), pa.array(above, pa.binary()), pa.array(chars), int64(sums)], ["conv", "length", "depth", "key", "above", "chars", "sum"])


def _refined(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv, length, depth, key, above, chars, sum of the texts above) down to where classes retire, and the retired (conv, length, depth)."""
    kind = convs.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, length bigint, depth bigint, key binary, above binary, chars bigint, sum bigint"
    lengths = turns.groupBy("conv").agg(F.count("*").alias("length"))
    zero = F.lit(0).cast("bigint")
    members = [write_table(convs.join(lengths, "conv", "left").select("conv", F.coalesce("length", zero).alias("length"), zero.alias("depth"), F.lit(_ROOT).alias("key"), F.lit(None).cast("binary").alias("above"), zero.alias("chars"), zero.alias("sum")), "members")]
    retired = []
    depth, stride = 0, FIRST
    while True:
        now = members[-1].where((F.col("depth") == depth) & (F.col("length") > depth))
        many = members[-1].where(F.col("depth") == depth).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        retired.append(now.join(many, "key", "left_anti").select("conv", "length", "depth"))
        active = write_table(now.join(many, "key", "left_semi").select("conv", "length", "key", (F.col("sum") + F.col("chars")).alias("sum")), "active")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, retired)
        ahead = turns.where((F.col("depth") > depth) & (F.col("depth") <= depth + stride)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "hash", "chars"))).alias("turns"))
        split = active.join(ahead, "conv").select("conv", "length", "key", "sum", "turns").mapInArrow(tidy(_chained), schema)
        members.append(write_table(split, "members"))
        depth, stride = depth + stride, min(STRIDE, stride * GROWTH)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) as (key, first conv, ids joined by commas), a row for each run of a batch."""
    for b in batches:
        keys, ids = b.column(0).to_pylist(), b.column(1)
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
        texts = list(map(str, ids.to_pylist()))
        runs = list(zip(cuts, cuts[1:]))
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in runs], pa.binary()), ids.take(pa.array([i for i, _ in runs], pa.int64())), pa.array([",".join(texts[i:j]) for i, j in runs], pa.string())], ["key", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, SHA-256 of its blocks joined by commas) of sorted (key, first, ids): a running hash, whatever the number of ids."""
    last, state = None, None
    for b in batches:
        keys, out = [], []
        for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if key != last:
                if state is not None:
                    keys.append(last)
                    out.append(state.hexdigest())
                last, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])


def _ends(members: DataFrame) -> DataFrame:
    """(key, ends): digest of the ascending ids of the members that end at a node."""
    kind = members.schema["conv"].dataType.simpleString()
    rows = members.where("length = depth").select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    blocks = rows.mapInArrow(_joined_ids, f"key binary, first {kind}, ids string")
    return blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv, depth from 1, hash, chars) of the conversations ``convs`` (conv, each once).

    (conv_id: smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256); the root has depth 0 and holds conversations without turns.
    """
    turns = write_table(turns, "turns")
    members, retired = _refined(convs, turns)
    nodes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.max("depth").alias("depth"), F.max("above").alias("above"), F.max("sum").alias("sum"), F.count_if(F.col("length") == F.col("depth")).alias("ending"))
    nodes = write_table(nodes, "nodes")
    below = nodes.groupBy(F.col("above").alias("key")).agg(F.count("*").alias("below"))
    alone = F.col("n") == 1
    nodes = nodes.join(below, "key", "left").withColumn("children", F.when(alone, 1 - F.col("ending")).otherwise(F.coalesce("below", F.lit(0))))
    nodes = write_table(nodes.drop("below"), "nodes")
    # from where a conversation is the smallest member, the texts above that, and whether it stands for a leaf
    first = nodes.groupBy(F.col("least").alias("conv")).agg(F.min(F.struct("depth", "sum")).alias("first"), F.max((alone | (F.col("children") == 0)).cast("bigint")).alias("leaf"))
    whole = members.where("length = depth").select("conv", (F.col("sum") + F.col("chars")).alias("whole"))
    own = first.join(whole, "conv", "full").select("conv", F.coalesce("first.depth", F.lit(_NEVER)).alias("from"), F.coalesce("first.sum", "whole").alias("texts"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = F.when(F.col("from") > F.col("depth"), F.col("texts") - F.col("sum")).otherwise(0)
    folded = members.join(own, "conv").groupBy("key").agg(F.sum("leaf").alias("leaves"), F.sum(shared).alias("saved"))
    parents = nodes.select(F.col("key").alias("above"), F.col("least").alias("parent"))
    nothing = F.sha2(F.lit(b""), 256)
    inner = nodes.join(folded, "key").join(parents, "above", "left").join(_ends(members), "key", "left").select(F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"))
    tails = turns.join(retired.withColumnRenamed("depth", "from"), "conv").where("depth > from")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    goes_on = F.col("depth") < F.col("length")
    chains = tails.select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), goes_on.cast("bigint").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(goes_on, nothing).otherwise(F.sha2(F.col("conv").cast("string").cast("binary"), 256)).alias("ends_sha256"))
    return inner.unionByName(chains)


def conversation_trie(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """trie() of the conversations of a table of turns as they are."""
    turns = turns_in_order(df, key=key, turn=turn, role=role, text=text)
    turns = write_table(turns.select("conv", (F.col("nth") + 1).alias("depth"), "hash", "chars"), "turns")
    return trie(turns.select("conv").distinct(), turns)


#: The query over ``conversations`` for DuckDB; crc32 is written out, eight shifts for each byte.
ORACLE = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
        lambda p, q: list_reduce([xor(p, q), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
s AS (SELECT h.c, 0 AS k, t.i, t.r, t.x FROM h JOIN t ON t.c = h.b AND t.i < h.h UNION ALL SELECT h.c, 1, t.i, t.r, t.x FROM h JOIN t ON t.c = h.c AND t.i >= h.h),
l AS (SELECT c, list({'r': r, 'x': x} ORDER BY k, i) AS w FROM s GROUP BY c),
a AS (SELECT h.c, coalesce(w, []) AS w FROM h LEFT JOIN l USING (c)),
p AS (SELECT c, len(w) AS n, d, w[1:d] AS p, w[1:d - 1] AS o, CASE WHEN d > 0 THEN length(w[d].x) ELSE 0 END AS z FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM a)),
n AS (SELECT p, d, min(c) AS conv_id, any_value(o) AS o, count(*) AS n_convs, any_value(z) AS z, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends FROM p GROUP BY p, d),
g AS (SELECT o AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY o, d),
m AS (SELECT n.p, coalesce(n_children, 0) AS n_children, (n_convs - 1) * z AS own, unnest(range(0, n.d + 1)) AS e FROM n LEFT JOIN g ON n.p = g.p AND n.d = g.d),
f AS (SELECT p[1:e] AS p, e AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM m GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN q.conv_id END AS parent_conv_id, n.n_convs, coalesce(g.n_children, 0) AS n_children, f.n_leaves, CAST(f.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN g ON n.p = g.p AND n.d = g.d JOIN f ON n.p = f.p AND n.d = f.d LEFT JOIN n q ON n.o = q.p AND n.d - 1 = q.d
"""
