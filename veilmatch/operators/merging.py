"""Greedy grouping of one large component in rounds of merges that cannot conflict.

Pairs have places in the order of priority.  Two groups g and h merge at the first
pair between them, after both were formed, by which at least
``merge_threshold * |g| * |h|`` of their cross pairs were seen.  Pairs before that only
count, in any order, so a round takes whole counts instead of single pairs:

1. Per edge (two groups and the places of their pairs): the place of its merge, if
   its groups stay as they are, and of its next pair.  An edge is dead if its groups
   may never be one (a dataset would occur twice, or all cross pairs are wanted and
   one is missing), and its pairs go.
2. Per group: the earliest place at which anything can change it.  That is its
   first merge; but where an edge has enough pairs already and waits (only below
   a threshold of 1), joined with another edge it might merge at the group's very next pair.
3. Edges whose merge is the earliest change of both their groups are carried out,
   all at once, as no group occurs in two of them.  Groups that wait move past a
   next pair that merges nothing.
4. The graph is contracted: pairs take the names, sizes and times of the new groups.

The result is that of taking pairs one by one.  Rounds are written tables; the
driver sees whether something changed.  What is left after ``rounds`` is contracted;
its components are folded, each in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmatch.operators.components import components
from veilmatch.session import share_code, write_table

#: Rounds before the contracted rest is folded.
MERGE_ROUNDS = 100
_LATE = (1 << 63) - 1


def _judged(rows: DataFrame, threshold: float, deduplicated: bool) -> DataFrame:
    """Rows of live edges with the place of the edge's merge, its next pair and whether it waits."""
    edge = Window.partitionBy("a.id", "b.id")
    need = F.lit(float(threshold)) * F.col("a.size") * F.col("b.size")
    since = F.greatest("a.since", "b.since")
    rows = rows.withColumn("nth", F.row_number().over(edge.orderBy("place"))).withColumn("enough", F.col("nth") >= need).withColumn("later", F.col("place") > since)
    rows = rows.select(
        "place",
        "a",
        "b",
        (F.col("nth") == 1).alias("first"),
        F.min(F.when(F.col("later") & F.col("enough"), F.col("place"))).over(edge).alias("merge"),
        F.min(F.when(F.col("later"), F.col("place"))).over(edge).alias("next"),
        F.lit(False).alias("waits") if threshold >= 1 else F.max(~F.col("later") & F.col("enough")).over(edge).alias("waits"),
        *([F.count("*").over(edge).alias("pairs")] if threshold >= 1 else []),
    )
    if threshold >= 1:
        rows = rows.where(F.col("pairs") >= F.col("a.size") * F.col("b.size")).drop("pairs")
    return rows.where(~F.arrays_overlap("a.parties", "b.parties")) if deduplicated else rows


def _changes(edges: DataFrame) -> DataFrame:
    """(old, new, merged): the groups that change, as they become, and the place of the pair that merged them."""
    sides = [edges.select(F.col(f"{s}.id").alias("id"), "merge", "next", "waits") for s in "ab"]
    first = sides[0].unionByName(sides[1]).groupBy("id").agg(F.min("merge").alias("merge"), F.min("next").alias("next"), F.max("waits").alias("waits"))
    first = first.select("id", F.coalesce(F.when(F.col("waits"), F.col("next")).otherwise(F.col("merge")), F.lit(_LATE)).alias("first"), F.col("waits").alias("waiting"))
    met = edges.withColumn("ka", F.col("a.id")).withColumn("kb", F.col("b.id"))
    for s in "ab":
        met = met.join(first.select(F.col("id").alias(f"k{s}"), F.col("first").alias(f"first_{s}"), F.col("waiting").alias(f"waiting_{s}")), f"k{s}")
    merges = (F.col("merge") == F.col("first_a")) & (F.col("merge") == F.col("first_b"))
    together = F.struct(F.col("a.id").alias("id"), (F.col("a.size") + F.col("b.size")).alias("size"), F.col("merge").alias("since"), F.array_union("a.parties", "b.parties").alias("parties"))
    out = [met.where(merges).select(F.col(f"{s}.id").alias("old"), together.alias("new"), F.col("merge").alias("merged")) for s in "ab"]
    for s, o in ("ab", "ba"):
        passes = F.col(f"waiting_{s}") & (F.col("next") == F.col(f"first_{s}")) & (F.col(f"first_{o}") >= F.col("next")) & ~F.coalesce(F.col("merge") == F.col("next"), F.lit(False))
        later = F.struct(F.col(f"{s}.id").alias("id"), F.col(f"{s}.size").alias("size"), F.col("next").alias("since"), F.col(f"{s}.parties").alias("parties"))
        out.append(met.where(passes).select(F.col(f"{s}.id").alias("old"), later.alias("new"), F.lit(None).cast("bigint").alias("merged")))
    return reduce(DataFrame.unionByName, out)


def _contracted(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Pairs between the groups as they are now."""
    for s in "ab":
        rows = rows.withColumn("old", F.col(f"{s}.id")).join(changes.select("old", F.col("new").alias("new")), "old", "left").withColumn(s, F.coalesce("new", s)).drop("old", "new")
    return rows.where("a.id <> b.id").select("place", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fold_groups(rows: Sequence[tuple], threshold: float, deduplicated: bool) -> list[int]:
    """Places of the merges among sorted pairs (place, a, size, since, parties, b, size, since, parties) of contracted groups."""
    name: dict = {}
    size: dict = {}
    since: dict = {}
    parties: dict = {}
    seen: dict = defaultdict(lambda: defaultdict(int))
    merged = []

    def find(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for place, a, n, t, p, b, m, u, q in rows:
        for x, k, w, z in ((a, n, t, p), (b, m, u, q)):
            if x not in size:
                size[x], since[x], parties[x] = k, w, set(z)
        a, b = find(a), find(b)
        if a == b:
            continue
        seen[a][b] = seen[b][a] = seen[a][b] + 1
        if place <= max(since[a], since[b]) or seen[a][b] < threshold * size[a] * size[b] or (deduplicated and parties[a] & parties[b]):
            continue
        name[b] = a
        size[a] += size.pop(b)
        since[a] = place
        parties[a] |= parties.pop(b)
        for c, count in seen.pop(b).items():
            del seen[c][b]
            if c != a:
                seen[a][c] = seen[c][a] = seen[a][c] + count
        merged.append(place)
    return merged


def _rest(rows: DataFrame, threshold: float, deduplicated: bool) -> DataFrame:
    """(merged): merges among contracted pairs, folded by component."""
    rows = write_table(rows, "rest")
    roots = components(rows.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [[(x["id"]["d"], x["id"]["r"]), x["size"], x["since"], x["parties"]] for s in "ab" for x in pdf[s]]
        n = len(pdf)
        every = sorted((p, *x, *y) for p, x, y in zip(pdf["place"].tolist(), sides[:n], sides[n:]))
        return pd.DataFrame({"merged": fold_groups(every, threshold, deduplicated)}, dtype="int64")

    return rows.withColumn("node", F.col("a.id")).join(roots, "node").drop("node").groupBy("root").applyInPandas(run, "merged bigint")


def merge_rounds(pairs: DataFrame, merge_threshold: float, deduplicated: bool, order: Sequence[Column], rounds: int = MERGE_ROUNDS) -> DataFrame:
    """(node, root): groups of at least two records, as (dset, rec) structs (d, r); root is a group's smallest record.

    ``pairs``: (dset_i0, rec_i0, dset_i1, rec_i1, ...), taken as if one by one in ``order``.
    """
    share_code(pairs.sparkSession)
    x, y = (F.struct(F.col(f"dset_i{i}").cast("bigint").alias("d"), F.col(f"rec_i{i}").cast("bigint").alias("r")) for i in (0, 1))
    given = write_table(pairs.withColumn("x", x).withColumn("y", y).where("x <> y").orderBy(*order).select(F.monotonically_increasing_id().alias("place"), "x", "y"), "places")
    a, b = (F.struct(F.col(c).alias("id"), F.lit(1).cast("bigint").alias("size"), F.lit(-1).cast("bigint").alias("since"), F.array(F.col(f"{c}.d") if deduplicated else F.lit(0).cast("bigint")).alias("parties")) for c in "xy")
    rows = given.select("place", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    merged = []
    for _ in range(rounds):
        live = write_table(_judged(rows, merge_threshold, deduplicated), "live")
        changes = write_table(_changes(live.where("first")), "changes")
        if changes.isEmpty():
            break
        merged.append(changes.where("merged is not null").select("merged"))
        rows = _contracted(live.select("place", "a", "b"), changes)
    else:
        merged.append(_rest(rows, merge_threshold, deduplicated))
    places = reduce(DataFrame.unionByName, merged) if merged else given.sparkSession.createDataFrame([], "merged bigint")
    links = given.join(places.distinct(), F.col("place") == F.col("merged")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return components(links)
