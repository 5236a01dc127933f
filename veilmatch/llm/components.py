"""Connected components of link tables by alternating large and small stars.

Every round is two joins and three aggregations over the links and ends in a
written table, so lineage stays short and no link reaches the driver; the driver
sees one checksum per round.  A node of very many links is a skewed join key,
which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.llm.common import drop_table, write_table

#: Stars halve the distance to a root, so this suffices for chains of any length that fits a cluster.
ROUNDS = 60


def _round(now: DataFrame) -> DataFrame:
    """A large and a small star over links (a, b) with a > b: neighbours above a node, then those below it, are linked to the smallest node around it."""
    both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node of the component.

    Loops and repeated links are harmless; nulls are dropped; no links give no rows.
    """
    now = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        new = write_table(_round(now), "links")
        drop_table(now)
        now = new
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.min("a"), F.max("b")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not converge")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._veil_path = now._veil_path  # type: ignore[attr-defined]  # for drop_table()
    return out
