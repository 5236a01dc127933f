"""Connected components of links by alternating large and small stars.

Each round is two joins and two aggregations over the links and ends in a written
table; the driver sees one checksum per round and no link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.session import write_table

ROUNDS = 60


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node ``u`` (the greater ones, or else the smaller ones and itself) to the smallest node around it."""
    if large:
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    down = both.where("v < u")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (comparable columns a, b); root is the smallest node of its component."""
    now = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        around = _star(_both(now), True).where("a <> b").distinct()
        now = write_table(_star(_both(around), False).where("a <> b").distinct(), "links")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
