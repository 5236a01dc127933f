"""Pairs that decide the groups of a full product, made by bands of falling thresholds.

Solvers take the best pairs first, and groups only grow.  Once all pairs down to some
score are solved, two groups that share a dataset never merge: if datasets may not occur
twice, or if all cross pairs are wanted, as pairs inside a dataset are not made.  So the
pairs of the next band are made only for records whose groups share no dataset: records
go by the datasets of their group instead of their own, and tiles of kinds that share one
are not compared.  Bands hold about as many pairs as a task folds, told by counts of pairs by
score, which tasks add up where they make the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.operators import solving
from veilmatch.operators.candidates import _counted, find_candidate_pairs
from veilmatch.operators.similarity import Similarity, named
from veilmatch.plans.product import product_pairs
from veilmatch.schema import PAIR_COLUMNS, PAIRS, empty_pairs
from veilmatch.session import share_code, write_table

#: Kinds of records (dataset, datasets of its group) that are told apart, at most; parts of the range of scores that bands are cut at.
MOST_KINDS, GRID = 256, 4096


def score_counts(records: DataFrame, similarity: Similarity | str, threshold: float) -> DataFrame:
    """(sim, n): numbers of all candidate pairs by score; no pair leaves its task."""
    sim, spark = named(similarity), records.sparkSession
    share_code(spark)
    if sim.counts is not None:
        table, histogram, n_bytes, local = _counted(records)
        if n_bytes is None:
            return spark.createDataFrame([], "sim double, n bigint")
        if n_bytes:
            return write_table(product_pairs(table, histogram, sim, float(threshold), 8 * n_bytes, None, local, scores=True).groupBy("sim").agg(F.sum("n").alias("n")), "scores")
    return write_table(find_candidate_pairs(records, sim, threshold, in_order=False).groupBy("sim").agg(F.count("*").alias("n")), "scores")


def cut_for(counts: DataFrame, aim: int, threshold: float) -> float:
    """The lowest score, of a grid, that at most ``aim`` pairs reach, or the highest one that any does; ``threshold`` if all may."""
    part = F.floor(F.col("sim") * GRID)
    total, cut = 0, None
    for part, n in sorted(map(tuple, counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect()), reverse=True):  # GRID + 1 rows at most
        total += n
        if total > aim and cut is not None:
            return cut
        cut = max(part / GRID, threshold)
    return threshold


class _Kinds:
    """Records by (dataset, datasets of their group), one number each, and pairs of them whose groups share no dataset."""

    def __init__(self, records: DataFrame, groups: DataFrame | None):
        """``groups``: (g_dset, g_rec, dset_i, rec_i)."""
        own = F.array(F.col("dset_i").cast("bigint"))
        if groups is None:
            rows = records.withColumn("parties", own)
        else:
            parties = groups.groupBy("g_dset", "g_rec").agg(F.sort_array(F.collect_set("dset_i")).alias("parties"))
            known = groups.join(parties, ["g_dset", "g_rec"]).select(F.col("dset_i").cast("int").alias("dset_i"), "rec_i", "parties")
            rows = records.join(known, ["dset_i", "rec_i"], "left").withColumn("parties", F.coalesce("parties", own))
        self.rows = write_table(rows, "kinds")
        kinds = sorted((r["dset_i"], tuple(r["parties"])) for r in self.rows.select("dset_i", "parties").distinct().limit(MOST_KINDS + 1).collect())
        self.many = len(kinds) > MOST_KINDS
        every = {p for _, parties in kinds for p in parties}
        self.kinds = [k for k in kinds if set(k[1]) != every]  # a group of all datasets stays as it is
        self.allowed = np.array([[not set(p) & set(q) for _, q in self.kinds] for _, p in self.kinds], bool).reshape(len(self.kinds), len(self.kinds))

    def numbered(self) -> DataFrame:
        spark = self.rows.sparkSession
        names = spark.createDataFrame([(i, d, list(p)) for i, (d, p) in enumerate(self.kinds)], "kind int, dset_i int, parties array<bigint>")
        return self.rows.join(F.broadcast(names), ["dset_i", "parties"]).select(F.col("kind").alias("dset_i"), "rec_i", "clk")

    def named(self, pairs: DataFrame) -> DataFrame:
        dset = F.array(*[F.lit(d) for d, _ in self.kinds])  # kinds are in the order of datasets, so the lower one stays left
        sides = [F.get(dset, F.col(f"dset_i{i}")).cast("int").alias(f"dset_i{i}") for i in (0, 1)]
        return pairs.select("sim", *sides, "rec_i0", "rec_i1")


def deciding_pairs(records: DataFrame, similarity: Similarity | str, threshold: float, merge_threshold: float = 1.0, deduplicated: bool = False) -> DataFrame:
    """Written candidate pairs of ``records`` that have the same groups as all of them; see undecided_pairs(), which gets the pairs themselves."""
    sim, spark, aim = named(similarity), records.sparkSession, solving.PREFIX_PAIRS
    records = write_table(records.select(F.col("dset_i").cast("int").alias("dset_i"), F.col("rec_i").cast("bigint").alias("rec_i"), "clk"), "records")

    def every() -> DataFrame:
        return solving.undecided_pairs(write_table(find_candidate_pairs(records, sim, threshold, in_order=False), "pairs"), merge_threshold, deduplicated)

    if sim.counts is None or (not deduplicated and merge_threshold < 1):
        return every()
    order = ["sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1"], [False, True, True, True, True]
    kept, groups, upto = empty_pairs(spark), None, None
    while True:
        kinds = _Kinds(records, groups)
        if kinds.many:
            return every()
        if not kinds.allowed.any():
            return kept
        table, histogram, n_bytes, local = _counted(kinds.numbered())
        if not n_bytes:
            return every() if n_bytes == 0 else kept

        def product(low: float, scores: bool) -> DataFrame:
            found = product_pairs(table, histogram, sim, low, 8 * n_bytes, None, local, allowed=kinds.allowed, scores=scores)
            return found if upto is None else found.where(F.col("sim") < upto)

        counts = write_table(product(float(threshold), True).groupBy("sim").agg(F.sum("n").alias("n")), "scores")
        low = cut_for(counts, aim, float(threshold))
        band = kinds.named(product(low, False)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAIRS])
        kept = write_table(kept.unionByName(band), "deciding")
        if low <= threshold:
            return kept
        groups, upto = write_table(solving._solved(kept, merge_threshold, deduplicated, *order), "first-groups"), low
        size = kept.count()
        kept = write_table(solving.live_pairs(kept, groups).select(*PAIR_COLUMNS), "deciding")
        aim = aim if kept.count() <= 0.8 * size else 4 * aim
