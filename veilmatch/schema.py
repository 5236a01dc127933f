"""Schemas and the canonical order of candidate pairs.

Records are (dset_i INT, rec_i BIGINT, clk BINARY, ...): party, id within the
party, bit string; further columns may hold what blocking needs.  Candidate pairs
are (sim, dset_i0, dset_i1, rec_i0, rec_i1).  Solvers and statistics consume pairs
in canonical order, which is always named and never left to row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = T.StructType(
    [
        T.StructField("sim", T.DoubleType()),
        T.StructField("dset_i0", T.IntegerType()),
        T.StructField("dset_i1", T.IntegerType()),
        T.StructField("rec_i0", T.LongType()),
        T.StructField("rec_i1", T.LongType()),
    ]
)
GROUPS = T.StructType(
    [
        T.StructField("group_id", T.StructType([T.StructField("dset_i", T.IntegerType()), T.StructField("rec_i", T.LongType())])),
        T.StructField("dset_i", T.IntegerType()),
        T.StructField("rec_i", T.LongType()),
    ]
)
PAIR_COLUMNS = PAIRS.names


def canonical_order() -> list[Column]:
    return [F.col("sim").desc(), F.col("dset_i0"), F.col("dset_i1"), F.col("rec_i0"), F.col("rec_i1")]


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs by similarity from the top, ties by dataset and record ids."""
    return pairs.orderBy(*canonical_order())


def collection(datasets: Sequence[DataFrame]) -> DataFrame:
    """One records table from a sequence of datasets (rec_i, clk, ...); the party is the place in the sequence."""
    if not datasets:
        raise ValueError("no datasets given")
    out = None
    for i, d in enumerate(datasets):
        part = d.withColumn("dset_i", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def empty_pairs(spark) -> DataFrame:
    return spark.createDataFrame([], PAIRS)
