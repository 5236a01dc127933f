"""Candidate pairs of a stream of new records against a static, blocked index.

The index is an ordinary table, keyed by block; a micro-batch joins it on the
block key, so each new record meets only the records of its blocks.  Nothing is
kept between micro-batches.  Limits k and solving need all pairs and are left to
batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.functions.blocking import Blocking, Record
from veilmatch.operators.candidates import encode_records
from veilmatch.operators.similarity import DICE, Side, Similarity, named


def block_index(records: DataFrame, blocking: Blocking, n_bytes: int) -> DataFrame:
    """(dset_i, rec_i, pc, w0 .., _keys, _key): one row per record and block, to be written partitioned or bucketed by _key."""
    others = [c for c in records.columns if c not in ("dset_i", "rec_i", "clk")]
    n = -(-n_bytes // 8)
    rows = encode_records(records, n_bytes, *others)
    keys = F.array_distinct(blocking(Record([F.col(f"w{i}") for i in range(n)], 8 * n_bytes)))
    return rows.withColumn("_keys", keys).select("dset_i", "rec_i", "pc", *[f"w{i}" for i in range(n)], "_keys", F.explode("_keys").alias("_key"))


def link_stream(stream: DataFrame, index: DataFrame, blocking: Blocking, n_bytes: int, *, similarity: Similarity | str = DICE, threshold: float = 0.0) -> DataFrame:
    """Streaming candidate pairs (sim, dset_i0, dset_i1, rec_i0, rec_i1) of ``stream`` (records) with ``index`` of earlier datasets.

    Stateless: each pair comes once, in the first block that the two records share.
    """
    sim, n = named(similarity), -(-n_bytes // 8)
    new = block_index(stream, blocking, n_bytes)
    a, b = Side("a_", n), Side("b_", n)
    left = index.select(*[F.col(c).alias(f"a_{c}") for c in index.columns])
    right = new.select(*[F.col(c).alias(f"b_{c}") for c in new.columns])
    first = a["_key"] == F.array_min(F.array_intersect(a["_keys"], b["_keys"]))
    joined = right.join(left, (a["_key"] == b["_key"]) & (a["dset_i"] < b["dset_i"]) & first)
    return joined.select(
        sim.column(a, b, 8 * n_bytes).cast("double").alias("sim"),
        a["dset_i"].alias("dset_i0"),
        b["dset_i"].alias("dset_i1"),
        a["rec_i"].alias("rec_i0"),
        b["rec_i"].alias("rec_i1"),
    ).where(F.col("sim") >= F.lit(float(threshold)))
