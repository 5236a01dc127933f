"""Tiles of comparisons: planning them and working on one.

Spark deals work out by itself; tiles are for callers who schedule or resume
parts of a comparison on their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmatch.functions.blocking import Blocking
from veilmatch.operators.candidates import find_candidate_pairs
from veilmatch.operators.similarity import DICE, Similarity


def _counts(size0: int, size1: int, aim: float) -> tuple[int, int]:
    across = round(size0 / aim**0.5) or 1
    return across, round(size1 * (size0 / across) / aim) or 1


def _ranges(size: int, parts: int) -> list[list[int]]:
    at = [round(i * (size / parts)) for i in range(parts)] + [size]
    return [list(x) for x in zip(at, at[1:])]


def split_to_chunks(chunk_size_aim: float, *, dataset_sizes: Sequence[int]) -> Iterator[list[dict]]:
    """Tiles of about ``chunk_size_aim`` comparisons that cover each cross-dataset comparison once; JSON-serialisable."""
    sizes = [(i, int(n)) for i, n in enumerate(dataset_sizes)]
    for (i, n), (j, m) in combinations([(i, n) for i, n in sizes if n], 2):
        across, down = _counts(n, m, float(chunk_size_aim))
        for a in _ranges(n, across):
            for b in _ranges(m, down):
                yield [{"datasetIndex": i, "range": a}, {"datasetIndex": j, "range": b}]


def chunks_table(spark: SparkSession, chunk_size_aim: float, sizes: DataFrame) -> DataFrame:
    """The same tiles as rows (dset_i0, a0, b0, dset_i1, a1, b1), made by Spark from ``sizes`` (dset_i, n)."""
    aim = float(chunk_size_aim)
    s = sizes.where("n > 0")
    pair = s.select(F.col("dset_i").alias("dset_i0"), F.col("n").alias("n0")).join(s.select(F.col("dset_i").alias("dset_i1"), F.col("n").alias("n1")), F.col("dset_i0") < F.col("dset_i1"))
    one = F.lit(1.0)

    def half_even(x):
        return F.bround(x, 0)

    pair = pair.withColumn("c0", F.greatest(half_even(F.col("n0") / F.sqrt(F.lit(aim))), one))
    pair = pair.withColumn("c1", F.greatest(half_even(F.col("n1") * (F.col("n0") / F.col("c0")) / F.lit(aim)), one))

    def cut(n: str, c: str, i: str):
        size, parts, at = F.col(n), F.col(c), F.col(i)
        end = F.when(at + 1 == parts, size).otherwise(half_even((at + 1) * (size / parts)).cast("bigint"))
        return half_even(at * (size / parts)).cast("bigint"), end

    def places(c: str):
        return F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))

    # A row per tile of the first dataset is few bytes: a number of one's own keeps them apart, and no task makes all tiles.
    tasks = 4 * spark.sparkContext.defaultParallelism
    across = pair.withColumn("i", places("c0")).repartition(tasks, "dset_i0", "dset_i1", "i")
    (a0, b0), (a1, b1) = cut("n0", "c0", "i"), cut("n1", "c1", "j")
    return across.withColumn("j", places("c1")).select("dset_i0", a0.alias("a0"), b0.alias("b0"), "dset_i1", a1.alias("a1"), b1.alias("b1"))


def _validated(chunk: Sequence[dict], records: DataFrame) -> list[tuple[int, int, int]]:
    if len(chunk) != 2:
        raise NotImplementedError(f"a chunk names two ranges, not {len(chunk)}")
    out = []
    for part in chunk:
        for name in ("datasetIndex", "range"):
            if name not in part:
                raise ValueError(f"chunk lacks {name!r}")
        a, b = part["range"]
        if b < a:
            raise ValueError(f"range ends before it begins: {part['range']}")
        out.append((int(part["datasetIndex"]), int(a), int(b)))
    if out[0][0] == out[1][0]:
        raise ValueError("a chunk compares two different datasets")
    return out


def process_chunk(chunk: Sequence[dict], records: DataFrame, similarity: Similarity | str = DICE, threshold: float = 0.0, k: int | None = None, blocking: Blocking | None = None, *, in_order: bool = True) -> DataFrame:
    """Candidate pairs of one tile, with global ids; ``k`` holds inside the tile."""
    (i, a0, b0), (j, a1, b1) = _validated(chunk, records)
    d, r = F.col("dset_i"), F.col("rec_i")
    part = records.where(((d == i) & (r >= a0) & (r < b0)) | ((d == j) & (r >= a1) & (r < b1)))
    return find_candidate_pairs(part, similarity, threshold, k, blocking, in_order=in_order)
