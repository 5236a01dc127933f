"""Large blocks as tiles of common-bit counts.

A block of many records is dealt twice: to its key, then to tiles by popcount, so
that pairs of tiles whose counts cannot reach the threshold are never formed and
each of the others is a unit of work of bounded size, whatever the size of the
block.  Tiles come from the histogram (key, party, popcount) by running sums; no
part of it reaches the driver but the number of pairs of tiles.  A pair of tiles is
compared by the matrix kernel of the full product.

A tile has an eighth of a party's records in the block, but ``SMALLEST`` to
``LARGEST``, so a record is sent to eight tiles of another party or to one in
``LARGEST`` of its records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmatch.plans.product import LARGEST, MOST_TASKS, Records, hits_of
from veilmatch.session import write_table

if TYPE_CHECKING:
    from veilmatch.operators.similarity import Similarity

SMALLEST = 1024


def _tiles(keyed: DataFrame) -> DataFrame:
    """(_key, dset_i, pc, first, parts): the tiles among which records of a popcount are dealt."""
    party = Window.partitionBy("_key", "dset_i")
    counts = keyed.groupBy("_key", "dset_i", "pc").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(party.orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aim = F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.sum("n").over(party) / 8))
    placed = counts.select("_key", "dset_i", "pc", F.floor(before / aim).cast("int").alias("first"), F.greatest(F.lit(1), F.ceil(F.col("n") / aim)).cast("int").alias("parts"))
    return write_table(placed, "tiles")


def _met(tiles: DataFrame, similarity: Similarity, threshold: float, n_bits: int) -> DataFrame:
    """(_key, pair, dset_i0, tile0, dset_i1, tile1): pairs of tiles of a block that popcounts let reach ``threshold``."""
    every = tiles.select("_key", "dset_i", "pc", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("tile"))
    ranges = every.groupBy("_key", "dset_i", "tile").agg(F.min("pc").alias("low"), F.max("pc").alias("high"))
    a, b = (ranges.select("_key", *[F.col(c).alias(f"{c}{i}") for c in ("dset_i", "tile", "low", "high")]) for i in (0, 1))
    on = F.col("dset_i0") < F.col("dset_i1")
    if similarity.best is not None:  # the closest counts of two ranges score best; of those they share, the highest
        top = F.least("high0", "high1")
        on = on & (similarity.best(F.greatest("low0", top), F.greatest("low1", top), n_bits) >= F.lit(float(threshold)))
    return write_table(a.join(b, "_key").where(on).select("_key", F.monotonically_increasing_id().alias("pair"), "dset_i0", "tile0", "dset_i1", "tile1"), "tile-pairs")


def _side(rows: pa.Table, side: int, n_words: int) -> tuple[Records, list | None]:
    mine = rows.filter(pa.array(rows.column("side").to_numpy() == side))
    words = np.stack([mine.column(f"w{i}").to_numpy() for i in range(n_words)], axis=1) if n_words else np.zeros((len(mine), 0), np.int64)
    bits = np.ascontiguousarray(words.astype(">i8")).view(np.uint8).reshape(len(mine), 8 * n_words)
    keys = mine.column("_keys").to_pylist() if "_keys" in mine.column_names else None
    return (bits, *(mine.column(c).to_numpy() for c in ("pc", "rec_i", "dset_i"))), keys


def _lower_keys(keys: list, key: str) -> tuple[np.ndarray, list]:
    """(record, key) of the keys below ``key``: in one of those a pair is met before."""
    lower = [(i, x) for i, own in enumerate(keys) for x in own if x < key]
    return np.array([i for i, _ in lower], np.int64), [x for _, x in lower]


def _met_before(keys_a: list, keys_b: list, key: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function of rows of two tiles of block ``key``: whether two records share a key below it."""
    (at_a, lower_a), (at_b, lower_b) = _lower_keys(keys_a, key), _lower_keys(keys_b, key)
    code = {x: i for i, x in enumerate(sorted(set(lower_a) & set(lower_b)))}
    if not code:
        return lambda x, y: np.zeros(len(x), bool)
    # a bit for each key that both tiles have; a record with several of them has all in its words
    masks = []
    for n, at, lower in ((len(keys_a), at_a, lower_a), (len(keys_b), at_b, lower_b)):
        has = np.zeros((n, -(-len(code) // 64)), np.uint64)
        shared = np.array([x in code for x in lower], bool)
        bit = np.array([code[x] for x in lower if x in code], np.int64)
        np.bitwise_or.at(has, (at[shared], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        masks.append(has)
    a, b = masks

    def met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for w in range(a.shape[1]):
            out |= (a[x, w] & b[y, w]) != 0
        return out

    return met


def large_block_pairs(keyed: DataFrame, similarity: Similarity, threshold: float, n_words: int, n_bits: int, k: int | None) -> DataFrame:
    """(sim, dset_i0, dset_i1, rec_i0, rec_i1) and, with ``k``, _block of the records ``keyed`` (dset_i, rec_i, pc, w0 .., _key, _keys).

    Without ``k`` a pair comes from the first block that its records share only.
    """
    tiles = _tiles(keyed)
    met = _met(tiles, similarity, threshold, n_bits)
    many = max(1, min(MOST_TASKS, met.count()))
    ways = [met.select("_key", F.col(f"dset_i{s}").alias("dset_i"), F.col(f"tile{s}").alias("tile"), "pair", F.lit(s).alias("side")) for s in (0, 1)]
    words = [f"w{i}" for i in range(n_words)]
    once = k is None
    names = ["sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1", *([] if once else ["_block"])]
    tile = (F.col("first") + F.pmod(F.xxhash64("rec_i"), F.col("parts"))).cast("int")
    sent = keyed.join(tiles, ["_key", "dset_i", "pc"]).withColumn("tile", tile).join(ways[0].unionByName(ways[1]), ["_key", "dset_i", "tile"])
    sent = sent.select("pair", "side", "dset_i", "rec_i", "pc", "_key", *words, *(["_keys"] if once else [])).repartition(many, "pair").sortWithinPartitions("pair")

    def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        key = rows.column("_key")[0].as_py()
        (left, keys_a), (right, keys_b) = (_side(rows, s, n_words) for s in (0, 1))
        met_before = _met_before(keys_a, keys_b, key) if once else None
        for sim, x, y in hits_of(left, right, similarity, threshold, n_bits, k):
            if once:
                new = ~met_before(x, y)
                sim, x, y = sim[new], x[new], y[new]
            columns = [pa.array(sim), pa.array(left[3][x]), pa.array(right[3][y]), pa.array(left[2][x]), pa.array(right[2][y])]
            yield pa.RecordBatch.from_arrays([*columns, *([] if once else [pa.repeat(pa.scalar(key, pa.string()), len(sim))])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = b.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if held and i < j and held[-1].column("pair")[0].as_py() != at[i]:
                    yield from compared(held)
                    held = []
                if i < j:
                    held.append(b.slice(i, j - i))
        if held:
            yield from compared(held)

    return sent.mapInArrow(run, "sim double, dset_i0 int, dset_i1 int, rec_i0 bigint, rec_i1 bigint" + ("" if once else ", _block string"))
