"""Tiles of comparisons in one job that can be killed and run again.

Every tile of split_to_chunks() becomes a file of a folder, which gets its name when
the tile is whole.  The folder is the ledger: a run compares only tiles whose file
is not there, whatever ended the run before.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.operators.candidates import _both, _counted, _limit_block
from veilmatch.operators.chunks import _validated
from veilmatch.operators.similarity import DICE, Similarity, named
from veilmatch.plans.product import MOST_TASKS, _batches, _tile
from veilmatch.schema import PAIR_COLUMNS, empty_pairs
from veilmatch.sources.files import files_at, filesystem

Tile = tuple[int, int, int, int, int, int]


def _tile_of(chunk: Sequence[dict], records: DataFrame) -> Tile:
    """(party, from, to, party, from, to), the lower party first."""
    return tuple(x for part in sorted(_validated(chunk, records)) for x in part)


def _name(tile: Tile, rule: str) -> str:
    """Tiles of other similarities, thresholds and limits have other names."""
    return f"tile-{'-'.join(map(str, tile))}-{zlib.crc32(rule.encode()):08x}.parquet"


def finished_tiles(folder: str) -> set[str]:
    """Names of the tiles that are whole."""
    try:
        return {file.rpartition("/")[2] for file, _ in files_at(folder)}
    except FileNotFoundError:
        return set()


def run_chunks(records: DataFrame, chunks: Sequence[Sequence[dict]], folder: str, similarity: Similarity | str = DICE, threshold: float = 0.0, k: int | None = None) -> DataFrame:
    """Candidate pairs of all tiles with global ids, not in order; ``k`` holds inside each tile.

    One job compares the tiles whose file is not in ``folder`` yet, which executors
    and driver must share.  A tile is held by one task.  Records must be those of the
    runs before.  A tile without records on a side leaves no file and costs nothing.
    """
    sim = named(similarity)
    if sim.counts is None:
        raise ValueError("tiles are compared by counts of bits")
    if k is not None and k < 0:
        raise ValueError(f"k must not be negative, but is {k}")
    spark = records.sparkSession
    tiles = sorted({_tile_of(c, records) for c in chunks})
    rule = json.dumps([sim.name, float(threshold), k])
    names = [_name(t, rule) for t in tiles]
    done = finished_tiles(folder)
    missing = [i for i, n in enumerate(names) if n not in done]
    if missing and k != 0:
        _compare([(tiles[i], names[i]) for i in missing], records, folder, sim, float(threshold), k)
    whole = finished_tiles(folder)
    paths = [f"{folder.rstrip('/')}/{n}" for n in names if n in whole]
    if not paths or k == 0:
        return empty_pairs(spark)
    pairs = spark.read.schema("sim double, dset_i0 int, dset_i1 int, rec_i0 bigint, rec_i1 bigint, tile string").parquet(*paths)
    if k is not None:
        pairs = _both(_limit_block(pairs, sim, k, ["tile"]), k, ["tile", "rec_i0"], ["tile", "rec_i1"])
    return pairs.select(*PAIR_COLUMNS)


def _compare(tiles: list[tuple[Tile, str]], records: DataFrame, folder: str, sim: Similarity, threshold: float, k: int | None) -> None:
    table, _, n_bytes, _ = _counted(records)
    if not n_bytes:
        return
    spark = records.sparkSession
    ranges = sorted({r for t, _ in tiles for r in (t[:3], t[3:])})
    number = {r: i for i, r in enumerate(ranges)}
    routes = spark.createDataFrame([(number[t[3 * s : 3 * s + 3]], i, s) for i, (t, _) in enumerate(tiles) for s in (0, 1)], "range int, tile int, side int")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dset, rec = (b.column(c).to_numpy() for c in ("dset_i", "rec_i"))
            for i, (d, low, high) in enumerate(ranges):
                inside = np.flatnonzero((dset == d) & (rec >= low) & (rec < high))
                if len(inside):
                    rows = b.take(pa.array(inside))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(inside), i, np.int32))], [*b.schema.names, "range"])

    parts = min(MOST_TASKS, len(tiles))
    sent = table.mapInArrow(place, "dset_i int, rec_i bigint, clk binary, pc int, range int").join(F.broadcast(routes), "range")
    sent = sent.select("tile", "side", "dset_i", "rec_i", "pc", "clk").repartitionById(parts, F.pmod("tile", F.lit(parts)).cast("int")).sortWithinPartitions("tile")

    def finish(tile: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        rows, name = pa.Table.from_batches(held), tiles[tile][1]
        side = rows.column("side").to_numpy()
        left, right = (_tile(rows.filter(pa.array(side == s)), 8 * n_bytes) for s in (0, 1))
        if not len(left[1]) or not len(right[1]):
            return
        system, at = filesystem(folder)
        system.create_dir(at, recursive=True)
        begun, n = f"{at}/_begun-{uuid.uuid4().hex}", 0
        kinds = pa.schema([("sim", pa.float64()), ("dset_i0", pa.int32()), ("dset_i1", pa.int32()), ("rec_i0", pa.int64()), ("rec_i1", pa.int64()), ("tile", pa.string())])
        with system.open_output_stream(begun) as out, pq.ParquetWriter(out, kinds) as writer:
            for b in _batches(left, right, sim, threshold, 8 * n_bytes, k):
                writer.write_batch(pa.RecordBatch.from_arrays([*b.columns, pa.array([name] * len(b), pa.string())], schema=kinds))
                n += len(b)
        if system.get_file_info(f"{at}/{name}").is_file:  # a second attempt of this task was first
            system.delete_file(begun)
        else:
            system.move(begun, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([n], pa.int64())], ["tile", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for b in batches:
            at = b.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and at[i] != now:
                    yield from finish(now, held)
                    held = []
                now = int(at[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from finish(now, held)

    sent.mapInArrow(run, "tile int, n bigint").write.format("noop").mode("overwrite").save()
