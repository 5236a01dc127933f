"""The full product of parties as tiles of common-bit counts.

Without blocking every cross-party pair is compared.  Records are dealt to tiles
by popcount: the histogram of popcounts (at most one row per party and count)
fixes tiles of about equal size that cover narrow ranges of counts.  Pairs of
tiles whose counts cannot reach the threshold are never formed.  Every other pair
of tiles is one partition: records cross the wire packed, once per tile pair, and
are unpacked in blocks whose matrix product, of the bits as 0/1 floats, gives all
common-bit counts exactly.  Only scores that reach the threshold leave the task,
block by block.

Tiles grow with the input up to ``LARGEST`` records, and beyond it where there
would be more than ``MOST_PAIRS`` pairs of tiles, so what is broadcast (tiles and
their pairs) is bounded, and a record is sent to one tile in ``LARGEST`` records
of the other party.

Without a limit, equal bit strings of a tile are compared once, and unions of
neighbouring ones stand for several columns of a product: a left record's common bits
with a union are at least those with each of its members, so where they do not reach the
least need of the members, no member passes.  Members of the other unions are counted one
by one.  Sizes of unions are picked by trial on some rows and columns of each block.

With a limit ``k``, thresholds rise.  Inside a tile, a left record that has met some
columns must beat its k-th best score among them.  Across tiles, the pairs of tiles
are run in waves (each record's nearest tile by popcount first, then ``GROWTH`` times
as many a wave); a wave is told each record's k-th best score of the waves before, in
a table joined to the records, and emits only what reaches it, so about ``k`` pairs of a
record leave each wave instead of ``k`` for each tile it meets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmatch.session import write_table

if TYPE_CHECKING:  # workers import this module first, and the operators import it
    from veilmatch.operators.similarity import Similarity

LARGEST, SMALLEST = 65_536, 128
#: Pairs of tiles aimed at, at most; tasks, at most (further tile pairs share them).
MOST_PAIRS, MOST_TASKS = 1_000_000, 20_000
#: Records of the two sides that one matrix product compares, and pairs gathered before they leave the task.
ROWS, COLUMNS, FLUSH = 512, 8192, 500_000
#: Columns of a product of two limited sides, and records of the other side, at most, that give a record its first floor.
NARROW, SOME = 2048, 512
#: Sizes of unions tried, rows and unions of a trial, least pairs of two tiles that are worth trials, least bits, and the time of a pair counted by itself, in pairs of a product.
UNIONS, TRIAL, WORTH, BROAD, SINGLE = (16, 8, 4, 2), 64, 1 << 20, 256, 14
#: Waves of tile pairs grow by this; tiles of one party that a tile must meet for waves to pay.
GROWTH, WAVES_FROM = 8, 3

_SCHEMA = "sim double, dset_i0 int, dset_i1 int, rec_i0 bigint, rec_i1 bigint"
_COUNTS = "sim double, n bigint"
#: Bits up to which a margin of common bits, in parts of 1/64, is exact in 32-bit floats.
EXACT_BITS = 65_536

Tile = tuple[int, int, int, int, int, int]
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Score that a pair must reach at each left and at each right record: at either one is enough.
Floors = tuple[np.ndarray, np.ndarray]
#: Packed bits, popcounts, ids and parties of a tile's records.
Records = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _tile_table(counts: list[tuple[int, int, int]], aim: int, tile: int = 0) -> list[Tile]:
    """(dset_i, pc, first tile, tiles sharing this pc, lowest pc of the tile, highest) for a histogram (dset_i, pc, n)."""
    out: list[Tile] = []
    by_party: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, pc, n in counts:
        by_party[d].append((pc, n))
    for d in sorted(by_party):
        waiting: list[int] = []
        size = 0

        def close() -> None:
            nonlocal waiting, size, tile
            if waiting:
                out.extend((d, pc, tile, 1, min(waiting), max(waiting)) for pc in waiting)
                tile += 1
            waiting, size = [], 0

        for pc, n in sorted(by_party[d]):
            if n > 1.5 * aim:
                close()
                parts = -(-n // aim)
                out.append((d, pc, tile, parts, pc, pc))
                tile += parts
                continue
            if size and size + n > 1.25 * aim:
                close()
            waiting.append(pc)
            size += n
        close()
    return out


def _tile_pairs(left: list[Tile], right: list[Tile], similarity: Similarity, threshold: float, n_bits: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tiles of different parties (the lower one left; of those that ``allowed`` has) that popcounts let reach ``threshold``."""

    def each(table: list[Tile]) -> np.ndarray:
        return np.array(sorted({(d, first + i, low, high) for d, _, first, parts, low, high in table for i in range(parts)}), np.int64).reshape(-1, 4)

    d1, t1, low1, high1 = each(right).T
    out = []
    for d0, t0, low0, high0 in each(left).tolist():
        met = d1 > d0 if allowed is None else (d1 > d0) & allowed[d0, d1]
        if similarity.best is not None:
            # the best score lies at the closest counts of the two ranges, the highest ones if they meet (no bits: score 0)
            top = np.minimum(high0, high1)
            x, y = np.maximum(low0, top), np.maximum(low1, top)
            met &= similarity.counts(np.minimum(x, y).astype(np.float64), x, y, n_bits) >= threshold
        out.append(np.stack([np.full(np.count_nonzero(met), t0), t1[met]]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 2


def _aims(sizes: dict[int, int], slots: int, wide: bool) -> tuple[int, int]:
    """Records of a left and of a right tile; ``wide``: right tiles as large as they may be, so that limits of left records cut most."""
    total = sum(a * b for i, a in sizes.items() for j, b in sizes.items() if i < j)
    square = max(SMALLEST, min(LARGEST, (total / slots) ** 0.5), (total / MOST_PAIRS) ** 0.5)
    if not wide:
        return int(square), int(square)
    right = max(min(LARGEST, max(sizes.values(), default=1)), square)
    return int(max(SMALLEST, square * square / right)), int(right)


def _rank_within(group: np.ndarray, sim: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rank of each pair in its group by (sim descending, other ascending), from 0."""
    o = np.lexsort((other, -sim, group))
    g = group[o]
    first = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), np.arange(len(g)), 0)) if len(g) else g
    out = np.empty(len(g), np.int64)
    out[o] = np.arange(len(g)) - first
    return out


def product_pairs(records: DataFrame, histogram: list[tuple[int, int, int]], similarity: Similarity, threshold: float, n_bits: int, k: int | None, local: pa.Table | None = None, *, allowed: np.ndarray | None = None, scores: bool = False) -> DataFrame:
    """Pairs (unordered) of all parties that reach ``threshold``; with ``k``, those that the limits can still keep.

    ``allowed[i, j]``, if given: whether parties i < j are compared.  ``scores``: only (sim, n), the numbers of pairs, in several rows each.

    ``records``: (dset_i, rec_i, clk, pc), of which ``histogram`` has the counts (dset_i, pc, n)
    and ``local``, if given, the rows: few enough to be sent to every executor.
    """
    spark = records.sparkSession
    sizes: dict[int, int] = defaultdict(int)
    for d, _, n in histogram:
        sizes[d] += n
    one_sided = k is not None and not similarity.two_sided
    # shuffled tiles differ much in what popcounts and unions save, so there are many more tasks than slots
    aims = _aims(sizes, (16 if local is None and k is None else 4) * spark.sparkContext.defaultParallelism, one_sided)
    left = _tile_table([h for h in histogram if h[0] < max(sizes)], aims[0])
    right = _tile_table([h for h in histogram if h[0] > min(sizes)], aims[1], max((t[2] + t[3] for t in left), default=0))
    t0, t1 = _tile_pairs(left, right, similarity, threshold, n_bits, allowed)
    if local is not None:
        return _local_product(records, local, left, right, t0, t1, similarity, threshold, n_bits, k, scores)
    tiles = spark.createDataFrame([(d, pc, side, first, n) for side, table in enumerate((left, right)) for d, pc, first, n, _, _ in table], "dset_i int, pc int, side int, first int, parts int")
    placed = records.join(F.broadcast(tiles), ["dset_i", "pc"]).withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("rec_i"), F.col("parts"))).cast("int"))
    wave = _waves(left, right, t0, t1, similarity, n_bits) if k is not None else np.zeros(len(t0), np.int64)
    if not wave.any():
        return _compared_tiles(placed, t0, t1, None, None, similarity, threshold, n_bits, k, scores)
    party = {first + i: d for table in (left, right) for d, _, first, parts, _, _ in table for i in range(parts)}
    best = None
    for w in range(int(wave.max()) + 1):
        now = wave == w
        floors = None if best is None else _floor_table(best, similarity, k)
        pairs = _compared_tiles(placed, t0[now], t1[now], floors, party, similarity, threshold, n_bits, k)
        best = write_table(_leading(pairs if best is None else best.select(*pairs.columns).unionByName(pairs), similarity, k), "wave")
    return best.select(*pairs.columns)


def _waves(left: list[Tile], right: list[Tile], t0: np.ndarray, t1: np.ndarray, similarity: Similarity, n_bits: int) -> np.ndarray:
    """Wave of each pair of tiles: a left tile meets one tile of each other party in wave 0, up to GROWTH in the next, and so on, the closest popcounts first."""
    party, middle = {}, {}
    for table in (left, right):
        for d, _, first, parts, low, high in table:
            for i in range(parts):
                party[first + i], middle[first + i] = d, (low + high) / 2
    if not len(t0):
        return np.zeros(0, np.int64)
    other = np.array([party[t] for t in t1.tolist()])
    apart = np.abs(np.array([middle[t] for t in t0.tolist()]) - np.array([middle[t] for t in t1.tolist()]))
    o = np.lexsort((t1, apart, other, t0))
    new = np.append(True, (t0[o][1:] != t0[o][:-1]) | (other[o][1:] != other[o][:-1]))
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    if rank.max() + 1 < WAVES_FROM:
        return np.zeros(len(t0), np.int64)
    out = np.empty(len(t0), np.int64)
    out[o] = np.ceil(np.log(rank + 1) / np.log(GROWTH) - 1e-9)
    return out


def _ranks(similarity: Similarity) -> list[tuple[str, Column]]:
    left = Window.partitionBy("dset_i0", "dset_i1", "rec_i0").orderBy(F.col("sim").desc(), "rec_i1")
    right = Window.partitionBy("dset_i0", "dset_i1", "rec_i1").orderBy(F.col("sim").desc(), "rec_i0")
    return [("_l", F.row_number().over(left))] + ([("_r", F.row_number().over(right))] if similarity.two_sided else [])


def _leading(pairs: DataFrame, similarity: Similarity, k: int) -> DataFrame:
    """Pairs among the best ``k`` of a record that limits hold for, with these ranks."""
    ranks = _ranks(similarity)
    out = pairs.withColumns(dict(ranks))
    return out.where(" or ".join(f"{name} <= {k}" for name, _ in ranks))


def _floor_table(best: DataFrame, similarity: Similarity, k: int) -> DataFrame:
    """(dset_i, rec_i, other, floor): the k-th best score of each record that has ``k`` towards a party."""
    out = best.where(F.col("_l") == k).select(F.col("dset_i0").alias("dset_i"), F.col("rec_i0").alias("rec_i"), F.col("dset_i1").alias("other"), F.col("sim").alias("floor"))
    if similarity.two_sided:
        out = out.unionByName(best.where(F.col("_r") == k).select(F.col("dset_i1").alias("dset_i"), F.col("rec_i1").alias("rec_i"), F.col("dset_i0").alias("other"), F.col("sim").alias("floor")))
    return out


def _compared_tiles(placed: DataFrame, t0: np.ndarray, t1: np.ndarray, floors: DataFrame | None, party: dict[int, int] | None, similarity: Similarity, threshold: float, n_bits: int, k: int | None, scores: bool = False) -> DataFrame:
    """Pairs of the pairs of tiles (t0, t1), one partition each; ``floors``: scores that records must reach, if known."""
    spark = placed.sparkSession
    parts = max(1, min(MOST_TASKS, len(t0)))
    pair = np.arange(len(t0), dtype=np.int32)
    route = {"tile": np.concatenate([t0, t1]).astype(np.int32), "pair": np.concatenate([pair, pair])}
    if floors is not None:
        route["other"] = np.array([party[t] for t in [*t1.tolist(), *t0.tolist()]], np.int32)
    routed = placed.join(F.broadcast(spark.createDataFrame(pa.table(route))), "tile")
    columns = ["pair", "side", "dset_i", "rec_i", "pc", "clk"]
    if floors is not None:
        known = floors.groupBy("dset_i", "rec_i").agg(F.map_from_entries(F.collect_list(F.struct("other", "floor"))).alias("_floors"))  # an entry per party
        routed = routed.join(known, ["dset_i", "rec_i"], "left").withColumn("floor", F.coalesce(F.try_element_at("_floors", F.col("other")), F.lit(float("-inf"))))
        columns.append("floor")
    sent = routed.select(*columns).repartitionById(parts, F.pmod("pair", F.lit(parts)).cast("int"))
    if len(t0) > parts:
        sent = sent.sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = b.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if held and i < j and held[-1].column("pair")[0].as_py() != at[i]:
                    yield from _compared(pa.Table.from_batches(held), similarity, threshold, n_bits, k, scores)
                    held = []
                held.append(b.slice(i, j - i))
        if held:
            yield from _compared(pa.Table.from_batches(held), similarity, threshold, n_bits, k, scores)

    return sent.mapInArrow(run, _COUNTS if scores else _SCHEMA)


def _local_product(records: DataFrame, local: pa.Table, left: list[Tile], right: list[Tile], t0: np.ndarray, t1: np.ndarray, similarity: Similarity, threshold: float, n_bits: int, k: int | None, scores: bool = False) -> DataFrame:
    """The same tiles and pairs of them, cut from a broadcast of all records: no join or shuffle, one job of a task per slot."""
    spark = records.sparkSession
    bits, pc, rec, dset = _tile(local, n_bits)
    tiles: dict[int, np.ndarray] = {}
    for table in (left, right):
        for d, count, first, parts, _, _ in table:
            mine = np.flatnonzero((dset == d) & (pc == count))
            for i in range(parts):
                tiles[first + i] = np.concatenate([tiles.get(first + i, mine[:0]), mine[i::parts]])
    shared = spark.sparkContext.broadcast((bits, pc, rec, dset, tiles, t0, t1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pc, rec, dset, tiles, t0, t1 = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                sides = [tuple(x[tiles[t]] for x in (bits, pc, rec, dset)) for t in (int(t0[i]), int(t1[i]))]
                yield from _score_counts(*sides, similarity, threshold, n_bits) if scores else _batches(*sides, similarity, threshold, n_bits, k)

    return spark.range(0, len(t0), 1, max(1, min(spark.sparkContext.defaultParallelism, len(t0)))).mapInArrow(run, _COUNTS if scores else _SCHEMA)


def _compared(rows: pa.Table, similarity: Similarity, threshold: float, n_bits: int, k: int | None, scores: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of one pair of tiles, or their numbers by score."""
    side = rows.column("side").to_numpy()
    sides = [rows.filter(pa.array(side == s)) for s in (0, 1)]
    if scores:
        yield from _score_counts(*(_tile(x, n_bits) for x in sides), similarity, threshold, n_bits)
        return
    floors = tuple(x.column("floor").to_numpy() for x in sides) if "floor" in rows.column_names else None
    yield from _batches(*(_tile(x, n_bits) for x in sides), similarity, threshold, n_bits, k, floors)


def _batches(left: Records, right: Records, similarity: Similarity, threshold: float, n_bits: int, k: int | None, floors: Floors | None = None) -> Iterator[pa.RecordBatch]:
    for sim, x, y in hits_of(left, right, similarity, threshold, n_bits, k, floors):
        yield pa.RecordBatch.from_arrays([pa.array(sim), pa.array(left[3][x]), pa.array(right[3][y]), pa.array(left[2][x]), pa.array(right[2][y])], ["sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1"])


def _score_counts(left: Records, right: Records, similarity: Similarity, threshold: float, n_bits: int) -> Iterator[pa.RecordBatch]:
    """(sim, n): pairs of two tiles by score."""
    kinds, n = np.zeros(0), np.zeros(0, np.int64)
    for sim, _, _ in hits_of(left, right, similarity, threshold, n_bits, None):
        new, many = np.unique(sim, return_counts=True)
        kinds, at = np.unique(np.concatenate([kinds, new]), return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, at, np.concatenate([n, many]))
        n = total
    if len(kinds):
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["sim", "n"])


def hits_of(left: Records, right: Records, similarity: Similarity, threshold: float, n_bits: int, k: int | None, floors: Floors | None = None) -> Iterator[Hits]:
    """(sim, row of left, row of right) of pairs of two tiles that reach ``threshold``; with ``k``, those that the limits can still keep."""
    (bits_a, pc_a, rec_a, _), (bits_b, pc_b, rec_b, _) = left, right
    if not len(pc_a) or not len(pc_b):
        return
    if k is None and floors is None:
        yield from _all_hits(left, right, similarity, threshold, n_bits)
        return

    if k is not None and similarity.two_sided:
        yield from _both_sides(left, right, similarity, threshold, n_bits, k, floors)
        return

    def limited(hits: Hits) -> Hits:
        sim, x, y = hits
        top = _rank_within(x, sim, rec_b[y]) < k
        return sim[top], x[top], y[top]

    def columns(j: int) -> np.ndarray:
        return _with_needs(_floats(bits_b[j : j + COLUMNS]), pc_b[j : j + COLUMNS], similarity, threshold, n_bits, False)

    low = np.full(len(pc_a), -np.inf) if floors is None else np.array(floors[0])  # rises as left records meet columns
    only = columns(0) if len(pc_b) <= COLUMNS else None  # a tile of one block is unpacked once
    waiting: list[Hits] = []
    size, step = 0, FLUSH
    for i in range(0, len(pc_a), ROWS):
        a = _with_needs(_floats(bits_a[i : i + ROWS]), pc_a[i : i + ROWS], similarity, threshold, n_bits, True)
        for j in range(0, len(pc_b), COLUMNS):
            b = columns(j) if only is None else only
            at, to = slice(i, i + ROWS), slice(j, j + COLUMNS)
            if k is None:
                hits = _block(a, b, pc_a[at], pc_b[to], similarity, threshold, n_bits)
            else:
                hits = _best_of_block(a, b, pc_a[at], pc_b[to], similarity, threshold, n_bits, k, low[at])
            waiting.append((hits[0], hits[1] + i, hits[2] + j))
            size += len(hits[0])
            if size > step:
                got = _joined(waiting)
                waiting, size = [], 0
                if k is not None:
                    got = limited(got)
                    if len(got[0]) <= 4 * FLUSH:  # else they leave the task as they are: the limits are taken over all pairs later
                        waiting, size, step = [got], len(got[0]), max(FLUSH, 2 * len(got[0]))
                        continue
                yield got
        if waiting and (size > FLUSH // 4 or i + ROWS >= len(pc_a)):
            # these left records have met the whole tile
            got = _joined(waiting)
            waiting, size, step = [], 0, FLUSH
            yield got if k is None else limited(got)
    if waiting:
        yield _joined(waiting) if k is None else limited(_joined(waiting))


def _rises(scores: np.ndarray, pc: np.ndarray, ends: tuple[int, int], similarity: Similarity, threshold: float, n_bits: int) -> np.ndarray:
    """What the needs of these records rise by at least where they must reach ``scores``, not ``threshold``, with counts between ``ends`` on the other side."""
    slope, offset = similarity.cutoff(threshold, n_bits)
    kinds, which = np.unique(np.maximum(scores, threshold), return_inverse=True)
    slopes, offsets = (x[which] for x in np.array([similarity.cutoff(t, n_bits) for t in kinds.tolist()]).reshape(-1, 2).T)
    # needs are linear in the counts, so they rise least at the lowest or at the highest count
    return np.maximum(0, np.minimum(*((slopes - slope) * (pc + p) + offsets - offset for p in ends)) - 0.05).astype(np.float32)


def _first_floors(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], similarity: Similarity, threshold: float, n_bits: int, k: int) -> np.ndarray:
    """A score that each record's ``k``-th best reaches: the ``k``-th best among some records of the other side."""
    (bits, pc), (bits_o, pc_o) = own, other
    n = min(max(64, 8 * k, len(pc_o) // 32), SOME)
    if len(pc_o) < 2 * n or n < k:
        return np.full(len(pc), -np.inf)
    some = np.linspace(0, len(pc_o) - 1, n).astype(np.int64)
    b = _floats(bits_o[some])
    out = np.empty(len(pc))
    for i in range(0, len(pc), 2048):
        sims = similarity.counts((_floats(bits[i : i + 2048]) @ b.T).astype(np.float64), pc[i : i + 2048, None], pc_o[some][None, :], n_bits)
        out[i : i + 2048] = np.partition(sims, n - k, axis=1)[:, n - k]
    return out


def _both_sides(left: Records, right: Records, similarity: Similarity, threshold: float, n_bits: int, k: int, floors: Floors | None) -> Iterator[Hits]:
    """Pairs of two tiles among the ``k`` best of either record, with some others.

    Both records of a pair have a floor, at first by some records of the other side, which rises to the
    ``k``-th best score met.  A pair below both is among neither record's best and changes no rank that counts.
    """
    order = [np.argsort(x[1], kind="stable") for x in (left, right)]  # blocks of like counts: needs rise by about the same for all of them
    (bits_a, pc_a, rec_a), (bits_b, pc_b, rec_b) = ([x[c][o] for c in range(3)] for x, o in zip((left, right), order))
    low, high = _first_floors((bits_a, pc_a), (bits_b, pc_b), similarity, threshold, n_bits, k), _first_floors((bits_b, pc_b), (bits_a, pc_a), similarity, threshold, n_bits, k)
    if floors is not None:
        low, high = np.maximum(low, floors[0][order[0]]), np.maximum(high, floors[1][order[1]])

    def limited(hits: Hits) -> Hits:
        sim, x, y = hits
        by_left, by_right = _rank_within(x, sim, rec_b[y]), _rank_within(y, sim, rec_a[x])
        for floor, at, rank in ((low, x, by_left), (high, y, by_right)):
            last = rank == k - 1
            floor[at[last]] = np.maximum(floor[at[last]], sim[last])
        top = (by_left < k) | (by_right < k)
        return sim[top], x[top], y[top]

    waiting: list[Hits] = []
    size, step = 0, FLUSH
    for j in range(0, len(pc_b), NARROW):
        to = slice(j, j + NARROW)
        b = _with_needs(_floats(bits_b[to]), pc_b[to], similarity, threshold, n_bits, False)
        ends_b = (pc_b[to][0], pc_b[to][-1])
        for i in range(0, len(pc_a), ROWS):
            at = slice(i, i + ROWS)
            ends_a = (pc_a[at][0], pc_a[at][-1])
            a = _with_needs(_floats(bits_a[at]), pc_a[at], similarity, threshold, n_bits, True)
            margin = _margins(a, b, n_bits)
            reach = margin >= _rises(low[at], pc_a[at], ends_b, similarity, threshold, n_bits)[:, None]
            reach |= margin >= _rises(high[to], pc_b[to], ends_a, similarity, threshold, n_bits)[None, :]
            sim, x, y = _scores(margin, a, b, pc_a[at], pc_b[to], similarity, threshold, n_bits, reach)
            keep = (sim >= low[at][x]) | (sim >= high[to][y])
            waiting.append((sim[keep], x[keep] + i, y[keep] + j))
            size += len(waiting[-1][0])
            if size > step:
                got = limited(_joined(waiting))
                waiting, size, step = [got], len(got[0]), max(FLUSH, 2 * len(got[0]))
                if len(got[0]) > 4 * FLUSH:  # they leave the task: the limits are taken over all pairs later
                    yield got[0], order[0][got[1]], order[1][got[2]]
                    waiting, size, step = [], 0, FLUSH
    if waiting:
        sim, x, y = limited(_joined(waiting))
        yield sim, order[0][x], order[1][y]


def _distinct(bits: np.ndarray, pc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bit strings in the order of their popcounts, these counts, and the rows of each: ``rows[starts[i] : starts[i + 1]]``.

    Strings of under BROAD bits are only put in order: to compare them takes no longer than to find copies.
    """
    if 8 * bits.shape[1] < BROAD:
        rows = np.argsort(pc, kind="stable")
        return bits[rows], pc[rows], rows, np.arange(len(rows) + 1)
    _, first, kind = np.unique(np.ascontiguousarray(bits).view(f"V{bits.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by_count = np.argsort(pc[first], kind="stable")
    place = np.empty_like(by_count)
    place[by_count] = np.arange(len(by_count))
    kind = place[kind.ravel()]
    first = first[by_count]
    return bits[first], pc[first], np.argsort(kind, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=len(first)))])


def _each_row(hits: Hits, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> Iterator[Hits]:
    """Pairs of distinct bit strings as pairs of the rows that have them, up to FLUSH at once."""
    sim, x, y = hits
    (rows_a, from_a), (rows_b, from_b) = left, right
    if len(rows_a) == len(from_a) - 1 and len(rows_b) == len(from_b) - 1:  # no copies
        yield sim, rows_a[x], rows_b[y]
        return
    wide = from_b[y + 1] - from_b[y]
    ends = np.cumsum((from_a[x + 1] - from_a[x]) * wide)
    for i in range(0, int(ends[-1]) if len(ends) else 0, FLUSH):
        n = np.arange(i, min(i + FLUSH, int(ends[-1])))
        at = np.searchsorted(ends, n, side="right")
        n -= np.where(at > 0, ends[at - 1], 0)
        yield sim[at], rows_a[from_a[x[at]] + n // wide[at]], rows_b[from_b[y[at]] + n % wide[at]]


def _union_size(bits_a: np.ndarray, pc_a: np.ndarray, bits_b: np.ndarray, pc_b: np.ndarray, similarity: Similarity, threshold: float, n_bits: int) -> int:
    """Members of a union by which rows like these are compared with these columns in the least time; 1: no unions."""
    some = np.linspace(0, len(pc_a) - 1, min(TRIAL, len(pc_a))).astype(np.int64)
    a = _with_needs(_floats(bits_a[some]), pc_a[some], similarity, threshold, n_bits, True)
    best, least = 1, 1.0
    for m in UNIONS:
        if len(pc_b) < m:
            continue
        first = np.linspace(0, len(pc_b) // m - 1, min(TRIAL, len(pc_b) // m)).astype(np.int64) * m
        union = np.bitwise_or.reduce(bits_b[first[:, None] + np.arange(m)], axis=1)
        b = _with_needs(_floats(union), pc_b[first], similarity, threshold, n_bits, False)
        cost = 1 / m + SINGLE * float(np.mean(_margins(a, b, n_bits) >= 0))
        if cost < least:
            best, least = m, cost
    return best


def _all_hits(left: Records, right: Records, similarity: Similarity, threshold: float, n_bits: int) -> Iterator[Hits]:
    """(sim, row of left, row of right) of all pairs of two tiles that reach ``threshold``."""
    bits_a, pc_a, rows_a, from_a = _distinct(left[0], left[1])
    bits_b, pc_b, rows_b, from_b = _distinct(right[0], right[1])
    slope, offset = similarity.cutoff(threshold, n_bits)
    slack = 0.01 + 1e-6 * n_bits
    linear = 0 <= slope <= 1  # else a need may fall as counts grow
    unions = linear and n_bits >= BROAD and len(pc_a) * len(pc_b) >= WORTH
    blocks: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []  # columns from, to, of a union; bits and least counts of the unions
    for j in range(0, len(pc_b), COLUMNS):
        bits, pc = bits_b[j : j + COLUMNS], pc_b[j : j + COLUMNS]
        m = _union_size(bits_a, pc_a, bits, pc, similarity, threshold, n_bits) if unions else 1
        at = np.arange(0, len(pc), m)
        blocks.append((j, j + len(pc), m, bits if m == 1 else np.bitwise_or.reduceat(bits, at, axis=0), pc[at]))
    kept = sum(len(b[4]) for b in blocks) <= 2 * COLUMNS  # unpacked once
    unpacked: dict[int, np.ndarray] = {}
    waiting: list[Hits] = []
    size = 0
    for i in range(0, len(pc_a), ROWS):
        at = slice(i, i + ROWS)
        a = _with_needs(_floats(bits_a[at]), pc_a[at], similarity, threshold, n_bits, True)
        first, last = 0, len(pc_b)
        if linear:  # common bits are at most the lower count, which exceeds the need most at the closest count of these rows
            near = np.clip(pc_b, pc_a[at][0], pc_a[at][-1])
            met = np.flatnonzero(np.minimum(near, pc_b) >= slope * (near + pc_b) + offset - slack)
            first, last = (met[0], met[-1] + 1) if len(met) else (0, 0)
        for start, stop, m, bits, least in blocks:
            p, q = (max(first, start) - start) // m, -(-(min(last, stop) - start) // m)
            if p >= q:
                continue
            if start in unpacked:
                b = unpacked[start][p:q]
            elif kept:
                unpacked[start] = _with_needs(_floats(bits), least, similarity, threshold, n_bits, False)
                b = unpacked[start][p:q]
            else:
                b = _with_needs(_floats(bits[p:q]), least[p:q], similarity, threshold, n_bits, False)
            p = start + p * m
            q = min(start + q * m, stop)
            sim, x, y = _block(a, b, pc_a[at], pc_b[p:q], similarity, threshold, n_bits) if m == 1 else _by_unions(a, b, m, bits_a[at], pc_a[at], bits_b[p:q], pc_b[p:q], similarity, threshold, n_bits)
            waiting.append((sim, x + i, y + p))
            size += len(sim)
            if size > FLUSH:
                yield from _each_row(_joined(waiting), (rows_a, from_a), (rows_b, from_b))
                waiting, size = [], 0
    if waiting:
        yield from _each_row(_joined(waiting), (rows_a, from_a), (rows_b, from_b))


def _by_unions(a: np.ndarray, b: np.ndarray, m: int, bits_a: np.ndarray, pc_a: np.ndarray, bits_b: np.ndarray, pc_b: np.ndarray, similarity: Similarity, threshold: float, n_bits: int) -> Hits:
    """(sim, row, column) of the pairs of two blocks that reach ``threshold``, ``b`` being the unions of ``m`` columns each."""
    hit = np.flatnonzero(_margins(a, b, n_bits) >= 0)
    if len(hit) * m * SINGLE > len(pc_a) * len(pc_b):  # the trial was wrong here
        return _block(a, _with_needs(_floats(bits_b), pc_b, similarity, threshold, n_bits, False), pc_a, pc_b, similarity, threshold, n_bits)
    x, y = np.repeat(hit // len(b), m), ((hit % len(b))[:, None] * m + np.arange(m)).ravel()
    if len(pc_b) % m:  # the last union has fewer members
        x, y = x[y < len(pc_b)], y[y < len(pc_b)]
    common = np.empty(len(x))
    for i in range(0, len(x), 1 << 14):
        to = slice(i, i + (1 << 14))
        common[to] = _common(bits_a[x[to]], bits_b[y[to]])
    sim = similarity.counts(common, pc_a[x], pc_b[y], n_bits)
    keep = sim >= threshold
    return sim[keep], x[keep], y[keep]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that the rows of two tables of packed bits share."""
    if a.shape[1] % 8 == 0:
        a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    return np.bitwise_count(a & b).sum(1, dtype=np.int64)


def _joined(hits: list[Hits]) -> Hits:
    return hits[0] if len(hits) == 1 else tuple(np.concatenate(h) for h in zip(*hits))


def _with_needs(bits: np.ndarray, pc: np.ndarray, similarity: Similarity, threshold: float, n_bits: int, left: bool) -> np.ndarray:
    """Bits and two columns more, so that a product is what common bits exceed the pair's need by, less a slack.

    Needs are whole parts of 1/64, so no sum of up to EXACT_BITS bits is rounded.
    """
    slope, offset = similarity.cutoff(threshold, n_bits)
    slack = 0.01 + 1e-6 * n_bits  # more than needs and scores are off
    need = np.floor((slope * pc + (0 if left else offset - slack)) * 64) / 64
    one = np.ones(len(pc))
    return np.concatenate([bits, np.stack([-need, one] if left else [one, -need], axis=1).astype(np.float32)], axis=1)


def _margins(a: np.ndarray, b: np.ndarray, n_bits: int) -> np.ndarray:
    """What common bits exceed the needs of the pairs of two blocks by."""
    if n_bits <= EXACT_BITS:
        return a @ b.T
    return (a[:, :-2] @ b[:, :-2].T).astype(np.float64) + a[:, -2:-1] + b[:, -1]


def _scores(margin: np.ndarray, a: np.ndarray, b: np.ndarray, pc_a: np.ndarray, pc_b: np.ndarray, similarity: Similarity, threshold: float, n_bits: int, reach: np.ndarray) -> Hits:
    """(sim, row, column) of the pairs ``reach`` that do reach ``threshold``."""
    hit = np.flatnonzero(reach)
    x = hit // len(pc_b)
    y = hit - x * len(pc_b)
    common = np.rint(margin.ravel()[hit].astype(np.float64) - a[x, -2] - b[y, -1])
    sim = similarity.counts(common, pc_a[x], pc_b[y], n_bits)
    keep = sim >= threshold
    return (sim, x, y) if keep.all() else (sim[keep], x[keep], y[keep])


def _block(a: np.ndarray, b: np.ndarray, pc_a: np.ndarray, pc_b: np.ndarray, similarity: Similarity, threshold: float, n_bits: int) -> Hits:
    """(sim, row, column) of the pairs of two blocks that reach ``threshold``."""
    margin = _margins(a, b, n_bits)
    return _scores(margin, a, b, pc_a, pc_b, similarity, threshold, n_bits, margin >= 0)


def _best_of_block(a: np.ndarray, b: np.ndarray, pc_a: np.ndarray, pc_b: np.ndarray, similarity: Similarity, threshold: float, n_bits: int, k: int, low: np.ndarray) -> Hits:
    """The same, without pairs below ``low`` of their row, which is raised to the row's ``k``-th best score of the block."""
    margin = _margins(a, b, n_bits)
    known = low > threshold
    reach = margin >= 0
    if known.any():
        reach &= margin >= _rises(low, pc_a, (pc_b.min(), pc_b.max()), similarity, threshold, n_bits)[:, None]
    if k < len(pc_b) and np.count_nonzero(reach) > 2 * k * len(pc_a):
        # many pairs pass: leave those below a row's k-th best score, ties stay for the exact ranks
        common = np.rint(margin - a[:, -2:-1] - b[:, -1])
        dense = similarity.counts(common, pc_a[:, None], pc_b[None, :], n_bits)
        np.maximum(low, np.partition(dense, len(pc_b) - k, axis=1)[:, len(pc_b) - k], out=low)
        reach &= dense >= low[:, None]
    sim, x, y = _scores(margin, a, b, pc_a, pc_b, similarity, threshold, n_bits, reach)
    keep = sim >= low[x]
    return sim[keep], x[keep], y[keep]


def _tile(rows: pa.Table, n_bits: int) -> Records:
    """(packed bits, popcounts, ids, parties) of a tile's records."""
    packed = [packed_bits(c, n_bits // 8) for c in rows.column("clk").chunks]
    bits = np.concatenate(packed) if packed else np.zeros((0, n_bits // 8), np.uint8)
    return bits, *(rows.column(c).to_numpy() for c in ("pc", "rec_i", "dset_i"))


def packed_bits(clk: pa.Array, n_bytes: int) -> np.ndarray:
    """The bytes of bit strings of one length, without a Python object for each."""
    clk = clk.cast(pa.large_binary())
    if not len(clk):
        return np.zeros((0, n_bytes), np.uint8)
    off = np.frombuffer(clk.buffers()[1], np.int64)[clk.offset : clk.offset + len(clk) + 1]
    return np.frombuffer(clk.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].reshape(len(clk), n_bytes)


def _floats(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(np.float32)
