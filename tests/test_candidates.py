import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import linkage_spec as spec
from veilmatch import operators as ops
from veilmatch.functions import bit_blocking, block_and, block_or, continuous_blocking, custom_blocking, list_blocking
from veilmatch.operators.similarity import DICE, SMC, named
from veilmatch.plans import blocks, product


def make(seed, sizes=(13, 11, 9), n_bytes=4, few=6):
    """Datasets with many ties: records repeat and share most bits."""
    rng = random.Random(seed)
    pool = [rng.randbytes(n_bytes) for _ in range(few)] + [bytes(n_bytes), b"\xff" * n_bytes]
    return [[rng.choice(pool) for _ in range(n)] for n in sizes]


def table(spark, datasets, extra=None, kind=""):
    rows = [(d, r, x, *([extra[d][r]] if extra else [])) for d, s in enumerate(datasets) for r, x in enumerate(s)]
    return spark.createDataFrame(rows, "dset_i int, rec_i long, clk binary" + (f", v {kind}" if extra else ""))


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name,f,two", [("dice", spec.dice, False), ("smc", spec.smc, True)])
@pytest.mark.parametrize("k", [None, 0, 1, 2, 50])
@pytest.mark.parametrize("threshold", [0.0, 0.6])
def test_unblocked(spark, name, f, two, k, threshold):
    data = make(1)
    assert rows(ops.find_candidate_pairs(table(spark, data), name, threshold, k)) == spec.candidates(data, f, threshold, k, two_sided=two)


@pytest.mark.parametrize("name,f,two", [("dice", spec.dice, False), ("smc", spec.smc, True)])
@pytest.mark.parametrize("k", [None, 1, 2])
def test_blocked(spark, name, f, two, k):
    data, rng = make(2), random.Random(5)
    extra = [[[rng.choice([1, 2, 3, None]) for _ in range(rng.randrange(3))] for _ in d] for d in data]
    want = spec.candidates(data, f, 0.4, k, extra, two)
    assert rows(ops.find_candidate_pairs(table(spark, data, extra, "array<int>"), name, 0.4, k, custom_blocking("v"))) == want


def test_list_blocking_takes_null_as_a_value(spark):
    data = make(3)
    extra = [[None if i % 3 == 0 else "a" if i % 3 == 1 else "null" for i in range(len(d))] for d in data]
    want = spec.candidates(data, spec.dice, 0.3, None, [[[v] for v in d] for d in extra])
    assert rows(ops.find_candidate_pairs(table(spark, data, extra, "string"), "dice", 0.3, blocking=list_blocking("v"))) == want


def test_bit_blocking(spark):
    data = make(4, few=20)
    positions = bit_blocking(3, 5, seed="s").positions(32)
    assert [len(set(p)) for p in positions] == [5] * 3
    bit = lambda x, i: x[i // 8] >> (7 - i % 8) & 1
    keys = [[[sum(bit(x, b) << j for j, b in enumerate(p)) * 3 + t for t, p in enumerate(positions)] for x in d] for d in data]
    want = spec.candidates(data, spec.dice, 0.2, None, keys)
    assert rows(ops.find_candidate_pairs(table(spark, data), "dice", 0.2, blocking=bit_blocking(3, 5, seed="s"))) == want
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            bit_blocking(*bad)


def test_continuous_and_or(spark):
    data, rng = make(5, few=30), random.Random(8)
    extra = [[rng.choice([rng.uniform(-9, 9), float(rng.randrange(9))]) for _ in d] for d in data]
    r = 1.5
    near = [[[2 * int(x // (2 * r)), 2 * int((x + r) // (2 * r)) + 1] for x in d] for d in extra]
    whole = [[[int(x)] for x in d] for d in extra]
    t = table(spark, data, extra, "double")
    cast = list_blocking(F.col("v").cast("int"))
    assert rows(ops.find_candidate_pairs(t, "dice", 0, blocking=continuous_blocking(r, "v"))) == spec.candidates(data, spec.dice, 0, None, near)
    both = [[[(a, b) for a in x for b in y] for x, y in zip(d, e)] for d, e in zip(near, whole)]
    assert rows(ops.find_candidate_pairs(t, "dice", 0, blocking=block_and(continuous_blocking(r, "v"), cast))) == spec.candidates(data, spec.dice, 0, None, both)
    either = [[[(0, a) for a in x] + [(1, b) for b in y] for x, y in zip(d, e)] for d, e in zip(near, whole)]
    assert rows(ops.find_candidate_pairs(t, "dice", 0, 1, block_or([continuous_blocking(r, "v"), cast]))) == spec.candidates(data, spec.dice, 0, 1, either)
    for f in (block_and, block_or):
        with pytest.raises(TypeError):
            f()
    with pytest.raises(ValueError):
        continuous_blocking(0, "v")


def test_two_dataset_functions_and_errors(spark):
    data = make(6)[:2]
    parts = [table(spark, [d]).drop("dset_i") for d in data]
    want = [(s, a, b) for s, _, _, a, b in spec.canonical(spec.limited([(spec.dice(x, y), 0, 1, i, j) for i, x in enumerate(data[0]) for j, y in enumerate(data[1])], 2, True, False))]
    assert rows(ops.dice_coefficient(parts, 0.0, 2)) == want
    want = [(s, a, b) for s, _, _, a, b in spec.canonical(spec.limited([(spec.smc(x, y), 0, 1, i, j) for i, x in enumerate(data[0]) for j, y in enumerate(data[1])], 2))]
    assert rows(ops.simple_matching_coefficient(parts, 0.0, 2)) == want
    with pytest.warns(DeprecationWarning):
        assert rows(ops.hamming_similarity(parts, 0.0, 2)) == want
    with pytest.raises(ValueError):
        ops.dice_coefficient(parts[:1], 0.5)
    with pytest.raises(NotImplementedError):
        ops.dice_coefficient(parts + parts[:1], 0.5)
    with pytest.raises(NotImplementedError):
        ops.simple_matching_coefficient(parts[:1], 0.5, None)
    with pytest.raises(TypeError):
        ops.find_candidate_pairs(spark.createDataFrame([(0, 0, "a"), (1, 0, "b")], "dset_i int, rec_i long, clk string"))
    with pytest.raises(ValueError):
        ops.find_candidate_pairs(spark.createDataFrame([(0, 0, b"a"), (1, 0, b"ab")], "dset_i int, rec_i long, clk binary"))


def test_no_or_one_party_and_custom_similarity(spark):
    assert rows(ops.find_candidate_pairs(table(spark, [[], []]), "dice", 0.5)) == []
    assert rows(ops.find_candidate_pairs(table(spark, make(7)[:1]), "dice", 0.0)) == []
    data = make(8)
    extra = [[float(i) for i in range(len(d))] for d in data]
    sim = ops.custom_similarity("near", lambda a, b: F.lit(1.0) - F.abs(a["v"] - b["v"]) / 20, needs=("v",))
    got = rows(ops.find_candidate_pairs(table(spark, data, extra, "double"), sim, 0.9, 1))
    ids = [[bytes([i]) for i in range(len(d))] for d in data]
    assert got == spec.candidates(ids, lambda x, y: 1.0 - abs(x[0] - y[0]) / 20, 0.9, 1)


@pytest.mark.parametrize("two_sided", [False, True])
@pytest.mark.parametrize("k", [None, 2])
def test_block_function_in_parts(spark, two_sided, k):
    """A function of whole blocks gives the same pairs when blocks are dealt into parts."""
    data = make(11, (40, 31, 9))
    t = table(spark, data, [[r % 7 / 3 for r in range(len(d))] for d in data], "double").withColumn("b", F.col("rec_i") % 2)

    def near(left, right, threshold, k):
        both = left.merge(right, how="cross", suffixes=("_0", "_1"))
        both["sim"] = 1.0 - (both.v_0 - both.v_1).abs()
        both = both[both.sim >= threshold].rename(columns={"rec_i_0": "rec_i0", "rec_i_1": "rec_i1"}).sort_values(["sim", "rec_i1", "rec_i0"], ascending=[False, True, True])
        if k is not None:
            left_rank = both.groupby("rec_i0").cumcount()
            right_rank = both.sort_values(["sim", "rec_i0"], ascending=[False, True]).groupby("rec_i1").cumcount()
            both = both[(left_rank < k) & ((right_rank.reindex(both.index) < k) if two_sided else True)]
        return both[["sim", "rec_i0", "rec_i1"]]

    blocking = block_or(list_blocking("b"), list_blocking("v"))
    whole = rows(ops.block_similarity(t, near, 0.5, k, blocking))
    assert whole
    for split in (3, 1000):
        assert rows(ops.block_similarity(t, near, 0.5, k, blocking, split_rows=split, two_sided=two_sided)) == whole
    with pytest.raises(ValueError):
        ops.block_similarity(t, near, 0.5, k, blocking, split_rows=0)


@pytest.mark.parametrize("k", [None, 1])
def test_parts_of_blocks_share_their_way(spark, monkeypatch, k):
    """Records are sent to shares of blocks, not to every part that the function sees; parts stay as small as asked for."""
    from pyspark.sql import GroupedData

    data = make(17, (60, 50), 3)
    t = table(spark, data).withColumn("b", F.col("rec_i") % 2)
    sent, plain = [], GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda a, b: sent.append(a._df.count() + b._df.count()) or plain(a, b))

    def every(left, right, threshold, k):
        if len(left) > 3 or len(right) > 3:
            raise ValueError("parts are too large")
        both = left.merge(right, how="cross", suffixes=("0", "1"))
        return both.assign(sim=1 / (1 + both.rec_i0 + both.rec_i1))

    got = rows(ops.block_similarity(t, every, 0.0, k, list_blocking("b"), split_rows=3))
    want = [(1 / (1 + i + j), 0, 1, i, j) for i in range(60) for j in range(50) if i % 2 == j % 2]
    assert got == spec.canonical(want if k is None else spec.limited(want, k))
    assert sent == [110]


def test_tiles_as_rows_are_made_by_many_tasks(spark):
    """The same tiles as split_to_chunks(), dealt over tasks although their sizes are three rows."""
    sizes = [700, 0, 801, 650]
    tiles = ops.chunks_table(spark, 300, spark.createDataFrame(list(enumerate(sizes)), "dset_i int, n bigint"))
    want = [(x["datasetIndex"], *x["range"], y["datasetIndex"], *y["range"]) for x, y in ops.split_to_chunks(300, dataset_sizes=sizes)]
    assert sorted(map(tuple, tiles.collect())) == sorted(want)
    assert tiles.groupBy(F.spark_partition_id()).count().count() > 4


def test_explicit_pairs_and_tiles(spark):
    data = make(9, (40, 35), 8, 60)
    df = spark.createDataFrame([(x, y) for x, y in zip(*data)], "clk0 binary, clk1 binary")
    assert all(r["sim"] == spec.dice(r["clk0"], r["clk1"]) for r in ops.dice_coefficient_pairs(df).collect())
    t = table(spark, data)
    every = rows(ops.find_candidate_pairs(t, "dice", 0.5))
    tiles = list(ops.split_to_chunks(300, dataset_sizes=[40, 35]))
    assert len(tiles) > 1
    runs = [ops.process_chunk(c, t, "dice", 0.5) for c in tiles[:3]]
    inside = lambda r, c: c[0]["range"][0] <= r[3] < c[0]["range"][1] and c[1]["range"][0] <= r[4] < c[1]["range"][1]
    assert rows(ops.merge_pairs(*runs)) == [r for r in every if any(inside(r, c) for c in tiles[:3])]
    with pytest.raises(ValueError):
        ops.process_chunk([{"range": [0, 1]}, tiles[0][1]], t)
    with pytest.raises(NotImplementedError):
        ops.process_chunk(tiles[0][:1], t)


@pytest.mark.parametrize("aim", [1, 10, 100, 2500.0])
def test_chunks_cover_each_comparison_once(spark, aim):
    sizes = [17, 0, 1, 40]
    seen = [(p["datasetIndex"], a, q["datasetIndex"], b) for p, q in ops.split_to_chunks(aim, dataset_sizes=sizes) for a in range(*p["range"]) for b in range(*q["range"])]
    assert len(seen) == len(set(seen)) == sum(sizes[i] * sizes[j] for i in range(4) for j in range(i + 1, 4))
    got = {tuple(r) for r in ops.chunks_table(spark, aim, spark.createDataFrame(list(enumerate(sizes)), "dset_i int, n long")).collect()}
    assert got == {(p["datasetIndex"], *p["range"], q["datasetIndex"], *q["range"]) for p, q in ops.split_to_chunks(aim, dataset_sizes=sizes)}


@pytest.mark.parametrize("n_bytes", [1, 7, 8, 9, 15, 17, 25])
def test_lengths_and_empty_filters(spark, n_bytes):
    pattern = [b"\x4b" * n_bytes, bytes(n_bytes), b"\xff" * n_bytes]
    data = [pattern, pattern[::-1]]
    for threshold in (0.0, 0.5, 1.0):
        want = spec.candidates(data, spec.dice, threshold)
        assert rows(ops.find_candidate_pairs(table(spark, data), "dice", threshold)) == want
        assert rows(ops.find_candidate_pairs(table(spark, data), "dice", threshold, blocking=custom_blocking(F.array(F.lit(1))))) == want
    assert rows(ops.find_candidate_pairs(table(spark, data), "dice", 1.5)) == []


def test_large_products_use_many_tiles(spark):
    rng = random.Random(12)
    data = [[rng.randbytes(8) for _ in range(700)] for _ in range(2)]
    got = rows(ops.find_candidate_pairs(table(spark, data), "dice", 0.62, 3))
    assert got == spec.candidates(data, spec.dice, 0.62, 3)


@pytest.mark.parametrize("name,f,two", [("dice", spec.dice, False), ("smc", spec.smc, True)])
@pytest.mark.parametrize("threshold,k", [(0.0, None), (0.55, None), (0.0, 2)])
def test_large_blocks_by_tiles_equal_brute_force(spark, monkeypatch, name, f, two, threshold, k):
    """Blocks above the limit go through the kernel, in several tiles each; smaller ones through the join; records share several blocks of both kinds."""
    from veilmatch.operators import candidates
    from veilmatch.plans import blocks

    monkeypatch.setattr(candidates, "BLOCK_ROWS", 12)
    monkeypatch.setattr(blocks, "SMALLEST", 3)
    data, rng = make(11, (31, 27, 9), 5, few=25), random.Random(2)
    keys = [[rng.choice([["hot"], ["hot", "b"], ["hot", "b", "rare"], ["rare"], ["b", None], [], None]) for _ in d] for d in data]
    t = table(spark, data, keys, "array<string>")
    want = spec.candidates(data, f, threshold, k, [[[] if x is None else x for x in d] for d in keys], two)
    assert rows(ops.find_candidate_pairs(t, name, threshold, k, custom_blocking("v"))) == want


@pytest.mark.parametrize("name,f,two", [("dice", spec.dice, False), ("smc", spec.smc, True)])
@pytest.mark.parametrize("k", [None, 2])
def test_product_by_shuffled_tiles(spark, monkeypatch, name, f, two, k):
    """Tables too large to be sent to every executor give the same pairs."""
    from veilmatch.operators import candidates

    t = table(spark, make(12))
    want = rows(ops.find_candidate_pairs(t, name, 0.6, k))
    monkeypatch.setattr(candidates, "LOCAL_BYTES", 0)
    assert want and rows(ops.find_candidate_pairs(t, name, 0.6, k)) == want


@pytest.mark.parametrize("k", [None, 3])
def test_margins_equal_counts(monkeypatch, k):
    """Bit strings too long for exact margins take counts; both keep the same pairs with the same scores."""
    import numpy as np

    from veilmatch.plans import product

    rng = np.random.default_rng(3)
    sides = []
    for n in (700, 900):
        bits = rng.integers(0, 256, (n, 5), dtype=np.uint8) & rng.integers(0, 256, (n, 1), dtype=np.uint8)
        sides.append((bits, np.bitwise_count(bits).sum(1).astype(np.int32), np.arange(n), np.zeros(n, np.int32)))

    def hits(sim, threshold):
        return sorted(x for h in product.hits_of(*sides, sim, threshold, 40, k) for x in zip(*(c.tolist() for c in h)))

    for sim in (ops.DICE, ops.SMC):
        for threshold in (0.0, 0.5, 0.8, 1.0):
            with monkeypatch.context() as m:
                got = hits(sim, threshold)
                m.setattr(product, "EXACT_BITS", 0)
                assert got and hits(sim, threshold) == got


@pytest.mark.parametrize("name,k", [("dice", None), ("dice", 2), ("smc", 1)])
def test_killed_run_of_tiles(spark, tmp_path, name, k):
    """A run that died after some tiles ends with the same pairs, and compares only what was not there."""
    data = make(13, (40, 35, 20), 8, 60)
    t = table(spark, data)
    tiles = list(ops.split_to_chunks(300, dataset_sizes=[40, 35, 20]))
    want = sorted(r for c in tiles for r in rows(ops.process_chunk(c, t, name, 0.5, k)))
    folder = tmp_path / "tiles"
    assert sorted(rows(ops.run_chunks(t, tiles[1::2], str(folder), name, 0.5, k))) == sorted(r for c in tiles[1::2] for r in rows(ops.process_chunk(c, t, name, 0.5, k)))
    old = {p.name: p.stat().st_mtime_ns for p in folder.iterdir()}
    assert len(old) == len(tiles[1::2])
    (folder / "_begun-0").write_bytes(b"cut off")
    assert sorted(rows(ops.run_chunks(t, [c[::-1] for c in tiles], str(folder), name, 0.5, k))) == want
    now = {p.name: p.stat().st_mtime_ns for p in folder.iterdir() if not p.name.startswith("_")}
    assert len(now) == len(tiles) and {n: now[n] for n in old} == old
    assert ops.run_chunks(t.where("false"), tiles, str(tmp_path / "none"), name, 0.5, k).count() == 0


@pytest.mark.parametrize("name,f,two", [("dice", spec.dice, False), ("smc", spec.smc, True)])
@pytest.mark.parametrize("k", [1, 3])
def test_limits_in_waves_of_tiles(spark, monkeypatch, name, f, two, k):
    """Tiles of a few records, so that each record meets many: the same pairs, and fewer of them leave the tasks."""
    from veilmatch.operators import candidates
    from veilmatch.plans import product

    rng = random.Random(23)
    data = [[rng.randbytes(3) for _ in range(n)] + make(29, n_bytes=3)[0] for n in (20, 25, 15)]
    monkeypatch.setattr(candidates, "LOCAL_BYTES", 0)
    monkeypatch.setattr(product, "_aims", lambda sizes, slots, wide: (12, 6))
    monkeypatch.setattr(product, "GROWTH", 3)
    emitted = []
    plain = product._compared_tiles

    def counted(*args):
        out = plain(*args)
        emitted.append((args[3] is not None, out.count()))
        return out

    monkeypatch.setattr(product, "_compared_tiles", counted)
    want = spec.candidates(data, f, 0.3, k, two_sided=two)
    assert rows(ops.find_candidate_pairs(table(spark, data), name, 0.3, k)) == want
    assert [floors for floors, _ in emitted] == [False, True, True]
    in_waves = sum(n for _, n in emitted)
    monkeypatch.setattr(product, "WAVES_FROM", 10**9)
    emitted.clear()
    assert rows(ops.find_candidate_pairs(table(spark, data), name, 0.3, k)) == want
    assert len(emitted) == 1 and in_waves < emitted[0][1]


def test_thresholds_rise_inside_a_tile(monkeypatch):
    """Columns in small blocks: what is left of each row holds its best k, with ties, by Dice and by needs with offsets."""
    import numpy as np

    from veilmatch.operators.similarity import DICE, Similarity
    from veilmatch.plans import product

    agree = Similarity("agree", None, counts=lambda c, x, y, n: (n - (x + y - 2.0 * c)) / n, cutoff=lambda t, n: (0.5, (t - 1) * n / 2))
    rng = np.random.default_rng(31)
    sides = []
    for n in (40, 300):
        bits = np.packbits(rng.random((n, 64)) < rng.random((n, 1)), axis=1)
        sides.append((bits, np.bitwise_count(bits).sum(1).astype(np.int32), np.arange(n), np.zeros(n, np.int32)))
    monkeypatch.setattr(product, "COLUMNS", 37)
    common = np.unpackbits(sides[0][0], axis=1).astype(int) @ np.unpackbits(sides[1][0], axis=1).astype(int).T
    for sim in (DICE, agree):
        full = sim.counts(common.astype(float), sides[0][1][:, None], sides[1][1][None, :], 64)
        for k in (1, 4, 30):
            got = {(int(x), int(y)) for _, xs, ys in product.hits_of(*sides, sim, 0.2, 64, k) for x, y in zip(xs, ys)}
            want = {(x, int(y)) for x in range(40) for y in np.lexsort((np.arange(300), -full[x]))[:k] if full[x, y] >= 0.2}
            assert got == want


def _sparse_tiles(n: int, copies: int) -> list:
    """Two tiles of records with about a tenth of 1024 bits set, the first ``copies`` of them equal."""
    rng = np.random.default_rng(5)
    out = []
    for d in (0, 1):
        bits = rng.random((n, 1024)) < 0.1
        bits[:copies] = np.arange(1024) % 10 == 0
        bits[copies : copies + 9] = (rng.random((9, 1024)) < 0.02) ^ (np.arange(1024) % 7 == 0)  # near copies of one string
        out.append((np.packbits(bits, axis=1), bits.sum(1).astype(np.int32), np.arange(n), np.full(n, d, np.int32)))
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_full_product_compares_unions_and_distinct_strings(threshold, monkeypatch):
    n, cells = 1500, []
    left, right = _sparse_tiles(n, 40)
    margins = product._margins
    monkeypatch.setattr(product, "_margins", lambda a, b, n_bits: cells.append(len(a) * len(b)) or margins(a, b, n_bits))
    hits = list(product.hits_of(left, right, named("dice"), threshold, 1024, None))
    a, b = (np.unpackbits(x[0], axis=1).astype(np.float64) for x in (left, right))
    sim = 2 * (a @ b.T) / (left[1][:, None] + right[1][None, :])
    x, y = np.nonzero(sim >= threshold)
    got = sorted((int(i), int(j), float(s)) for h in hits for s, i, j in zip(*h))
    assert got == sorted(zip(x.tolist(), y.tolist(), sim[x, y].tolist())) and len(got) > 1600
    assert sum(cells) < n * n / 3


def test_full_product_of_copies_leaves_in_pieces(monkeypatch):
    monkeypatch.setattr(product, "FLUSH", 1000)
    tile = (np.full((300, 128), 1, np.uint8), np.full(300, 128, np.int32), np.arange(300), np.zeros(300, np.int32))
    hits = list(product.hits_of(tile, tile, named("dice"), 0.9, 1024, None))
    assert max(len(h[0]) for h in hits) <= 1000
    assert len({(int(i), int(j)) for _, x, y in hits for i, j in zip(x, y)}) == 300 * 300


def test_pairs_of_several_large_blocks_once_without_a_set_for_each():
    """What a pair's earlier block is found by: bits of the lower keys that both tiles have, for whole batches of pairs."""
    rng = random.Random(8)
    own = [[sorted(rng.sample([f"k{i}" for i in range(150)], rng.randrange(1, 40)) + ["k50x"]) for _ in range(40)] for _ in (0, 1)]
    met = blocks._met_before(*own, "k50x")
    x, y = (g.ravel() for g in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    assert met(x, y).tolist() == [min(set(own[0][i]) & set(own[1][j])) != "k50x" for i, j in zip(x, y)]
    assert not blocks._met_before([["a"], ["b", "c"]], [["a"], ["c"]], "a")(np.array([0, 1]), np.array([0, 1])).any()


@pytest.mark.parametrize("similarity,k", [(SMC, 1), (SMC, 3), (replace(DICE, two_sided=True), 2)])
def test_limits_of_both_sides_rise_inside_a_tile(monkeypatch, similarity, k):
    """Few of the pairs over the threshold are scored, and none that the limits keep is missed; ties, copies and blocks of any size."""
    rng = np.random.default_rng(k)
    sides = []
    for n, d in ((700, 0), (900, 1)):
        bits = rng.integers(0, 256, (n, 8), dtype=np.uint8)
        bits[::50] = bits[0]
        sides.append((bits, np.bitwise_count(bits).sum(1).astype(np.int32), rng.permutation(n).astype(np.int64), np.full(n, d, np.int32)))
    common = np.bitwise_count(sides[0][0][:, None] & sides[1][0][None]).sum(2)
    sim = similarity.counts(common, sides[0][1][:, None], sides[1][1][None, :], 64)
    x, y = np.nonzero(sim >= 0.5)

    def kept(s, x, y):
        top = (product._rank_within(x, s, sides[1][2][y]) < k) & (product._rank_within(y, s, sides[0][2][x]) < k)
        return sorted(zip(s[top].tolist(), x[top].tolist(), y[top].tolist()))

    want, scored, scores = kept(sim[x, y], x, y), [], product._scores
    monkeypatch.setattr(product, "_scores", lambda *a: scored.append(np.count_nonzero(a[-1])) or scores(*a))
    for rows, narrow, flush in ((512, 2048, 500_000), (64, 100, 300)):
        for name, value in (("ROWS", rows), ("NARROW", narrow), ("FLUSH", flush)):
            monkeypatch.setattr(product, name, value, raising=False)
        for floors in (None, (np.full(700, 0.5), np.full(900, -np.inf))):
            scored.clear()
            got = [np.concatenate(c) for c in zip(*product.hits_of(*sides, similarity, 0.5, 64, k, floors))]
            assert kept(*got) == want
            assert sum(scored) < len(x) / 4


def test_limited_pairs_equal_enforced_ones(spark):
    rng = random.Random(5)
    datasets = [[(i, bytes(rng.choices(range(256), k=2))) for i in range(60)] for _ in range(3)]
    records = [spark.createDataFrame(d, "rec_i long, clk binary") for d in datasets]
    for k in (1, 2):
        want = ops.enforce_k(ops.find_candidate_pairs(records, "dice", 0.6), k)
        assert sorted(map(tuple, ops.find_limited_pairs(records, "dice", 0.6, k).collect())) == sorted(map(tuple, want.collect()))


def test_disjoint_runs_are_not_shuffled(spark):
    data = table(spark, make(9, (30, 40)))
    tiles = list(ops.split_to_chunks(200, dataset_sizes=[30, 40]))
    merged = ops.merge_pairs(*[ops.process_chunk(c, data, "dice", 0.5, in_order=False) for c in tiles], in_order=False, disjoint=True)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(merged)) == sorted(rows(ops.find_candidate_pairs(data, "dice", 0.5)))
