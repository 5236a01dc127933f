import random

import numpy as np
import pytest

from tests import linkage_spec as spec
from veilmatch import operators as ops
from veilmatch.operators import solving, stats
from veilmatch.schema import PAIRS


def some(seed, n=60):
    rng = random.Random(seed)
    ids = rng.sample([(a, b) for a in range(15) for b in range(15)], n)
    return spec.canonical([(rng.choice([rng.random(), 0.5, 0.25, 1.0]), 0, 1, a, b) for a, b in ids])


@pytest.mark.parametrize("given", [some(1), [], [(0.5, 0, 1, 0, 0)], [(0.5, 0, 1, 0, 0), (0.5, 0, 1, 1, 0)]])
def test_histograms(spark, given):
    df = spark.createDataFrame(given, PAIRS)
    sims = np.array([r[0] for r in given])
    want, edges = np.histogram(sims, bins=7)
    got = ops.similarities_hist(df, 7).orderBy("bin").collect()
    assert [r["n"] for r in got] == want.tolist() and [r["lo"] for r in got] == edges[:-1].tolist()
    good = set(spec.greedy([(r[3], r[4]) for r in given]))
    both = ops.matches_nonmatches_hist(df, 7).orderBy("bin").collect()
    assert [r["matches"] for r in both] == np.histogram([r[0] for r in given if (r[3], r[4]) in good], bins=edges)[0].tolist()
    assert [r["matches"] + r["nonmatches"] for r in both] == want.tolist()
    curve = ops.cumul_number_matches_vs_threshold(df, 7).orderBy("step").collect()
    assert [r["num_matches"] for r in curve] == [len(spec.greedy([(r[3], r[4]) for r in given if r[0] >= t])) for t in edges]


def test_nonmatch_index(spark):
    order = [(0, 1), (0, 0), (1, 1), (1, 2), (2, 2)]
    df = spark.createDataFrame([(1 - i / 10, 0, 1, a, b) for i, (a, b) in enumerate(order)], PAIRS)
    assert [ops.nonmatch_index_score(df, n) for n in (1, 2, 3)] == [1, 2, 4]
    for n in (4, 0):
        with pytest.raises(ValueError):
            ops.nonmatch_index_score(df, n)


def test_two_parties_only(spark):
    df = spark.createDataFrame([(0.5, 0, 2, 0, 0)], PAIRS)
    for f in (ops.matches_nonmatches_hist, ops.cumul_number_matches_vs_threshold, ops.nonmatch_index_score):
        with pytest.raises(ValueError):
            f(df)


def test_precision_recall(spark):
    found = spark.createDataFrame([(0, 0), (1, 1), (2, 5)], "rec_i0 long, rec_i1 long")
    truth = spark.createDataFrame([(0, 0), (1, 1), (3, 3), (4, 4)], "rec_i0 long, rec_i1 long")
    r = ops.precision_recall(found, truth).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 2) and r["f1"] == 4 / 7
    assert ops.precision_recall(found.limit(0), truth.limit(0)).first()["f1"] == 0.0


def test_precision_recall_of_classes_equals_that_of_pairs(spark):
    """Copies, near copies with one class, empty strings, null classes, records without a class."""
    rng = random.Random(3)
    pool = [rng.randbytes(4) for _ in range(5)] + [bytes(4)]
    records = [(d, r, rng.choice(pool)) for d in (0, 1) for r in range(40)]
    classes = [(d, r, rng.choice(["x", "y", None]) if rng.random() < 0.3 else x.hex()) for d, r, x in records if r % 9]
    df = spark.createDataFrame(records, "dset_i int, rec_i long, clk binary")
    cls = spark.createDataFrame(classes, "dset_i int, rec_i long, class string")
    found = ops.find_candidate_pairs(df, "dice", 0.9)
    a, b = (cls.where(f"dset_i = {i}").selectExpr(f"rec_i as rec_i{i}", "class") for i in (0, 1))
    truth = a.join(b, "class").select("rec_i0", "rec_i1")
    want = ops.precision_recall(found, truth).first()
    got = ops.precision_recall_of_classes(df, cls, "dice", 0.9)
    assert got.first() == want and min(want["tp"], want["fp"], want["fn"]) > 0
    assert got.schema.names == ops.precision_recall(found, truth).schema.names
    assert tuple(ops.precision_recall_of_classes(df.limit(0), cls, "dice", 0.9).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def _records(spark, parties, n, seed=4):
    rng = random.Random(seed)
    pool = [rng.randbytes(3) for _ in range(3 * n // 2)]
    return spark.createDataFrame([(d, r, rng.choice(pool)) for d in range(parties) for r in range(n)], "dset_i int, rec_i long, clk binary")


def test_statistics_of_records_equal_those_of_pairs(spark, monkeypatch):
    """Bands of few pairs, ties of copies, and too few nonmatches in the first bands."""
    for module in (solving, stats):
        monkeypatch.setattr(module, "PREFIX_PAIRS", 60)
    records = _records(spark, 2, 30)
    pairs = ops.find_candidate_pairs(records, "dice", 0.5)
    assert sorted(map(tuple, ops.match_hist_of_records(records, "dice", 0.5, 7).collect())) == sorted(map(tuple, ops.matches_nonmatches_hist(pairs, 7).collect()))
    assert ops.deciding_pairs(records, "dice", 0.5).count() < pairs.count() / 2
    n = 100
    assert ops.nonmatch_index_of_records(records, "dice", 0.5, [1, n]) == [ops.nonmatch_index_score(pairs, 1), ops.nonmatch_index_score(pairs, n)]
    with pytest.raises(ValueError):
        ops.nonmatch_index_of_records(records, "dice", 0.5, [10**6])
    with pytest.raises(ValueError):
        ops.match_hist_of_records(_records(spark, 3, 5), "dice", 0.5, 7)
    none = records.limit(0)
    assert [r["matches"] for r in ops.match_hist_of_records(none, "dice", 0.5, 3).collect()] == [0, 0, 0]


@pytest.mark.parametrize("merge_threshold,deduplicated", [(1.0, False), (0.5, True)])
def test_deciding_pairs_have_the_groups_of_all_pairs(spark, monkeypatch, merge_threshold, deduplicated):
    records = _records(spark, 3, 35, 8)
    pairs = ops.find_candidate_pairs(records, "dice", 0.5)
    want = spec_groups(pairs, merge_threshold, deduplicated)
    monkeypatch.setattr(solving, "PREFIX_PAIRS", 150)
    left = ops.deciding_pairs(records, "dice", 0.5, merge_threshold, deduplicated)
    assert left.count() < pairs.count() and spec_groups(left, merge_threshold, deduplicated) == want


def spec_groups(pairs, merge_threshold, deduplicated):
    rows = spec.canonical([tuple(r) for r in pairs.collect()])
    return sorted(sorted(g) for g in solving.fold([((a, x), (b, y)) for _, a, b, x, y in rows], merge_threshold, deduplicated))
