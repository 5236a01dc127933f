import random

import pytest
from pyspark.sql import functions as F

from tests import linkage_spec as spec
from veilmatch import operators as ops
from veilmatch.operators import solving
from veilmatch.operators.components import components
from veilmatch.operators.merging import fold_groups, merge_rounds
from veilmatch.schema import PAIRS, canonical_order


def pairs(spark, text):
    """Pairs written '.8 0.0-1.0; ...'."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(";"))):
        sim, ids = part.split()
        (a, b), (c, d) = (map(int, x.split(".")) for x in ids.split("-"))
        out.append((float(sim), a, c, b, d))
    return spark.createDataFrame(out, PAIRS)


def groups(df):
    return {frozenset((m["dset_i"], m["rec_i"]) for m in r["members"]) for r in ops.nested_groups(df).collect()}


def written(text):
    return {frozenset(tuple(map(int, x.split("."))) for x in g.split()) for g in filter(None, text.split("|"))}


GREEDY = [
    (".8 0.0-1.0", "0.0 1.0"),
    (".8 0.0-1.0; .7 0.1-1.0", "0.0 1.0"),
    ("", ""),
    (".8 0.0-1.0; .7 0.0-1.1; .7 0.1-1.0; .6 0.1-1.1", "0.0 1.0|0.1 1.1"),
    (".9 1.0-2.0; .8 0.0-1.1; .8 0.0-2.1; .8 1.1-2.1; .7 0.0-1.0; .7 0.0-2.0", "0.0 1.1 2.1|1.0 2.0"),
    (".8 0.0-1.0; .8 0.1-2.1; .8 1.1-2.1; .7 0.0-2.0; .7 0.1-1.1", "0.0 1.0|0.1 1.1 2.1"),
    ("1 0.0-1.0; 1 0.0-2.0; 1 2.0-2.1", "0.0 1.0|2.0 2.1"),
    (".9 0.0-1.0; .9 2.0-3.0; .7 0.0-2.0; .7 1.0-3.0; .7 0.0-3.0; .7 1.0-2.0", "0.0 1.0 2.0 3.0"),
]


@pytest.mark.parametrize("given,want", GREEDY)
def test_greedy(spark, given, want):
    assert groups(ops.greedy_solve(pairs(spark, given))) == written(want)


def test_greedy_joins_five_by_order(spark):
    given = ["0-1", "2-3", "2-4", "3-4", "0-2", "0-3", "0-4", "1-2", "1-3", "1-4"]
    rows = [(i, *(int(x) for x in g.split("-"))) for i, g in enumerate(given)]
    df = spark.createDataFrame([(1.0, a, b, 0, 0, i) for i, a, b in rows], "sim double, dset_i0 int, dset_i1 int, rec_i0 long, rec_i1 long, place int")
    assert groups(ops.greedy_solve(df, order="place")) == {frozenset((d, 0) for d in range(5))}


@pytest.mark.parametrize("threshold,dedup,want", [(0.0, True, "0.0 1.0"), (0.75, True, "0.0 1.0"), (0.76, True, "0.0 1.0"), (1.0, True, "0.0 1.0"), (0.0, False, "0.0 0.1 1.0 1.1"), (0.75, False, "0.0 0.1 1.0 1.1"), (0.76, False, "0.0 0.1|1.0 1.1"), (1.0, False, "0.0 0.1|1.0 1.1")])
def test_probabilistic(spark, threshold, dedup, want):
    given = ".9 0.0-0.1; .8 1.0-1.1; .7 0.0-1.0; .6 0.0-1.1; .5 0.1-1.0"
    assert groups(ops.probabilistic_greedy_solve(pairs(spark, given), merge_threshold=threshold, deduplicated=dedup)) == written(want)


@pytest.mark.parametrize("bad", [-0.1, 1.01])
def test_merge_threshold_is_checked(spark, bad):
    with pytest.raises(ValueError):
        ops.probabilistic_greedy_solve(pairs(spark, ""), merge_threshold=bad)


def two_party(seed, n=40, ties=3):
    rng = random.Random(seed)
    ids = rng.sample([(a, b) for a in range(12) for b in range(12)], n)
    return spec.canonical([(rng.randrange(ties) / ties, 0, 1, a, b) for a, b in ids])


@pytest.mark.parametrize("seed", range(3))
def test_rounds_and_components_equal_the_fold(spark, seed, monkeypatch):
    given = two_party(seed)
    df = spark.createDataFrame(given, PAIRS)
    want = set(spec.greedy([(r[3], r[4]) for r in given]))
    assert {tuple(r) for r in ops.pairs_from_groups(ops.greedy_solve(df)).collect()} == want
    assert {(r["rec_i0"], r["rec_i1"]) for r in ops.matching_rounds(df, rounds=2).collect()} == want
    assert sorted(tuple(r) for r in ops.pivot_matching(df, small=6).select("rec_i0", "rec_i1").collect()) == sorted(want)
    if seed == 0:
        monkeypatch.setattr(solving, "FOLD_PAIRS", 5)  # of two components, a larger one goes by rounds
        more = df.unionByName(spark.createDataFrame([(0.5, 0, 1, 100, 100)], PAIRS))
        assert {tuple(r) for r in ops.pairs_from_groups(ops.greedy_solve(more)).collect()} == want | {(100, 100)}


def test_pivots_on_ties_and_nothing(spark):
    same = spark.createDataFrame([(0.5, 0, 1, a, b) for a in (1, 2, 3) for b in (4, 5)], PAIRS)
    for small in (0, 2, 100):
        assert sorted(tuple(r) for r in ops.pivot_matching(same, small=small).collect()) == [(0.5, 1, 4), (0.5, 2, 5)]
    assert ops.pivot_matching(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ops.pivot_matching(spark.createDataFrame([(0.5, 0, 2, 1, 1)], PAIRS))


def crowd(seed, pieces=70):
    """Many small components of two to four datasets, pairs inside a dataset included, in random order."""
    rng = random.Random(seed)
    given = []
    for c in range(pieces):
        nodes = [(d, 10 * c + r) for d in range(rng.randrange(2, 5)) for r in range(rng.randrange(1, 5))]
        every = [(x, y) for i, x in enumerate(nodes) for y in nodes[:i]]
        given += rng.sample(every, rng.randrange(len(every) + 1))
    rng.shuffle(given)
    return given


@pytest.mark.parametrize("merge_threshold, deduplicated, rounds", [(1.0, False, 100), (0.5, True, 100), (0.3, False, 100), (0.75, False, 2), (0.0, True, 1)])
def test_merges_in_rounds_equal_the_fold(spark, merge_threshold, deduplicated, rounds):
    given = crowd(int(10 * merge_threshold))
    df = spark.createDataFrame([(i, x[0], y[0], x[1], y[1]) for i, (x, y) in enumerate(given)], "i long, dset_i0 int, dset_i1 int, rec_i0 long, rec_i1 long").repartition(3)
    got = {}
    for r in merge_rounds(df, merge_threshold, deduplicated, [F.col("i")], rounds=rounds).collect():
        got.setdefault((r["root"]["d"], r["root"]["r"]), []).append((r["node"]["d"], r["node"]["r"]))
    want = solving.fold(given, merge_threshold, deduplicated)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert all(min(m) == root for root, m in got.items())


def test_folding_contracted_groups_equals_the_fold():
    rng = random.Random(8)
    for _ in range(300):
        given, t, once = crowd(rng.random(), 2), rng.choice([0.0, 0.3, 0.5, 0.75, 1.0]), rng.random() < 0.5
        places = fold_groups([(i, x, 1, -1, [x[0]], y, 1, -1, [y[0]]) for i, (x, y) in enumerate(given)], t, once)
        root = {n: n for e in given for n in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in places:
            root[find(given[i][0])] = find(given[i][1])
        groups = {}
        for n in root:
            groups.setdefault(find(n), []).append(n)
        assert sorted(sorted(m) for m in groups.values() if len(m) > 1) == sorted(map(sorted, solving.fold(given, t, once)))


def test_no_pairs_no_merges(spark):
    empty = spark.createDataFrame([], PAIRS)
    assert merge_rounds(empty, 1.0, False, canonical_order()).count() == 0
    loop = spark.createDataFrame([(1.0, 0, 0, 3, 3)], PAIRS)
    assert merge_rounds(loop, 1.0, False, canonical_order()).count() == 0


@pytest.mark.parametrize("parties, threshold, dedup", [(2, 1.0, False), (3, 1.0, False), (3, 0.5, True)])
def test_best_pairs_decide_most_others(spark, monkeypatch, parties, threshold, dedup):
    """Pairs that the best ones leave without effect go before anything is shuffled; groups and matches stay."""
    rng = random.Random(parties)
    nodes = [(d, r) for d in range(parties) for r in range(14)]
    given = [(rng.randrange(20) / 20, x[0], y[0], x[1], y[1]) for x in nodes for y in nodes if x[0] < y[0] and rng.random() < 0.7]
    df = spark.createDataFrame(given, PAIRS)
    want = groups(ops.probabilistic_greedy_solve(df, merge_threshold=threshold, deduplicated=dedup))
    monkeypatch.setattr(solving, "PREFIX_PAIRS", 20)
    left = ops.undecided_pairs(df, threshold, dedup)
    assert left.count() < len(given) / 2 and want
    assert groups(ops.probabilistic_greedy_solve(df, merge_threshold=threshold, deduplicated=dedup)) == want
    inner = df.unionByName(spark.createDataFrame([(0.9, 0, 0, 1, 2)], PAIRS))
    assert (ops.undecided_pairs(inner, threshold, dedup).count() < len(given)) == dedup and ops.undecided_pairs(df, 0.5, False).count() == len(given)
    if parties == 2:
        good = spec.greedy([(r[3], r[4]) for r in spec.canonical(given)])
        assert sorted(tuple(r) for r in ops.matching_rounds(df, rounds=2).select("rec_i0", "rec_i1").collect()) == sorted(good)
        assert sorted((r["rec_i0"], r["rec_i1"]) for r in ops.match_labels(df).where("is_match").collect()) == sorted(good)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_many_components_equal_the_fold(spark, batch, monkeypatch):
    rng = random.Random(5)
    given = []
    for c in range(12):  # components of 1 to 40 pairs over three datasets
        nodes = [(d, 10 * c + r) for d in range(3) for r in range(rng.randrange(1, 6))]
        every = [(x, y) for x in nodes for y in nodes if x[0] < y[0]]
        given += [(rng.randrange(4) / 4, x[0], y[0], x[1], y[1]) for x, y in rng.sample(every, rng.randrange(1, len(every) + 1))]
    df = spark.createDataFrame(given, PAIRS)
    want = groups(ops.probabilistic_greedy_solve(df, merge_threshold=0.5))
    monkeypatch.setattr(solving, "FOLD_PAIRS", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert groups(ops.probabilistic_greedy_solve(df, merge_threshold=0.5)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_pairs_from_groups_rejects_other_groups(spark):
    with pytest.raises(Exception, match="two-party"):
        ops.pairs_from_groups(ops.greedy_solve(pairs(spark, ".9 0.0-0.1"))).collect()


def slow_groups(pairs, merge_threshold, deduplicated):
    """Groups as sets; two merge once enough of their cross pairs were seen and, if asked for, no dataset occurs twice."""
    group, seen = {}, set()
    for x, y in pairs:
        a, b = group.setdefault(x, frozenset([x])), group.setdefault(y, frozenset([y]))
        if a == b:
            continue
        seen.add(frozenset([x, y]))
        count = sum(frozenset([p, q]) in seen for p in a for q in b)
        clash = deduplicated and {p[0] for p in a} & {q[0] for q in b}
        if not clash and count >= merge_threshold * len(a) * len(b):
            for p in a | b:
                group[p] = a | b
    return {g for g in group.values() if len(g) > 1}


@pytest.mark.parametrize("merge_threshold", [0.0, 0.3, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("deduplicated", [True, False])
def test_fold_equals_brute_force(merge_threshold, deduplicated):
    rng = random.Random(int(merge_threshold * 100) + deduplicated)
    for _ in range(150):
        nodes = [(d, r) for d in range(rng.randrange(2, 5)) for r in range(rng.randrange(1, 4))]
        every = [(x, y) for i, x in enumerate(nodes) for y in nodes[:i]]
        given = rng.sample(every, rng.randrange(len(every) + 1))
        got = {frozenset(g) for g in solving.fold(given, merge_threshold, deduplicated)}
        assert got == slow_groups(given, merge_threshold, deduplicated)


def test_order_of_rows_and_partitions_does_not_matter(spark):
    given = two_party(9)
    want = None
    for parts in (1, 3, 7):
        rows = list(given)
        random.Random(parts).shuffle(rows)
        got = groups(ops.greedy_solve(spark.createDataFrame(rows, PAIRS).repartition(parts)))
        want = got if want is None else want
        assert got == want
