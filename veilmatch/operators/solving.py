"""Solvers: candidate pairs, walked in order of priority, become groups of records.

State flows only between groups that a pair joins, so each connected component
can be solved alone.  Small inputs are folded in one task; larger ones are split
into components first.  A component too large for a task is solved in rounds of
merges that cannot conflict (merging.py); two parties can also be matched in rounds
of locally best pairs, or band by band of similarity.  All give the greedy result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmatch.operators.components import components
from veilmatch.operators.merging import merge_rounds
from veilmatch.schema import GROUPS, canonical_order
from veilmatch.session import share_code, write_table

#: Pairs that one task folds.
FOLD_PAIRS = 2_000_000
#: Best pairs that are solved to find which of the others can still change a group; up to twice as many are taken where they tie, which a task still folds.
PREFIX_PAIRS = 1_000_000
#: Rounds of locally best pairs before the rest is folded.
MATCHING_ROUNDS = 12

Node = tuple[int, int]


def fold(pairs: Iterable[tuple[Node, Node]], merge_threshold: float = 1.0, deduplicated: bool = False) -> list[list[Node]]:
    """Groups of at least two records from pairs in order of priority.

    Two groups merge once the pairs seen between them are at least
    ``merge_threshold`` of all their cross pairs and, if ``deduplicated``, no dataset
    would occur twice.
    """
    group_of: dict[Node, int] = {}
    members: dict[int, list[Node]] = {}
    parties: dict[int, set[int]] = {}
    seen: dict[int, dict[int, int]] = defaultdict(dict)
    fresh = 0

    def start(nodes: list[Node]) -> int:
        nonlocal fresh
        fresh += 1
        members[fresh], parties[fresh] = nodes, {n[0] for n in nodes}
        for n in nodes:
            group_of[n] = fresh
        return fresh

    for x, y in pairs:
        if x == y:
            continue
        g, h = group_of.get(x), group_of.get(y)
        if g is None and h is None:
            if not (deduplicated and x[0] == y[0]):
                start([x, y])
            continue
        if g is None or h is None:
            grouped, lone = (h, x) if g is None else (g, y)
            clash = deduplicated and lone[0] in parties[grouped]
            if not clash and 1 >= merge_threshold * len(members[grouped]):
                members[grouped].append(lone)
                parties[grouped].add(lone[0])
                group_of[lone] = grouped
            else:
                own = start([lone])
                seen[grouped][own] = seen[own][grouped] = 1
            continue
        if g == h:
            continue
        overlap = seen[g].get(h, 0) + 1
        clash = deduplicated and not parties[g].isdisjoint(parties[h])
        if clash or overlap < merge_threshold * len(members[g]) * len(members[h]):
            seen[g][h] = seen[h][g] = overlap
            continue
        if len(members[g]) < len(members[h]):
            g, h = h, g
        for n in members[h]:
            group_of[n] = g
        members[g] += members.pop(h)
        parties[g] |= parties.pop(h)
        for other, count in seen.pop(h, {}).items():
            del seen[other][h]
            if other != g:
                seen[g][other] = seen[other][g] = seen[g].get(other, 0) + count
    return [m for m in members.values() if len(m) > 1]


def _folded(rows: pd.DataFrame, merge_threshold: float, deduplicated: bool, order: Sequence[str], ascending: Sequence[bool]) -> pd.DataFrame:
    rows = rows.sort_values(list(order), ascending=list(ascending), kind="stable")
    ids = [rows[c].tolist() for c in ("dset_i0", "rec_i0", "dset_i1", "rec_i1")]
    out = [(min(m), n) for m in fold((((a, b), (c, d)) for a, b, c, d in zip(*ids)), merge_threshold, deduplicated) for n in m]
    return pd.DataFrame({"g_dset": [g[0] for g, _ in out], "g_rec": [g[1] for g, _ in out], "dset_i": [n[0] for _, n in out], "rec_i": [n[1] for _, n in out]}, dtype="int64")


def _by_component(solve: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``solve`` for rows sorted by column ``root``: many small components in one call, as no state flows between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last component seen, which may go on
        for b in batches:
            if not len(b):
                continue
            keys = pc.run_end_encode(pc.binary_join_element_wise(*(pc.cast(x, pa.string()) for x in b.column("root").flatten()), ","))
            ends = keys.run_ends.to_pylist()
            begins = ends[-2] if len(ends) > 1 else 0  # where the batch's last component begins
            if held and (begins or held[-1].column("root")[len(held[-1]) - 1] != b.column("root")[0]):
                held.append(b.slice(0, begins))
                yield from solved(held)
                held = []
            elif begins:
                yield from solved([b.slice(0, begins)])
            held.append(b.slice(begins))
        if held:
            yield from solved(held)

    def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return iter(pa.Table.from_pandas(solve(pa.Table.from_batches(parts).drop_columns(["root"]).to_pandas()), preserve_index=False).to_batches())

    return run


def _checked(pairs: DataFrame, merge_threshold: float) -> None:
    if not 0 <= merge_threshold <= 1:
        raise ValueError(f"merge_threshold must be in [0, 1], not {merge_threshold}")
    for c in ("dset_i0", "dset_i1", "rec_i0", "rec_i1"):
        if c not in pairs.columns:
            raise ValueError(f"candidate pairs lack {c}")


def _solved(held: DataFrame, merge_threshold: float, deduplicated: bool, by: Sequence[str], ascending: Sequence[bool]) -> DataFrame:
    """(g_dset, g_rec, dset_i, rec_i): groups of written pairs."""
    schema = "g_dset bigint, g_rec bigint, dset_i bigint, rec_i bigint"
    solve = lambda pdf: _folded(pdf, merge_threshold, deduplicated, by, ascending)
    if held.count() <= FOLD_PAIRS:
        solved = held.withColumn("_one", F.col("dset_i0") * 0).groupBy("_one").applyInPandas(solve, schema)
    else:
        a, b = (F.struct(F.col(f"dset_i{i}").cast("bigint").alias("d"), F.col(f"rec_i{i}").alias("r")) for i in (0, 1))
        roots = components(held.select(a.alias("a"), b.alias("b")))
        tagged = write_table(held.withColumn("node", a).join(roots, "node").drop("node"), "tagged")
        large = tagged.groupBy("root").count().where(F.col("count") > FOLD_PAIRS).select("root")
        large = write_table(large, "large")
        small = tagged.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root")
        solved = small.mapInArrow(_by_component(solve), schema)
        if not large.isEmpty():
            order_by = [F.col(c).asc() if up else F.col(c).desc() for c, up in zip(by, ascending)]
            merged = merge_rounds(tagged.join(large, "root", "left_semi"), merge_threshold, deduplicated, order_by)
            solved = solved.unionByName(merged.select(F.col("root.d").alias("g_dset"), F.col("root.r").alias("g_rec"), F.col("node.d").alias("dset_i"), F.col("node.r").alias("rec_i")))
    return solved


def _first_pairs(pairs: DataFrame, key: Column, aim: int, size: int) -> DataFrame | None:
    """About ``aim`` pairs of the lowest ``key``, ties together; None if that is all of them."""
    cut = pairs.agg(F.percentile_approx(key, min(1.0, aim / size), max(10_000, 20 * size // aim))).first()[0]
    upto, below = pairs.where(key <= F.lit(cut)), pairs.where(key < F.lit(cut))
    n = upto.count()
    if n > 2 * aim and below.count() >= aim / 64:  # many pairs tie at the cut: the next time
        return below
    return upto if n < size else None


def live_pairs(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs inside one of the ``groups`` (g_dset, g_rec, dset_i, rec_i), or of two, or lone records, that share no dataset."""
    parties = groups.groupBy("g_dset", "g_rec").agg(F.collect_set("dset_i").alias("parties"))
    known = write_table(groups.join(parties, ["g_dset", "g_rec"]), "known")
    for i in (0, 1):
        side = known.select(F.col("dset_i").cast("int").alias(f"dset_i{i}"), F.col("rec_i").alias(f"rec_i{i}"), F.struct("g_dset", "g_rec").alias(f"_g{i}"), F.col("parties").alias(f"_p{i}"))
        pairs = pairs.join(F.broadcast(side), [f"dset_i{i}", f"rec_i{i}"], "left").withColumn(f"_p{i}", F.coalesce(f"_p{i}", F.array(F.col(f"dset_i{i}").cast("bigint"))))
    inside = F.coalesce(F.col("_g0") == F.col("_g1"), F.lit(False))
    return pairs.where(inside | ~F.arrays_overlap("_p0", "_p1"))


def undecided_pairs(pairs: DataFrame, merge_threshold: float = 1.0, deduplicated: bool = False, order: str | None = None) -> DataFrame:
    """Written ``pairs`` (each at most once) without those that cannot change the groups, if there are over PREFIX_PAIRS.

    The best pairs alone are solved.  Groups only grow, so two that share a dataset by then
    never merge: if ``deduplicated``, as the dataset would occur twice; if all cross pairs
    are wanted and no pair lies inside a dataset, as one is missing.  No merge counts the
    pairs between such groups, so the others alone have the same groups.  Records of the
    best pairs, two for each at most, are sent to every task; the pairs are not shuffled.
    """
    size, aim = pairs.count(), PREFIX_PAIRS
    if size <= aim or not (order is None or isinstance(pairs.schema[order].dataType, T.NumericType)):
        return pairs
    if not deduplicated and (merge_threshold < 1 or not pairs.where("dset_i0 = dset_i1 and rec_i0 <> rec_i1").isEmpty()):
        return pairs
    by, ascending = ([order], [True]) if order else (["sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1"], [False, True, True, True, True])
    key = F.col(order) if order else -F.col("sim")
    columns = pairs.columns
    while size > aim:
        first = _first_pairs(pairs, key, aim, size)
        if first is None:
            break
        groups = write_table(_solved(first, merge_threshold, deduplicated, by, ascending), "first-groups")
        pairs = write_table(live_pairs(pairs, groups).select(*columns), "undecided")
        left = pairs.count()
        aim = aim if left <= 0.8 * size else 4 * aim
        size = left
    return pairs


def probabilistic_greedy_solve(pairs: DataFrame, *, merge_threshold: float = 0.5, deduplicated: bool = True, order: str | None = None) -> DataFrame:
    """Groups (group_id, dset_i, rec_i) of at least two records; group_id is the group's smallest (dset_i, rec_i).

    Pairs are taken in canonical order, or by ascending column ``order``.  Any number
    of datasets; pairs inside a dataset are legal.
    """
    _checked(pairs, merge_threshold)
    share_code(pairs.sparkSession)
    by, ascending = ([order], [True]) if order else (["sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1"], [False, True, True, True, True])
    ids = pairs.select("dset_i0", "rec_i0", "dset_i1", "rec_i1", *(x for x in by if x in ("sim", order)))
    held = undecided_pairs(write_table(ids, "pairs"), merge_threshold, deduplicated, order)
    solved = _solved(held, merge_threshold, deduplicated, by, ascending)
    return solved.select(
        F.struct(F.col("g_dset").cast("int").alias("dset_i"), F.col("g_rec").alias("rec_i")).alias("group_id"),
        F.col("dset_i").cast("int").alias("dset_i"),
        "rec_i",
    ).to(GROUPS)


def greedy_solve(pairs: DataFrame, *, order: str | None = None) -> DataFrame:
    """Groups in which every cross pair was a candidate: merge only when all pairs between two groups were seen."""
    return probabilistic_greedy_solve(pairs, merge_threshold=1.0, deduplicated=False, order=order)


def nested_groups(groups: DataFrame) -> DataFrame:
    """One row per group: (group_id, members ARRAY<STRUCT<dset_i, rec_i>>), members sorted."""
    return groups.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("dset_i", "rec_i"))).alias("members"))


def pairs_from_groups(groups: DataFrame) -> DataFrame:
    """(rec_i0, rec_i1) of two-party groups; fails on a group that is not one record of dataset 0 and one of dataset 1."""
    found = groups.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("dset_i") == 0).alias("left"),
        F.count_if(F.col("dset_i") == 1).alias("right"),
        F.max(F.when(F.col("dset_i") == 0, F.col("rec_i"))).alias("rec_i0"),
        F.max(F.when(F.col("dset_i") == 1, F.col("rec_i"))).alias("rec_i1"),
    )
    good = (F.col("n") == 2) & (F.col("left") == 1) & (F.col("right") == 1)
    return found.select(F.when(good, F.col("rec_i0")).otherwise(F.raise_error(F.lit("only two-party groups can become pairs")).cast("bigint")).alias("rec_i0"), "rec_i1")


def check_bipartite(pairs: DataFrame) -> None:
    """ValueError unless all pairs lead from dataset 0 to dataset 1."""
    ok = pairs.agg(F.bool_and((F.col("dset_i0") == 0) & (F.col("dset_i1") == 1))).first()[0]
    if ok is False:
        raise ValueError("only two-party candidate pairs are supported")


def matching_rounds(pairs: DataFrame, rounds: int = MATCHING_ROUNDS) -> DataFrame:
    """Greedy two-party matching (sim, rec_i0, rec_i1) without a sequential fold of all pairs.

    Each round accepts the pairs that are best for both their records and drops
    all pairs of the records so matched.  What is left after ``rounds`` is folded.
    """
    given = write_table(pairs.select("sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1"), "unmatched")
    check_bipartite(given)
    left = undecided_pairs(given).select("sim", "rec_i0", "rec_i1")
    matched: DataFrame | None = None
    for _ in range(rounds):
        best0 = left.groupBy("rec_i0").agg(F.max(F.struct("sim", (-F.col("rec_i0")).alias("x"), (-F.col("rec_i1")).alias("y"))).alias("m"))
        best1 = left.groupBy("rec_i1").agg(F.max(F.struct("sim", (-F.col("rec_i0")).alias("x"), (-F.col("rec_i1")).alias("y"))).alias("m"))
        one, two = (b.select(F.col("m.sim").alias("sim"), (-F.col("m.x")).alias("rec_i0"), (-F.col("m.y")).alias("rec_i1")) for b in (best0, best1))
        new = write_table(one.join(two, ["sim", "rec_i0", "rec_i1"]), "matched")
        matched = new if matched is None else matched.unionByName(new)
        left = write_table(left.join(new.select("rec_i0"), "rec_i0", "left_anti").join(new.select("rec_i1"), "rec_i1", "left_anti").select("sim", "rec_i0", "rec_i1"), "unmatched")
        if left.isEmpty():
            return matched
    rest = left.select("sim", F.lit(0).alias("dset_i0"), F.lit(1).alias("dset_i1"), "rec_i0", "rec_i1")
    more = pairs_from_groups(greedy_solve(rest)).join(left, ["rec_i0", "rec_i1"]).select("sim", "rec_i0", "rec_i1")
    return more if matched is None else matched.unionByName(more)


def pivot_matching(pairs: DataFrame, small: int = FOLD_PAIRS) -> DataFrame:
    """Greedy two-party matching (sim, rec_i0, rec_i1) by recursion over pivots of similarity, without a total sort.

    A band of pairs is solved once all better bands are: first pairs of records
    matched there go (provable rejects).  A band of at most ``small`` pairs is folded.
    In a larger one the pairs that are best for both their records are matches, as all
    better pairs are decided and all others of these records lie below (provable
    accepts).  What remains is cut at its median place, (sim, rec_i0, rec_i1), and the better half is solved first.
    """
    given = write_table(pairs.select("sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1"), "unmatched")
    check_bipartite(given)
    given = undecided_pairs(given)
    place = F.struct((-F.col("sim")).alias("s"), F.col("rec_i0").alias("x"), F.col("rec_i1").alias("y"))
    given = given.select("sim", "rec_i0", "rec_i1", place.alias("place"))
    matched: list[DataFrame] = []
    waiting = [(given, 0)]  # a band and how many tables of matches it has met
    while waiting:
        band, met = waiting.pop()
        for new in matched[met:]:
            band = band.join(new.select("rec_i0"), "rec_i0", "left_anti").join(new.select("rec_i1"), "rec_i1", "left_anti")
        band = write_table(band.select("sim", "rec_i0", "rec_i1", "place"), "band")
        met, size = len(matched), band.count()
        if not size:
            continue
        if size <= small:
            ids = band.select("sim", F.lit(0).alias("dset_i0"), F.lit(1).alias("dset_i1"), "rec_i0", "rec_i1")
            matched.append(write_table(pairs_from_groups(greedy_solve(ids)).join(band.select("sim", "rec_i0", "rec_i1"), ["rec_i0", "rec_i1"]), "matched"))
            continue
        bests = [band.groupBy(c).agg(F.min("place").alias("place")).select("place") for c in ("rec_i0", "rec_i1")]
        sure = bests[0].join(bests[1], "place").select("place.x", "place.y", (-F.col("place.s")).alias("sim"))
        matched.append(write_table(sure.select("sim", F.col("x").alias("rec_i0"), F.col("y").alias("rec_i1")), "matched"))
        middle = band.select(F.percentile_approx("place.s", 0.5, 1000).alias("s")).first()["s"]
        better = F.col("place.s") < middle
        if not 0 < band.where(better).count() < size:
            better = F.col("place.s") <= middle  # the median is the best value
            if band.where(better).count() == size:  # all are alike: by record instead, their order among ties
                cut = band.select(F.percentile_approx("rec_i0", 0.5, 1000).alias("x"), F.min("rec_i0").alias("low")).first()
                better = F.col("rec_i0") < cut["x"] if cut["x"] > cut["low"] else F.col("rec_i0") <= cut["low"]
        waiting += [(band.where(~better), met), (band.where(better), met)]
    out = matched[0].select("sim", "rec_i0", "rec_i1") if matched else given.select("sim", "rec_i0", "rec_i1")
    for more in matched[1:]:
        out = out.unionByName(more.select("sim", "rec_i0", "rec_i1"))
    return out


def greedy_matches(left: DataFrame) -> DataFrame:
    """(rec_i0, rec_i1) of the greedy two-party matching of written pairs."""
    if left.count() <= FOLD_PAIRS:
        return pairs_from_groups(greedy_solve(left))
    return matching_rounds(left).select("rec_i0", "rec_i1")


def match_labels(pairs: DataFrame) -> DataFrame:
    """``pairs`` with is_match: whether greedy two-party matching accepts the pair (else it can never be accepted)."""
    held = write_table(pairs, "labelled")
    check_bipartite(held)
    left = undecided_pairs(held.select("sim", "dset_i0", "dset_i1", "rec_i0", "rec_i1"))
    found = write_table(greedy_matches(left), "found")  # a record occurs once, so they are no more than records and go to every task; pairs are not shuffled
    return held.join(F.broadcast(found.withColumn("_m", F.lit(True))), ["rec_i0", "rec_i1"], "left").select(*pairs.columns, F.coalesce("_m", F.lit(False)).alias("is_match"))


def priority() -> list[Column]:
    """The order in which solvers take pairs unless told otherwise."""
    return canonical_order()
