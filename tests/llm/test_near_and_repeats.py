import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from veilmatch.llm import simhash, suffixes
from veilmatch.llm.common import ASCII_LOWER
from veilmatch.llm.components import components


def slow_simhash(text, k=4, wide=False):
    w = (text or "").encode().translate(ASCII_LOWER).split()
    f = xxhash.xxh3_128_intdigest if wide else xxhash.xxh64_intdigest
    h = [f(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(128 if wide else 64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(rows, fps, most=4, shared=0):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            x = fps[i] ^ fps[j]
            if x.bit_count() <= most and (not shared or sum(x >> s & 255 == 0 for s in range(0, 128, 8)) >= shared):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def test_groups_equal_brute_force(docs, rows):
    fps = [slow_simhash(t) for _, t in rows]
    want = sorted(repr((d, f, g)) for (d, _), f, g in zip(rows, fps, grouped(rows, fps)))
    assert sorted(repr((r["doc_id"], r["f0"] % 2**64, r["component_id"])) for r in simhash.groups(docs).collect()) == want


def test_long_lists_keep_every_group(spark):
    """Thousands of close fingerprints in few lists: searched, not paired."""
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = set()
    for s in seeds:
        x = s
        for _ in range(300):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            fps.add(x)
    fps = sorted(fps)
    want = grouped([(i, None) for i in range(len(fps))], fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "f0 long")
    found = simhash.links(df).collect()
    assert len(found) < 4 * len(fps)
    root = {r["node"]: r["root"] for r in components(spark.createDataFrame([tuple(r) for r in found], "a long, b long")).collect()}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    parts = {}
    for f, w in zip(signed, want):
        parts.setdefault(root.get(f, f), set()).add(w)
    assert all(len(p) == 1 for p in parts.values()) and len(parts) == len(set(want))


def test_contracted_links_connect_the_same_rows():
    rng = np.random.default_rng(5)
    for n, width in ((0, 1), (1, 2), (50, 1), (400, 2)):
        pool = rng.integers(0, 2**63, (n // 2 + 2, width)).astype(np.uint64)
        a, b = pool[rng.integers(0, len(pool), n)], pool[rng.integers(0, len(pool), n)]
        x, y = simhash.contracted(a, b)

        def parts(p, q):
            root = {}

            def find(v):
                while root.setdefault(v, v) != v:
                    v = root[v]
                return v

            for u, v in zip(map(tuple, p.tolist()), map(tuple, q.tolist())):
                root[find(u)] = find(v)
            out = {}
            for v in list(root):
                out.setdefault(find(v), set()).add(v)
            return sorted(sorted(g) for g in out.values() if len(g) > 1)

        assert parts(a, b) == parts(x, y) and len(x) <= len(pool)


def test_triples_meet_every_four_positions():
    from itertools import combinations

    assert len(simhash.NARROW.subsets) == 20 and len(simhash.CANDIDATES.subsets) == 120
    for index in (simhash.NARROW, simhash.CANDIDATES):
        assert all(any(set(t) <= set(q) for t in index.subsets) for q in combinations(range(8 * index.longs), index.shared))


def shingle_set(text, k=5):
    w = (text or "").encode().translate(ASCII_LOWER).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike_groups(rows, similarity=0.8):
    """The smallest position of each row's group by all pairs of shingle sets."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(rows))]


def test_one_row_of_every_alike_group(docs, rows):
    kept = simhash.one_of_each_group(docs).collect()
    assert kept[0].__fields__ == docs.columns
    want = {}
    for (d, t), g in zip(rows, alike_groups(rows)):
        want.setdefault(g, set()).add((d is None, d or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(min(x) for x in want.values())


def test_verified_links_connect_as_all_links_do():
    rng = random.Random(2)
    for trial in range(30):
        base = rng.sample(range(10**6), 40)
        sets = []
        for _ in range(25):
            x = set(base)
            for y in rng.sample(base, rng.randrange(0, 12)):
                x.discard(y)
                x.add(rng.randrange(10**6))
            sets.append(np.array(sorted(x), np.uint64))
        sets += [np.zeros(0, np.uint64)] * 2
        side = np.array([rng.randrange(2) for _ in sets])
        fps = np.zeros((len(sets), 2), np.uint64)
        for across in (False, True):
            if across and len(set(side)) < 2:
                continue
            root = list(range(len(sets)))
            for i in range(len(sets)):
                for j in range(i):
                    a, b = set(sets[i].tolist()), set(sets[j].tolist())
                    if (a == b or len(a & b) >= 0.8 * len(a | b)) and (not across or side[i] != side[j]):
                        root = [root[j] if r == root[i] else r for r in root]
            got = list(range(len(sets)))
            links, label = simhash.verified_links(side, fps, sets, 0.8, across)
            assert len(set(zip(root, label.tolist()))) == len(set(root)) == len(set(label.tolist()))
            for i, j in links:
                assert got[i] != got[j] and (not across or side[i] != side[j])
                got = [got[j] if r == got[i] else r for r in got]
            assert len(set(zip(root, got))) == len(set(root)) == len(set(got))


def test_near_groups_find_links_of_0_8_and_no_others(spark, monkeypatch):
    """Recall of pairs of 0.8 and more is 0.9 at least, no text is in a group without such a link; blocks change nothing."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(200)]
        rows.append(" ".join(w))
        for _ in range(rng.randrange(1, 12)):  # a chain of edits, and edits of one text
            v = w if i % 2 else list(w)
            for k in rng.sample(range(200), rng.randrange(1, 10)):
                v[k] = rng.choice(words)
            rows.append(" ".join(v))
    rows = list(enumerate(rows))
    named = spark.createDataFrame(rows, "row long, text string").repartition(3)
    got = {r["row"]: r["group"] for r in simhash.near_groups(named).collect()}
    truth = alike_groups(rows)
    assert all(truth[i] == truth[g] for i, g in got.items())
    pairs = [(i, j) for i, a in rows for j, b in rows[max(0, i - 12) : i] for x, y in [(shingle_set(a), shingle_set(b))] if len(x & y) >= 0.8 * len(x | y)]
    assert len(pairs) > 100 and np.mean([got[i] == got[j] for i, j in pairs]) > 0.95
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    assert {r["row"]: r["group"] for r in simhash.near_groups(named).collect()} == got


def slow_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((d, len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("length,shard", [(400, 2_000_000), (60, 1500)])
def test_repeats_equal_brute_force(docs, rows, length, shard, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    got = suffixes.remove_repeats(docs, length=length, keep=("doc_id",)).collect()
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in got) == slow_repeats(rows, length)


def test_hashes_of_many_fragments_are_dealt_over_tasks(docs, rows, monkeypatch):
    monkeypatch.setattr(suffixes, "SPLIT", 900)
    got = suffixes.remove_repeats(docs, length=60, keep=("doc_id",)).collect()
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in got) == slow_repeats(rows, 60)


def test_shards_of_words():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(120)]
    for _ in range(10):
        parts = [np.array([x if rng.random() < 0.97 else rng.getrandbits(64) for x in base[a : a + 60]], "<u8") for a in (rng.randrange(50) for _ in range(6))]
        counts = [len(p) - 8 for p in parts]
        seen = Counter(p[i : i + 9].tobytes() for p, n in zip(parts, counts) for i in range(n))
        s = suffixes.Shard([p.tobytes() for p in parts], counts, 9, 8)
        assert [s.repeated[b : b + n].tolist() for b, n in zip(s.begin, s.count)] == [[seen[p[i : i + 9].tobytes()] > 1 for i in range(n)] for p, n in zip(parts, counts)]


def test_shards_and_their_merge():
    rng = random.Random(1)
    for trial in range(20):
        length = rng.choice([5, 9, 40])
        base = bytes(rng.choice(b"ab" if trial % 2 else b"abcdefg\0") for _ in range(300))
        parts = []
        for _ in range(rng.randint(2, 10)):
            a = rng.randint(0, 150)
            p = bytearray(base[a : a + length + rng.randint(0, 100)])
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = 120
            parts.append(bytes(p))
        counts = [len(p) - length + 1 for p in parts]
        seen = Counter(p[i : i + length] for p, n in zip(parts, counts) for i in range(n))
        want = [[seen[p[i : i + length]] > 1 for i in range(n)] for p, n in zip(parts, counts)]
        half = len(parts) // 2
        one = [suffixes.Shard(parts, counts, length)]
        two = [suffixes.Shard(parts[:half], counts[:half], length), suffixes.Shard(parts[half:], counts[half:], length)]
        suffixes.merge_shards(two)
        for shards in (one, two):
            assert [s.repeated[b : b + n].tolist() for s in shards for b, n in zip(s.begin, s.count)] == want


def test_whole_characters_stay_text(spark, docs):
    df = spark.createDataFrame([(1, "é" * 300 + "abc"), (2, "xé" + "é" * 300)], "doc_id long, text string")
    for r in suffixes.remove_repeats(df, length=101, whole_characters=True).collect():
        r["kept"].decode()


def test_nothing_and_nulls(none, nulls):
    for df, n in ((none, 0), (nulls, 3)):
        assert simhash.groups(df).count() == n
        assert suffixes.remove_repeats(df).count() == n
    assert {r["component_id"] for r in simhash.groups(nulls).collect()} == {1}


def test_repeats_of_few_bytes_and_many_words(spark):
    """Runs of 51 words go, whatever their bytes and the white space inside; runs of 50 words stay."""
    rng = random.Random(11)

    def some(n, size=3):
        return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(size)) for _ in range(n)]

    run, short, long = some(51), some(50), some(1, 500)
    texts = [
        some(40) + run + some(30),
        run + some(5) + short,
        short + some(60) + run + long,
        long + some(3),
        some(200),
        ["a"] * 52,
        ["b"] * 51,
        run,
        [],
    ]
    rows = [(i, " ".join(t) if i % 2 else " \n".join(t)) for i, t in enumerate(texts)]
    rows.append((9, rows[4][1]))
    texts.append(texts[4])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in suffixes.remove_repeats(df, length=400, whole_characters=True, words=51).collect()}
    seen = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    for i, t in enumerate(texts):
        gone = {k for j in range(len(t) - 50) if seen[tuple(t[j : j + 51])] > 1 for k in range(j, j + 51)}
        want = [w for k, w in enumerate(t) if k not in gone and w != long[0]]
        assert got[i].decode().split() == want
    counted = {r["doc_id"]: r for r in suffixes.remove_repeats(df, length=400, words=51, cut_words=False).collect()}
    plain = {r["doc_id"]: r for r in suffixes.remove_repeats(df, length=400).collect()}
    text = dict(rows)
    for i, t in enumerate(texts):
        gone = {k for j in range(len(t) - 50) if seen[tuple(t[j : j + 51])] > 1 for k in range(j, j + 51)}
        assert counted[i]["kept"] == plain[i]["kept"] and (counted[i]["n_in_runs"] > 0) == bool(gone) and counted[i]["n_in_runs"] <= len(text[i].encode())


def test_candidates_are_found_by_two_shared_bytes(spark):
    """Fingerprints of up to 26 differing bits and 2 shared bytes are linked; others are not."""
    rng = random.Random(12)
    fps = []
    for i in range(300):
        x = rng.getrandbits(128)
        touched = rng.sample(range(16), 15 if i % 3 == 0 else rng.randrange(4, 15))
        bits = rng.sample([8 * b + k for b in touched for k in range(8)], rng.choice([8, 18, 26, 27]))
        fps += [x, x ^ sum(1 << b for b in bits)]
    fps += [fps[0] & ~0xFFFF | v for v in range(64)]  # long lists
    distinct = sorted(set(fps))

    def signed(x):
        return tuple(v - 2**64 if v >> 63 else v for v in (x >> 64, x & (2**64 - 1)))

    found = simhash.links(spark.createDataFrame([signed(f) for f in distinct], "f0 long, f1 long"), simhash.CANDIDATES).collect()
    names = {signed(f): i for i, f in enumerate(distinct)}
    root = list(range(len(distinct)))
    for r in found:
        i, j = names[r["a0"], r["a1"]], names[r["b0"], r["b1"]]
        root = [root[j] if x == root[i] else x for x in root]
    want = grouped([(i, None) for i in range(len(distinct))], distinct, 26, 2)
    assert len(set(zip(root, want))) == len(set(root)) == len(set(want))


def test_one_row_of_every_group_with_repeated_and_null_keys(spark):
    rng = random.Random(13)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(5))
    rows = [(2, a), (5, a), (5, b), (7, c), (7, d), (None, d), (None, e), (None, c + " x"), (None, e), (9, b), (9, b)]
    rows += [(None, "p " * 9), (11, None), (None, ""), (12, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = simhash.one_of_each_group(df).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in got) == sorted(map(repr, [(2, a), (5, b), (7, c), (7, d), (None, e), (None, "p " * 9), (11, None)]))
    assert got[0].__fields__ == df.columns


def test_suffixes_of_few_letters_take_few_sorts(monkeypatch):
    """First keys hold as many symbols as the letters that occur need; orders and repeats equal brute force."""
    rng, sorts = random.Random(8), []
    argsort = np.argsort
    monkeypatch.setattr(suffixes.np, "argsort", lambda x, **k: sorts.append(len(x)) or argsort(x, **k))
    letters = np.array([[0], [255], [1, 255], [97, 122], list(range(256))], object)
    for few in letters:
        for sizes in ([1], [5, 3], [400], [60, 200, 9]):
            parts = [bytes(rng.choice(few) for _ in range(k)) for k in sizes]
            sym = np.array([x for p in parts for x in [*(b + 1 for b in p), 0]], np.uint64)
            stops = np.flatnonzero(sym == 0)
            end = np.repeat(stops, np.array(sizes) + 1)
            sa = suffixes.suffix_array(sym, end)
            # closing symbols differ, in the order in which they come first in sa
            rank = {int(p): i for i, p in enumerate(sa[: len(parts)])}
            suffix = lambda i: [(int(x), 0) for x in sym[i : end[i]]] + [(0, rank[int(end[i])])]
            assert set(rank) == set(stops.tolist()) and sa.tolist() == sorted(range(len(sym)), key=suffix)
            begin, count = np.concatenate(([0], stops[:-1] + 1)), np.maximum(0, np.array(sizes) - 4)
            s = suffixes.Shard(parts, count.tolist(), 5)
            windows = Counter(p[i : i + 5] for p, c in zip(parts, count) for i in range(c))
            assert all(s.repeated[b + i] == (windows[p[i : i + 5]] > 1) for p, b, c in zip(parts, begin, count) for i in range(c))
    text = bytes(rng.choice(b"yz") for _ in range(200))
    assert max(text.rfind(text[i : i + 30]) - i for i in range(170)) == 0  # no repeat of 30
    sorts.clear()
    suffixes.Shard([text], [150], 51)
    assert sorts.count(201) == 1 and len(sorts) == 2  # one of the suffixes, one of Kasai's lanes
