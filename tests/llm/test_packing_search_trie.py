"""Packing, ranked search and the prefix trie against plain brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import prose
from veilmatch.llm import packing, prefix_trie, search

P = pytest.importorskip("public_tokenizers")
BYTES = P.path("byte_bpe_50k.json")
CLASHES = "doc_id long, text string, piece long, start long, ids string, task long, nth long, n long, base long, `at` long, number long, term string, shard long, keys long, rank int"


@pytest.fixture(scope="module")
def wide(spark, rows):
    """The rows beside columns named as the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, 5, 6, 7, 8, "t", 9, 10, 11) for i, t in rows], CLASHES).repartition(3)


# ----------------------------------------------------------------- packing
def plain_bins(histogram, capacity):
    """Best-two-fit, one bin and one piece at a time."""
    left, bins = dict(histogram), []
    while any(left.values()):
        gap, inside = capacity, []
        while fits := [n for n in left if left[n] and n <= gap]:
            n = max(fits)
            left[n] -= 1
            inside.append(n)
            gap -= n
        if gap and len(inside) > 1:
            small = inside[-1]
            smaller = [n for n in left if left[n] and n < small]
            pairs = [(x + y, max(x, y), min(x, y)) for x in smaller for y in smaller if (x != y or left[x] > 1) and small < x + y <= gap + small]
            if pairs:
                _, x, y = max(pairs)
                inside.pop()
                inside += [x, y]
                left[small] += 1
                left[x] -= 1
                left[y] -= 1
        bins.append(sorted(inside))
    return sorted(bins)


def test_plans_equal_one_bin_at_a_time():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 30, 50])
        most = rng.choice([capacity, capacity // 2, capacity // 3])
        histogram = Counter()
        for _ in range(rng.randrange(80)):
            histogram[rng.randint(1, most)] += rng.choice([1, 1, 3])
        plan = packing.plan(histogram, capacity)
        want = plain_bins(histogram, capacity)
        assert sorted(sorted(n for n, c in inside.items() for _ in range(c)) for inside, times in plan for _ in range(times)) == want
        length = np.array([n for n, c in histogram.items() for _ in range(c)], np.int64)
        rank = np.array([i for c in histogram.values() for i in range(c)], np.int64)
        at = defaultdict(list)
        for n, s, o in zip(length.tolist(), *(x.tolist() for x in packing._place(packing._ranges(plan), length, rank))):
            at[s].append((o, n))
        for x in at.values():
            x.sort()
            assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))]
        assert sorted(sorted(n for _, n in x) for x in at.values()) == want
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed_pieces_hold_every_token_once(spark, wide, rows, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    packed = packing.pack(wide, BYTES, end_id=0, capacity=capacity)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = packed.collect()
    docs = Counter()
    for i, t in rows:
        docs[i, np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    pieces = Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got)
    want = Counter()
    for (i, ids), many in docs.items():
        n = len(ids) // 4
        first = (n - 1) % capacity + 1
        at = [0, *range(first, n, capacity), n]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[i, k, a, ids[4 * a : 4 * b]] += many
    assert pieces == want
    by = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) // 4
        by[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for x in by.values():
        x.sort()
        assert [o for o, _, _ in x] == [sum(n for _, n, _ in x[:i]) for i in range(len(x))] and sum(n for _, n, _ in x) <= capacity
    assert len(by) <= 1.05 * -(-sum(r["length"] for r in got) // capacity) + 1
    assert len(by) == len(plain_bins(Counter(r["length"] for r in got), capacity))
    for r in packing.sequences(packed).collect():
        x = by[r["sequence_id"]]
        assert bytes(r["ids"]) == b"".join(i for _, _, i in x) and r["starts"] == [o for o, _, _ in x] and r["n_tokens"] == sum(n for _, n, _ in x)


def test_the_fast_encoder_equals_the_library(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rng = random.Random(2)
    pool = [*"aabcdest'' 'r\"-.,12\u00e9\u00b2\u00bd\u00d1\u00df\u0130\u017f\u65e5\u0301 \n\t\r\x1c\x85\xa0\u2014\U0001f600", "'re", "'ll", "n't", "<|endoftext|>", "the ", " ing", "tion", "   ", "\n\n", "ABC", "2024"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshr dlucm") for _ in range(300)) for _ in range(500)] + [prose(rng, 200) for _ in range(50)] + [t or "" for _, t in rows]
    texts += [" " * 900, "x" * 100_000, "a " + "\n" * 5000, ("q" * 399 + " ") * 20, "\x00\x01 a"]
    encode = packing.encoder(BYTES)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == want.ids, text[:80]


def test_packing_nothing_and_nulls(spark, none, nulls):
    assert packing.pack(none, BYTES).count() == 0
    assert sorted((r["length"], r["offset"]) for r in packing.pack(nulls, BYTES).collect()) == [(1, 0), (1, 1), (1, 2)]


# ------------------------------------------------------------------ search
TERM = re.compile(search.TERM)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(scored[:k], 1)]
    return sorted(map(repr, out))


ITEMS = [(1, "the big red FOX's river"), (2, "日本語 ４５ straße"), (2, "lazy"), (None, "MIT license 42"), (5, ""), (6, None), (7, "absent words only zzz"), (8, "a a a"), (9, "line one")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranks_equal_brute_force(spark, wide, rows, monkeypatch, k):
    monkeypatch.setattr(search, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(search, "BLOCK_TERMS", 6)
    items = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in ITEMS], "item_id long, text string, number long, term string, rank int")
    index = search.build_index(wide)
    got = search.search(index, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_ranks(rows, ITEMS, k)
    index.drop()


def test_small_shards_change_nothing(spark, rows):
    import pyarrow as pa

    keys, raws = [i for i, _ in rows], [(t or "").encode() for _, t in rows]
    made = {}
    for step in (1, 5, 1000):
        shards = []
        for a in range(0, len(rows), step):
            batches = list(search._shard(pa.array(keys[a : a + step], pa.int64()), raws[a : a + step], a, 30, 5000, ["shard", "term", "df", "docs", "impacts", "keys"]))
            if batches:
                shards.append(pa.Table.from_batches(batches))
        every = set()
        for s in shards:
            of = next(r["keys"] for r in s.to_pylist() if r["term"] is None)
            for r in s.to_pylist():
                if r["term"] is not None:
                    places, impacts = np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["impacts"], "<i4")
                    assert r["df"] == len(places) == len(impacts) and (np.diff(places.astype(int)) > 0).all()
                    every |= {(r["term"], of[p], int(i)) for p, i in zip(places, impacts)}
        made[step] = every
    assert made[1] == made[5] == made[1000] and made[1]


def test_search_nothing_and_nulls(spark, none, nulls, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (none, nulls):
        assert search.search(search.build_index(df), items).count() == 0
    assert search.search(search.build_index(docs), items.limit(0)).count() == 0
    strings = docs.selectExpr("cast(doc_id as string) doc_id", "text")
    assert search.search(search.build_index(strings), items, 3).schema["doc_id"].dataType.simpleString() == "string"


# -------------------------------------------------------------------- trie
def plain_nodes(convs):
    """Nodes of {conversation: [(role, text)]} by walking all prefixes."""
    members, children, under = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, w in convs.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
            if d:
                children[tuple(w[: d - 1])].add(tuple(w[:d]))
    for p in members:
        for d in range(len(p) + 1):
            under[p[:d]].append(p)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under[p] if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in under[p]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(w)] for c, w in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


@pytest.fixture(scope="module")
def talks():
    """Few different turns, so much is shared; long equal conversations, a hot one, missing bases, nulls."""
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 260), 1001]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    long = [(t, rng.choice("ua"), rng.choice(["x", "yy", "zzz😀"])) for t in range(30)]
    for c in (300, 301, 302, 303):
        rows += [(c, t, r, x) for t, r, x in long[: 30 - 7 * (c == 302)]]
    rows += [(304, t, r, x + ("!" if t == 20 else "")) for t, r, x in long]
    rows += [(400, t, "u", str(t % 7)) for t in range(300)]
    rows += [(500, None, "u", "first"), (500, 0, "a", "second"), (500, 0, "a", "second"), (None, 0, "u", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


TALKS = "conv_id long, turn long, role string, text string"


def nodes(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("growth, stride", [(1, 1), (8, 4096), (3, 5)])
def test_tries_equal_brute_force(spark, talks, monkeypatch, growth, stride):
    monkeypatch.setattr(prefix_trie, "GROWTH", growth)
    monkeypatch.setattr(prefix_trie, "STRIDE", stride)
    some = talks if stride > 1 else [r for r in talks if r[0] not in (300, 301, 302, 303, 304)]
    df = spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in some], f"{TALKS}, conv long, key string, depth long, nth long, n long").repartition(5)
    if growth == 3:
        assert nodes(prefix_trie.conversation_trie(df)) == plain_nodes(in_order(some))
    turns = prefix_trie.turns_in_order(df)
    assert nodes(prefix_trie.trie(*prefix_trie.share_beginnings(turns))) == plain_nodes(rebuilt(in_order(some)))


def test_tries_of_nothing(spark):
    empty = spark.createDataFrame([], TALKS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    assert prefix_trie.trie(*prefix_trie.share_beginnings(prefix_trie.turns_in_order(empty))).count() == 0
    lost = spark.createDataFrame([(None, 1, "u", "x")], TALKS)
    assert prefix_trie.conversation_trie(lost).count() == 0
    one = spark.createDataFrame([(7, None, None, None)], TALKS)
    assert nodes(prefix_trie.conversation_trie(one)) == plain_nodes({7: [("", "")]})


def test_digest_of_many_ends_runs_over_blocks(spark):
    convs = spark.range(25_000).toDF("conv")
    turns = convs.selectExpr("conv", "1L depth", "cast('t' as binary) hash", "1L chars").where("conv > 2")
    got = prefix_trie.trie(convs, turns).where("depth = 1").first()
    assert got["n_convs"] == 24_997 and got["ends_sha256"] == hashlib.sha256(",".join(map(str, range(3, 25_000))).encode()).hexdigest()
    assert got["saved_tokens"] == 24_996 and got["conv_id"] == 3 and got["parent_conv_id"] == 0
