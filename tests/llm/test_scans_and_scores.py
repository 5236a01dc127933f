import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from veilmatch.llm import decontamination, fingerprints, licenses, lm, quality
from veilmatch.llm.common import fold

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------- licences
def slow_scan(text):
    w = WORD.findall(lower(text))
    found = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(i for i, _ in found), ",".join(sorted({x for _, x in found}))


def test_base_places_equal_brute_force(docs, rows, spark):
    more = ["MIT License, mit-license! general PUBLIC license GNU General Public License general public license", "permit license apache licenses", "Apache\nLicense"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(more, 20_000)], "doc_id long, text string"))
    want = sorted(repr((i, *slow_scan(t))) for i, t in [*rows, *enumerate(more, 20_000)])
    got = licenses.scan_documents(df).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], sorted(r["starts"]), r["base_labels"])) for r in got) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_expressions():
    value = licenses.parse("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0")
    assert value.op == "or" and value.names == {"mit", "apache-2.0", "gpl-2.0-only with classpath-exception-2.0"}
    assert value.met_by({"mit"}) and not value.met_by({"apache-2.0"}) and value.met_by({"apache-2.0", "gpl-2.0-only with classpath-exception-2.0"})
    both = licenses.parse("(MIT OR ISC) AND Zlib see the file")
    assert both.op == "and" and both.met_by({"isc", "zlib"}) and not both.met_by({"mit", "isc"}) and both.text == "( mit or isc ) and zlib"
    for bad in ("", "AND MIT", "(MIT", "MIT OR", "()", "(MIT OR ISC) WITH x"):
        assert licenses.parse(bad) is None
    got = licenses.scan(b"// SPDX-License-Identifier: (BSD-3-Clause OR MIT)\nint x;")
    assert got[3] == ["bsd", "mit"] and got[4] > 0.9 and got[5] == ["( bsd-3-clause or mit )"]


def test_expressions_against_python_logic():
    rng = random.Random(8)
    names = ["mit", "isc", "zlib", "bsd-3-clause", "apache-2.0"]

    def build(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice(names)
        a, b, op = build(depth - 1), build(depth - 1), rng.choice(["and", "or"])
        return f"({a} {op} {b})" if rng.random() < 0.5 else f"{a} {op} {b}"

    for _ in range(200):
        text = build(5)
        held = {n for n in names if rng.random() < 0.5}
        want = eval(re.sub(r"[a-z][a-z0-9.-]+", lambda m: m[0] if m[0] in ("and", "or") else str(m[0] in held), text))
        assert licenses.parse(text).met_by(held) == want


def test_long_expressions():
    pairs = " and ".join(f"(x{i}-1.0 or y{i}-1.0)" for i in range(10_000))
    deep = "(" * 10_000 + "x" + "".join(f" {('or', 'and')[i % 2]} n{i})" for i in range(10_000))
    for text, n in ((pairs, 20_000), (deep, 10_001), (" or ".join(f"n{i}" for i in range(10_000)), 10_000)):
        value = licenses.parse(text)
        assert len(value.names) == n and value.met_by(value.names) and not value.met_by(set())
    got = licenses.scan(f"# spdx-license-identifier: {pairs} and mit\nmit is another line".encode())
    assert "mit" in got[3] and len(got[3]) == 20_001


# ------------------------------------------------------ decontamination
def test_hits_equal_brute_force(docs, rows, spark):
    rng = random.Random(2)
    some = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(1, " ".join(some[0].split()[5:30])), (2, prose(rng, 40)), (3, "red fox jumps"), (4, None), (5, ""), (6, " ".join(some[3].upper().split()[:12])), (10, "!!! ..."), (2, "near river"), (7, "a " * 40)]
    windows = [(str(i), w[k : k + min(10, len(w))]) for i, t in items for w in [WORD.findall(lower(t))] if w for k in range(len(w) - min(10, len(w)) + 1)]
    want = []
    for d, t in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        want.append(repr((d, len(w), len(hit), sorted(found), bool(hit))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(want)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum("False" in w for w in want)
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_items_without_ids_are_found(spark):
    docs = spark.createDataFrame([(1, "say red fox jumps"), (2, "near river bank, red fox jumps"), (3, "lazy dogs")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "red fox jumps"), (None, "say red fox"), (4, "near river")], "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.decontaminate(docs, bench).collect()}
    assert got == {1: (4, 4, [None], True), 2: (6, 5, ["4", None], True), 3: (2, 0, [], False)}
    assert [r["doc_id"] for r in decontamination.clean(docs, bench).collect()] == [3]


# -------------------------------------------------------------- quality
def labelled(spark, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        text = prose(rng, rng.randrange(30, 120))
        rows.append((i, text if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.split()), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_on_unseen_rows(spark, docs, rows):
    df = labelled(spark)
    labels = df.select("doc_id", "quality")
    model = quality.fit(df, labels.where(fold(labels, 3) != 1))
    held = {r["doc_id"]: r for r in quality.score_documents(df.where(fold(df, 3) == 1), model, keep=("doc_id", "quality")).collect()}
    assert len(held) > 80 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in held.values()]) > 0.95
    got = quality.score_documents(docs.drop("score"), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)


def test_curve_ends_at_its_maximum_also_when_classes_part_cleanly():
    rng = np.random.default_rng(0)
    for n, gap in ((60, 8.0), (4000, 0.5), (4000, 30.0)):
        y = (np.arange(n) % 2).astype(float)
        x = np.stack([np.ones(n), (2 * y - 1) * gap + rng.normal(0, 1, n), rng.normal(0, 1, n), rng.uniform(0, 0.2, n)], 1)
        w = quality.fit_curve(x, y)
        weight = np.full(n, n * 0.5 / n + 0.5)
        slope = x.T @ (weight * (y - 1 / (1 + np.exp(-x @ w)))) - quality.RIDGE * w
        assert np.abs(slope).max() < 1e-3 * max(1, gap) and (((x @ w) > 0) == (y == 1)).mean() > 0.6
        if gap > 1:
            assert (((x @ w) > 0) == (y == 1)).all()


def test_scores_equal_plain_compression(spark, docs, rows):
    """The operator's scores against sizes and a curve written out anew."""
    import zstandard

    df = labelled(spark)
    model = quality.fit(df, df.select("doc_id", "quality"))
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        g, b = (len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)) for d in (model.good, model.bad))
        x, r = (b - g) / (b + g), (b + g) / (len(raw) + 20)
        z = min(40, max(-40, sum(w * f for w, f in zip(model.weights, (1, x, x * x, r, r * r)))))
        want.append((i, round(1 / (1 + math.exp(-z)), 6)))
    got = [(r["doc_id"], round(r["score"], 6)) for r in quality.score_documents(docs.drop("score"), model).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_repeated_ids_reach_the_fit_once(spark):
    df = labelled(spark)
    model = quality.fit(df.unionByName(df).unionByName(df), df.select("doc_id", "quality"))
    assert model.weights == quality.fit(df, df.select("doc_id", "quality")).weights


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_quality_of_few_labels(n):
    good = [(f"the quick brown fox number {i} jumps over the lazy dog near the river bank".encode(), 1) for i in range(n)]
    bad = [(f"zzq#{i} $$$ xx{i}!! ### qqk zz 000{i} $$$ xx!! ### qqk zz".encode(), 0) for i in range(n)]
    model = quality.train(good + bad)
    got = model.scores([b"the lazy fox jumps over the quick brown dog near the bank", b"### qqk zz $$$ xx!! zzq# 111"])
    assert model.trained == (n > 1)
    assert got[0] > 0.5 > got[1] if n > 1 else set(got) == {0.5}


def test_quality_without_labels(spark, docs, none, nulls):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert {r["score"] for r in quality.score_documents(docs.drop("score"), model).collect()} == {0.5}
    assert quality.score_documents(none.drop("score"), model).count() == 0 and quality.score_documents(nulls, model).count() == 3


# --------------------------------------------------------- fingerprints
def test_fingerprints_are_homomorphic():
    f = fingerprints.fingerprint
    a, b = b"first line of words here\n", b"and a second, longer line of other words\n"
    assert f(a + b) == f(b + a) == f(a) + f(b) and (f(a + b) - f(b)) == f(a)
    assert f(a) != f(b) and f(b"") == f(b"\n \n") and f(b"").likeness(f(b"")) == 1.0 and f(b"").likeness(f(a)) == 0.0
    assert f(a + a) != f(a)


def test_next_and_edited(docs, rows, nulls, none):
    got = fingerprints.compare_with_next(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 4
        e = (t[: len(t) - k] + after[:k]).encode()
        a, b, c = (fingerprints.fingerprint(x) for x in (t.encode(), e, after.encode()))
        want.append((d, len(t), hashlib.sha256(e).hexdigest(), a.text(), b.text(), a.likeness(b), a.likeness(c)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fingerprints.compare_with_next(nulls).count() == 3 and fingerprints.compare_with_next(none).count() == 0
    long = [w for w in want if w[1] > 200]
    assert np.mean([w[5] for w in long]) > 0.6


# ------------------------------------------------------- language model
def test_base_scores_equal_brute_force(docs, rows, none, nulls):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: (t or "").encode().translate(lm.ASCII_LOWER).split()
    c = Counter(w for i, t in rows if not held(i) for w in [*split(t), b""])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = [*split(t), b""]
        want.append((i if i is not None else -1, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score(docs.drop("score"), fold(docs, 7) == 2).collect()]
    assert sorted(got) == sorted(want)
    assert lm.score(none, fold(none, 7) == 2).count() == 0
    assert [r["n_tokens"] for r in lm.score(nulls, fold(nulls, 7) == 2).collect()] == [1, 1, 1]


def test_rare_words_get_their_counts_by_join(docs, monkeypatch):
    held = fold(docs, 7) == 2
    want = {(r["doc_id"], r["n_tokens"]): r for r in lm.score(docs.drop("score"), held).collect()}
    monkeypatch.setattr(lm, "LOCAL_WORDS", 5)
    for r in lm.score(docs.drop("score"), held).collect():
        w = want[(r["doc_id"], r["n_tokens"])]
        assert r["n_known"] == w["n_known"] and math.isclose(r["base_score"], w["base_score"], rel_tol=1e-9)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.append(rng.choice([1, 2, 3], 30) if i % 2 else rng.choice([4, 5, 6], 30), 0) for i in range(800)]).astype(np.int32)
    share = (np.bincount(ids, minlength=9) + 1.0) / (len(ids) + 9)
    model = lm.LogBilinear(share)
    model.train(ids[: len(ids) // 2])
    model.sharpen(ids[len(ids) // 2 :][:3000])
    last, prior, norm = model.tables()
    p = np.exp(last[:, None, :] + prior[None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    test = ids[-6000:]
    got = np.log(p[test[1:-1], test[:-2], test[2:]]).mean()
    assert got > np.log(share[test[2:]]).mean() + 0.3


def test_words_of_a_bucket_share_its_probability(docs):
    counts = lm.count_words(docs)
    voc = lm.vocabulary(counts)
    assert voc.tokens == counts.agg(F.sum("c")).first()[0] and voc.distinct == counts.count()
    inside = Counter()
    voc.place
    for w, c, cls in zip(voc.words, voc.counts, voc.cls):
        if cls > voc.own:
            inside[cls - 1 - voc.own] += c + 1
    assert all(voc.bucket_norm[b] == inside[b] + 1 for b in range(lm.BUCKETS))


def test_words_of_equal_counts_stay_known_by_place(spark, monkeypatch):
    """With more words of one count than places, some get places and classes; before, none did."""
    monkeypatch.setattr(lm, "LOCAL_WORDS", 100)
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(50)], "doc_id long, text string")
    voc = lm.vocabulary(lm.count_words(df))
    assert 50 <= len(voc.words) <= 150 and voc.own == len(voc.words) and voc.distinct == 2001


@pytest.mark.parametrize("near", [5, 10_000])
def test_scores_equal_the_model_written_out(docs, rows, near, monkeypatch):
    """Each score against probabilities of a plain softmax over all classes, word by word; ``near`` words make contexts of their own."""
    monkeypatch.setattr(lm, "CONTEXTS", lm.BUCKETS + 1 + near)
    held = fold(docs, 7) == 2
    plain = docs.drop("score")
    learn = plain.where(~F.coalesce(fold(plain, 7) == 2, F.lit(False)))
    voc = lm.vocabulary(lm.count_words(learn))
    voc.place
    model = lm.fit(learn, voc)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in lm.score(plain, held).collect())
    known = dict(zip(voc.words, voc.counts.tolist()))
    own = {w: 1 + i for i, w in enumerate(voc.words[: voc.own])}
    want = []
    for d, t in rows:
        total, u, v = 0.0, 0, 0
        parts = (t or "").encode().translate(lm.ASCII_LOWER).split()
        for w in [*parts, b""]:
            cls = own.get(w, 1 + voc.own + lm.bucket(w)) if w else 0
            z = model.outputs.astype(float) @ (model.r[u] * model.c[0] + model.r[v] * model.c[1]).astype(float) + model.b
            total += (z[cls] - np.log(np.exp(z - z.max()).sum()) - z.max()) / math.log(10)
            if cls > voc.own:
                total += math.log10((known.get(w, 0) + 1) / voc.bucket_norm[lm.bucket(w)])
            place = own.get(w, near + 1) if w else 0
            u, v = place if place <= near else min(near, voc.own) + 1 + lm.bucket(w), u
        want.append((d is None, d or 0, len(parts) + 1, total))
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], rtol=2e-3, atol=1e-3)


def test_every_training_text_trains_and_scales_the_model(spark, monkeypatch):
    """The texts of the first and of the last part change the parameters, and the scale is picked by the likelihood of all tokens, those of long texts too."""
    rng, seen = random.Random(3), []
    texts = [prose(rng, 40) for _ in range(60)] + [prose(rng, 5000), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    voc = lm.vocabulary(lm.count_words(df))
    whole = lm.fit(df, voc).r  # no scale changes it
    ids = voc.stream([(t or "").encode() for t in texts])
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(lm.PARTS))
    parts = {r[0] for r in df.select(part).collect()}
    for p in sorted(parts)[:1] + sorted(parts)[-1:]:
        assert not np.array_equal(lm.fit(df.where(part != p), voc).r, whole)
    rescale = lm.LogBilinear.rescale
    monkeypatch.setattr(lm.LogBilinear, "rescale", lambda self, gains: seen.append(gains) or rescale(self, gains))
    assert np.array_equal(lm.fit(df, voc).r, whole)
    share = lm.class_shares(voc) / lm.class_shares(voc).sum()
    assert min(parts) < lm.FIRST and math.isclose(seen[0][0], np.log(share)[ids].sum(), rel_tol=1e-6)


def test_rounds_grow_with_tasks_and_steps_are_not_diluted():
    for tasks in (0, 1, 2, 8, 33, 5000):
        ends = lm.round_ends(tasks)
        assert ends[0] == lm.FIRST and ends[-1] == lm.PARTS and ends == sorted(set(ends))
    assert [len(lm.round_ends(t)) for t in (1, 8, 64, 4096)] == [3, 6, 9, 15]
    start = np.array([1.0, 1.0, 1.0, 1.0, 1.0, 1.0], np.float32)  # three parameters, three sums of squares
    one, two = np.array([2.0, 1.0, 3.0, 2.0, 1.0, 5.0], np.float32), np.array([1.0, 1.0, 2.0, 1.0, 1.0, 3.0], np.float32)
    got = lm.joined(start, lm.progress(start, one) + lm.progress(start, two))
    # moved by one task alone; by none; by both, of which the first has twice the other's squares
    assert np.allclose(got, [2.0, 1.0, 1 + (2 * 4 + 1 * 2) / 6, 2.0, 1.0, 1 + (16 + 4) / 6])


def test_gains_are_the_likelihoods_of_scaled_models():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 7, 400).astype(np.int32)
    model = lm.LogBilinear((np.bincount(ids, minlength=9) + 1.0) / (len(ids) + 9))
    model.train(ids)
    got = model.gains(ids, model.normalisers())
    for scale, g in zip(lm.SCALES, got):
        last, prior, norm = model.scaled(scale).tables()
        total, u, v = 0.0, 0, 0
        for w in ids:
            total += last[u, w] + prior[v, w] - norm[u, v]
            u, v = w, u if w else 0
        assert math.isclose(g, total, rel_tol=1e-5)


def test_words_are_split_looked_up_and_dealt_whole_columns_at_a_time(monkeypatch):
    """Against bytes.split() and crc32, word by word; no call of Python for each word (before, one for each unknown word)."""
    rng = random.Random(4)
    texts = ["", " ", None, "A", "x" * 900, "\x00\x1f\x7f\x08 \x0e", "\t\n\x0b\x0c\r É\x85\u00a0\u2003B"]
    texts += ["".join(rng.choice("aBé \t\n\x0b\x1c字Z") for _ in range(rng.randrange(60))) for _ in range(400)]
    want = [(t or "").encode().translate(lm.ASCII_LOWER).split() for t in texts]
    every = [w for ws in want for w in ws]
    known = sorted(set(every))[::3]
    counts, size, own = np.arange(len(known), 0, -1), len(known), len(known) // 2
    voc = lm.Vocabulary(known, counts, own, 1000, size, np.ones(lm.BUCKETS), len(texts))
    place = {w: i for i, w in enumerate(known)}
    ids = [x for ws in want for x in [*(1 + place[w] if place.get(w, size) < own else 1 + own + lm.bucket(w) for w in ws), 0]]
    dealt = [lm.bucket(w) for w in every]
    monkeypatch.setattr(lm, "bucket", lambda word: pytest.fail("called for a word"))
    for span in (1, 64, 1 << 20):
        monkeypatch.setattr(lm, "SPAN", span)
        col = pa.array(["cut off", *texts])[1:]
        found = list(lm.split(col))
        assert [w for _, _, ws, _ in found for w in ws.to_pylist()] == every
        assert [k for *_, n in found for k in n.tolist()] == [len(ws) for ws in want]
        assert [k for _, _, ws, _ in found for k in lm.buckets(ws).tolist()] == dealt
        assert voc.stream([(t or "").encode() for t in texts]).tolist() == ids


def test_a_training_step_sums_by_class_group_and_context(monkeypatch):
    """Against sums made row by row; two sorts a step (before, four)."""
    rng, sorts, argsort = np.random.default_rng(5), [], np.argsort
    share = rng.random(40) + 0.1
    model = lm.LogBilinear(share, rng.integers(0, 9, 40).astype(np.int32), rng.integers(0, 6, 40).astype(np.int32))
    u, v, w, noise = rng.integers(0, 9, 300), rng.integers(0, 9, 300), rng.integers(0, 40, 300), rng.integers(0, 40, lm.NOISE)
    base = np.log(lm.NOISE * model.share).astype(np.float32)
    want = [x.astype(float) for x in model.parameters]
    r, q, b, c, g = (x.copy() for x in want)
    context, out = r[u] * c[0] + r[v] * c[1], q + g[model.kin]
    good = 1 / (1 + np.exp((context * out[w]).sum(1) + b[w] - base[w]))
    bad = 1 / (1 + np.exp(base[noise] - b[noise] - context @ out[noise].T))
    back = good[:, None] * out[w] - bad @ out[noise]
    both, grads = np.append(w, noise), np.concatenate([good[:, None] * context, -(bad.T @ context)])
    for which, rows, x in ((1, both, grads), (4, model.kin[both], grads), (2, both, np.append(good, -bad.sum(0))), (0, np.append(u, v), np.concatenate([back * c[0], back * c[1]]))):
        total = np.zeros_like(want[which])
        np.add.at(total, rows, x)
        n = np.maximum(1, np.bincount(rows, minlength=len(total)))
        total /= np.sqrt(n).reshape(-1, *[1] * (total.ndim - 1))
        want[which] += lm.RATE * total / np.sqrt(1 + total * total)
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    model._step(u, v, w, noise, base)
    assert len(sorts) == 2
    for i in (0, 1, 2, 4):
        assert np.allclose(model.parameters[i], want[i], atol=1e-5)


def slow_fingerprint(text):
    """Lanes in whole numbers, one word and one line at a time."""
    full, odd = 2**64, 0x9E3779B97F4A7C15

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % full
        return x ^ x >> 32

    strong, lanes = [0] * 4, [0] * 256
    for line in (text or "").encode().split(b"\n"):
        line = line.strip(b" \t\r\x0b\x0c")
        if not line:
            continue
        digest = hashlib.blake2b(line, digest_size=32).digest()
        strong = [(a + int.from_bytes(digest[8 * i : 8 * i + 8], "little")) % full for i, a in enumerate(strong)]
        words = [mix(sum((b + 1) * pow(odd, k, full) for k, b in enumerate(w)) % full) for w in line.split()]
        if len(words) >= 8:
            features = [mix((3 * a + 5 * b + 7 * c) % full) for a, b, c in zip(words, words[1:], words[2:])]
        else:
            k = min(len(line), 6 if len(line) >= 16 else 3)
            features = [mix((sum(b * pow(odd, k - 1 - j, full) for j, b in enumerate(line[i : i + k])) + k) % full) for i in range(len(line) - k + 1)]
        for f in features:
            lanes[(f >> 8) % 256] += 1 if f >> 60 & 1 else -1
    return strong, lanes


def slow_likeness(a, b):
    if a == b:
        return 1.0
    norm = math.sqrt(sum(x * x for x in a[1]) * sum(x * x for x in b[1]))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(a[1], b[1])) / norm)) if norm else 0.0


def test_fingerprints_and_likeness_equal_plain_sums(docs, rows):
    short = [(i, t) for i, t in rows if len(t or "") < 5000]
    df = docs.where(F.length(F.coalesce("text", F.lit(""))) < 5000)
    order = sorted(short, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    prints = [slow_fingerprint(t) for _, t in order]
    want = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        k = len(t) // 4
        e = slow_fingerprint(t[: len(t) - k] + after[:k])
        text = "".join(f"{x:016x}" for x in prints[i][0]) + "".join(f"{x % 2**32:08x}" for x in prints[i][1])
        want.append((repr(d), text, round(slow_likeness(prints[i], e), 9), round(slow_likeness(prints[i], prints[(i + 1) % len(order)]), 9)))
    got = [(repr(r["doc_id"]), r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.compare_with_next(df).collect()]
    assert sorted(got) == sorted(want)


def test_long_repetitive_texts_stay_alike():
    line = b"the quick brown fox jumps over the lazy dog\n"
    a, b = fingerprints.fingerprint(line * 40_000), fingerprints.fingerprint(line * 30_000)
    assert a != b and a.likeness(b) > 0.999
