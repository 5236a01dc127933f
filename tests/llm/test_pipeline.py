"""The pipeline, stage by stage, against brute force on a small corpus with planted cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_near_and_repeats import alike_groups
from tests.llm.test_scans_and_scores import WORD, lower


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    at = tmp_path_factory.mktemp("corpus")
    rows = []
    passage, item = prose(rng, 120), prose(rng, 25)
    for i in range(150):
        text = prose(rng, rng.randrange(30, 150))
        if i % 5 == 0:
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split())
        if i % 20 == 1:
            text = f"{text} {passage} {prose(rng, 20)}"
        if i % 20 == 2:
            text = f"{prose(rng, 15)} {item} {text}"
        rows.append((i, text, "en", "src", len(text), i))
    rows += [(200 + j, rows[j][1], "en", "src", rows[j][4], j) for j in (1, 3, 7)]
    rows += [(300, None, None, None, None, None), (301, "", "en", "s", 0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 5 > 0), 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert all(kept[i] == by[i] for i in kept)
    assert np.mean([(i in kept) == (i % 5 > 0) for i in range(150)]) > 0.95
    near = steps["SimHash near-dedup"](spark, good, folder)
    assert near.columns == docs.columns
    given = sorted(kept.items())
    ids = {r["doc_id"] for r in near.collect()}
    assert ids == {given[g][0] for g in alike_groups(given)}
    cut = steps["suffix-array dedup"](spark, near, folder)
    assert cut.columns == docs.columns and cut.schema == docs.schema
    raws = {i: (kept[i] or "").encode() for i in ids}
    seen: dict = {}
    for r in raws.values():
        for k in range(len(r) - 399):
            seen[r[k : k + 400]] = seen.get(r[k : k + 400], 0) + 1
    after = {r["doc_id"]: r for r in cut.collect()}
    for i, raw in raws.items():
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 399):
            if seen[raw[k : k + 400]] > 1:
                gone[k : k + 400] = True
        # spans shrink to whole characters
        text, edge = bytearray(), np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        at = 0
        for p, q in zip(edge[::2], edge[1::2]):
            while p < q and raw[p] & 0xC0 == 0x80:
                p += 1
            while q > p and q < len(raw) and raw[q] & 0xC0 == 0x80:
                q -= 1
            text += raw[at:p]
            at = q
        text = bytes(text + raw[at:])
        if gone.any() and not text:
            assert i not in after
            continue
        assert (after[i]["text"] or "") == text.decode()
        assert not gone.any() or after[i]["n_chars"] == len(text.decode())
    clean = steps["benchmark decontamination"](spark, cut, folder)
    assert clean.columns == docs.columns
    item = WORD.findall(lower(spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]))
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    want = {i for i, r in after.items() for w in [WORD.findall(lower(r["text"]))] if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    assert {r["doc_id"] for r in clean.collect()} == want
    end = {r["doc_id"]: r for r in steps["BPE encoding and decoding"](spark, clean, folder).collect()}
    assert set(end) == want
    assert all(end[i]["decoded_sha256"] == hashlib.sha256((after[i]["text"] or "").encode()).hexdigest() for i in want)


#: Names that stages use inside, beside the columns of the table.
INSIDE = "_k _t _th _kept _digest _nth _null _none _row _text _key _md5 none row key same n f0 f1 low cluster root group team tkey begins ends kept n_removed n_bytes hit items _item _ik _w _len score quality start length"


def test_columns_of_any_name_change_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("kept")
    wide = docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(INSIDE.split())])
    for name, stage in corpus_pipeline.STAGES:
        plain, other = stage(spark, docs, folder), stage(spark, wide, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert other.columns == wide.columns
            assert all(r[c] == f"x{i}" for r in other.collect() for i, c in enumerate(INSIDE.split()))
        assert sorted(map(repr, other.select(plain.columns).collect())) == sorted(map(repr, plain.collect())), name


def test_labels_that_teach_nothing_reject_nothing(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.warns(UserWarning, match="too few"):
        assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == docs.count()


def test_run_registers_and_handles_nothing(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
