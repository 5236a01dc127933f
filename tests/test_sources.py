import base64
import json
import random
import struct

import pytest

from tests import linkage_spec as spec
from veilmatch.schema import PAIRS
from veilmatch.sources import clks, pairs

#: Twelve rows in order, with ties in every leading run of columns.
ROWS = spec.canonical([(0.95 - 0.25 * (i // 6), i // 3 % 2, 3 + i // 2 % 2, 7 * i % 5, 40 + i) for i in range(12)])


def write(path, rows, sim="d", dset="I", rec="I", version=1):
    sizes = [struct.calcsize(x) for x in (sim, dset, rec)]
    path.write_bytes(bytes([version, *sizes]) + b"".join(struct.pack(f"<{sim}{dset}{dset}{rec}{rec}", *r) for r in rows))
    return str(path)


@pytest.mark.parametrize("sim,dset,rec", [("d", "I", "I"), ("f", "B", "H"), ("d", "Q", "Q")])
def test_load(spark, tmp_path, sim, dset, rec):
    f = write(tmp_path / "x", ROWS, sim, dset, rec)
    want = [(struct.unpack(f"<{sim}", struct.pack(f"<{sim}", r[0]))[0], *r[1:]) for r in ROWS]
    assert list(pairs.load_to_iterable(f)) == want
    assert sorted(map(tuple, pairs.load_candidate_pairs(spark, f).collect())) == sorted(want)
    pairs.register(spark)
    got = spark.read.format("pairfile").option("entriesPerPartition", 3).load(f)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(want)


def test_dump_and_merge(spark, tmp_path):
    df = spark.createDataFrame(ROWS[::-1], PAIRS).repartition(3)
    size = pairs.dump_candidate_pairs(df, str(tmp_path / "all"))
    parts, n = pairs.dump_candidate_pairs_iter(df)
    raw = b"".join(parts)
    assert raw == (tmp_path / "x" if False else next(p for p in (tmp_path / "all").iterdir() if p.name.startswith("part"))).read_bytes()
    assert size == n == len(raw) == pairs.dump_size(len(ROWS)) == pairs.pairs_size(df).first()["n_bytes"]
    for mask in range(6):
        side = random.Random(mask).choices((0, 1), k=len(ROWS))
        runs = [[r for r, x in zip(ROWS, side) if x == i] for i in (0, 1)]
        files = [write(tmp_path / f"r{mask}{i}", r, "d", "BH"[i], "I") for i, r in enumerate(runs)]
        merged, n = pairs.merge_streams_iter(files, sizes=[(tmp_path / f"r{mask}{i}").stat().st_size for i in range(2)])
        got = b"".join(merged)
        assert len(got) == n and got[:4] == bytes([1, 8, 2, 4])
        (tmp_path / "m").write_bytes(got)
        assert list(pairs.load_to_iterable(str(tmp_path / "m"))) == spec.canonical(ROWS)
    assert pairs.merge_streams(spark, files, str(tmp_path / "merged")) == n
    assert sorted(map(tuple, pairs.load_candidate_pairs(spark, str(tmp_path / "merged")).collect())) == sorted(ROWS)
    for f in (lambda: pairs.merge_streams_iter([]), lambda: pairs.merge_streams(spark, [], "x")):
        with pytest.raises(ValueError):
            f()


def test_one_file_from_many_tasks(spark, tmp_path):
    """Ranges merged and written by several tasks make the bytes that one writer makes; ties fall into one range or several."""
    draw = random.Random(7)
    rows = spec.canonical([(draw.choice((0.5, 0.75, 1.0)), 0, 1, draw.randrange(6), draw.randrange(300)) for _ in range(4000)])
    rows = spec.canonical([*rows, *[(0.75, 0, 1, 3, 3)] * 900])
    df = spark.createDataFrame(rows, PAIRS).repartition(5)
    pairs.dump_candidate_pairs(df, str(tmp_path / "all"))
    pairs.dump_candidate_pairs(df, str(tmp_path / "all"))
    (made,) = [p for p in (tmp_path / "all").iterdir() if not p.name.startswith(".")]
    assert list(pairs.load_to_iterable(str(made))) == rows
    side = draw.choices(range(4), k=len(rows))
    files = [write(tmp_path / f"s{i}", [r for r, x in zip(rows, side) if x == i]) for i in range(4)] + [write(tmp_path / "none", [])]
    for entries in (100, 1000, 10**9):
        out = tmp_path / f"m{entries}"
        assert pairs.merge_streams(spark, files, str(out), range_entries=entries) == made.stat().st_size
        assert [p.read_bytes() for p in out.iterdir() if not p.name.startswith(".")] == [made.read_bytes()]
    assert pairs.merge_streams(spark, files[-1:], str(tmp_path / "empty")) == 4
    with pytest.raises(Exception, match="not in canonical order"):
        pairs.merge_streams(spark, [write(tmp_path / "back", rows[::-1])], str(tmp_path / "bad"))


def test_broken_files(spark, tmp_path):
    good = (tmp_path / "g", ROWS)
    write(*good)
    raw = good[0].read_bytes()
    for i, bad in enumerate([b"", raw[:3], b"\2" + raw[1:], b"\1\3" + raw[2:], b"\1\10\5" + raw[3:], raw[:-1]]):
        f = tmp_path / f"b{i}"
        f.write_bytes(bad)
        with pytest.raises(ValueError):
            pairs.load_candidate_pairs(spark, str(f))
        with pytest.raises(ValueError):
            list(pairs.load_to_iterable(str(f)))
    half = write(tmp_path / "h", ROWS, "e")
    assert len(list(pairs.load_to_iterable(half))) == len(ROWS)
    with pytest.raises(ValueError):
        pairs.load_candidate_pairs(spark, half)
    with pytest.raises(OverflowError):
        pairs.pack([(0.5, 0, 300, 0, 0)], pairs.Widths(8, 1, 4))


def test_json_and_random(spark, tmp_path):
    values = [b"abc", b"\0\1\2", b"xyz"]
    (tmp_path / "c.json").write_text(json.dumps({"clks": [base64.b64encode(v).decode() for v in values]}, indent=1))
    assert [(r["rec_i"], bytes(r["clk"])) for r in clks.read_clk_json(spark, str(tmp_path / "c.json")).orderBy("rec_i").collect()] == list(enumerate(values))
    (tmp_path / "t.json").write_text("[[1, 2],\n [3, 4]]")
    assert sorted(map(tuple, clks.read_truth_json(spark, str(tmp_path / "t.json")).collect())) == [(1, 2), (3, 4)]
    a = clks.random_clks(spark, 50, 136, seed=3)
    assert {len(r["clk"]) for r in a.collect()} == {17} and a.select("clk").distinct().count() == 50
    n = clks.random_problem(spark, 40, 50, 0.25).count()
    assert 380 < n < 620


def test_json_by_ranges(spark, tmp_path):
    """Ranges of a few bytes, which cut elements anywhere, give the elements of the whole document in their places."""
    values = [bytes([i % 256] * (1 + i % 5)) for i in range(60)]
    for k, text in enumerate([json.dumps({"clks": [base64.b64encode(v).decode() for v in values]}, indent=i) for i in (None, 3)]):
        (tmp_path / f"c{k}.json").write_text(text.replace("/", "\\/") if k else text)
        for split in (5, 64, 10**6):
            got = clks.read_clk_json(spark, str(tmp_path / f"c{k}.json"), split=split).orderBy("rec_i").collect()
            assert [(r["rec_i"], bytes(r["clk"])) for r in got] == list(enumerate(values))
    want = [(i, -i * i) for i in range(40)]
    (tmp_path / "t.json").write_text(json.dumps(want, indent=1))
    for split in (3, 50, 10**6):
        assert sorted(map(tuple, clks.read_truth_json(spark, str(tmp_path / "t.json"), split=split).collect())) == sorted(want)
    records = spark.createDataFrame([(d, i, v) for d in (0, 2) for i, v in enumerate(values)], "dset_i int, rec_i bigint, clk binary").repartition(7)
    clks.write_clk_json(records, str(tmp_path / "w"))
    for d in (0, 2):
        (made,) = [p for p in (tmp_path / "w" / f"dset_i={d}").iterdir()]
        assert [base64.b64decode(x) for x in json.loads(made.read_text())["clks"]] == values
    for name, rows in (("some", want), ("none", [])):
        clks.write_truth_json(spark.createDataFrame(rows, "rec_i0 bigint, rec_i1 bigint").repartition(3), str(tmp_path / name))
        (made,) = (tmp_path / name).iterdir()
        assert sorted(map(tuple, json.loads(made.read_text()))) == sorted(rows)
        assert clks.read_truth_json(spark, str(tmp_path / name)).count() == len(rows)
    for name, text in (("a", '{"x": 1, "clks": []}'), ("b", '{"clks": ["YQ=="], "x": 1}'), ("c", "[]")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="filters are read from"):
            clks.read_clk_json(spark, str(tmp_path / name)).collect()
    (tmp_path / "e").write_text('{"clks": []}')
    assert clks.read_clk_json(spark, str(tmp_path / "e")).count() == 0
    (tmp_path / "d").write_text("[[1, 2], [3]]")
    with pytest.raises(Exception, match="pairs are read from"):
        clks.read_truth_json(spark, str(tmp_path / "d")).collect()


def test_random_links(spark):
    left, right = (spark.range(a, b, c).withColumnRenamed("id", "rec_i") for a, b, c in ((5, 45, 1), (100, 200, 2)))
    got = clks.random_links(left, right, 0.3, seed=4).collect()
    assert sorted(got) == sorted(clks.random_links(left.repartition(3), right.repartition(2), 0.3, seed=4).collect())
    assert 450 < len(got) < 750 and len({(r["rec_i0"], r["rec_i1"]) for r in got}) == len(got)
    assert {r["rec_i1"] for r in got} == set(range(100, 200, 2)) and all(0 <= r["sim"] < 1 for r in got)
    assert clks.random_links(left, right, 1.0).count() == 2000 and clks.random_links(left, right, 0.0).count() == 0
    assert clks.random_links(left, right.where("false"), 0.5).count() == 0
    assert clks.random_problem(spark, 10, 10**12, 1e-12).count() < 60


def test_iterators_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """The queries' files are made and read by tasks: no rows come to the driver, and every stretch of a file is read once."""
    from pyspark.sql import DataFrame

    from veilmatch import queries

    rows = [(1 - i / 100, 0, 1, i, 2 * i) for i in range(50)]
    monkeypatch.setattr(queries, "_pairs", lambda s, d: s.createDataFrame(rows, PAIRS))
    monkeypatch.setattr(queries, "LAZY_ENTRIES", 7)

    def none(self, *args, **options):
        raise AssertionError("rows pass through the driver")

    for query in (queries.dump_iterator, queries.merge_iterator):
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "toLocalIterator", none)
            out = query(spark, "")
        assert out.rdd.getNumPartitions() == 8 and sorted(map(tuple, out.collect()), reverse=True) == rows
    monkeypatch.setattr(queries, "_pairs", lambda s, d: s.createDataFrame([], PAIRS))
    assert queries.dump_iterator(spark, "").count() == queries.merge_iterator(spark, "").count() == 0


def test_pairs_of_large_ranges_are_held_in_pieces(spark, tmp_path, monkeypatch):
    """A range of a truth document is read piece by piece, with the same pairs."""
    path = tmp_path / "truth.json"
    given = [[i, 1000 - 7 * i] for i in range(500)]
    path.write_text(json.dumps(given))
    monkeypatch.setattr(clks, "PIECE", 100)
    read, held = clks._read_range, []
    monkeypatch.setattr(clks, "_read_range", lambda r, ends: held.append(r.end - r.first) or read(r, ends))
    reader = clks.TruthReader({"path": str(path)})
    got = [list(x) for part in reader.partitions() for b in reader.read(part) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert got == given and max(held) == 100


def test_files_are_made_without_copies(spark, tmp_path, monkeypatch):
    """On a mounted file system tasks write entries to their places; no second file of the entries is made and copied, and none is left."""
    monkeypatch.setattr(pairs, "assemble", lambda *a: pytest.fail("a copy"))
    df = spark.createDataFrame(ROWS[::-1], PAIRS).repartition(3)
    for widths in (pairs.Widths(), pairs.Widths(4, 1, 8)):
        size = pairs.dump_candidate_pairs(df, str(tmp_path / "one"), widths)
        assert size == pairs.dump_size(len(ROWS), widths)
    pairs.dump_candidate_pairs(df.where("rec_i1 % 2 = 0"), str(tmp_path / "two"))
    assert pairs.dump_candidate_pairs(df.limit(0), str(tmp_path / "none")) == pairs.HEADER.size
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        pairs.dump_candidate_pairs(df.withColumn("dset_i1", df.dset_i1 + 300), str(tmp_path / "bad"), pairs.Widths(8, 1, 4))
    pairs.merge_streams(spark, [str(tmp_path / x) for x in ("one", "two", "none")], str(tmp_path / "all"), range_entries=5)
    (made,) = (tmp_path / "all").iterdir()
    both = [*pairs.load_to_iterable(str(next((tmp_path / "one").iterdir()))), *pairs.load_to_iterable(str(next((tmp_path / "two").iterdir())))]
    assert list(pairs.load_to_iterable(str(made))) == spec.canonical(both)
    assert [len(x) for x in pairs.load_to_arrays(str(made), 2, 5)] == [5]
