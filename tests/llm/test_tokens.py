import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veilmatch.llm import bpe, sequences, transducer
from tests.llm.conftest import prose
from veilmatch.llm.common import fresh_path

P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def by_row(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_encoding_equals_the_library(docs, rows, library):
    t = library[BYTES]
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(bpe.encoding_digests(docs, BYTES)) == sorted(map(repr, want))
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs.where("doc_id > 0"), BYTES).collect()}
    assert all(got[i]["decoded"] == (x or "") for i, x in rows if i)


def test_counts_equal_the_library(docs, rows, library, monkeypatch):
    want = []
    for i, x in rows:
        n = len(library[WORDS].encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 100))
    assert by_row(transducer.count_tokens(docs, WORDS, limit=100)) == sorted(map(repr, want))


def test_state_maps_compose_at_any_cut(library):
    m = transducer.transducer(WORDS)
    text = "the quick  brown\n fox it's 12 're-union'll " * 3 + "unbelievable" * 4
    want = len(library[WORDS].encode(text, add_special_tokens=False).ids)
    x = np.frombuffer(text.encode(), np.uint8)
    pieces = transducer.find_pieces(x)
    for k in range(1, 12):
        maps = m.chunk_maps(x, *pieces, size=k)
        left = maps[0]
        for part in maps[1:]:
            left = m.compose(left, part)
        assert m.apply(left, m.start) == m.apply(m.scan(maps), m.start)
        assert m.apply(left, m.start)[1] == want


def test_transitions_sum_to_counts_and_lead_to_ids(library, rows):
    t, m = library[WORDS], transducer.Transducer(bpe.load(WORDS))
    rng = random.Random(3)
    pool = [*"aabcdest'' 'r\"-.,12é²½ÑßİſΣ日本\u0301 \n\x1c\x85\xa0—😀", "'re", "'ve", "'ll", "'s", "n't", "<|endoftext|>", "the ", "ing", "tion"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["'" * 50, "x" * 200_000, "ab'll " * 30_000] + [x or "" for _, x in rows]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    raws = [x.encode() for x in texts]
    assert [x.tolist() for x in m.ids(raws)] == want
    assert m.counts(raws).tolist() == [m.count(x) for x in raws] == list(map(len, want))


def test_emptied_transitions_change_nothing(library, monkeypatch):
    monkeypatch.setattr(transducer, "MOST", 5)
    monkeypatch.setattr(transducer, "BLOCK", 40)
    monkeypatch.setattr(transducer, "CHUNK", 30)
    monkeypatch.setattr(transducer, "SLOTS", 16)
    m = transducer.Transducer(bpe.load(WORDS))
    texts = [prose(random.Random(i), 40) for i in range(20)]
    assert m.counts([x.encode() for x in texts]).tolist() == [len(e.ids) for e in library[WORDS].encode_batch(texts, add_special_tokens=False)]


def test_cuts_are_never_merged_over():
    b = bpe.load(BYTES)
    for raw in (b"hello42!?", "naïve日本".encode(), b"a" * 300 + b"\x00\xff" * 200):
        assert b"".join(b.cuts(raw)) == raw
        ids = [b.first[x] for x in raw]
        assert b.piece(raw) == np.array(b._merge_long(list(ids)), "<u4").tobytes()


def test_full_tables_change_nothing(library, monkeypatch):
    b = bpe.Bpe(BYTES)
    b.spaced.most = b.stretch.most = b._inner.most = b._whole.most = 300
    text = "one two three four five six one two three seven eight nine one four"
    assert np.frombuffer(b.encode(text), "<u4").tolist() == library[BYTES].encode(text, add_special_tokens=False).ids


def test_files_round_trip(spark, docs, rows, library):
    files = sequences.write_sequences(docs, WORDS, fresh_path(spark, "sequences"), length=64)
    got = [tuple(r) for r in sequences.read_documents(files).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64)))
    want, start = [], 0
    for i, x in order:
        ids = np.array(library[WORDS].encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    first = files.orderBy("part").first()
    path = first["path"].removeprefix("file:").replace("//", "/")
    for i in (0, (first["n_tokens"] - 1) // 64):
        ids, mask = sequences.read_sequence(path, i)
        assert len(ids) == len(mask) == 64 and ids.dtype == np.uint16 and not ids.flags.owndata
        assert mask.true_count == min(64, first["n_tokens"] - 64 * i)
    with pytest.raises(IndexError):
        sequences.read_sequence(path, (first["n_tokens"] - 1) // 64 + 1)


def test_files_take_keys_of_any_type(spark, docs, none):
    strings = docs.where("doc_id is not null").selectExpr("concat('d', doc_id) doc_id", "text")
    files = sequences.write_sequences(strings, WORDS, fresh_path(spark, "sequences"))
    got = sequences.read_documents(files)
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in strings.collect())
    empty = sequences.read_documents(sequences.write_sequences(strings.limit(0), WORDS, fresh_path(spark, "sequences")))
    assert empty.count() == 0 and empty.schema["doc_id"].dataType.simpleString() == "string"


def test_long_pieces_take_linear_time(library):
    import time

    m = transducer.Transducer(bpe.load(WORDS))
    for text in ("a" * 400_000, "abcab" * 80_000, "lorem" + "ipsum" * 60_000 + " " + "x" * 300_000):
        began = time.process_time()
        assert m.count(text.encode()) == len(next(iter(m.ids([text.encode()])))) == len(library[WORDS].encode(text, add_special_tokens=False).ids)
        assert time.process_time() - began < 20


def test_any_sequence_is_found_by_its_place(tmp_path):
    ids = np.arange(64 * 37 + 5, dtype=np.uint16)
    with open(tmp_path / "x.arrows", "wb") as raw:
        sink = pa.PythonFile(raw)
        writer = sequences.SequenceWriter(sink, pa.uint16(), 64, batch=4)
        for part in np.array_split(ids, 9):
            writer.append(part)
        assert writer.close() == len(ids)
    with pa.OSFile(str(tmp_path / "x.batches.arrows"), "wb") as f, pa.ipc.new_stream(f, pa.schema([("place", pa.int64())])) as out:
        out.write_table(pa.table({"place": pa.array(writer.places, pa.int64())}))
    for i in (0, 3, 4, 36, 37):
        got, mask = sequences.read_sequence(str(tmp_path / "x"), i)
        known = ids[64 * i : 64 * i + 64]
        assert got[: len(known)].tolist() == known.tolist() and mask.true_count == len(known)


def test_nothing_and_nulls(spark, none, nulls):
    for df, n in ((none, 0), (nulls, 3)):
        assert bpe.encoding_digests(df, BYTES).count() == transducer.count_tokens(df, WORDS).count() == n
        files = sequences.write_sequences(df, WORDS, fresh_path(spark, "sequences"))
        assert sorted(r["start"] for r in sequences.read_documents(files).collect()) == list(range(n))
