"""Token ids in Arrow stream files with fixed-size-list batches.

Each file holds the documents of one range of keys, end to end, as sequences of
``SEQUENCE`` ids: a list of fixed size per row and, beside it, a mask that is
false where the last sequence is padded.  All batches but the last have
``BATCH`` rows, and a side file says at which byte each batch begins, so any
sequence is read by two seeks, as a view of the memory map.  A second side file
says where each document begins.  Ids take 16 bits where the vocabulary allows it.

Files are written by tasks below the shared folder under names of their own, so
a task that runs again after an executor was lost leaves no mixed result; the
driver gets one row per file.  Documents are in ascending key order over all
files (null keys first; equal keys by the XXH64 of their texts, so that rows of
one key also spread over tasks).  Null texts are empty and hold the end id only;
an empty table gives no file.

Word vocabularies are encoded by the transducer (transducer.py), byte-level ones
by forced boundaries (bpe.py); both equal the library.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmatch.llm.bpe import load
from veilmatch.llm.common import byte_rows, int64, tidy
from veilmatch.llm.transducer import transducer

SEQUENCE = 2048
BATCH = 256


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sequence_schema(width: pa.DataType, length: int, batch: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", width, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)], metadata={"batch": str(batch)})


class SequenceWriter:
    """Appends documents' ids to one stream file of equal-length sequences."""

    def __init__(self, sink, width: pa.DataType, length: int = SEQUENCE, batch: int = BATCH):
        self.length, self.batch, self.kind = length, batch, width.to_pandas_dtype()
        self.schema = sequence_schema(width, length, batch)
        self.sink, self.places = sink, []  # where each batch begins
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.total = 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind, copy=False))
        self.n_waiting += len(ids)
        self.total += len(ids)
        if self.n_waiting >= self.length * self.batch:
            self._flush()

    def _put(self, flat: np.ndarray, known: int) -> None:
        kinds = self.schema.types
        mask = np.arange(len(flat)) < known
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((flat, mask), kinds)]
        batch = pa.RecordBatch.from_arrays(lists, schema=self.schema)
        self.out.write_batch(batch)  # the first one writes the schema too
        self.places.append(self.sink.tell() - pa.ipc.get_record_batch_size(batch))

    def _flush(self, last: bool = False) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        step, at = self.length * self.batch, 0
        while len(flat) - at >= step:
            self._put(flat[at : at + step], step)
            at += step
        rest = flat[at:]
        if last and len(rest):
            self._put(np.concatenate([rest, np.zeros(-len(rest) % self.length, self.kind)]), len(rest))
            rest = rest[:0]
        self.waiting, self.n_waiting = [rest], len(rest)

    def close(self) -> int:
        self._flush(True)
        self.out.close()
        return self.total


def read_flat(source) -> Iterator[np.ndarray]:
    """The unmasked ids of each batch of a stream file, in order, as views of the batch."""
    for batch in pa.ipc.open_stream(source):
        ids = batch.column(0)
        flat = ids.flatten().to_numpy(zero_copy_only=True)
        known = batch.column(1).flatten()
        yield flat[: known.true_count] if known.true_count < len(flat) else flat


def read_sequence(path: str, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """(ids, mask) of one sequence of a local file (``path`` without ending): views of the memory map, found by their place."""
    with pa.memory_map(f"{path}.batches.arrows") as side:
        places = pa.ipc.open_stream(side).read_all()["place"].to_numpy()
    with pa.memory_map(f"{path}.arrows") as source:
        schema = pa.ipc.open_stream(source).schema
        which, row = divmod(number, int(schema.metadata[b"batch"]))
        if not 0 <= number or which >= len(places):
            raise IndexError("no such sequence")
        source.seek(int(places[which]))
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
        if row >= len(batch):
            raise IndexError("no such sequence")
        n = batch.column(0).type.list_size
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)[row * n : (row + 1) * n], batch.column(1).flatten().slice(row * n, n)


def write_sequences(df: DataFrame, vocabulary: str, folder: str, *, end_id: int = 2, length: int = SEQUENCE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode ``df`` and write it below ``folder``.  Returns one row per file, in key order: (part, path, n_docs, n_tokens, start)."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        encode = transducer(vocabulary).ids if bpe.words else lambda raws: (np.frombuffer(bpe.encode(x.decode("utf-8", "replace")), "<u4") for x in raws)
        width = pa.uint16() if bpe.size <= 1 << 16 else pa.uint32()
        end = np.array([end_id], "<u4")
        name, writer = f"{folder}/{uuid.uuid4().hex}", None
        keys: list = []
        counts: list[np.ndarray] = []
        low = part = None
        from pyspark import TaskContext

        for b in batches:
            if not len(b):
                continue
            if writer is None:
                fs, at = _open(name)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(at + ".arrows")
                writer, low, part = SequenceWriter(sink, width, length), b.column(0)[0].as_py(), TaskContext.get().partitionId()
            n = []
            for ids in encode(byte_rows(b.column(1))):
                writer.append(ids)
                writer.append(end)
                n.append(len(ids) + 1)
            keys.append(b.column(0))
            counts.append(np.array(n, np.int64))
        if writer is not None:
            total = writer.close()
            sink.close()
            index = pa.table({"key": pa.chunked_array(keys), "n_tokens": np.concatenate(counts)})
            for ending, table in ((".index.arrows", index), (".batches.arrows", pa.table({"place": int64(writer.places)}))):
                with fs.open_output_stream(at + ending) as f, pa.ipc.new_stream(f, table.schema) as out:
                    out.write_table(table, max_chunksize=10_000)
            yield pa.RecordBatch.from_arrays([int64([part]), pa.array([name], pa.string()), int64([len(index)]), int64([total])], ["part", "path", "n_docs", "n_tokens"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key), body.alias("text"), F.xxhash64(body).alias("_hash")).repartitionByRange(F.col(key), F.col("_hash")).sortWithinPartitions(key, "_hash", "text")
    files = sorted(tuple(x) for x in rows.select(key, "text").mapInArrow(tidy(run), "part bigint, path string, n_docs bigint, n_tokens bigint").collect())  # a row for each file
    out, start = [], 0
    for part, path, n_docs, n_tokens in files:
        out.append((part, path, n_docs, n_tokens, start))
        start += n_tokens
    written = spark.createDataFrame(out, "part bigint, path string, n_docs bigint, n_tokens bigint, start bigint").repartition(max(1, len(out)))
    written._veil_key = df.schema[key].dataType.simpleString()  # type: ignore[attr-defined]  # where there is no file
    return written


def _key_type(files: DataFrame) -> str:
    """The type of the keys in the files, from the side file of one of them."""
    from pyspark.sql.pandas.types import from_arrow_type

    one = files.select("path").first()
    if one is None:
        return getattr(files, "_veil_key", "bigint")
    fs, at = _open(one["path"])
    with fs.open_input_stream(at + ".index.arrows") as side:
        return from_arrow_type(pa.ipc.open_stream(side).schema.field("key").type).simpleString()


def read_documents(files: DataFrame, key_type: str | None = None, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files that write_sequences() returned, read back from them."""
    key_type = key_type or _key_type(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, at = _open(row["path"])
                with fs.open_input_stream(at + ".arrows") as source, fs.open_input_stream(at + ".index.arrows") as side:
                    flat, have, start = read_flat(source), np.zeros(0, "<u4"), row["start"]
                    for docs in pa.ipc.open_stream(side):
                        n = docs.column(1).to_numpy()
                        sums = []
                        for k in n.tolist():
                            crc = 0
                            while k > len(have):
                                crc, k = zlib.crc32(have, crc), k - len(have)
                                have = next(flat).astype("<u4", copy=False)
                            sums.append(zlib.crc32(have[:k], crc))
                            have = have[k:]
                        starts = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays([docs.column(0), int64(starts), int64(n), int64(sums)], [key, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(tidy(run), f"`{key}` {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
