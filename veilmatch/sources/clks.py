"""Bit strings and true pairs from JSON files, and random problems for benchmarks.

    spark.read.format("clkjson").load(path)      rec_i, clk of {"clks": ["<base64>", ...]}
    spark.read.format("truthjson").load(path)    rec_i0, rec_i1 of [[i, j], ...]

Both read one JSON document by byte ranges.  Base64 and numbers hold neither quotes
nor brackets, so a range finds its first element by itself; filters are numbered by
a pass that counts the quotes of every range.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veilmatch.schema import PAIR_COLUMNS
from veilmatch.session import share_code, write_table
from veilmatch.sources.files import Slice, assemble, files_at, open_file, read_slice

#: Bytes of one input partition, and elements of one batch.
SPLIT, BATCH = 32 << 20, 16_384
#: Bytes of pairs that a task holds at once.
PIECE = 1 << 20
_OPENING = re.compile(rb'\s*\{\s*"clks"\s*:\s*\[')
_PAIR = re.compile(rb"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]")


@dataclass
class Bytes(InputPartition):
    path: str
    first: int
    end: int
    size: int
    #: Quotes before ``first``.
    before: int


def ranges_of(path: str, split: int) -> list[Bytes]:
    return [Bytes(file, at, min(at + split, size), size, 0) for file, size in files_at(path) for at in range(0, size, split)]


def count_quotes(r: Bytes) -> int:
    return sum(raw.count(b'"') for raw in read_slice(Slice(r.path, r.first, r.end - r.first)))


def _read_range(r: Bytes, ends: bytes) -> bytes:
    """The bytes of a range, and those behind it up to the next one of ``ends``."""
    with open_file(r.path) as f:
        f.seek(r.first)
        out = [f.read(r.end - r.first)]
        while raw := f.read(4096):
            out.append(raw)
            if ends in raw:
                break
    return b"".join(out)


class FilterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("bytesPerPartition", SPLIT))
        self.counts = [int(x) for x in options.get("quotes", "").split(",") if x]

    def partitions(self) -> list[Bytes]:
        out, before = ranges_of(self.path, self.split), 0
        if len({r.path for r in out}) != 1:
            raise ValueError("filters are read from one JSON document at a time")
        if not _OPENING.match(next(read_slice(Slice(out[0].path, 0, min(out[0].size, 4096))))):
            raise ValueError('filters are read from documents {"clks": [...]}')
        for r, n in zip(out, self.counts or map(count_quotes, out), strict=True):
            r.before, before = before, before + n
        return out

    def read(self, r: Bytes) -> Iterator[pa.RecordBatch]:
        """The filters whose first quote lies in the range: filter i is between quotes 2 i + 2 and 2 i + 3 of the document."""
        raw = _read_range(r, b'"')
        inside, words = raw.count(b'"', 0, r.end - r.first), raw.split(b'"')
        first = r.before % 2  # 1 if the range begins within a string
        between = b"".join(words[first : inside + 1 : 2]).translate(None, b" \t\r\n,")
        if between not in b"{:[]}":
            raise ValueError('filters are read from documents {"clks": [...]}')
        found = [((r.before + i - 1) // 2 - 1, words[i]) for i in range(1 + first, inside + 1, 2)]
        found = [(i, base64.b64decode(w.replace(b"\\/", b"/"), validate=True)) for i, w in found if i >= 0]
        for k in range(0, len(found), BATCH):
            ids, values = zip(*found[k : k + BATCH])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], ["rec_i", "clk"])


class FilterJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clkjson"

    def schema(self):
        return "rec_i bigint, clk binary"

    def reader(self, schema) -> FilterReader:
        return FilterReader(self.options)


class TruthReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("bytesPerPartition", SPLIT))

    def partitions(self) -> list[Bytes]:
        return ranges_of(self.path, self.split)

    def read(self, r: Bytes) -> Iterator[pa.RecordBatch]:
        """The pairs whose bracket opens in the range, from pieces of PIECE bytes."""
        at = r.first
        while at < r.end:
            part = Bytes(r.path, at, min(at + PIECE, r.end), r.size, 0)
            yield from self._pairs_of(part)
            at = part.end

    def _pairs_of(self, r: Bytes) -> Iterator[pa.RecordBatch]:
        raw = _read_range(r, b"]")
        found = [m for m in _PAIR.finditer(raw) if m.start() < r.end - r.first]
        # What stands between pairs: commas, and the outer brackets at both ends.
        cuts = [0, *(x for m in found for x in m.span()), len(raw)]
        between = [raw[a:b].translate(None, b" \t\r\n,") for a, b in zip(cuts[::2], cuts[1::2])]
        whole = r.first == 0 and r.end == r.size
        if any(between[1:-1]) or (whole and b"".join(between) != b"[]") or (r.first == 0 and between[0][:1] != b"["):
            raise ValueError("pairs are read from documents [[i, j], ...]")
        for k in range(0, len(found), BATCH):
            both = [pa.array([int(m[g]) for m in found[k : k + BATCH]], pa.int64()) for g in (1, 2)]
            yield pa.RecordBatch.from_arrays(both, ["rec_i0", "rec_i1"])


class TruthJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "truthjson"

    def schema(self):
        return "rec_i0 bigint, rec_i1 bigint"

    def reader(self, schema) -> TruthReader:
        return TruthReader(self.options)


def read_clk_json(spark: SparkSession, path: str, dset_i: int = 0, *, split: int = SPLIT) -> DataFrame:
    """Records of a document ``{"clks": ["<base64>", ...]}``; the place in the list is rec_i.  Ranges of ``split`` bytes are read apart."""
    share_code(spark)
    spark.dataSource.register(FilterJson)
    ranges = ranges_of(path, split)

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "n": [count_quotes(Bytes(*r, 0)) for r in b[["path", "first", "end", "size"]].itertuples(index=False)]})

    table = [(i, r.path, r.first, r.end, r.size) for i, r in enumerate(ranges)]
    quotes = ""
    if len(ranges) > 1:
        rows = spark.createDataFrame(table, "i int, path string, first bigint, end bigint, size bigint").repartitionByRange(len(table), "i").mapInPandas(count, "i int, n bigint").collect()
        quotes = ",".join(str(r["n"]) for r in sorted(rows))
    found = spark.read.format("clkjson").options(path=path, bytesPerPartition=split, quotes=quotes).load()
    return found.select(F.lit(dset_i).alias("dset_i"), "rec_i", "clk")


def read_truth_json(spark: SparkSession, path: str, *, split: int = SPLIT) -> DataFrame:
    """(rec_i0, rec_i1) of a document ``[[i, j], ...]``, or of a folder of such.  Ranges of ``split`` bytes are read apart."""
    share_code(spark)
    spark.dataSource.register(TruthJson)
    return spark.read.format("truthjson").options(path=path, bytesPerPartition=split).load()


def _document(spark: SparkSession, lines: str, path: str, head: bytes, tail: bytes) -> None:
    """One document from text files whose lines end with a comma each."""
    slices = [Slice(file, 0, n) for file, n in files_at(lines) if n]
    if slices:
        slices[-1] = slices[-1]._replace(n=slices[-1].n - 2)
    assemble(spark, slices, path, lines, head, tail)


def write_clk_json(records: DataFrame, path: str) -> None:
    """One JSON document in a folder dset_i=<i> per dataset, records in the order of rec_i, each written by many tasks."""
    spark, scratch = records.sparkSession, f"{path.rstrip('/')}/_lines-{uuid.uuid4().hex}"
    value = F.concat(F.lit('"'), F.base64("clk"), F.lit('",')).alias("value")
    records.orderBy("dset_i", "rec_i").select("dset_i", value).write.partitionBy("dset_i").text(scratch)
    for (i,) in records.select("dset_i").distinct().collect():
        _document(spark, f"{scratch}/dset_i={i}", f"{path.rstrip('/')}/dset_i={i}", b'{"clks": [', b"]}\n")


def write_truth_json(pairs: DataFrame, path: str) -> None:
    """(rec_i0, rec_i1) as one JSON document ``[[i, j], ...]`` in a folder, in no order, written by many tasks."""
    scratch = f"{path.rstrip('/')}/_lines-{uuid.uuid4().hex}"
    pairs.select(F.format_string("[%d, %d],", "rec_i0", "rec_i1").alias("value")).write.text(scratch)
    _document(pairs.sparkSession, scratch, path, b"[", b"]\n")


def random_filters(records: DataFrame, length: int = 1024, *, seed: int = 0) -> DataFrame:
    """Records (rec_i, ...) with a ``clk`` of ``length`` uniformly random bits that depends on ``seed`` and rec_i only."""
    if length < 0 or length % 8:
        raise ValueError("the length must be whole bytes")
    words = [F.lpad(F.hex(F.xxhash64("rec_i", F.lit(j), F.lit(seed))), 16, "0") for j in range(-(-length // 64))]
    return records.withColumn("clk", F.substring(F.unhex(F.concat(*words)) if words else F.lit(b""), 1, length // 8))


def random_clks(spark: SparkSession, count: int, length: int = 1024, *, seed: int = 0, dset_i: int = 0, start: int = 0) -> DataFrame:
    """``count`` random filters with the ids from ``start``."""
    return random_filters(spark.range(start, start + count).select(F.lit(dset_i).alias("dset_i"), F.col("id").alias("rec_i")), length, seed=seed)


def sparse_places(ids: DataFrame, m: int, sparsity: float, *, seed: int = 0) -> DataFrame:
    """(id, place, sim): for each id every place below ``m`` with probability ``sparsity``, with a uniform similarity.

    Gaps between places are drawn, not places tested, so work grows with the rows that
    come out.  They depend on ``seed``, the id and ``m`` only.
    """
    if not 0 <= sparsity <= 1:
        raise ValueError("the sparsity must be between 0 and 1")

    def draw(batches):
        for b in batches:
            for i in b["id"] if m > 0 and sparsity > 0 else ():
                rng, at = np.random.Generator(np.random.Philox(key=[seed % 2**64, int(i) % 2**64])), -1
                while at < m:
                    # A gap above m leads out in any case; cut there, sums stay far from the limits of 64 bits.
                    n = min(65_536, math.ceil(m * sparsity) + 16)
                    places = at + np.cumsum(np.minimum(rng.geometric(sparsity, n), m + 1))
                    sims, at = rng.random(n), int(places[-1])
                    keep = places < m
                    yield pd.DataFrame({"id": i, "place": places[keep], "sim": sims[keep]})

    return ids.select("id").mapInPandas(draw, "id bigint, place bigint, sim double")


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """(place, id): places from 0 in the order of the ids.  One row per task goes through a window, not the ids."""
    cut = write_table(ids.select(F.col(column).cast("bigint").alias("id")).orderBy("id").select("id", F.monotonically_increasing_id().alias("n")), "numbered")
    part = F.shiftright("n", 33)
    sizes = cut.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    return cut.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + F.col("n").bitwiseAND(2**33 - 1)).alias("place"), "id")


def random_links(left: DataFrame, right: DataFrame, sparsity: float, *, seed: int = 0) -> DataFrame:
    """Candidate pairs of two tables' records (rec_i, distinct), each with probability ``sparsity``, with uniform similarities."""
    places = numbered(right, "rec_i")
    drawn = sparse_places(left.select(F.col("rec_i").cast("bigint").alias("id")), places.count(), sparsity, seed=seed)
    found = drawn.withColumnRenamed("id", "rec_i0").join(places.withColumnRenamed("id", "rec_i1"), "place")
    return found.withColumns({"dset_i0": F.lit(0), "dset_i1": F.lit(1)}).select(*PAIR_COLUMNS)


def random_problem(spark: SparkSession, n: int, m: int, sparsity: float, *, seed: int = 0) -> DataFrame:
    """Candidate pairs of an n x m problem, each present with probability ``sparsity``, with uniform similarities."""
    found = sparse_places(spark.range(n), m, sparsity, seed=seed)
    return found.select("sim", F.lit(0).alias("dset_i0"), F.lit(1).alias("dset_i1"), F.col("id").alias("rec_i0"), F.col("place").alias("rec_i1"))
