"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph (a line) is hashed to a vector: ``STRONG`` numbers modulo 2**64 from
a 256-bit hash of the paragraph, and ``LANES`` numbers modulo 2**32, the sum of
signed unit vectors picked by hashes of its word triples (of neighbouring bytes,
if it has fewer than ``SHORT`` words).  A text's fingerprint is the sum of its paragraphs' vectors, lane by lane,
so paragraphs may come in any order, and inserting or deleting one adds or
subtracts its vector.  Equal multisets have equal fingerprints; the strong part
makes others differ.  The signed lanes keep inner products in expectation, so
the cosine of two fingerprints estimates how much two texts share, with an error
of about ``LANES ** -0.5``.

Null texts are empty: all lanes zero, alike (1) to each other and unlike (0) all else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.llm.common import byte_rows, int64, tidy

STRONG = 4
LANES = 256
#: Lines of fewer words are known by their bytes, not by word triples.
SHORT = 8
#: Ranges of keys per task of compare_with_next(): several, so that ranges that fall to one task even out.
RANGES = 8
_ODD_NUMBER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each white-space-separated word, where it starts) of an array of bytes."""
    gap = _SPACE[x]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    power = np.ones(len(x), np.uint64)
    power[1:] = _ODD_NUMBER
    power = np.multiply.accumulate(power)  # powers of an odd number, modulo 2**64
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power)))
    lead = np.uint64(pow(int(_ODD_NUMBER), -1, 1 << 64))
    back = np.ones(len(x), np.uint64)
    back[1:] = lead
    back = np.multiply.accumulate(back)
    return _mix((sums[ends] - sums[starts]) * back[starts]), starts


def _byte_grams(x: np.ndarray) -> np.ndarray:
    """Hashes of every few neighbouring bytes of a short line (the line itself, if it is shorter)."""
    k = min(len(x), 6 if len(x) >= 16 else 3)
    out = np.zeros(len(x) - k + 1, np.uint64)
    for j in range(k):
        out = out * _ODD_NUMBER + x[j : len(x) - k + 1 + j]
    return _mix(out + np.uint64(k))


class Fingerprint:
    """Lanes of a multiset of paragraphs; ``+`` and ``-`` insert and delete."""

    def __init__(self, strong: np.ndarray | None = None, lanes: np.ndarray | None = None):
        self.strong = np.zeros(STRONG, np.uint64) if strong is None else strong
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.strong + other.strong, self.lanes + other.lanes)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.strong - other.strong, self.lanes - other.lanes)

    def __eq__(self, other) -> bool:
        return bool((self.strong == other.strong).all() and (self.lanes == other.lanes).all())

    def text(self) -> str:
        return self.strong.astype(">u8").tobytes().hex() + self.lanes.astype(">u4").tobytes().hex()

    def likeness(self, other: "Fingerprint") -> float:
        """0 to 1; 1 for equal fingerprints."""
        if self == other:
            return 1.0
        a, b = self.lanes.view(np.int32).astype(np.float64), other.lanes.view(np.int32).astype(np.float64)
        norm = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, a @ b / norm))) if norm else 0.0


def fingerprint(raw: bytes) -> Fingerprint:
    """The fingerprint of one text (UTF-8).  Paragraphs are its lines without white space at either end; empty ones count for nothing."""
    lines = [p for x in raw.split(b"\n") if (p := x.strip(b" \t\r\x0b\x0c"))]
    if not lines:
        return Fingerprint()
    strong = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=8 * STRONG).digest() for p in lines]), "<u8").reshape(-1, STRONG).sum(0, dtype=np.uint64)
    joined = np.frombuffer(b"\n".join(lines), np.uint8)
    h, starts = word_hashes(joined)
    stops = np.append(np.flatnonzero(joined == 10), len(joined))
    of = np.searchsorted(stops, starts)  # the paragraph of each word
    size = np.bincount(of, minlength=len(lines))
    if len(h) > 2:
        same = (of[2:] == of[:-2]) & (size[of[2:]] >= SHORT)
        features = [_mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[same]]
    else:
        features = []
    features += [_byte_grams(np.frombuffer(lines[i], np.uint8)) for i in np.flatnonzero(size < SHORT).tolist()]
    triples = np.concatenate(features)
    lane, sign = (triples >> np.uint64(8)) % np.uint64(LANES), (triples >> np.uint64(60)) & np.uint64(1)
    counts = np.bincount((lane * np.uint64(2) + sign).astype(np.int64), minlength=2 * LANES)
    return Fingerprint(strong, ((counts[1::2] - counts[::2]) & 0xFFFFFFFF).astype(np.uint32))


def fingerprint_documents(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every row; row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x).text() for x in byte_rows(b.column(1))], pa.string())], [key, "fingerprint"])

    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint string")


def edited(own: str, following: str) -> str:
    """``own`` with its last quarter (whole code points, rounded down) replaced by as much of the start of ``following``."""
    k = len(own) // 4
    return own[: len(own) - k] + following[:k]


def compare_with_next(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document against its edited text and against the next document by ascending key.

    One shuffle: rows go to ranges of keys and are sorted there; the first row of
    each range travels also to the range before it.  Range limits come from
    quantiles; the driver sees one number per range.  Null keys come first, equal
    keys in the order of their texts' SHA-256.  Keys must be numbers.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = RANGES * parts if parts > 1 else 1
    cuts = sorted({float(x) for x in rows.select(F.col("_key").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    if cuts:
        split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_k", outputCol="_b", handleInvalid="keep")
        rows = split.transform(rows.withColumn("_k", F.coalesce(F.col("_key").cast("double"), F.lit(float(cuts[0]) - 1)))).drop("_k").withColumn("_b", F.col("_b").cast("int"))
    else:
        rows = rows.withColumn("_b", F.lit(0))
    order = F.struct(F.col("_key").isNotNull().alias("a"), "_key", F.sha2("_text", 256).alias("h"))
    firsts = sorted((r[0], r[1]) for r in rows.groupBy("_b").agg(F.min(order).alias("f")).collect())  # one row per range
    if not firsts:
        return spark.createDataFrame([], f"`{key}` {df.schema[key].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = [(f["a"], f["_key"], f["h"], firsts[i - 1][0]) for i, (_, f) in enumerate(firsts)]
    kind = df.schema[key].dataType.simpleString()
    heads = spark.createDataFrame(before, f"a boolean, k {kind}, h string, to int")
    copies = (
        rows.join(F.broadcast(heads), F.col("_key").eqNullSafe(F.col("k")) & (F.sha2("_text", 256) == F.col("h")))
        .dropDuplicates(["to"])
        .select("_key", "_text", F.col("to").alias("_b"), F.lit(True).alias("_copy"))
    )
    placed = rows.withColumn("_copy", F.lit(False)).unionByName(copies)
    shuffled = placed.repartition(parts, "_b").sortWithinPartitions("_b", "_copy", "_key", F.sha2("_text", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for b in batches:
            keys, raws, copy = b.column(0), byte_rows(b.column(1)), b.column(2).to_pylist()
            out: list[tuple] = []
            for k, raw, last in zip(keys.to_pylist(), raws, copy):
                t, f = raw.decode("utf-8", "replace"), fingerprint(raw)
                if held is not None:
                    k0, t0, f0 = held
                    e = edited(t0, t).encode()
                    fe = fingerprint(e)
                    out.append((k0, len(t0), hashlib.sha256(e).hexdigest(), f0.text(), fe.text(), f0.likeness(fe), f0.likeness(f)))
                held = None if last else (k, t, f)
            cols = list(zip(*out)) if out else [()] * 7
            types = [keys.type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return shuffled.select("_key", "_text", "_copy").mapInArrow(tidy(run), f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
