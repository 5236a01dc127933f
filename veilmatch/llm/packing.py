"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

1. Pieces.  Each text is encoded (see encoder()), closed with the end id and cut into pieces of
   ``CAPACITY`` tokens (the first one may be shorter); only longer documents are cut.
   Pieces are written with their ids, and with their rank among the pieces of the
   same length that the same task wrote.
2. Plan.  Pieces of one length are alike, so the plan needs the histogram of
   lengths only: at most ``CAPACITY`` rows, whatever the input.  A sequence is
   filled greedily with the longest piece that fits, again and again.  If a gap
   is left, its smallest piece is taken out and the two unpacked pieces that fit
   the larger gap most tightly (and leave less of it) go in.  As long as no length
   runs out, the next sequence comes out the same, so equal sequences are planned
   together.
3. Places.  Ranks become global by running sums over tasks, one per length, and a
   piece's length and rank name its sequence and offset.  A length that holds a
   third of all pieces is no group anywhere: no task gathers the pieces of a length.

Null texts are empty and hold the end id only.  Rows with null or repeated keys
are packed like any other.  An empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmatch.llm.bpe import BYTE_PATTERN, is_odd, load
from veilmatch.llm.common import byte_rows, int64, spans, tidy, write_table

CAPACITY = 2048
#: Ids that leave a task in one batch.
BATCH_IDS = 1_000_000
#: Pieces of one length are counted in so many bits; lengths take the rest of 63.
RANK_BITS = 42
#: Texts with longer stretches without a space, or of spaces only, are not for tiktoken.
LONGEST = 400


# -------------------------------------------------------------------- plan
def _two_that_fit(lengths: list[int], left: dict[int, int], gap: int, most: int) -> tuple[int, int] | None:
    """Two unpacked pieces, each shorter than ``most``, with the largest sum up to ``gap``; of equal sums the one with the longest piece."""
    best, low, high = None, 0, bisect_right(lengths, min(gap, most - 1)) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > gap:
            high -= 1
        elif low == high and left[a] < 2:
            break
        else:
            if best is None or a + b > best[0] + best[1]:
                best = (b, a)
                if a + b == gap:
                    break
            low += 1
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Contents {length: pieces} of sequences and how many sequences have them, by best-two-fit; every piece is placed once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    lengths = sorted(left)  # those still unpacked
    out: list[tuple[dict[int, int], int]] = []
    while lengths:
        inside: dict[int, int] = {}
        gap, smallest, touched = capacity, None, []
        while gap and (at := bisect_right(lengths, gap)):
            smallest = lengths[at - 1]
            many = min(left[smallest], gap // smallest)
            inside[smallest] = many
            touched.append(smallest)
            left[smallest] -= many
            gap -= many * smallest
            if not left[smallest]:
                del lengths[at - 1]
        taken = dict(inside)
        if gap and sum(inside.values()) > 1:
            pair = _two_that_fit(lengths, left, gap + smallest, smallest)
            if pair is not None and sum(pair) > smallest:
                inside[smallest] -= 1
                for n in pair:
                    inside[n] = inside.get(n, 0) + 1
        for n in touched:  # the pieces go back before whole runs are taken
            if not left[n]:
                insort(lengths, n)
            left[n] += taken[n]
        inside = {n: c for n, c in inside.items() if c}
        # the next sequence is the same while every length, also of the piece taken out, is there
        times = min(left[n] // max(inside.get(n, 0), taken.get(n, 0)) for n in inside.keys() | taken.keys())
        for n, c in inside.items():
            left[n] -= times * c
        lengths = [n for n in lengths if left[n]]
        out.append((inside, times))
    return out


def _ranges(contents: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Ranks of each length and where they go, as arrays ordered by (length, first rank): sequence = base + rank % times, offset + length * (rank // times)."""
    rows, used, base = [], {}, 0
    for inside, times in contents:
        offset = 0
        for n in sorted(inside, reverse=True):
            rows.append((n, used.get(n, 0), times, base, offset))
            used[n] = used.get(n, 0) + times * inside[n]
            offset += n * inside[n]
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "base", "offset"), table.T))


def _place(ranges: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces."""
    at = np.searchsorted((ranges["length"] << RANK_BITS) + ranges["rank"], (length << RANK_BITS) + rank, "right") - 1
    nth = rank - ranges["rank"][at]
    times = ranges["times"][at]
    return ranges["base"][at] + nth % times, ranges["offset"][at] + length * (nth // times)


# ----------------------------------------------------------------- encoding
@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Ids (little-endian uint32) of a text by the vocabulary at ``path``, as the tokenizers library gives them.

    Byte-level vocabularies whose merges are numbered in order are given to tiktoken as
    ranks, which is several times faster.  Texts with a stretch of over ``LONGEST``
    characters, or with characters for which pattern engines may differ, go the way of bpe.py.
    """
    bpe = load(path)
    made = [k & ((1 << 20) - 1) for k in bpe.merges.values()]
    if bpe.words or made != sorted(made) or max(bpe.first) >= min(made, default=0):
        return bpe.encode
    import tiktoken

    ranks = {raw: i for i, raw, _ in bpe.tokens()}
    encode = tiktoken.Encoding("packing", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=bpe.special).encode_to_numpy
    gap = " " * LONGEST

    def ids(text: str) -> bytes:
        if is_odd(text) or gap in text or max(map(len, text.split(" "))) > LONGEST:
            return bpe.encode(text)
        return encode(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    return ids


# --------------------------------------------------------------- operators
def cut_pieces(df: DataFrame, vocabulary: str, *, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Table (key, piece, start, length, ids BINARY of little-endian uint32, task, nth): encoded documents, cut; row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            keys, raws = b.column(0), byte_rows(b.column(1))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in raws], dtype=np.int64)])
            for i, j in spans(sizes, BATCH_IDS):
                coded = [encode(x.decode("utf-8", "replace")) + end for x in raws[i:j]]
                n = np.array([len(x) // 4 for x in coded], np.int64)
                many = -(-n // capacity)  # an end id is always there, so this is 1 at least
                of = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                first = n - (many - 1) * capacity
                start = np.where(piece > 0, first[of] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[of])
                nth = np.empty(len(of), np.int64)
                order = np.argsort(length, kind="stable")
                lengths, at, counts = np.unique(length[order], return_index=True, return_counts=True)
                nth[order] = np.arange(len(of)) - np.repeat(at, counts) + np.repeat(seen[lengths], counts)
                seen[lengths] += counts
                flat = pa.py_buffer(b"".join(coded))
                for a in range(0, len(of), 10_000):
                    z = min(a + 10_000, len(of))
                    offsets = np.concatenate([[0], np.cumsum(length)])[a : z + 1] * 4
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(offsets), flat]).cast(pa.binary()) if offsets[-1] < 2**31 else pa.array([flat[x:y].to_pybytes() for x, y in zip(offsets, offsets[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(i + of[a:z])), int64(piece[a:z]), int64(start[a:z]), int64(length[a:z]), ids, int64(np.full(z - a, task)), int64(nth[a:z])], [key, "piece", "start", "length", "ids", "task", "nth"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, piece bigint, start bigint, length bigint, ids binary, task bigint, nth bigint")


def pack(df: DataFrame, vocabulary: str, *, end_id: int = 0, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset) of every piece of every document; the lengths of a sequence add up to ``capacity`` at most."""
    pieces = write_table(cut_pieces(df, vocabulary, end_id=end_id, capacity=capacity, text=text, key=key), "pieces")
    counts = write_table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ranges = _ranges(plan(histogram, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = _place(ranges, length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(bases, ["task", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return placed.select(F.col(key), "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids BINARY, starts ARRAY<BIGINT>): whole sequences of what pack() returned; a group is one sequence."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), pieces.alias("pieces"))
    joined = F.unhex(F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), ""))
    return rows.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("pieces.offset").alias("starts"))
