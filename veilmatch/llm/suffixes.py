"""Repeated byte strings by suffix arrays, exact over the whole table.

A byte is removed where a string of ``LENGTH`` bytes covers it that also starts
at another place of any text.  Texts are judged as UTF-8 bytes and matches stay
inside texts.

1. Fragments.  The smallest hash of ``GRAM`` bytes inside a window of ``LENGTH``
   bytes depends on the window's bytes alone, so equal windows meet under equal
   hashes.  A maximal run of window starts with one smallest hash is a fragment;
   fragments are counted by (hash, digest of their bytes).  What stands alone
   under its hash is not repeated; what is there twice with the same bytes is
   repeated as a whole.  Neither needs its text again, so copies, however many,
   collapse before any text moves.
2. Shards.  The distinct fragments that share a hash with other ones are cut
   from their texts (one example each), dealt by hash, and sorted into suffix
   arrays of at most ``SHARD`` bytes: Larsson-Sadakane doubling, then Kasai's
   common prefixes, here for many lanes of starts at once.  A hash with more
   bytes than one shard gets several; their windows are merged by binary search.
   A hash with more than ``SPLIT`` bytes is dealt over several tasks; windows that
   two of these tasks have are found by a join of window hashes.
3. Removal.  Repeated starts go back to all places of a fragment, become spans,
   and the spans are cut from the texts.

Repeats can be counted in words as well: each word becomes one symbol, the hash of
its bytes, and the same steps find repeated strings of that many symbols, whatever
white space lies between the words.

Texts shorter than ``LENGTH`` bytes and null texts lose nothing.  Rows with equal
ids, or none, are documents of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmatch.llm.common import byte_rows, drop_table, flat_bytes, int64, spans, tidy, write_table

LENGTH = 400
GRAM = 32
#: Symbols of a shard, and of one smallest hash in one task.
SHARD, SPLIT = 500_000, 4_000_000
#: Bytes of a word's symbol.
CODE = 8
#: Bytes hashed at a time, and starts of one lane of Kasai's scan.
SPAN, LANE = 1 << 20, 32
_LISTS = ("hashes", "digests", "starts", "counts", "twice")
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of every ``size`` (a power of two) neighbouring bytes."""
    h, m = x.astype(np.uint64) + np.uint64(1), 1
    while m < size:
        h = h[:-m] * _power(m) + h[m:]
        m *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_hashes(x: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of every ``size`` neighbouring bytes."""
    one, done, out, at = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(x) - size + 1
    level = one
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            part = level[at : at + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, done, 1 << 64)) + part
            at += done
        if size >> (bit + 1):
            level = level[:-done] * np.uint64(pow(base, done, 1 << 64)) + level[done:]
            done *= 2
    return out


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, s = h, 1
    while 2 * s <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return m if s == width else np.minimum(m[: len(h) - width + 1], m[width - s :])


def fragments(x: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, start in row, number of window starts, smallest hash, whether it is there twice) of the fragments of rows laid end to end in ``x``."""
    n = len(x) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.astype(bool)
    gram = min(GRAM, 1 << max(0, (length // 4).bit_length() - 1))
    grams = _gram_hashes(x, gram)
    low = _sliding_min(grams, length - gram + 1)
    open_ = np.zeros(n + length + 1, np.int8)  # +1 where the starts of a row begin, -1 behind the last
    keep = np.diff(off) >= length
    rows = np.flatnonzero(keep)
    np.add.at(open_, off[:-1][keep] - off[0], 1)
    np.add.at(open_, off[1:][keep] - off[0] - length + 1, -1)
    valid = np.cumsum(open_[:n], dtype=np.int8) > 0
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(edge & valid)
    stop = np.flatnonzero(np.append((edge | ~valid)[1:], True) & valid) + 1
    row = rows[np.searchsorted(off[:-1][keep] - off[0], begin, "right") - 1]
    reach = (stop + (length - gram)).tolist()
    twice = np.array([np.count_nonzero(grams[p:q] == m) > 1 for p, q, m in zip(begin.tolist(), reach, low[begin])], bool)
    return row, begin - (off[row] - off[0]), stop - begin, low[begin], twice


def suffix_array(sym: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``sym`` (small whole numbers) in order; ``end`` is the place of the 0 that closes each place's fragment.

    Larsson and Sadakane: groups of equal prefixes of h symbols are refined by
    the groups of the suffixes h places on; h doubles; sorted groups rest.  The
    closing symbols count as different, in any order.  (Sorts need not be stable:
    what ties is one group.)
    """
    n = len(sym)
    end = end.astype(np.int64)
    at = np.arange(n)
    left = end - at
    bits = int(sym.max()).bit_length()
    h = max(1, 63 // bits)

    def then(key: np.ndarray, more: np.ndarray, first: int, wide: int) -> np.ndarray:
        """Keys of ``first`` symbols with those of ``wide`` symbols that follow them; behind the end there are zeros."""
        out = key << np.uint64(bits * wide)
        m = max(0, n - first)
        out[:m] |= np.where(left[:m] >= first, more[first:], np.uint64(0))
        return out

    key, size, piece, wide = None, 0, sym.astype(np.uint64), 1
    while True:
        if h & wide:
            key, size = (piece if key is None else then(key, piece, size, wide)), size + wide
        if 2 * wide > h:
            break
        piece, wide = then(piece, piece, wide, wide), 2 * wide
    sa = np.argsort(key)
    key = key[sa]
    new = np.append(True, key[1:] != key[:-1])
    del key, piece, left
    new[: np.count_nonzero(sym == 0)] = True  # they come first
    group = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    rests = new & np.append(new[1:], True)
    slots, group = np.flatnonzero(~rests), group[~rests]
    while len(slots):
        at = sa[slots]
        order = rank[np.minimum(at + h, end[at])] + group * n
        o = np.argsort(order)
        order, at = order[o], at[o]
        sa[slots] = at
        new = np.append(True, order[1:] != order[:-1])
        group = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = group
        rests = new & np.append(new[1:], True)
        slots, group = slots[~rests], group[~rests]
        h *= 2
    return sa


def common_prefixes(x: np.ndarray, sa: np.ndarray, end: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """For each start, the common prefix (at most ``most``, inside fragments) with the suffix before it in ``sa``.

    Kasai: from one start to the next the common prefix shrinks by one at most.
    Starts run from ``begin`` for ``count`` places, cut into lanes that advance together.
    """
    n = len(x)
    end = end.astype(np.int64)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    step = 8 if x.itemsize == 1 else 1  # symbols compared at a time
    words = np.ndarray((n,), "<u8", np.concatenate([x, np.zeros(8, x.dtype)]).tobytes(), strides=(x.itemsize,))
    pieces = -(-count // LANE)
    start = np.repeat(begin, pieces) + LANE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(LANE, np.repeat(begin + count, pieces) - start)
    o = np.argsort(-size, kind="stable")
    start, size = start[o], size[o]
    out = np.zeros(n, np.int32)
    length = np.zeros(len(start), np.int64)
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for i, m in enumerate(alive.tolist()):
        p = start[:m] + i
        q = phi[p]
        cap = np.minimum(np.minimum(end[p] - p, end[q] - q), most)
        cap[q < 0] = 0
        now = np.minimum(np.maximum(length[:m] - 1, 0), cap)
        act = np.flatnonzero(now < cap)
        while len(act):
            at = now[act]
            diff = words[p[act] + at] ^ words[q[act] + at]
            same = np.where(diff == 0, step, np.bitwise_count((diff & -diff) - np.uint64(1)).astype(np.int64) >> 3 if step > 1 else 0)
            now[act] = np.minimum(at + same, cap[act])
            act = act[(same == step) & (now[act] < cap[act])]
        length = now
        out[p] = now
    return out


def window_hashes(x: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _window_hashes(x, length, _BASE)[at], _window_hashes(x, length, 0xD6E8FEB86659FD93)[at]


class Shard:
    """Fragments of symbols of ``width`` bytes with their window starts; ``repeated`` marks starts whose window occurs twice in the shard."""

    def __init__(self, parts: list[bytes], counts: list[int], length: int, width: int = 1):
        sizes = np.array([len(p) // width for p in parts])
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        self.count, self.length = np.array(counts, np.int64), length
        self.x = np.frombuffer(bytes(width).join([*parts, b""]), np.uint8 if width == 1 else "<u8")
        if width == 1:  # few symbols are few bits
            sym = np.cumsum(np.bincount(self.x, minlength=256) > 0).astype(np.uint64)[self.x]
        else:
            sym = np.unique(self.x, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        stops = self.begin + sizes
        sym[stops] = 0
        end = np.repeat(stops.astype(np.int32), sizes + 1)
        sa = suffix_array(sym, end)
        lcp = common_prefixes(self.x, sa, end, self.begin, self.count, length)[sa] >= length
        hit = lcp.copy()
        hit[:-1] |= lcp[1:]
        self.repeated = np.zeros(len(self.x), bool)
        self.repeated[sa[hit]] = True

    def starts(self) -> np.ndarray:
        """All window starts of the shard."""
        return np.repeat(self.begin, self.count) + np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 hash bits of the windows that begin at ``at``."""
        return window_hashes(self.x, self.length, at)


def merge_shards(shards: list[Shard]) -> None:
    """Mark windows that occur in several shards: each shard's windows, by 128 hash bits, are searched in the merged run of those before it."""
    seen = np.zeros(0, [("a", np.uint64), ("b", np.uint64)])
    runs, hits = [], np.zeros(0, bool)
    for s in shards:
        at = s.starts()
        run = np.empty(len(at), seen.dtype)
        run["a"], run["b"] = s.windows(at)
        runs.append((s, at, run))
        own = np.unique(run)
        pos = _find(seen, own)
        hits[pos[pos >= 0]] = True
        fresh = own[pos < 0]
        where = np.searchsorted(seen["a"], fresh["a"], "right")
        seen, hits = np.insert(seen, where, fresh), np.insert(hits, where, False)
    for s, at, run in runs:
        pos = _find(seen, run)
        s.repeated[at[(pos >= 0) & hits[pos]]] = True


def _find(run: np.ndarray, what: np.ndarray) -> np.ndarray:
    """Places of ``what`` in the run ordered by its first hash, or -1."""
    lo = np.searchsorted(run["a"], what["a"])
    out = np.full(len(what), -1)
    todo = np.arange(len(what))
    while len(todo):
        at = lo[todo]
        todo, at = todo[at < len(run)], at[at < len(run)]
        same = run["a"][at] == what["a"][todo]
        todo, at = todo[same], at[same]
        found = run["b"][at] == what["b"][todo]
        out[todo[found]] = at[found]
        todo = todo[~found]
        lo[todo] += 1
    return out


# --------------------------------------------------------------- operator
def _key(col) -> F.Column:
    return F.unhex(F.md5(col.cast("binary")))


def word_codes(raw: bytes) -> bytes:
    """The symbols of the words of a text, end to end."""
    return b"".join(map(xxhash.xxh3_64_digest, raw.split()))


def repeated_spans(df: DataFrame, *, length: int = LENGTH, text: str = "text", code: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(tkey, copies, begins, ends): per distinct text (tkey: its md5) with repeats how many rows have it, and the spans to remove (unmerged).

    With ``code`` the symbols of CODE bytes that it makes of a text are judged, and spans are places among them.
    """
    width = 1 if code is None else CODE
    texts = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            data, off = flat_bytes(b.column(0))
            for lo, hi in spans(off, SPAN):
                o = off[lo : hi + 1]
                mv = data[o[0] : o[-1]]
                x = np.frombuffer(mv, np.uint8)
                rel = (o - o[0]).tolist()
                keys = [hashlib.md5(mv[p:q]).digest() for p, q in zip(rel, rel[1:])]
                if code is not None:
                    coded = [code(bytes(mv[p:q])) for p, q in zip(rel, rel[1:])]
                    mv = memoryview(b"".join(coded))
                    x, o = np.frombuffer(mv, "<u8"), np.concatenate(([0], np.cumsum([len(c) // CODE for c in coded])))
                first = np.zeros(hi - lo, bool)
                for i, k in enumerate(keys):
                    if k not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(k)
                        first[i] = True
                row, start, count, low, twice = fragments(x, o, length)
                keep = first[row]
                row, start, count, low, twice = row[keep], start[keep], count[keep], low[keep], twice[keep]
                at = (o[row] - o[0] + start).tolist()
                to = (o[row] - o[0] + start + count + length - 1).tolist()
                digest = np.array([xxhash.xxh3_64_intdigest(mv[width * p : width * q]) for p, q in zip(at, to)], np.uint64)
                bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))).astype(np.int32))
                empty = pa.array(~first | (np.bincount(row, minlength=hi - lo) == 0))

                def lists(values, kind):
                    return pa.ListArray.from_arrays(bounds, pa.array(values, kind), mask=empty)

                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), int64(np.diff(o)), lists(low.view(np.int64), pa.int64()), lists(digest.view(np.int64), pa.int64()), lists(start.astype(np.int32), pa.int32()), lists(count.astype(np.int32), pa.int32()), lists(twice, pa.bool_())],
                    ["tkey", "n", *_LISTS],
                )

    rows = texts.mapInArrow(tidy(cut), "tkey binary, n bigint, hashes array<bigint>, digests array<bigint>, starts array<int>, counts array<int>, twice array<boolean>")
    by_text = rows.groupBy("tkey").agg(F.count("*").alias("copies"), F.max("n").alias("n"), *(F.first(c, ignorenulls=True).alias(c) for c in _LISTS))
    table = write_table(by_text, "texts")

    def places(of: DataFrame) -> DataFrame:
        zipped = F.explode(F.arrays_zip(*_LISTS)).alias("z")
        return of.where("hashes is not null").select("tkey", "copies", zipped).select("tkey", "copies", F.col("z.hashes").alias("hash"), F.col("z.digests").alias("digest"), F.col("z.starts").alias("start"), F.col("z.counts").alias("windows"), F.col("z.twice").alias("twice"))

    kinds = write_table(places(table).groupBy("hash", "digest").agg(F.sum("copies").alias("times"), F.min(F.struct("tkey", "start", "windows", "twice")).alias("at")), "fragments")
    sized = kinds.groupBy("hash").agg(F.count("*").alias("k"), F.max(F.col("at.twice") & (F.col("times") == 1)).alias("inside"), F.sum(F.col("at.windows") + F.lit(length - 1)).alias("all"))
    shared = write_table(sized.where("k > 1 or inside").select("hash", F.ceil(F.col("all") / SPLIT).alias("tasks")), "shared")
    wanted = kinds.join(shared, "hash").select(
        F.col("at.tkey").alias("tkey"),
        "tasks",
        F.struct("hash", "digest", "times", F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), F.pmod("digest", "tasks").alias("task")).alias("f"),
    )
    long_enough = texts.where(F.octet_length("text") >= length) if code is None else texts
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows of one text come to one task
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                out: list[tuple] = []
                for raw, k, fs in zip(byte_rows(part.column(1)), part.column(0).to_pylist(), part.column(2).to_pylist()):
                    if k not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(k)
                        raw = raw if code is None else code(raw)
                        out += [(f["hash"], f["digest"], f["times"], f["windows"], raw[width * f["start"] : width * (f["start"] + f["windows"] + length - 1)], f["task"]) for f in fs]
                cols = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], ["hash", "digest", "times", "windows", "bytes", "task"])

    def cut_fragments(of: DataFrame) -> DataFrame:
        """The bytes of one example of each fragment of ``of``."""
        cuts = long_enough.select("text", _key(F.col("text")).alias("tkey")).join(of.groupBy("tkey").agg(F.collect_list("f").alias("f")).hint("shuffle_hash"), "tkey")
        return cuts.select("tkey", "text", "f").mapInArrow(tidy(cut_out), "hash bigint, digest bigint, times bigint, windows int, bytes binary, task bigint")

    dealt = cut_fragments(wanted).repartition("hash", "task").sortWithinPartitions("hash", "task", "digest")

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "digest", "begins", "ends"]

        def solve(keys: list[list[tuple]]) -> pa.RecordBatch:
            """``keys``: the fragments of whole hashes, or of one hash that is larger than a shard (as far as this task has it)."""
            flat = [f for k in keys for f in k]
            cuts_, size, groups_ = [0], 0, []
            for i, f in enumerate(flat):
                if size and size + len(f[4]) // width > SHARD * 1.5:
                    cuts_.append(i)
                    size = 0
                size += len(f[4]) // width
            for p, q in zip(cuts_, [*cuts_[1:], len(flat)]):
                groups_.append((flat[p:q], Shard([f[4] for f in flat[p:q]], [f[3] for f in flat[p:q]], length, width)))
            if len(groups_) > 1:
                merge_shards([s for _, s in groups_])
            out = []
            for fs, s in groups_:
                for f, at in zip(fs, s.begin.tolist()):
                    if f[2] > 1:
                        continue
                    mark = s.repeated[at : at + f[3]]
                    if mark.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
                        out.append((f[0], f[1], edge[::2].tolist(), (edge[1::2] + length - 1).tolist()))
            cols = list(zip(*out)) if out else [()] * 4
            kinds_ = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], names)

        ready: list[list[tuple]] = []
        now: list[tuple] = []
        size = 0
        for b in batches:
            for i in range(0, len(b), 1000):
                for f in zip(*(c.to_pylist() for c in b.slice(i, 1000).columns)):
                    if now and (f[0], f[5]) != (now[-1][0], now[-1][5]):
                        ready.append(now)
                        size += sum(len(x[4]) for x in now) // width
                        now = []
                        if size >= SHARD:
                            yield solve(ready)
                            ready, size = [], 0
                    if not now or f[1] != now[-1][1]:
                        now.append(f)
        if now:
            ready.append(now)
        if ready:
            yield solve(ready)

    found = dealt.mapInArrow(tidy(sort_shards), "hash bigint, digest bigint, begins array<int>, ends array<int>")
    whole = kinds.where("times > 1").select("hash", "digest", F.array(F.lit(0)).alias("begins"), F.array(F.lit(None).cast("int")).alias("ends"))
    marks = found.unionByName(whole)
    if shared.where("tasks > 1").limit(1).count():
        marks = marks.unionByName(_across_tasks(cut_fragments(wanted.where("tasks > 1")), length, width))
    marks = write_table(marks, "repeats")
    hit = places(table.where("copies = 1")).join(marks, ["hash", "digest"]).select(
        "tkey",
        F.explode(F.arrays_zip("begins", "ends")).alias("z"),
        "start",
        (F.col("windows") + F.lit(length - 1)).alias("all"),
    )
    per_text = hit.groupBy("tkey").agg(F.collect_list(F.struct((F.col("start") + F.col("z.begins")).alias("b"), (F.col("start") + F.coalesce("z.ends", "all")).alias("e"))).alias("s"))
    some = per_text.select("tkey", F.lit(1).cast("bigint").alias("copies"), "s")
    many = table.where(f"copies > 1 and n >= {length}").select("tkey", "copies", F.array(F.struct(F.lit(0).alias("b"), F.col("n").cast("int").alias("e"))).alias("s"))
    return some.unionByName(many).select("tkey", "copies", F.col("s.b").alias("begins"), F.col("s.e").alias("ends"))


def _across_tasks(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """(hash, digest, begins, ends): windows of ``pieces`` that pieces of another task have too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, d, n, raw, task in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                x = np.frombuffer(raw, np.uint8 if width == 1 else "<u8")
                a, c = window_hashes(x, length, np.arange(n))
                yield pa.RecordBatch.from_arrays([int64(a.view(np.int64)), int64(c.view(np.int64)), int64(np.full(n, h)), int64(np.full(n, d)), int64(np.full(n, task)), pa.array(np.arange(n, dtype=np.int32))], ["a", "b", "hash", "digest", "task", "at"])

    windows = pieces.mapInArrow(tidy(each), "a bigint, b bigint, hash bigint, digest bigint, task bigint, at int")
    table = write_table(windows, "windows")
    both = table.groupBy("a", "b").agg(F.min("task").alias("low"), F.max("task").alias("high")).where("low < high").select("a", "b")
    hit = table.join(both, ["a", "b"]).groupBy("hash", "digest").agg(F.sort_array(F.collect_set("at")).alias("begins"))
    return hit.select("hash", "digest", "begins", F.transform("begins", lambda x: x + F.lit(length)).alias("ends"))


def merge_spans(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans united where they touch or overlap, in order."""
    o = np.argsort(begins, kind="stable")
    b, e = begins[o], np.maximum.accumulate(ends[o])
    new = np.flatnonzero(np.append(True, b[1:] > e[:-1])) if len(b) else np.zeros(0, int)
    return list(zip(b[new].tolist(), e[np.append(new[1:] - 1, len(b) - 1)].tolist())) if len(b) else []


def word_spans(raw: bytes, begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Spans of a text for spans of its words: from the start of the first to the end of the last."""
    at, out = [m.span() for m in _WORD.finditer(raw)], []
    for p, q in merge_spans(np.array(begins), np.array(ends)):
        out.append((at[p][0], at[q - 1][1]))
    return out


def remove_repeats(df: DataFrame, *, length: int = LENGTH, text: str = "text", keep: tuple[str, ...] = ("doc_id",), whole_characters: bool = False, words: int | None = None, cut_words: bool = True) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, n_in_runs, kept BINARY of every row.

    With ``words``, repeats of that many words go too, however few bytes they have;
    without ``cut_words`` they stay and are only counted, in ``n_in_runs`` (their bytes).
    With ``whole_characters`` a span is shortened where it begins or ends inside a
    UTF-8 character, so what is kept is text.
    """
    marks = repeated_spans(df, length=length, text=text)
    rows = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("tkey", _key(F.col("_text")))
    if words is None:
        marks = marks.select("tkey", "begins", "ends", F.lit(None).cast("array<int>").alias("word_begins"), F.lit(None).cast("array<int>").alias("word_ends"))
    else:
        coded = repeated_spans(df, length=words, text=text, code=word_codes).select("tkey", F.col("begins").alias("word_begins"), F.col("ends").alias("word_ends"))
        marks = marks.select("tkey", "begins", "ends").join(coded, "tkey", "full")
    joined = rows.join(marks, "tkey", "left").select("_text", "begins", "ends", "word_begins", "word_ends", *keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "n_bytes", "n_removed", "n_spans", "n_in_runs", "kept"]
        for batch in batches:
            for i in range(0, len(batch), 1000):
                b = batch.slice(i, 1000)
                raws = byte_rows(b.column(0))
                removed, spans_, runs, kept = [0] * len(b), [0] * len(b), [0] * len(b), list(raws)
                marked = pc.or_(b.column(1).is_valid(), b.column(3).is_valid())
                for j in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
                    raw, out, at, gone = raws[j], [], 0, 0
                    found = list(zip(b.column(1)[j].as_py() or [], b.column(2)[j].as_py() or []))
                    if b.column(3)[j].is_valid:
                        in_runs = word_spans(raw, b.column(3)[j].as_py(), b.column(4)[j].as_py())
                        runs[j] = sum(q - p for p, q in in_runs)
                        found += in_runs if cut_words else []
                    merged = merge_spans(np.array([p for p, _ in found], np.int64), np.array([q for _, q in found], np.int64))
                    for p, q in merged:
                        if whole_characters:
                            while p < q and p < len(raw) and raw[p] & 0xC0 == 0x80:
                                p += 1
                            while q > p and q < len(raw) and raw[q] & 0xC0 == 0x80:
                                q -= 1
                        out.append(raw[at:p])
                        gone += q - p
                        at = q
                    removed[j], spans_[j], kept[j] = gone, len(merged), b"".join([*out, raw[at:]])
                yield pa.RecordBatch.from_arrays([*b.columns[5:], int64([len(x) for x in raws]), int64(removed), int64(spans_), int64(runs), pa.array(kept, pa.binary())], names)

    schema = T.StructType([df.schema[c] for c in keep])
    for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("n_in_runs", T.LongType()), ("kept", T.BinaryType())):
        schema.add(name, kind)
    return joined.mapInArrow(tidy(cut), schema)
