"""Scores of a log-bilinear language model trained by noise-contrastive estimation.

Words fall into ``CLASSES`` classes: the end of a text, the most frequent words
(one class each), and buckets of all other words by their last bytes.  The model
predicts a class from the two words before, each of which is one of ``CONTEXTS``
contexts: the end, fewer words of their own, and the same buckets for the rest.  The
context vector is ``c1 * r[u] + c2 * r[v]`` (``u`` the last word, ``v`` the one before), the
score of a class ``context . (q[class] + g[group]) + b[class]``, where words that would
share a bucket are a group, so a rarer word starts from what its group has learnt.
It is trained with noise-contrastive estimation in numpy; since the score is a sum
over the two context words, one product of two exponentiated matrices gives the normaliser of every context
exactly, and a token's log-probability is four table entries.  Inside a bucket a
word has its add-one share of the bucket's training tokens, so all tokens
together, one place for unseen words in each bucket included, have probability 1.

What is gathered: counts of all words of all training texts (pre-aggregated by
task, then summed by word).  Words with the ``LOCAL_WORDS`` largest counts are sent
to all tasks; the counts of the others reach their texts by a join on the word.
Every training text is trained on once, in a round picked by its hash (more rounds the
more tasks there are, see round_ends()): in a round each task trains on the round's texts of its partition, from the model of the
round before, and each parameter takes the average step of the tasks that moved it,
weighted by their squared gradients, so scores depend a little on how rows are
dealt to tasks.  Before that, the same texts, which the model of the round before has
not seen, are scored under several influences of the context (those of the first round,
in which the model is random, by the model after it); the influence under which all
training texts together are likeliest scales the model at the end.

Null texts are empty; an empty text is its end token.  Rows may repeat, ids may be null.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmatch.llm.common import ASCII_LOWER, drop_table, flat_bytes, int64, spans, tidy, write_table

CLASSES = 4096
CONTEXTS = 1024
BUCKETS = 320
WIDTH = 16
NOISE = 48
BATCH = 1024
RATE = 0.1
LOCAL_WORDS = 200_000
#: Influences of the context that are tried on texts before they are trained on.
SCALES = (0.0, 0.5, 0.75, 1.0, 1.25)
#: Parts into which training texts fall by their hash; those of the first round.
PARTS, FIRST = 64, 4
#: Bytes of words that a task gathers before it counts them and hands them on; sums of steps that one task adds up.
FLUSH, FAN_IN = 16 << 20, 8
#: Bytes of texts that are split at once (a longer text stands alone).
SPAN = 2 << 20
END = b""


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


CRC = crc_table()


def buckets(words: pa.Array) -> np.ndarray:
    """bucket() of every word of a binary array."""
    data, off = flat_bytes(words)
    raw, ends, size = np.frombuffer(data, np.uint8), off[1:], np.diff(off)
    crc = np.full(len(ends), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        has = np.flatnonzero(size >= k)
        old = crc[has]
        crc[has] = CRC[(old ^ raw[ends[has] - k]) & 255] ^ (old >> 8)
    return (~crc % BUCKETS).astype(np.int32)


def split(col: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(first row, row after the last, all their words with A-Z lower-cased, number of words of each row) of every span of a string or binary column; words are what bytes.split() gives."""
    data, off = flat_bytes(col)
    for a, e in spans(off, SPAN):
        raw = np.frombuffer(bytes(data[off[a] : off[e]]).translate(ASCII_LOWER), np.uint8)
        inside = (raw != 32) & (raw - np.uint8(9) > 4)
        begin = off[a : e + 1] - off[a]
        cut = begin[(begin > 0) & (begin < len(raw))]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[cut], last[cut - 1] = inside[cut], inside[cut - 1]  # words end with their text
        starts = np.flatnonzero(first)
        ends = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - starts)))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw[inside])])
        yield a, e, words, np.diff(np.searchsorted(starts, begin))


def closed(cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes of texts of ``n`` words, end to end, each closed by class 0, which of them are words)."""
    is_word = np.ones(len(cls) + len(n), bool)
    is_word[np.cumsum(n + 1) - 1] = False
    ids = np.zeros(len(is_word), np.int32)
    ids[is_word] = cls
    return ids, is_word


def contexts(context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (last word, the one before) of each class of a stream: texts end to end, each closed by class 0 and begun by none: context 0, 0."""
    before = np.concatenate(([0, 0], ids[:-1])).astype(ids.dtype)
    return context[before[1:]], context[np.where(before[1:] == 0, 0, before[:-1])]


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))


def run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows (float32, an even number of columns), two columns in one addition."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


class LogBilinear:
    """Parameters, training and tables of the class model."""

    def __init__(self, share: np.ndarray, context: np.ndarray | None = None, kin: np.ndarray | None = None, seed: int = 7):
        """``share``: probability of each class among training tokens; ``context``: the context that each class makes; ``kin``: the group whose vector is added to the class's own (each class's own one if not given)."""
        rng = np.random.default_rng(seed)
        self.share = np.maximum(share, 1e-9) / np.maximum(share, 1e-9).sum()
        self.context = np.arange(len(share)) if context is None else context
        self.r = rng.normal(0, 0.1, (int(self.context.max()) + 1, WIDTH)).astype(np.float32)
        self.kin = np.arange(len(share)) if kin is None else kin
        self.q = rng.normal(0, 0.1 if kin is None else 0.01, (len(share), WIDTH)).astype(np.float32)
        self.g = rng.normal(0, 0.1, (int(self.kin.max()) + 1, WIDTH)).astype(np.float32)
        self.b = np.log(self.share).astype(np.float32)
        self.c = np.ones((2, WIDTH), np.float32)
        self.rng = np.random.default_rng(seed + 1)
        self._squares = [np.ones_like(x) for x in self.parameters]
        self._key = np.uint16 if max(len(share), len(self.r)) <= 1 << 16 else np.int64  # 16 bits are sorted by radix
        # the places of classes in the order of their groups: one sort for sums by class and by group
        self._rank = np.empty(len(share), self._key)
        self._rank[np.argsort(self.kin, kind="stable")] = np.arange(len(share))

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.c, self.g]

    @property
    def outputs(self) -> np.ndarray:
        """The vector of each class: its group's and its own."""
        return self.q + self.g[self.kin]

    def flat(self) -> np.ndarray:
        """Parameters and the sums of squares by which steps shrink."""
        return np.concatenate([x.ravel() for x in (*self.parameters, *self._squares)])

    def load(self, flat: np.ndarray) -> "LogBilinear":
        at = 0
        for x in (*self.parameters, *self._squares):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def train(self, ids: np.ndarray) -> None:
        """One pass over a stream of classes (texts end to end, each closed by class 0 and begun by none: context 0, 0)."""
        if len(ids) < 3:
            return
        last, prior = (x.astype(np.intp) for x in contexts(self.context, ids))
        ids = ids.astype(np.intp)
        noise_pool = self.rng.choice(len(self.share), size=(-(-len(ids) // BATCH), NOISE), p=self.share)
        base = np.log(NOISE * self.share).astype(np.float32)
        for i, k in enumerate(range(0, len(ids), BATCH)):
            self._step(last[k : k + BATCH], prior[k : k + BATCH], ids[k : k + BATCH], noise_pool[i], base)

    def _step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, noise: np.ndarray, base: np.ndarray) -> None:
        both = np.concatenate([w, noise])
        out = self.q.take(both, 0)
        out += self.g.take(self.kin.take(both), 0)
        ru, rv, qw, qn = self.r.take(u, 0), self.r.take(v, 0), out[: len(w)], out[len(w) :]
        context = ru * self.c[0] + rv * self.c[1]
        good = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", context, qw) + self.b.take(w) - base.take(w), -30, 30)))  # 1 - P(data)
        bad = context @ -qn.T  # becomes P(data) of noise
        bad += base[noise] - self.b[noise]
        np.clip(bad, -30, 30, out=bad)
        np.exp(bad, out=bad)
        bad += 1
        np.divide(1, bad, out=bad)
        g_context = good[:, None] * qw - bad @ qn
        g_out = np.concatenate([good[:, None] * context, -(bad.T @ context)])
        g_bias = np.concatenate([good, -(np.ones(len(w), np.float32) @ bad)])
        # sums by class, and of these by group: classes are in the order of their groups
        o = np.argsort(self._rank.take(both), kind="stable")
        at = both.take(o)
        first = runs(at)
        at, n = at.take(first), np.diff(np.append(first, len(o)))
        by_class, kin = run_sums(g_out.take(o, 0), first), self.kin.take(at)
        of_kin = runs(kin)
        self._add(4, kin.take(of_kin), run_sums(by_class, of_kin), np.add.reduceat(n, of_kin))
        self._add(1, at, by_class, n)
        self._add(2, at, np.add.reduceat(g_bias.take(o), first), n)
        seen = np.concatenate([u, v])
        o = np.argsort(seen.astype(self._key), kind="stable")
        seen = seen.take(o)
        first = runs(seen)
        grads = np.concatenate([g_context * self.c[0], g_context * self.c[1]])
        self._add(0, seen.take(first), run_sums(grads.take(o, 0), first), np.diff(np.append(first, len(o))))
        g = np.stack([(g_context * ru).sum(0), (g_context * rv).sum(0)]) / len(w)
        self._squares[3] += g * g
        self.c += 0.1 * RATE * g / np.sqrt(self._squares[3])

    def _add(self, which: int, at: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        """Take an adaptive step in rows ``at``, of which each once, by sums of ``n`` gradients."""
        root = np.sqrt(n.astype(np.float32))
        g = g / (root[:, None] if g.ndim > 1 else root)
        squares, x = self._squares[which], self.parameters[which]
        s = squares.take(at, 0)
        s += g * g
        squares[at] = s
        g *= np.float32(RATE)
        g /= np.sqrt(s, out=s)
        g += x.take(at, 0)
        x[at] = g

    def scaled(self, scale: float) -> "LogBilinear":
        """A model with so many times the context's influence; 0 leaves the classes' shares."""
        other = LogBilinear(self.share, self.context, self.kin).load(self.flat())
        other.q *= np.float32(scale)
        other.g *= np.float32(scale)
        if not scale:
            other.b = np.log(self.share).astype(np.float32)
        return other

    def normalisers(self) -> np.ndarray:
        """Those of each of SCALES but zero, as shares sum to 1: of a pair of contexts side by side."""
        return np.stack([self.scaled(s).normaliser() for s in SCALES if s], axis=-1)

    def gains(self, ids: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Log-likelihoods of a stream of classes under each of SCALES; ``norms``: normalisers()."""
        scales = np.array(SCALES)
        own, norm = np.zeros(len(SCALES)), np.zeros(norms.shape[-1])
        factors, shares = self.factors(), np.log(self.share)
        us, vs = contexts(self.context, ids)
        across, norms = norms.shape[1], norms.reshape(-1, norms.shape[-1])
        for k in range(0, len(ids), 16 * BATCH):
            u, v, w = (x[k : k + 16 * BATCH].astype(np.intp) for x in (us, vs, ids))
            dot = affinity(factors, u, v, w).sum(dtype=np.float64)
            own += np.where(scales != 0, scales * dot + self.b.take(w).sum(dtype=np.float64), shares.take(w).sum())
            norm += norms.take(u * across + v, 0).sum(0, dtype=np.float64)
        own[scales != 0] -= norm
        return own

    def rescale(self, gains: np.ndarray) -> None:
        """Scale the context's influence to that of SCALES with the largest of ``gains``."""
        best = self.scaled(SCALES[int(np.argmax(gains))])
        self.q, self.g, self.b = best.q, best.g, best.b

    def sharpen(self, ids: np.ndarray) -> None:
        """Scale the context's influence to what suits a stream of classes best."""
        if len(ids):
            self.rescale(self.gains(ids, self.normalisers()))

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What by_context() needs: vectors of contexts as last word and as the one before, of classes, and biases."""
        return self.r * self.c[0], self.r * self.c[1], self.outputs, self.b

    def normaliser(self) -> np.ndarray:
        """Natural logs of the sums over all classes, for each last context and each one before it; a block of classes at a time."""
        last, prior, out, bias = self.factors()
        a = np.max([by_context(last, prior, out[i : i + 512], bias[i : i + 512])[0].max(1) for i in range(0, len(out), 512)], axis=0)
        b = np.max([(prior @ out[i : i + 512].T).max(1) for i in range(0, len(out), 512)], axis=0)
        total = np.zeros((len(last), len(prior)))
        for i in range(0, len(out), 512):
            x, y = by_context(last, prior, out[i : i + 512], bias[i : i + 512])
            # 64 bits: the largest terms of the two factors may belong to different words, hundreds of nats below their maxima
            total += np.exp((x - a[:, None]).astype(np.float64)) @ np.exp((y - b[:, None]).astype(np.float64)).T
        return (np.log(total, out=total) + a[:, None] + b).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(by last, by prior, log normaliser): log P(w | u, v) = last[u, w] + prior[v, w] - norm[u, v] for contexts u, v; natural logs."""
        return *by_context(*self.factors()), self.normaliser()


def by_context(last: np.ndarray, prior: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the score of each class: of each last context, with the bias, and of each one before it."""
    return last @ out.T + bias, prior @ out.T


def affinity(factors: tuple[np.ndarray, ...], u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of classes ``w`` after contexts ``u``, ``v`` without biases and normalisers; of rows that caches hold, not of the larger tables."""
    last, prior, out, _ = factors
    context = last.take(u, 0)
    context += prior.take(v, 0)
    return np.einsum("ij,ij->i", context, out.take(w, 0))


@dataclass
class Vocabulary:
    """Words known to every task and the totals of all: picklable, bounded by LOCAL_WORDS."""

    words: list[bytes]
    counts: np.ndarray
    own: int  # the first ``own`` words have classes of their own (from 1 on)
    tokens: int  # N
    distinct: int  # V
    bucket_norm: np.ndarray  # tokens + distinct words + 1 of each bucket
    end_count: int

    def __post_init__(self):
        self._place = None

    def __getstate__(self):
        return {**self.__dict__, "_place": None}

    @property
    def context(self) -> np.ndarray:
        """The context that each class makes: the most frequent words their own, other words that of their bucket."""
        near = min(self.own, CONTEXTS - BUCKETS - 1)
        far = [near + 1 + bucket(w) for w in self.words[near : self.own]]
        return np.concatenate([np.arange(near + 1), np.array(far, np.int64), near + 1 + np.arange(BUCKETS)]).astype(np.int32)

    @property
    def kin(self) -> np.ndarray:
        """The group of each class: the bucket that the word would be in; the end alone."""
        return np.concatenate([[BUCKETS], [bucket(w) for w in self.words[: self.own]], np.arange(BUCKETS)]).astype(np.int32)

    @property
    def place(self) -> pa.Array:
        """The words as an array; also makes tables by place, whose last entry is that of words without one."""
        if self._place is None:
            first = 1 + self.own
            words = pa.array(self.words, pa.large_binary())
            near = np.arange(len(words)) < self.own
            cls = np.where(near, 1 + np.arange(len(words)), first + buckets(words))
            log_count = np.log10(self.counts + 1.0)
            log_inside = np.where(near, 0.0, log_count - np.log10(self.bucket_norm)[np.maximum(0, cls - first)])
            self.cls = np.append(cls, 0).astype(np.int32)
            self.log_count, self.log_inside = np.append(log_count, 0.0), np.append(log_inside, 0.0)
            self._place = words
        return self._place

    def classes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``words`` or -1, classes) of all words of an array."""
        at = pc.fill_null(pc.index_in(words, value_set=self.place), -1).to_numpy()
        cls = self.cls[at]
        miss = np.flatnonzero(at < 0)
        cls[miss] = 1 + self.own + buckets(words.take(pa.array(miss)))
        return at, cls

    def streams(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Classes of the texts of a column, span by span, end to end, each closed by class 0."""
        for _, _, words, n in split(col):
            yield closed(self.classes(words)[1], n)[0]

    def stream(self, raws: list[bytes]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *self.streams(pa.array(raws, pa.large_binary()))])


def count_words(df: DataFrame, *, text: str = "text") -> DataFrame:
    """(word BINARY, bucket, c) over all rows of ``df``; the end token is the empty word."""

    def counted(held: list[pa.Array], texts: int) -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.large_binary()).value_counts()
        words = pa.concat_arrays([found.field("values").cast(pa.binary()), pa.array([END], pa.binary())])
        return pa.RecordBatch.from_arrays([words, pa.array(buckets(words)), pa.concat_arrays([found.field("counts"), int64([texts])])], ["word", "bucket", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for b in batches:
            for a, e, words, _ in split(b.column(0)):
                held.append(words)
                size, texts = size + words.nbytes, texts + e - a
                if size > FLUSH:
                    yield counted(held, texts)
                    held, size, texts = [], 0, 0
        if texts:
            yield counted(held, texts)

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "word binary, bucket int, c bigint")
    return rows.groupBy("word", "bucket").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What tasks need to know of ``counts``; at most about LOCAL_WORDS words reach the driver: by counts, of about equal counts by their hash."""
    plain = counts.where(F.octet_length("word") > 0)
    steps = plain.groupBy(F.floor(F.log2("c") * 16).alias("s")).agg(F.count("*").alias("n"), F.max("c").alias("most")).collect()  # at most 16 x 63 rows
    step, total, chosen = F.floor(F.log2("c") * 16), 0, F.lit(False)
    for r in sorted(steps, key=lambda r: -r["s"]):
        room = LOCAL_WORDS - total
        total += r["n"]
        if r["n"] > room:  # of a step that is too large, the words of the smallest hashes
            share = int(0.95 * room / r["n"] * 2**31)
            chosen = (step > r["s"]) | ((step == r["s"]) & (F.shiftrightunsigned(F.xxhash64("word"), 33) < F.lit(share)))
            break
        chosen = step >= r["s"]
    top = sorted((-r["c"], bytes(r["word"])) for r in plain.where(chosen).select("word", "c").collect())
    own = min(len(top), CLASSES - BUCKETS - 1)
    sums = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.octet_length("word") == 0, F.col("c")))).first()
    norm = np.ones(BUCKETS)
    for r in plain.groupBy("bucket").agg((F.sum("c") + F.count("*")).alias("n")).collect():
        norm[r["bucket"]] += r["n"]
    for c, w in top[:own]:
        norm[bucket(w)] -= 1 - c
    return Vocabulary([w for _, w in top], np.array([-c for c, _ in top], np.int64), own, int(sums[0] or 0), int(sums[1] or 0), norm, int(sums[2] or 0))


def class_shares(voc: Vocabulary) -> np.ndarray:
    """Add-one share of each class among training tokens."""
    return np.concatenate([[voc.end_count], voc.counts[: voc.own], voc.bucket_norm]) + 1.0


def fit(df: DataFrame, voc: Vocabulary, *, text: str = "text") -> LogBilinear:
    """Train on every row of ``df``, and scale the context's influence by every row."""
    spark = df.sparkSession
    context, kin = voc.context, voc.kin
    model = LogBilinear(class_shares(voc) / class_shares(voc).sum(), context, kin)
    kind = "sums binary, gains array<double>"
    names = ["sums", "gains"]

    def packed(sums: np.ndarray, gains: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sums.astype("<f4").tobytes()], pa.binary()), pa.array([gains.tolist()], pa.list_(pa.float64()))], names)

    def united(rows: Iterable[tuple]) -> tuple[np.ndarray | None, np.ndarray]:
        total, gains = None, np.zeros(len(SCALES))
        for m, g in rows:
            x = np.frombuffer(m, "<f4").astype(np.float64)
            total, gains = x if total is None else total + x, gains + np.array(g)
        return total, gains

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gains = united(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        if total is not None:
            yield packed(total, gains)

    body = F.col(text).cast("string")
    part = F.pmod(F.xxhash64(F.coalesce(body, F.lit(""))), F.lit(PARTS))  # the same for equal texts
    gains = np.zeros(len(SCALES))
    i, ends = 0, [FIRST, PARTS]
    while i < len(ends):
        sent = spark.sparkContext.broadcast((voc, model.flat(), model.share, context, kin, model.normalisers() if i else None, i))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voc, start, share, context, kin, norms, i = sent.value
            before, own = LogBilinear(share, context, kin).load(start), LogBilinear(share, context, kin, seed=7 + i).load(start)
            n, gains = 0, np.zeros(len(SCALES))
            for b in batches:
                for k in range(0, len(b), 1000):  # filters copy
                    rows = b.slice(k, 1000)
                    for fresh in (False, True):
                        for ids in voc.streams(rows.filter(pc.equal(rows.column(1), fresh)).column(0)):
                            if norms is not None:  # the first model is random: its texts are scored by the next one
                                gains += before.gains(ids, norms)
                            if fresh:
                                own.train(ids)
                            n += len(ids)
            if n:
                yield packed(progress(start, own.flat()), gains)

        fresh = (part < ends[i]) & (part >= ends[i - 1]) if i else part < ends[0]
        learnt = df.where(part < ends[1] if i == 1 else fresh).select(body.alias("text"), fresh.alias("fresh"))
        models = write_table(learnt.mapInArrow(tidy(run), kind), "models")
        tasks = left = models.count()
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            fewer = write_table(models.repartition(left).mapInArrow(tidy(add), kind), "models")
            drop_table(models)
            models = fewer
        sums, more = united((r["sums"], r["gains"]) for r in models.collect())  # at most FAN_IN rows
        drop_table(models)
        sent.destroy()
        if sums is not None:
            model.load(joined(model.flat(), sums))
            gains += more
        if i == 0:
            ends = round_ends(tasks)
        i += 1
    if gains.any():
        model.rescale(gains)
    return model


def round_ends(tasks: int) -> list[int]:
    """Parts up to which each round trains: after the first, two rounds and one more each time the tasks double, as what tasks learn side by side adds up in the next round only."""
    more = min(PARTS - FIRST, 2 + max(0, tasks - 1).bit_length())
    return [FIRST, *(FIRST + (PARTS - FIRST) * j // more for j in range(1, more + 1))]


def progress(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What a task adds to the sums of a round, from flat() before and after: steps and squares of gradients, weighted by these squares, and the weights."""
    was, now = start.reshape(2, -1).astype(np.float64), end.reshape(2, -1).astype(np.float64)
    step, squares = now - was
    return np.concatenate([step * squares, squares * squares, squares])


def joined(start: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """flat() after a round: each parameter moves by the average step of the tasks that moved it, so what few tasks have seen is not diluted by the others."""
    steps, squares, weight = sums.reshape(3, -1)
    moved = np.divide(np.stack([steps, squares]), weight, out=np.zeros((2, len(weight))), where=weight > 0)
    return start + moved.ravel().astype(np.float32)


def score(df: DataFrame, held_out: Column, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows where ``held_out`` is not true are learnt from."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text).cast("string").alias("_text"))
    learn = rows.where(~F.col("_held"))
    counts = write_table(count_words(learn, text="_text"), "counts")
    voc = vocabulary(counts)
    model = fit(learn, voc, text="_text")
    sent = spark.sparkContext.broadcast((voc, model.context, model.factors(), model.normaliser()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        voc, context, factors, norm = sent.value
        across, norm, bias = len(norm), norm.ravel(), factors[3]
        log_all, log_norm = math.log10(voc.tokens + voc.distinct + 1), np.log10(voc.bucket_norm)
        end_base = math.log10(voc.end_count + 1) - log_all
        uid = TaskContext.get().partitionId() << 34
        for b in batches:
            for i, e, found, n in split(b.column(2)):
                at, cls = voc.classes(found)
                ids, is_word = closed(cls, n)
                starts = np.cumsum(n + 1) - n - 1
                us, vs = contexts(context, ids)
                token = np.empty(len(ids))
                for k in range(0, len(ids), 16 * BATCH):
                    u, v, w = (x[k : k + 16 * BATCH].astype(np.intp) for x in (us, vs, ids))
                    token[k : k + 16 * BATCH] = affinity(factors, u, v, w) + bias.take(w) - norm.take(u * across + v)
                p = np.add.reduceat(token, starts) / math.log(10)

                def by_text(values: np.ndarray) -> np.ndarray:
                    token[:] = 0
                    token[is_word] = values
                    return np.add.reduceat(token, starts)

                miss = np.flatnonzero(at < 0)
                base = by_text(voc.log_count[at]) - n * log_all + end_base
                inside = voc.log_inside[at]
                inside[miss] = -log_norm[cls[miss] - 1 - voc.own]
                p += by_text(inside)
                known_n = by_text(at >= 0).astype(np.int64) + (voc.end_count > 0)
                # words without a place, once a text
                rare = found.take(pa.array(miss)).dictionary_encode()
                many = max(1, len(rare.dictionary))
                pairs, tail_n = np.unique(np.repeat(np.arange(len(n)), n)[miss] * many + rare.indices.to_numpy(), return_counts=True)
                k, m = len(n), len(pairs)
                none = lambda kind: pa.nulls(m, kind)
                cat = lambda col, kind: pa.concat_arrays([col, none(kind)])
                key, held = b.column(0).slice(i, k), b.column(1).slice(i, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        int64(np.concatenate([np.arange(uid, uid + k), uid + pairs // many])),
                        cat(key, key.type),
                        cat(held, pa.bool_()),
                        cat(int64(n + 1), pa.int64()),
                        int64(np.concatenate([known_n, tail_n])),
                        cat(pa.array(base, pa.float64()), pa.float64()),
                        cat(pa.array(p, pa.float64()), pa.float64()),
                        pa.concat_arrays([pa.nulls(k, pa.binary()), rare.dictionary.take(pa.array(pairs % many)).cast(pa.binary())]),
                    ],
                    ["uid", "key", "held", "n_tokens", "n", "base", "p", "word"],
                )
                uid += k

    kind = df.schema[key].dataType.simpleString()
    scored = write_table(rows.mapInArrow(tidy(run), f"uid bigint, key {kind}, held boolean, n_tokens bigint, n bigint, base double, p double, word binary"), "scored")
    # counts of words that tasks do not know: at least 1 for those seen in training
    rare = scored.where("word is not null").join(counts.select("word", "c"), "word", "left")
    rest = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    out = scored.where("word is null").join(rest, "uid", "left")
    more = F.coalesce("log", F.lit(0.0))
    return out.select(
        F.col("key").alias(key),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("p") + more).alias("score"),
    )
