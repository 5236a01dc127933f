"""Quality scores from compressed sizes under two dictionaries.

Two zstandard dictionaries are trained, one on texts of label 1 and one on texts
of label 0.  A text that resembles the first packs smaller with it: the
difference of the two compressed sizes, divided by their sum, is the evidence.
A logistic curve, fitted on labelled texts that no dictionary has seen, turns it
into a probability.  The curve has the difference, how far the text packs at all
(both sizes together, divided by its length), and the square of each; the second
tells how much a given difference means, as repeated lines and random letters
pack unlike prose.  The fit maximises a concave function by Newton steps that are
halved until they gain, so it ends at its one maximum also where the labels can
be told apart without error.

Fitting uses a bounded sample of labelled rows: at most ``SAMPLE`` of each label,
those with the smallest hash of their id, of at most ``LONGEST`` bytes each; of
several rows with one id, the smallest text.  Scores read whole texts and nothing
else.  Null texts are empty.  Each label needs two texts that are not empty, one for
its dictionary and one for the curve; with fewer, nothing is trained and every
score is the share of label 1 among the labelled texts, moved towards 0.5 by one text of each label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmatch.llm.common import byte_rows, smallest, tidy

SAMPLE = 4000
LONGEST = 32_768
DICTIONARY = 65_536
LEVEL = 3
#: Bytes that packing adds to any text; the weight that keeps the curve finite.
FRAME, RIDGE = 20, 1e-3


class CompressionClassifier:
    def __init__(self, good: bytes | None, bad: bytes | None, weights: list[float], share: float = 0.5):
        self.good, self.bad, self.weights, self.share = good, bad, weights, share
        self._packers = None

    @property
    def trained(self) -> bool:
        """Whether scores depend on the text."""
        return self.good is not None and self.bad is not None

    def __getstate__(self):
        return {**self.__dict__, "_packers": None}

    def _sizes(self, raw: bytes) -> tuple[int, int]:
        if self._packers is None:
            self._packers = []
            for d in (self.good, self.bad):
                kept = zstandard.ZstdCompressionDict(d)
                kept.precompute_compress(level=LEVEL)
                self._packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(len(p.compress(raw)) for p in self._packers)

    def features(self, raw: bytes) -> list[float]:
        g, b = self._sizes(raw)
        x, packed = (b - g) / (b + g), (b + g) / (len(raw) + FRAME)
        return [1.0, x, x * x, packed, packed * packed]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.share)
        z = np.array([self.features(x) for x in texts]).reshape(len(texts), -1) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the logistic curve for rows ``x`` and labels ``y`` (0 or 1); labels count halfway between equal rows and equal shares."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y) * 0.5 + 0.5

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        share = 1.0
        while share > 1e-10 and loss(w + share * step) > now - 1e-4 * share * float(slope @ step):
            share /= 2
        w = w + share * step
        before, now = now, loss(w)
        if before - now <= 1e-10 * max(1.0, before):
            break
    return w


def train(rows: list[tuple[bytes, int]]) -> CompressionClassifier:
    """Dictionaries from every other text of each label, the curve from the rest.  ``rows`` come in a fixed order."""
    kinds = {q: [t for t, x in rows if x == q and t] for q in (0, 1)}
    share = (len(kinds[1]) + 1) / (len(kinds[0]) + len(kinds[1]) + 2)
    if min(map(len, kinds.values())) < 2:
        return CompressionClassifier(None, None, [], share)
    books = {}
    for q, texts in kinds.items():
        own = list(dict.fromkeys(texts[::2]))
        try:
            books[q] = zstandard.train_dictionary(DICTIONARY, own).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            books[q] = b"".join(own)[-DICTIONARY:]
    out = CompressionClassifier(books[1], books[0], [], share)
    fit = [(t, q) for q, texts in kinds.items() for t in texts[1::2]]
    out.weights = fit_curve(np.array([out.features(t) for t, _ in fit]), np.array([q for _, q in fit], float)).tolist()
    return out


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> CompressionClassifier:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); at most ``sample`` rows of each label reach the driver."""
    chosen = None
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    for q in (0, 1):
        part = smallest(known.where(F.col("quality") == q), "doc_id", sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text").between(1, LONGEST))
    got = texts.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality").collect()  # bounded: 2 x sample short texts
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return train([(r[1].encode(), r[2]) for r in got])


def score_documents(df: DataFrame, model: CompressionClassifier, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: label 1 likelier) of every row; row-local, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i + 1) for i in range(len(keep))), pa.array(model.scores(byte_rows(b.column(0))))], [*keep, "score"])

    rows = df.select(F.col(text).cast("string").alias("_text"), *keep)
    return rows.mapInArrow(tidy(run), T.StructType([df.schema[c] for c in keep]).add("score", T.DoubleType()))
