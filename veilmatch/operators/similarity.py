"""Similarities as column expressions and, for full products, as functions of common-bit counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmatch.functions.bits import dice, smc


@dataclass(frozen=True)
class Side:
    """One record of a pair in a join: words, popcount, and its other columns by name."""

    prefix: str
    n_words: int

    @property
    def words(self) -> list[Column]:
        return [F.col(f"{self.prefix}w{i}") for i in range(self.n_words)]

    @property
    def pc(self) -> Column:
        return F.col(f"{self.prefix}pc")

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.prefix}{name}")


@dataclass(frozen=True)
class Similarity:
    """``column(a, b, n_bits)`` scores a pair.

    ``two_sided``: inside a block, k limits both records of a pair, not the left one only.
    ``best(low_count, high_count, n_bits)``: highest score that popcounts allow, as a column.
    ``counts(common, pc_a, pc_b, n_bits)``: scores from numpy counts (vectors, or a matrix with a column and a row); without it there is no full-product kernel.
    """

    name: str
    column: Callable[[Side, Side, int], Column]
    two_sided: bool = False
    best: Callable[[Column, Column, int], Column] | None = None
    counts: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray] | None = None
    #: (slope, offset) with common >= slope * (pc_a + pc_b) + offset wherever the score reaches t
    cutoff: Callable[[float, int], tuple[float, float]] | None = None
    needs: tuple[str, ...] = ()


def _dice_counts(common: np.ndarray, pa: np.ndarray, pb: np.ndarray, n_bits: int) -> np.ndarray:
    total = np.asarray(pa + pb, np.float64)
    return np.divide(2.0 * common, total, out=np.zeros(np.shape(total)), where=total > 0)


def _dice_best(a: Column, b: Column, n_bits: int) -> Column:
    return F.when(a + b > 0, F.lit(2.0) * F.least(a, b) / (a + b)).otherwise(F.lit(0.0))


def _smc_best(a: Column, b: Column, n_bits: int) -> Column:
    return (F.lit(n_bits) - F.abs(a - b)).cast("double") / F.lit(float(n_bits))


DICE = Similarity(
    "dice",
    lambda a, b, n: dice(a.words, b.words, a.pc, b.pc),
    best=_dice_best,
    counts=_dice_counts,
    cutoff=lambda t, n: (t / 2, 0.0),
)
SMC = Similarity(
    "smc",
    lambda a, b, n: smc(a.words, b.words, n),
    two_sided=True,
    best=_smc_best,
    counts=lambda c, pa, pb, n: (n - (pa + pb - 2.0 * c)) / float(n),
    cutoff=lambda t, n: (0.5, (t - 1) * n / 2),
)


def custom_similarity(name: str, column: Callable[[Side, Side], Column], *, needs: Sequence[str] = (), two_sided: bool = False) -> Similarity:
    """A similarity of one's own: ``column(a, b)`` from the sides' words, popcounts or further record columns (named in ``needs``)."""
    return Similarity(name, lambda a, b, n: column(a, b), two_sided=two_sided, needs=tuple(needs))


def named(similarity: Similarity | str) -> Similarity:
    if isinstance(similarity, Similarity):
        return similarity
    try:
        return {"dice": DICE, "smc": SMC, "hamming": SMC}[similarity]
    except KeyError:
        raise ValueError(f"unknown similarity {similarity!r}") from None
