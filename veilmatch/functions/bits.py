"""Bit strings as 64-bit words, so that counts stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clk_words(clk: Column, n_bytes: int) -> list[Column]:
    """The BIGINT words of a BINARY column of ``n_bytes`` bytes, first byte highest; a last partial word is filled with zeros."""

    def half(at: int) -> Column:
        part = F.substring(clk, at + 1, 4)
        return F.conv(F.rpad(F.hex(part), 8, "0"), 16, 10).cast("bigint") if at < n_bytes else F.lit(0).cast("bigint")

    return [F.shiftleft(half(8 * i), 32).bitwiseOR(half(8 * i + 4)) for i in range(-(-n_bytes // 8))]


def _total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts) if parts else F.lit(0)


def popcount(words: Sequence[Column]) -> Column:
    """Number of set bits."""
    return _total([F.bit_count(w) for w in words])


def logand_count(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Number of bits set in both."""
    return _total([F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b, strict=True)])


def dice(a: Sequence[Column], b: Sequence[Column], pc_a: Column | None = None, pc_b: Column | None = None) -> Column:
    """Dice coefficient ``2 |a & b| / (|a| + |b|)``; 0 where no bit is set."""
    total = (popcount(a) if pc_a is None else pc_a) + (popcount(b) if pc_b is None else pc_b)
    return F.when(total > 0, F.lit(2.0) * logand_count(a, b) / total).otherwise(F.lit(0.0))


def smc(a: Sequence[Column], b: Sequence[Column], n_bits: int) -> Column:
    """Simple matching coefficient: the share of equal bits of ``n_bits``."""
    if n_bits < 1:
        raise ZeroDivisionError("the simple matching coefficient needs at least one bit")
    differ = _total([F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])
    return (F.lit(n_bits) - differ).cast("double") / F.lit(float(n_bits))


def get_bit(words: Sequence[Column], i: int) -> Column:
    """Bit ``i``, counted from the highest bit of the first byte."""
    return F.shiftrightunsigned(words[i // 64], 63 - i % 64).bitwiseAND(F.lit(1))


def py_floordiv(x: Column, y: float) -> Column:
    """``x // y`` as Python computes it for floats, for a positive ``y``.

    Python goes by the remainder, which differs from ``floor(x / y)`` where the
    quotient rounds up to a whole number.
    """
    if not y > 0:
        raise ValueError("the divisor must be positive")
    x = x.cast("double")
    rest = x % F.lit(float(y))
    whole = (x - rest) / F.lit(float(y)) - F.when(rest < 0, F.lit(1.0)).otherwise(F.lit(0.0))
    low = F.floor(whole).cast("double")
    return low + F.when(whole - low > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))


def all_equal(df: DataFrame, column: str) -> bool:
    """Whether a column holds one value only (true when empty)."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return low == high
