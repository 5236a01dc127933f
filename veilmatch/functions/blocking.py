"""Blocking keys: records are compared iff they share at least one.

A blocking is a factory of an ARRAY<STRING> column.  Values become tagged strings,
so that null is a key like any other and values of different functions or
positions never collide.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmatch.functions.bits import get_bit, py_floordiv


@dataclass(frozen=True)
class Record:
    """What a blocking sees of a record: its words, its length in bits, and columns by name."""

    words: Sequence[Column]
    n_bits: int

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


Blocking = Callable[[Record], Column]


def _tagged(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def list_blocking(source: str | Column) -> Blocking:
    """One key: the value of a column (null is a value)."""

    def keys(record: Record) -> Column:
        return F.array(_tagged(F.col(source) if isinstance(source, str) else source))

    return keys


def custom_blocking(source: str | Column | Callable[[Record], Column]) -> Blocking:
    """Keys from an array column or a function of the record; no key: never compared.  A null array has no key."""

    def keys(record: Record) -> Column:
        col = source(record) if callable(source) and not isinstance(source, Column) else F.col(source) if isinstance(source, str) else source
        return F.coalesce(F.array_distinct(F.transform(col, _tagged)), F.array().cast("array<string>"))

    return keys


def bit_blocking(g: int, r: int, *, seed: int | str | bytes | float | None = 0) -> Blocking:
    """``g`` keys, each from ``r`` sampled bits and the number of its table.

    Positions come from Python's generator with ``seed``, sampled without
    replacement within a table.  With no seed, positions are drawn once per blocking.
    """
    if g < 1:
        raise ValueError(f"g must be positive, not {g}")
    if r < 1:
        raise ValueError(f"r must be positive, not {r}")
    drawn: dict[int, list[list[int]]] = {}

    def positions(n_bits: int) -> list[list[int]]:
        if n_bits not in drawn:
            if drawn:
                raise ValueError("bit strings differ in length")
            rng = random.Random(seed)
            drawn[n_bits] = [rng.sample(range(n_bits), r) for _ in range(g)]
        return drawn[n_bits]

    def keys(record: Record) -> Column:
        out = []
        for table, bits in enumerate(positions(record.n_bits)):
            chunks = [bits[i : i + 48] for i in range(0, len(bits), 48)]
            numbers = [sum((F.shiftleft(get_bit(record.words, b), j) for j, b in enumerate(c)), F.lit(0).cast("bigint")) for c in chunks]
            out.append(F.concat_ws(",", F.lit(str(table)), *[n.cast("string") for n in numbers]))
        return F.array(*out)

    keys.positions = positions  # type: ignore[attr-defined]
    return keys


def continuous_blocking(radius: float, source: str | Column) -> Blocking:
    """Two keys from overlapping ranges of width ``2 * radius``: values within ``radius`` share one, values over ``2 * radius`` apart share none."""
    if radius <= 0:
        raise ValueError(f"radius must be positive, not {radius}")

    def keys(record: Record) -> Column:
        x = (F.col(source) if isinstance(source, str) else source).cast("double")
        even = py_floordiv(x, 2 * radius) * 2
        odd = py_floordiv(x + F.lit(float(radius)), 2 * radius) * 2 + 1
        return F.array(even.cast("bigint").cast("string"), odd.cast("bigint").cast("string"))

    return keys


def _parts(name: str, given: tuple) -> list[Blocking]:
    if not given:
        raise TypeError(f"{name} needs at least one blocking")
    if len(given) == 1 and isinstance(given[0], Iterable):
        given = tuple(given[0])
    return list(given)


def block_and(*blockings: Blocking | Iterable[Blocking]) -> Blocking:
    """Records share a key iff they share one in every blocking: tuples of keys."""
    parts = _parts("block_and", blockings)

    def sized(key: Column) -> Column:
        return F.concat(F.length(key).cast("string"), F.lit(":"), key)

    def extended(out: Column, more: Column) -> Column:
        return F.flatten(F.transform(out, lambda a: F.transform(more, lambda x: F.concat(a, sized(x)))))

    def keys(record: Record) -> Column:
        out = F.array(F.lit(""))
        for b in parts:
            out = extended(out, b(record))
        return out

    return keys


def block_or(*blockings: Blocking | Iterable[Blocking]) -> Blocking:
    """Records share a key iff they share one in some blocking: keys carry the number of their blocking."""
    parts = _parts("block_or", blockings)

    def numbered(i: int, keys_: Column) -> Column:
        return F.transform(keys_, lambda x: F.concat(F.lit(f"{i}|"), x))

    def keys(record: Record) -> Column:
        tagged = [numbered(i, b(record)) for i, b in enumerate(parts)]
        return F.concat(*tagged) if tagged else F.array().cast("array<string>")

    return keys
