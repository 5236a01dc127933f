"""Licence scans: phrases and tags by Aho-Corasick, expressions by a shunting-yard parser.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
bytes.  One automaton over the words, joined by single spaces, finds all notice
phrases, overlapping ones too, and the identifier tag; where a tag stands, the
expression after it is read from the text itself and parsed: ``with`` binds
tighter than ``and``, ``and`` tighter than ``or``.  An expression ends with its
line, however long that is, and is kept as a tree, so time grows with its length.

Null and empty texts have no words, no labels and score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.llm.common import ALNUM_LOWER, ASCII_LOWER, byte_rows, int64, tidy

# The phrases that count as base places, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, their labels and how sure each makes us.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.7),
    "licensed under the apache license version 2 0": ("apache", 0.9),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd license": ("bsd", 0.8),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.7),
    "isc license": ("isc", 0.8),
    "the unlicense": ("unlicense", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("all-rights-reserved", 0.4),
}
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.95
# Families of licence identifiers by their first part.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "unlicense": "unlicense", "cc0": "cc0", "cc": "cc-by"}
_TAG_TEXT = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_ATOM = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Licence:
    """A parsed expression: a name, or an operator over parts.  Chains of one operator are one node; nothing is multiplied out."""

    op: str  # "name", "or" or "and"
    parts: tuple  # of Licence; of one name for "name"
    text: str = ""  # of the root: what was parsed, in lower case with single spaces

    @property
    def names(self) -> set[str]:
        """All licences named, those with exceptions as "x with y"."""
        out, left = set(), [self]
        while left:
            here = left.pop()
            if here.op == "name":
                out.add(here.parts[0])
            else:
                left += here.parts
        return out

    def met_by(self, held: set[str]) -> bool:
        """Whether holding these licences meets the expression."""
        done: dict[int, bool] = {}
        left = [(self, False)]
        while left:
            here, ready = left.pop()
            if here.op == "name":
                done[id(here)] = here.parts[0] in held
            elif ready:
                done[id(here)] = (any if here.op == "or" else all)(done[id(x)] for x in here.parts)
            else:
                left += [(here, True), *((x, False) for x in here.parts)]
        return done[id(self)]


def parse(expression: str) -> Licence | None:
    """The tree of a licence expression of any length, by two stacks; None if it is not well-formed.

    ``with`` attaches an exception's name to the licence before it.  Prose behind a
    complete expression ends it.
    """
    values: list[tuple[str, list]] = []  # operator and parts; chains grow in place
    waiting: list[str] = []

    def done(value: tuple[str, list]) -> Licence:
        return Licence(value[0], tuple(value[1]))

    def apply() -> None:
        op, b, a = waiting.pop(), values.pop(), values.pop()
        if op == "with":
            if a[0] != "name" or b[0] != "name":
                raise ValueError("an exception belongs to one licence")
            values.append(("name", [f"{a[1][0]} with {b[1][0]}"]))
            return
        parts = a[1] if a[0] == op else [done(a)]
        if b[0] == op:
            parts += b[1]
        else:
            parts.append(done(b))
        values.append((op, parts))

    read: list[str] = []
    want = True  # whether a licence (not an operator) comes next
    try:
        for found in _ATOM.finditer(expression.lower()):
            token = found[0]
            if token == "(":
                if not want:
                    break
                waiting.append(token)
            elif token == ")":
                if want or "(" not in waiting:
                    break
                while waiting[-1] != "(":
                    apply()
                waiting.pop()
            elif token in _BINDS:
                if want:
                    return None
                while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                    apply()
                waiting.append(token)
                want = True
            elif want:
                values.append(("name", [token.rstrip(".:-")]))
                want = False
            else:
                break  # prose after the expression
            read.append(token)
        if want or "(" in waiting:
            return None
        while waiting:
            apply()
    except (IndexError, ValueError):
        return None
    return Licence(values[0][0], tuple(values[0][1]), " ".join(read)) if len(values) == 1 else None


def family(name: str) -> str:
    """The label of a licence name; a name of no known family is a label itself."""
    return FAMILIES.get(re.split(r"[-.+ ]", name, maxsplit=1)[0], name.partition(" with ")[0])


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan(raw: bytes) -> tuple[int, list[int], list[str], list[str], float, list[str]]:
    """(words, starts of base places, base labels, all labels, score, parsed expressions) of one text."""
    words = raw.translate(ALNUM_LOWER).split()
    if not words:
        return 0, [], [], [], 0.0, []
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    starts, base, labels, doubt, tags, told = [], set(), set(), 1.0, 0, set()
    at = word = 0
    for end, phrase in _automaton().iter(line):
        if phrase in BASE:
            first = end - len(phrase) - 1
            if first >= at:  # places of shorter phrases may end later and begin earlier
                word, at = word + line.count(" ", at, first), first
                starts.append(word)
            else:
                starts.append(line.count(" ", 0, first))
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase][0])
        tags += phrase == TAG
        if phrase not in told:
            told.add(phrase)
            doubt *= 1 - (BASE_WEIGHT if phrase in BASE else NOTICES[phrase][1] if phrase in NOTICES else 0)
    expressions = []
    if tags:
        for m in _TAG_TEXT.finditer(raw.translate(ASCII_LOWER)):
            if value := parse(m[1].decode("utf-8", "replace")):
                expressions.append(value.text)
                labels |= {family(n) for n in value.names}
                doubt *= 1 - TAG_WEIGHT
    return len(words), starts, sorted(base), sorted(base | labels), 1 - doubt, expressions


def scan_documents(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: words, base places (all starts), labels, score, expressions.  Row-local, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(x) for x in byte_rows(b.column(1))]
            n, starts, base, labels, score, found = map(list, zip(*rows)) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), int64(n), pa.array(starts, pa.list_(pa.int64())), pa.array([",".join(x) for x in base], pa.string()), pa.array([",".join(x) for x in labels], pa.string()), pa.array(np.array(score, np.float64)), pa.array(found, pa.list_(pa.string()))],
                [key, "n_words", "starts", "base_labels", "labels", "score", "expressions"],
            )

    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, n_words bigint, starts array<bigint>, base_labels string, labels string, score double, expressions array<string>")
