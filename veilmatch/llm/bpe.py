"""Byte-pair encoding with vocabulary files of public tokenizers: encode and decode.

Encoding by forced boundaries.  A text is first cut where the tokenizer's own
pre-tokenizer cuts it.  Inside such a piece, a pair of neighbouring bytes that
stands inside no vocabulary token can never be merged over, so the piece is cut
there too; the fragments are encoded on their own and their ids concatenated.
Fragments and whole space-delimited stretches repeat a lot, so their ids are
kept in tables that together take at most ``CACHE_MB`` of a worker; the half of a
table that was not asked for lately goes when it is full, and what is not kept is
encoded anew, with the same result.

Null texts are empty; empty texts have no ids.  Texts of any length are
processed whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.llm.common import byte_rows, int64, tidy

#: Megabytes of all tables of encoded stretches of a worker, and what an entry takes besides its bytes.
CACHE_MB, ENTRY_BYTES = 160, 200
#: Longer stretches are encoded without being kept.
CACHE_CHARS = 48
#: Fragments longer than this are merged with a heap, shorter ones by scanning.
HEAP_FROM = 48
# The published pre-tokenizer patterns of the two vocabulary files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ODD = re.compile("[^\t-\r -~\xa1-ɏ]")  # beyond these, the library's own normalizer and pre-tokenizer decide
_PLAIN_LATIN = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])
_GAPS = re.compile(r" \s|\s ")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = re.compile(f"[{_SPACES}]+")
_SHIFT = 20
_NEVER = 1 << 62


def is_odd(text: str) -> bool:
    """Whether a text holds anything for which Python's and the library's character tables might differ."""
    try:
        return bool(text.encode("latin-1").translate(None, _PLAIN_LATIN))
    except UnicodeEncodeError:
        return _ODD.search(text) is not None


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Table(dict):
    """What was made of stretches so far: two generations of at most ``most`` bytes; the older one goes when the newer is full."""

    def __init__(self, make, share: float):
        super().__init__()
        self.make, self.most, self.held, self.older = make, share * CACHE_MB * 1e6 / 2, 0, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= CACHE_CHARS:
            self.held += ENTRY_BYTES + len(key) + len(out)
            if self.held > self.most:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[key] = out
        return out


class Bpe:
    """One vocabulary file of the tokenizers library with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = model.get("end_of_word_suffix") or ""
        self.words = bool(self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._special_bytes = [t.encode() for t in self.special]
        vocab: dict[str, int] = model["vocab"]
        self._vocab = vocab
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << _SHIFT | vocab[b], rank << _SHIFT | vocab[a + b])
        size = 1 + max(max(vocab.values()), *self.special.values()) if self.special else 1 + max(vocab.values())
        self.size = size
        self.token_bytes: list[bytes] = [b""] * size
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(byte_of[c] for c in (token.removesuffix(self.end) if self.end else token))
            self.token_bytes[i] = raw
            if len(raw) > 1:
                x = np.frombuffer(raw, np.uint8)
                inside[x[:-1], x[1:]] = True
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.inside = inside
        self._inside_flat = inside.tobytes()
        self.pattern = regex.compile(WORD_PATTERN if self.words else BYTE_PATTERN)
        self._inner: dict[bytes, bytes] = _Table(self._first_ids, 0.1)
        self._final: dict[bytes, bytes] = _Table(self._last_ids, 0.1) if self.words else self._inner
        self._whole: dict[bytes, bytes] = _Table(self._cut_piece, 0.2)
        self.stretch: dict[str, bytes] = _Table(self._stretch, 0.5 if self.words else 0.15)
        self.spaced: dict[str, bytes] = _Table(lambda x: self._stretch(" " + x), 0.1 if self.words else 0.5)

    def tokens(self) -> Iterator[tuple[int, bytes, bool]]:
        """(id, bytes, whether it ends a word) of every token that is not special."""
        for token, i in self._vocab.items():
            if token not in self.special:
                yield i, self.token_bytes[i], bool(self.end) and token.endswith(self.end)

    def merge_symbols(self, symbols: list[int]) -> list[int]:
        """Ids of bytes without any cut before; a symbol of 256 and more is a byte that ends a word."""
        ids = [self.first[s] if s < 256 else self.last[s - 256] for s in symbols]
        return np.frombuffer(self._merge(ids), "<u4").tolist()

    def has_special(self, raw: bytes) -> bool:
        return any(s in raw for s in self._special_bytes)

    def split_special(self, text: str) -> tuple[list[str], list[int]]:
        """(stretches between special tokens, one more than these; ids of the special tokens)."""
        if self._special is None:
            return [text], []
        return self._special.split(text), [self.special[x] for x in self._special.findall(text)]

    # -- one piece -------------------------------------------------------
    def cuts(self, raw: bytes) -> list[bytes]:
        """The fragments of a piece between its forced boundaries."""
        if len(raw) < 256:
            inside = self._inside_flat
            at = [i for i, (a, b) in enumerate(zip(raw, raw[1:]), 1) if not inside[a << 8 | b]]
        else:
            x = np.frombuffer(raw, np.uint8)
            at = (np.flatnonzero(~self.inside[x[:-1], x[1:]]) + 1).tolist()
        if not at:
            return [raw] if raw else []
        at = [0, *at, len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def piece(self, raw: bytes) -> bytes:
        """Ids (little-endian uint32) of one pre-tokenized piece."""
        return self._whole[raw] if raw else b""

    def _cut_piece(self, raw: bytes) -> bytes:
        parts = self.cuts(raw)
        if len(parts) == 1:
            return self._last_ids(raw)
        return b"".join([self._inner[p] for p in parts[:-1]]) + self._final[parts[-1]]

    def _first_ids(self, raw: bytes) -> bytes:
        """Ids of a fragment that another one follows."""
        first = self.first
        return self._merge([first[b] for b in raw])

    def _last_ids(self, raw: bytes) -> bytes:
        """Ids of the fragment that ends a piece."""
        first = self.first
        ids = [first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return self._merge(ids)

    def _merge(self, ids: list[int]) -> bytes:
        if len(ids) > HEAP_FROM:
            return array("I", self._merge_long(ids)).tobytes()
        get, low = self.merges.get, (1 << _SHIFT) - 1
        keys = [get(a << _SHIFT | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while keys and (best := min(keys)) != _NEVER:
            at = keys.index(best)
            ids[at] = best & low
            del ids[at + 1], keys[at]
            if at < len(keys):
                keys[at] = get(ids[at] << _SHIFT | ids[at + 1], _NEVER)
            if at:
                keys[at - 1] = get(ids[at - 1] << _SHIFT | ids[at], _NEVER)
        return array("I", ids).tobytes()

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, low, n = self.merges.get, (1 << _SHIFT) - 1, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i) for i in range(n - 1) if (k := get(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or get(ids[i] << _SHIFT | ids[j]) != k:
                continue
            ids[i], ids[j] = k & low, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get(ids[i] << _SHIFT | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := get(ids[p] << _SHIFT | ids[i])) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in ids if x >= 0]

    # -- texts -----------------------------------------------------------
    def pieces(self, text: str) -> list[bytes]:
        """What the tokenizer's pre-tokenizer makes of a (normalised) stretch, in bytes."""
        if self.words and text.isalpha() and _ODD.search(text) is None:
            return [text.encode()]
        if _ODD.search(text) is None:
            return [p.encode() for p in self.pattern.findall(text)]
        letters = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(letters[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _stretch(self, text: str) -> bytes:
        return b"".join([self.piece(p) for p in self.pieces(text)])

    def normal(self, text: str) -> str:
        """The text as the vocabulary's normalizer leaves it (word vocabularies: lower case, composed, single spaces)."""
        if not self.words:
            return text
        return text.lower() if not is_odd(text) else self.library.normalizer.normalize_str(text)

    @staticmethod
    def split(text: str) -> list[str]:
        """Stretches between white space; str.split() also takes U+001C to U+001F, which are no white space here."""
        return text.split() if not is_odd(text) else _WHITE.split(text.strip(_SPACES)) if text.strip(_SPACES) else []

    def plain_parts(self, text: str) -> list[bytes]:
        """Encoded stretches, in order, of a text without special tokens."""
        if self.words:
            words = self.split(self.normal(text)) if is_odd(text) else text.lower().split()
            return list(map(self.stretch.__getitem__, words))
        chunks = text.split(" ") if _GAPS.search(text) is None else _SAFE_SPACE.split(text)
        table = self.spaced
        return [self.stretch[chunks[0]], *map(table.__getitem__, chunks[1:])] if text else []

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self._special is None or self._special.search(text) is None:
            return b"".join(self.plain_parts(text))
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self.plain_parts(text[at : m.start()])
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join(out + self.plain_parts(text[at:]))

    def decode(self, ids: bytes) -> str:
        """Text of ids of a byte-level vocabulary, special tokens included."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once by each worker."""
    return Bpe(path)


# --------------------------------------------------------------- operators
def encode_documents(df: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids BINARY of little-endian uint32, decoded STRING) of each row of ``df``; row-local, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.slice(i, 1000)
                ids = [bpe.encode(x.decode("utf-8", "replace")) for x in byte_rows(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], [key, "ids", "decoded"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, ids binary, decoded string")


def encoding_digests(df: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode_documents() reduced to digests in the same Python pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        sha = hashlib.sha256
        for b in batches:
            n, a, d = [], [], []
            for x in byte_rows(b.column(1)):
                ids = bpe.encode(x.decode("utf-8", "replace"))
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                d.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), int64(n), pa.array(a, pa.string()), pa.array(d, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
