"""A word vocabulary compiled to a deterministic transducer over bytes.

Inside a pre-tokenized piece, the last token of every prefix's encoding is
determined: it is the one token that ends there, encodes to itself and may follow
the last token of the prefix before it.  So a prefix can be told by what later
bytes may ask about it: for each start of a token that may still be going on, its
place in the trie of tokens, the last token before it, and how many tokens stand
there.  These are the states.  A transition by a byte carries the number of tokens
by which the encoding grows (it may shrink: two tokens become one) and the last
token behind it; a closing transition does the same for the byte that ends the
piece.  Sums of the numbers along a path are exact token counts.

Transitions are compiled when a text first asks for them, into one table of
integers with open addressing; it is emptied between blocks of text once it holds
``MOST`` transitions, so memory is bounded and results do not depend on it.  All
pieces of a block walk through the table together, one byte of each at a time.

Long texts are cut into chunks of ``CHUNK`` bytes, wherever that falls.  Each chunk
becomes a map from the state before it to (state behind it, tokens emitted), and
the maps are composed pairwise, level by level, as in a parallel prefix scan.

White space, letters, digits and contractions are told apart by a few
neighbouring bytes, so pieces are found in all bytes at once.  Texts with
characters beyond Latin are cut by the library's own normalizer and pre-tokenizer.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmatch.llm.bpe import Bpe, byte_letters, is_odd, load
from veilmatch.llm.common import byte_rows, int64, tidy

#: Transitions that a worker keeps from one block of text to the next.
MOST = 600_000
#: Pairs of tokens whose neighbourhood is remembered.
PAIRS = 300_000
#: Bytes of text that walk together, and bytes of a chunk of the scan.
BLOCK, CHUNK = 1 << 20, 1 << 16
SLOTS = 1 << 20
#: Pieces still walking below which each goes on alone.
FEW = 16
#: Added to a byte that ends a piece.
CLOSING = 256
_ODD_NUMBER, _FREE = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1)
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each single-byte character, and of each two-byte one (index: lead byte * 256 + second byte)."""
    patterns = [regex.compile(x) for x in (r"\s", r"\p{L}", r"\p{N}")]
    of = lambda c: next((k for k, p in enumerate(patterns) if p.match(c)), OTHER)
    one, two = np.full(256, OTHER, np.uint8), np.full(1 << 16, OTHER, np.uint8)
    for i in range(0x250):
        raw = chr(i).encode()
        if len(raw) == 1:
            one[raw[0]] = of(chr(i))
        else:
            two[raw[0] << 8 | raw[1]] = of(chr(i))
    return one, two


def find_pieces(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces in normalised UTF-8 bytes of characters below U+0250: contractions, runs of letters, digits, runs of others."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = _kinds()
    kind = one[x]
    lead = np.flatnonzero(x >= 0xC0)
    lead = lead[lead + 1 < len(x)]
    if len(lead):
        kind[lead + 1] = kind[lead] = two[x[lead].astype(np.int32) << 8 | x[lead + 1]]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    first = (kind != before) | ((kind == NUMBER) & (x & 0xC0 != 0x80))
    for at in np.flatnonzero((x == 39) & (before != OTHER)).tolist():  # apostrophes that may begin a contraction
        tail = x[at + 1 : at + 3].tobytes()
        n = 2 if tail[:1] in (b"s", b"t", b"m", b"d") else 3 if tail in (b"re", b"ve", b"ll") else 0
        if n:
            first[at + 1 : at + n] = False
            if at + n < len(x):
                first[at + n] = True
    edges = np.flatnonzero(first)
    ends = np.append(edges[1:], len(x))
    real = kind[edges] != SPACE
    return edges[real], ends[real]


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to the state before it.

    ``head`` are the bytes up to the chunk's first certain boundary: they go on with
    a piece that began before.  With ``closed``, the piece ends with them, ``n`` more
    tokens follow, and the state behind the chunk is ``exit`` whatever the state
    before it; without, the whole chunk is inside one piece.  States are told by
    what they mean (see Transducer.chains), which outlasts an emptied table.
    """

    head: bytes
    closed: bool
    n: int
    exit: bytes


class Transducer:
    def __init__(self, bpe: Bpe):
        if not bpe.words:
            raise ValueError("the transducer needs a vocabulary of words with ends")
        self.bpe = bpe
        self.symbols: dict[int, list[int]] = {}
        self.below: dict[int, int] = {}  # trie of tokens: node << 9 | symbol -> node
        self.token: dict[int, int] = {}
        nodes = 1
        for i, raw, closing in bpe.tokens():
            word = [*raw[:-1], raw[-1] + CLOSING * closing]
            self.symbols[i] = word
            node = 0
            for s in word:
                k = node << 9 | s
                if k not in self.below:
                    self.below[k] = nodes
                    nodes += 1
                node = self.below[k]
            self.token[node] = i
        self.inner = {k >> 9 for k in self.below}
        self.length = np.zeros(bpe.size, np.int64)
        for i, word in self.symbols.items():
            self.length[i] = len(word)
        self._letters = {c: b for b, c in enumerate(byte_letters())}
        self._follows: dict[int, bool] = {}
        self.reset()

    # -- states ----------------------------------------------------------
    def reset(self) -> None:
        """Forget all states and transitions."""
        self.start = array("q", [self._pack(0, -1, 0)]).tobytes()
        self.chains: list[bytes] = [self.start]
        self.steps: dict[int, int] = {}
        self.number: dict[bytes, int] = {self.start: 0}
        self._room(SLOTS)

    def _state(self, chain: bytes) -> int:
        state = self.number.get(chain)
        if state is None:
            state = self.number[chain] = len(self.chains)
            self.chains.append(chain)
        return state

    @staticmethod
    def _pack(node: int, last: int, n: int) -> int:
        return node << 32 | (last + 1) << 12 | n + 1024

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether ``token`` encodes to itself and, behind ``last``, the two stay as they are."""
        k = (last + 1) << 20 | token
        out = self._follows.get(k)
        if out is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            before = self.symbols[last] if last >= 0 else []
            out = self._follows[k] = (last < 0 or self._may_follow(-1, token)) and self.bpe.merge_symbols(before + self.symbols[token]) == ([last, token] if last >= 0 else [token])
        return out

    def _transition(self, state: int, symbol: int) -> tuple[bytes, int, int]:
        """(state behind, tokens more, last token) of one transition."""
        going, hit = [], None
        for packed in array("q", self.chains[state]):
            node = self.below.get((packed >> 32) << 9 | symbol)
            if node is None:
                continue
            last, n = (packed >> 12 & 0xFFFFF) - 1, (packed & 0xFFF) - 1024
            if hit is None and (token := self.token.get(node)) is not None and self._may_follow(last, token):
                hit = token, n + 1
            if node in self.inner:
                going.append((node, last, n))
        token, more = hit  # one token always ends here: the byte's own, if no longer one
        if symbol >= CLOSING:
            return b"", more, token
        return array("q", [*(self._pack(node, last, n - more) for node, last, n in going), self._pack(0, token, 0)]).tobytes(), more, token

    # -- the table -------------------------------------------------------
    def _room(self, slots: int) -> None:
        self.mask, self._shift = np.uint64(slots - 1), np.uint64(65 - slots.bit_length())
        self.keys, self.values = np.full(slots, _FREE), np.zeros(slots, np.uint64)
        self.transitions = 0

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 2 * (self.transitions + len(keys)) > len(self.keys):
            held = self.keys != _FREE
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self._room(max(2 * len(self.keys), 1 << int(4 * len(keys) - 1).bit_length()))
        self.transitions += len(keys)
        slot = keys * _ODD_NUMBER >> self._shift
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == _FREE]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            taken = left[self.keys[slot[left]] != _FREE]
            slot[taken] = slot[taken] + np.uint64(1) & self.mask

    def _compile(self, keys: np.ndarray) -> None:
        values = []
        for k in keys.tolist():
            chain, more, token = self._transition(k >> 9, k & 511)
            values.append((self._state(chain) if chain else 0) << 32 | more + 1024 << 20 | token)
        self._insert(keys, np.array(values, np.uint64))

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """Packed transitions: state << 32 | tokens more + 1024 << 20 | last token."""
        slot = keys * _ODD_NUMBER >> self._shift
        got = self.keys[slot]
        out = self.values[slot]
        bad = np.flatnonzero(got != keys)
        got = got[bad]
        while len(bad):
            new = got == _FREE
            if new.any():
                at = bad[new]
                self._compile(np.unique(keys[at]))
                out[at] = self._look(keys[at])
                bad = bad[~new]
                if not len(bad):
                    break
                # the table may have grown: look for the rest anew
                out[bad] = self._look(keys[bad])
                break
            slot[bad] = slot[bad] + np.uint64(1) & self.mask
            got = self.keys[slot[bad]]
            out[bad] = self.values[slot[bad]]
            other = got != keys[bad]
            bad, got = bad[other], got[other]
        return out

    def _step(self, key: int) -> int:
        """One packed transition, for walks of few pieces: a dictionary in front of the table."""
        got = self.steps.get(key)
        if got is None:
            if len(self.steps) >= MOST:
                self.steps.clear()
            got = self.steps[key] = int(self._look(np.array([key], np.uint64))[0])
        return got

    # -- walks -----------------------------------------------------------
    def _blocks(self, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of pieces of about BLOCK bytes; between them the table may be emptied."""
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, "right")))
            if self.transitions > MOST:
                self.reset()
            yield a, b
            a = b

    def _walk(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray | None) -> np.ndarray:
        """Token counts of whole pieces of ``x``; ``tokens`` gets the last token behind every byte."""
        size = ends - starts
        order = np.argsort(-size.astype(np.int32), kind="stable")
        at, long = starts[order], size[order]
        active = len(long) - np.searchsorted(long[::-1], np.arange(2, long[0] + 1))  # pieces of at least 2, 3, .. bytes
        state, n = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
        nine, low = np.uint64(9), np.uint64(0xFFF)
        together = int(np.searchsorted(-active, -FEW, "right"))  # bytes that more than FEW pieces have
        for j, m in enumerate(active[:together].tolist()):
            got = self._look(state[:m] << nine | x[at[:m] + j])
            state[:m] = got >> np.uint64(32)
            if tokens is None:
                n[:m] += (got >> np.uint64(20) & low).astype(np.int64) - 1024
            else:
                tokens[at[:m] + j] = (got & np.uint64(0xFFFFF)).astype(np.int32)
        for i in range(int(active[together]) if together < len(active) else 0):  # the rest of the longest ones, each on its own
            now, more, low_bits = int(state[i]), 0, []
            for b in x[at[i] + together : at[i] + long[i] - 1].tolist():
                step = self._step(now << 9 | b)
                now, more = step >> 32, more + (step >> 20 & 0xFFF) - 1024
                if tokens is not None:
                    low_bits.append(step & 0xFFFFF)
            state[i] = now
            n[i] += more
            if low_bits:
                tokens[at[i] + together : at[i] + long[i] - 1] = low_bits
        last = at + long - 1
        got = self._look(state << nine | x[last] + np.uint64(CLOSING))
        if tokens is not None:
            tokens[last] = (got & np.uint64(0xFFFFF)).astype(np.int32)
        out = np.empty_like(n)
        out[order] = n + (got >> np.uint64(20) & low).astype(np.int64) - 1024
        return out

    def piece_counts(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self._walk(x, starts[a:b], ends[a:b], None) for a, b in self._blocks(starts, ends))])

    def piece_ids(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, byte at which each ends): from the end of each piece back by the length of its last token."""
        tokens, mark = np.zeros(len(x), np.int32), np.zeros(len(x), bool)
        for a, b in self._blocks(starts, ends):
            self._walk(x, starts[a:b], ends[a:b], tokens)
            at, stop = ends[a:b] - 1, starts[a:b]
            while len(at):
                mark[at] = True
                at = at - self.length[tokens[at]]
                more = at >= stop
                at, stop = at[more], stop[more]
        places = np.flatnonzero(mark)
        return tokens[places], places

    # -- maps of chunks --------------------------------------------------
    def run(self, chain: bytes, raw: bytes, closed: bool) -> tuple[bytes, int]:
        """(state, tokens) after ``raw`` inside a piece, which ends with it if ``closed``."""
        n, state = 0, self._state(chain)
        for b in raw[: len(raw) - closed]:
            got = self._step(state << 9 | b)
            state, n = got >> 32, n + (got >> 20 & 0xFFF) - 1024
        if closed and raw:
            got = self._step(state << 9 | raw[-1] + CLOSING)
            state, n = got >> 32, n + (got >> 20 & 0xFFF) - 1024
        return self.chains[state], n

    def apply(self, part: StateMap, chain: bytes) -> tuple[bytes, int]:
        after, n = self.run(chain, part.head, part.closed)
        return (part.exit, n + part.n) if part.closed else (after, n)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of chunk a followed by chunk b; associative."""
        if not a.closed:
            return StateMap(a.head + b.head, b.closed, b.n, b.exit)
        after, n = self.apply(b, a.exit)
        return StateMap(a.head, True, a.n + n, after)

    def chunk_maps(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = CHUNK) -> list[StateMap]:
        out = []
        for low in range(0, len(x), size):
            high = min(low + size, len(x))
            a, b = int(np.searchsorted(starts, low)), int(np.searchsorted(starts, high))
            head, closed = b"", True
            if a and ends[a - 1] > low:  # a piece that began before
                end, head = int(ends[a - 1]), x[low : min(int(ends[a - 1]), high)].tobytes()
                closed = end <= high
            whole = b if b == a or ends[b - 1] <= high else b - 1
            n, state = int(self.piece_counts(x, starts[a:whole], ends[a:whole]).sum()), self.start
            if whole < b:
                state, more = self.run(state, x[int(starts[whole]) : high].tobytes(), False)
                n += more
            out.append(StateMap(head, closed, n, state))
        return out

    def scan(self, maps: list[StateMap]) -> StateMap:
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else StateMap(b"", True, 0, self.start)

    # -- texts -----------------------------------------------------------
    def plain(self, raw: bytes) -> bytes | None:
        """The normalised text in bytes, if it holds Latin characters only and no special token."""
        if raw.isascii():
            text = raw.lower()
            if text.translate(None, _PLAIN):
                return None
        else:
            whole = raw.decode("utf-8", "replace")
            lower = whole.lower()
            if is_odd(whole) or is_odd(lower):
                return None
            text = lower.encode()
        return None if self.bpe.has_special(raw) else text

    def cut(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends) of the pieces that the library makes of any text without special tokens."""
        found = [bytes(self._letters[c] for c in p) for p, _ in self.bpe.library.pre_tokenizer.pre_tokenize_str(self.bpe.library.normalizer.normalize_str(text))]
        found = [p for p in found if p]
        ends = np.cumsum([len(p) for p in found], dtype=np.int64)
        return np.frombuffer(b"".join(found), np.uint8), ends - np.array([len(p) for p in found], np.int64), ends

    def count(self, raw: bytes) -> int:
        """Tokens of one text, by the maps of its chunks."""
        text, n = self.plain(raw), 0
        if text is not None:
            x = np.frombuffer(text, np.uint8)
            parts = [(x, *find_pieces(x))]
        else:
            parts, n = self.parts(raw)
        for x, starts, ends in parts:
            n += self.apply(self.scan(self.chunk_maps(x, starts, ends)), self.start)[1]
        return n

    def parts(self, raw: bytes) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
        """(what cut() makes of the stretches between special tokens, special tokens)."""
        between, special = self.bpe.split_special(raw.decode("utf-8", "replace"))
        return [self.cut(t) for t in between if t], len(special)

    def _joined(self, raws: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Blocks of short plain texts: (places in ``raws``, all bytes with a gap behind each text, where each text begins and the end)."""
        places, texts, size = [], [], 0
        for i, raw in enumerate(raws):
            if len(raw) <= CHUNK and (text := self.plain(raw)) is not None:
                places.append(i)
                texts.append(text)
                size += len(text) + 1
                if size >= BLOCK:
                    yield places, np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts)])
                    places, texts, size = [], [], 0
        if places:
            yield places, np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts)])

    def counts(self, raws: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        out = np.full(len(raws), -1, np.int64)
        for places, x, begin in self._joined(raws):
            starts, ends = find_pieces(x)
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.piece_counts(x, starts, ends))))
            out[places] = np.diff(sums[np.searchsorted(starts, begin)])
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self.count(raws[i])
        return out

    def ids(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        out: list = [None] * len(raws)
        for places, x, begin in self._joined(raws):
            ids, where = self.piece_ids(x, *find_pieces(x))
            edges = np.searchsorted(where, begin).tolist()
            ids = ids.astype("<u4")
            for i, a, b in zip(places, edges, edges[1:]):
                out[i] = ids[a:b]
        for i, have in enumerate(out):
            if have is None:
                text = self.plain(raws[i])
                if text is not None:
                    x = np.frombuffer(text, np.uint8)
                    out[i] = self.piece_ids(x, *find_pieces(x))[0].astype("<u4")
                else:
                    between, special = self.bpe.split_special(raws[i].decode("utf-8", "replace"))
                    found = [self.piece_ids(*self.cut(t))[0] if t else np.zeros(0, np.int32) for t in between]
                    mixed = [y for k, f in enumerate(found) for y in (f, np.array(special[k : k + 1], np.int32))]
                    out[i] = np.concatenate(mixed).astype("<u4")
        return out


_PLAIN = bytes([*range(9, 14), *range(32, 127)])


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """The transducer of the vocabulary at ``path``, one for each worker."""
    return Transducer(load(path))


def count_tokens(df: DataFrame, vocabulary: str, *, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of ``df``; row-local, no shuffle.

    Null and empty texts have no tokens; rows with equal or null keys are rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for b in batches:
            raw = byte_rows(b.column(1))
            n = machine.counts(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), int64([len(x) for x in raw]), int64(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
