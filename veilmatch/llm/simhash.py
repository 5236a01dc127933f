"""SimHash near-duplicate groups through an inverted index of fingerprint bytes.

A fingerprint is a row of positional bytes.  The index lists fingerprints under
small subsets of their bytes, chosen so that two fingerprints that share the
guaranteed number of positional bytes meet in at least one list (a Turán system).
In a list, the positional bytes that two fingerprints share are tallied; pairs
with the guaranteed number are verified by their differing bits.  (Lists of single
bytes would hold 1/256 of all rows each and their pairs would grow with the square
of the input.)

* ``NARROW``: 64 bits, links of at most 4 bits.  They touch at most 4 of 8 bytes, so
  4 are shared for certain, and any 4 of 8 positions include one of 20 triples.
* ``CANDIDATES``: 128 bits, links of at most 26 bits that share at least 2 of 16
  bytes; all 120 pairs of positions are lists, so any 2 shared bytes meet.  This
  index only finds candidates: texts of a shingle similarity of 0.8 differ in 19 bits
  in the mean (standard deviation 4) and share 2 bytes or more 19 times of 20; the
  similarity itself is then computed from the shingles (near_groups()).

Equal fingerprints are one entry of the index, however many documents have them.
A long list is not turned into pairs: it is searched from one entry to all that
are still unreached, and only the links that reach a new entry are kept, which
leaves the groups unchanged.  What a task finds is contracted to stars.

near_groups() solves what candidate links connect.  Texts of one connected cluster
are dealt to blocks of about ``BLOCK`` texts or ``BLOCK_BYTES`` (nearly always one), each pair of blocks is one group of rows,
and in it texts are compared by their sets of shingles unless they are connected
already or their fingerprints differ in more than ``FAR`` bits (which texts of 0.8
do less than once in a thousand times).  Only links that connect something new
leave a group, so neither a list nor a cluster is turned into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmatch.llm.common import ASCII_LOWER, byte_rows, drop_table, int64, packed, tidy, write_table
from veilmatch.llm.components import components

WORDS = 4
SEED = 42
#: Lists of up to this many entries are compared pair by pair, longer ones are searched.
SHORT_LIST = 8
#: Links that a task holds before it contracts them.
HELD_LINKS = 400_000
#: Texts of a block of a cluster and bytes of their shingles; bits beyond which no two texts are compared.
BLOCK, BLOCK_BYTES, FAR = 2048, 32_000_000, 36
#: What is sent to every task: up to so many bytes, at so many a row at most (digests and fingerprints; keys of usual size).
BROADCAST_BYTES, ROW_BYTES = 32_000_000, 200
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(-1).view(np.uint64)


@dataclass(frozen=True)
class Index:
    """``longs`` 64-bit words a fingerprint; links of at most ``distance`` bits; lists by ``subsets`` of byte positions that meet every ``shared`` positions."""

    longs: int
    distance: int
    shared: int
    subsets: tuple[tuple[int, ...], ...]

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.longs)]


def _triples() -> tuple[tuple[int, ...], ...]:
    """Triples of 8 positions such that any 4 positions include one: within a third of them, or two of one third and one of the next."""
    thirds = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [t for part in thirds for t in combinations(part, 3)]
    for i, part in enumerate(thirds):
        out += [tuple(sorted((*pair, one))) for pair in combinations(part, 2) for one in thirds[(i + 1) % 3]]
    return tuple(sorted(out))


NARROW = Index(1, 4, 4, _triples())
CANDIDATES = Index(2, 26, 2, tuple(combinations(range(16), 2)))


def simhash(raw: bytes, words: int = WORDS, longs: int = 1) -> bytes:
    """Fingerprint (big-endian) of a text: lower case A-Z, shingles of ``words`` words with repeats; 0 without words.

    Shingles are hashed by XXH64, or XXH3 of 128 bits for ``longs`` = 2.
    """
    parts = raw.translate(ASCII_LOWER).split()
    n, hashed = len(parts), xxhash.xxh64_digest if longs == 1 else xxhash.xxh3_128_digest
    if not n:
        return bytes(8 * longs)
    line = b" ".join(parts)
    if n <= words:
        return hashed(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    both = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())
    table = _SPREAD[np.frombuffer(b"".join([hashed(line[a:b], SEED) for a, b in both]), np.uint8)].reshape(-1, 8 * longs)
    count = np.add.reduceat(table, np.arange(0, len(table), 255), axis=0).view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(table)).tobytes()


def fingerprints(df: DataFrame, *, words: int = WORDS, index: Index = NARROW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, f0 BIGINT, ..) of every row; null texts are empty.  Row-local."""
    longs, columns = index.longs, index.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.frombuffer(b"".join([simhash(x, words, longs) for x in byte_rows(b.column(1))]), ">i8").reshape(-1, longs)
            yield pa.RecordBatch.from_arrays([b.column(0), *(int64(got[:, i]) for i in range(longs))], [key, *columns])

    kinds = "".join(f", {c} bigint" for c in columns)
    return df.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), f"`{key}` {df.schema[key].dataType.simpleString()}{kinds}")


def _close(x: np.ndarray, index: Index) -> np.ndarray:
    """Which rows of differing bits belong to a link: tally of shared bytes, then bits."""
    tally = (x.view(np.uint8).reshape(len(x), 8 * index.longs) == 0).sum(1)
    return (tally >= index.shared) & (np.bitwise_count(x).sum(1, dtype=np.int64) <= index.distance)


def _linked_only(x: np.ndarray, index: Index) -> np.ndarray:
    """Rows of a list that have a link in it; of lists that are long because the table is, few have."""
    step = max(1, 65536 // len(x))
    if step < 16:  # one at a time is as fast
        return x
    rows = [sum(np.bitwise_count(x[i : i + step, None, w] ^ x[None, :, w]).astype(np.int16) for w in range(index.longs)) for i in range(0, len(x), step)]
    return x[np.concatenate([(r <= index.distance).sum(1) for r in rows]) > 1]


def _search(x: np.ndarray, index: Index) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a long list as all its links would."""
    out, left = [], _linked_only(x, index)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = _close(left ^ here, index)
            if near.any():
                got = left[near]
                out.append((np.repeat(here[None], len(got), 0), got))
                left = left[~near]
                queue += list(got)
    return out


def linked(keys: np.ndarray, fps: np.ndarray, index: Index = NARROW) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole lists, given as equal neighbouring ``keys``; ``fps`` has a row of 64-bit words for each."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(first, len(keys)))
    long = size > SHORT_LIST
    out = [p for i, n in zip(first[long].tolist(), size[long].tolist()) for p in _search(np.unique(fps[i : i + n], axis=0), index)]
    short = np.repeat(~long & (size > 1), size)
    k, f = keys[short], fps[short]
    for d in range(1, SHORT_LIST):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        x = f[same] ^ f[same + d]
        good = _close(x, index) & x.any(1)
        out.append((f[same][good], f[same + d][good]))
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros((0, index.longs), np.uint64),) * 2
    return a, b


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the same rows as the links (a, b): each row but one of a group with the group's smallest, so at most one pair a row."""
    n = a.shape[1]
    if not len(a):
        return a, b
    nodes, at = np.unique(np.ascontiguousarray(np.concatenate([a, b])).view([(f"f{i}", np.uint64) for i in range(n)]).ravel(), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        low = np.minimum(p, q)
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while (label[label] != label).any():
            label = label[label]
    rows = nodes.view(np.uint64).reshape(-1, n)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return rows[moved], rows[label[moved]]


def links(fps: DataFrame, index: Index = NARROW) -> DataFrame:
    """(a0, .., b0, ..) BIGINT: pairs that connect the distinct fingerprints of ``fps`` (columns f0, ..) as all links would.

    Each task contracts its links before it hands them on, so large groups do not
    leave it as their pairs.
    """
    n, columns = index.longs, index.columns

    def byte(i: int) -> Column:
        return F.shiftrightunsigned(columns[i // 8], 8 * (7 - i % 8)).bitwiseAND(F.lit(255))

    keys = [sum((byte(i) * F.lit(256**k) for k, i in enumerate(t)), F.lit(m * 256 ** len(t))).cast("int") for m, t in enumerate(index.subsets)]
    lists = F.array(*keys)
    posted = fps.select(*columns, F.explode(lists).alias("key")).repartition("key").sortWithinPartitions("key")
    names = [f"{side}{i}" for side in "ab" for i in range(n)]

    def batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([int64(np.ascontiguousarray(side[:, i]).view(np.int64)) for side in (x, y) for i in range(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, f = np.zeros(0, np.int32), np.zeros((0, n), np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            held.append(found)
            if sum(len(x) for x, _ in held) > HELD_LINKS:
                held[:] = [contracted(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > HELD_LINKS // 2:
                    yield batch(*held.pop())

        for b in batches:
            own = np.stack([b.column(i).to_numpy().view(np.uint64) for i in range(n)], axis=1)
            k, f = np.concatenate([k, b.column(n).to_numpy()]), np.concatenate([f, own])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last list may go on
            yield from add(linked(k[:cut], f[:cut], index))
            k, f = k[cut:], f[cut:]
        yield from add(linked(k, f, index))
        if held:
            yield batch(*contracted(*(np.concatenate(x) for x in zip(*held))))

    return posted.mapInArrow(tidy(run), ", ".join(f"{c} bigint" for c in names))


def groups(df: DataFrame, *, words: int = WORDS, index: Index = NARROW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, f0, .., component_id) of every row; component_id is the smallest key reachable by links, itself included.

    Texts without words have fingerprint 0 and are linked like others.  A row
    with a null key is in its group too; a group of null keys only has a null id.
    """
    columns = index.columns
    rows = write_table(fingerprints(df, words=words, index=index, text=text, key=key).withColumnRenamed(key, "_key"), "simhash")
    low = rows.groupBy(*columns).agg(F.min("_key").alias("low"))
    # a node orders by its smallest key, so a component's smallest node names the component
    nodes = low.select(*columns, F.struct(F.col("low").isNull().alias("none"), "low", *columns).alias("node"))
    found = links(nodes.select(*columns), index)
    for side in "ab":
        ends = [f"{side}{i}" for i in range(index.longs)]
        found = found.join(nodes.select(*[F.col(c).alias(e) for c, e in zip(columns, ends)], F.col("node").alias(side)), ends).drop(*ends)
    root = components(found.select("a", "b"))
    named = nodes.join(root, "node", "left").select(*columns, F.coalesce("root.low", "node.low").alias("component_id"))
    return rows.join(named, columns).select(F.col("_key").alias(key), *columns, "component_id")


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The set of hashed shingles of a text, sorted; of fewer words, the one of all; without words, none."""
    parts = raw.translate(ASCII_LOWER).split()
    n = len(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if n else [], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    both = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in both], np.uint64))


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``others`` have at least this Jaccard similarity with ``one``; all are sorted sets.  Two empty sets are alike."""
    sizes = np.array([len(x) for x in others], np.int64)
    if not len(one):
        return sizes == 0
    out = np.zeros(len(others), bool)
    near = np.flatnonzero((sizes >= similarity * len(one)) & (len(one) >= similarity * sizes) & (sizes > 0))
    if len(near):
        flat = np.concatenate([others[i] for i in near.tolist()])
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        both = np.add.reduceat(hit, np.concatenate(([0], np.cumsum(sizes[near])[:-1])), dtype=np.int64)
        # both / union >= similarity, with what floats lose on exact ties given back
        out[near] = both * (1 + 1e-12) >= similarity * (len(one) + sizes[near] - both)
    return out


def verified_links(side: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float, across: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, one member of each text's group): links between texts that connect them as all links would; with ``across``, only links between the two sides count."""
    n = len(sets)
    label, out = np.arange(n), []
    first = np.flatnonzero(side == side.min()) if across else np.arange(n)
    rest = np.flatnonzero(side != side.min()) if across else None
    for i in first.tolist():
        left = rest if across else np.arange(i + 1, n)
        left = left[label[left] != label[i]]
        left = left[np.bitwise_count(fps[left] ^ fps[i]).sum(1, dtype=np.int64) <= FAR]
        if len(left):
            for j in left[alike(sets[i], [sets[k] for k in left.tolist()], similarity)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out, label


def near_groups(named: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, group) of each distinct ``row`` of ``named`` (row: any orderable type, text STRING): ``group`` is the smallest row that verified links reach.

    A row must always have the same text.  Texts that are equal in words (A-Z in
    lower case, white space aside) are one text; texts without words are one too.
    """
    row_type = named.schema["row"].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = byte_rows(b.column(1))
            got = np.frombuffer(b"".join([simhash(x, words, 2) for x in raws]), ">i8").reshape(-1, 2)
            lines = [b" ".join(x.translate(ASCII_LOWER).split()) for x in raws]
            same = [xxhash.xxh3_128_digest(x) for x in lines]
            n = [x.count(b" ") + 1 for x in lines]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), int64(n), int64(got[:, 0]), int64(got[:, 1])], ["row", "same", "n", "f0", "f1"])

    rows = write_table(named.select("row", "text").mapInArrow(tidy(prints), f"row {row_type}, same binary, n bigint, f0 bigint, f1 bigint"), "prints")
    texts = write_table(rows.groupBy("same").agg(F.min("row").alias("low"), *(F.first(c).alias(c) for c in ("n", "f0", "f1"))), "texts")
    close = links(texts.select("f0", "f1").distinct(), CANDIDATES)
    spot = components(close.select(F.struct(F.col("a0").alias("f0"), F.col("a1").alias("f1")).alias("a"), F.struct(F.col("b0").alias("f0"), F.col("b1").alias("f1")).alias("b")))
    placed = texts.join(spot.select("node.*", "root"), ["f0", "f1"], "left").select("same", "low", "n", "f0", "f1", F.coalesce("root", F.struct("f0", "f1")).alias("cluster"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    large = placed.groupBy("cluster").agg(F.count("*").alias("size"), blocks.alias("blocks")).where("size > 1")
    open_texts = write_table(placed.join(large, "cluster").select("low", "same", "f0", "f1", "cluster", "blocks"), "clusters")
    n, most = open_texts.agg(F.count("*"), F.max("blocks")).first()
    looked = F.broadcast(open_texts) if n * ROW_BYTES <= BROADCAST_BYTES else open_texts
    found = named.join(looked, F.col("row").eqNullSafe(F.col("low")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c0", "c1", "blocks", "same", "f0", "f1", "set"]
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                got = [shingles(x, words).tobytes() for x in byte_rows(part.column(6))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(6)), pa.array(got, pa.binary())], names)

    body = found.select(F.col("cluster.f0").alias("c0"), F.col("cluster.f1").alias("c1"), "blocks", "same", "f0", "f1", "text")
    own = F.pmod(F.xxhash64("same"), "blocks").cast("int")
    dealt = (
        body.mapInArrow(tidy(sets), "c0 bigint, c1 bigint, blocks int, same binary, f0 bigint, f1 bigint, set binary")
        .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("c0", "c1", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("blocks") > 1).alias("part"), "own", "same", "f0", "f1", "set")
        .repartition("c0", "c1", "p", "q")
        .sortWithinPartitions("c0", "c1", "p", "q", "same")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(group: list[tuple]) -> pa.RecordBatch:
            once = [x for x, before in zip(group, [None, *group]) if before is None or x[1] != before[1]]  # repeated rows
            got: list[tuple[int, int]] = []
            if len(once) > 1:
                got, label = verified_links(np.array([x[0] for x in once]), np.array([x[2:4] for x in once], np.int64).view(np.uint64), [np.frombuffer(x[4], np.uint64) for x in once], similarity, key[2] != key[3])
                if not key[4]:  # a whole cluster: its groups are final
                    got = [(i, j) for i, j in enumerate(label.tolist()) if i != j]
            return pa.RecordBatch.from_arrays([pa.array([once[i][1] for i, _ in got], pa.binary()), pa.array([once[j][1] for _, j in got], pa.binary()), pa.array([key[4]] * len(got), pa.bool_())], ["a", "b", "part"])

        key, group = None, []
        for b in batches:
            for i in range(0, len(b), 1000):
                cols = [c.to_pylist() for c in b.slice(i, 1000).columns]
                for row in zip(*cols):
                    if row[:5] != key:
                        if len(group) > 1:
                            yield ended(group)
                        key, group = row[:5], []
                    group.append(row[5:])
        if len(group) > 1:
            yield ended(group)

    solved = write_table(dealt.mapInArrow(tidy(solve), "a binary, b binary, part boolean"), "solved")
    root, tables = solved.where("not part").select(F.col("a").alias("node"), F.col("b").alias("root")), [open_texts, spot, solved]
    if most and most > 1:
        linked_parts = components(solved.where("part").select("a", "b"))
        root, tables = root.unionByName(linked_parts), [*tables, linked_parts]
    out = texts.join(root, texts["same"] == root["node"], "left").select(texts["same"], "low", F.coalesce("root", texts["same"]).alias("team"))
    lows = write_table(out.groupBy("team").agg(F.min("low").alias("group")).join(out, "team").select("same", "group"), "groups")
    for table in tables:
        drop_table(table)
    result = rows.join(lows, "same").select("row", "group").distinct()
    result._veil_tables = (rows, texts, lows)  # type: ignore[attr-defined]
    return result


def one_of_each_group(df: DataFrame, *, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of one row of each group of near_groups(): the smallest key (null last), of equal keys the one of the smallest text digest.

    Rows of different groups never meet, also where keys are repeated or null.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.md5(body).alias("digest"))
    found = near_groups(df.select(name.alias("row"), body.alias("text")), words=words, similarity=similarity)
    kept = write_table(found.select("group").distinct().select(F.col("group.id").alias("_kept"), F.col("group.digest").alias("_digest")), "kept")
    for table in found._veil_tables:  # type: ignore[attr-defined]
        drop_table(table)
    rows = df.select(F.col(key).alias("_key"), F.md5(body).alias("_md5"), F.col(text).isNull().alias("_none"), packed(df))
    rows = rows.join(kept, F.col("_key").eqNullSafe(F.col("_kept")) & (F.col("_md5") == F.col("_digest")))
    order = Window.partitionBy("_kept", "_digest").orderBy("_none")
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("_row.*")
