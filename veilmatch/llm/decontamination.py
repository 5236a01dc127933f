"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are letters, digits and non-ASCII characters.  A window is ``WINDOW``
consecutive words of a benchmark item; an item of fewer words is one window.

1. Fingerprints.  In every window the smallest hash of ``GRAM`` neighbouring
   words is kept, for documents and items alike, so any shared window shares one.
   The first pass lowers all letters (a coarser match that loses nothing).
   Fingerprints of all window lengths come from one scan of the documents.
2. Documents that share a fingerprint with an item are looked at.  The item side is
   broadcast while it has at most ``BROADCAST_BYTES``; else the join shuffles.
3. Extension.  All windows of these documents, now of exact words, and of all items
   meet in one join on 128 bits of hash.  Its rows hold no text and a document's
   window once, so a document that meets many items, or a long one that holds a long
   item, costs its length.  The words inside occurrences are hit.

Null texts have no words; documents and items without words match nothing.
Repeated rows get the same result each; ids may be null.  All found items without
an id are one null, the last of a document's items.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmatch.llm.common import packed

WINDOW = 10
GRAM = 5
BROADCAST_BYTES = 32_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_words(text: Column) -> Column:
    """Words after lowering A-Z only."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _SEPARATORS), "")


def coarse_words(text: Column) -> Column:
    """The same words after lowering all letters: equal words stay equal, and the number is the same."""
    return F.array_remove(F.split(F.lower(text), _SEPARATORS), "")


def _grams(hashes: str, size: int) -> Column:
    """Hashes of every ``size`` neighbouring entries of the array column ``hashes``."""
    at = F.sequence(F.lit(0), F.size(hashes) - F.lit(size))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(size)]))


def _smallest(grams: str, width: int) -> Column:
    at = F.sequence(F.lit(0), F.size(grams) - F.lit(width))
    return F.array_distinct(F.transform(at, lambda i: F.least(*[F.get(F.col(grams), i + k) for k in range(width)])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also when the optimizer merges projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprints(df: DataFrame, windows: list[int], *, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``window`` and ``fp``: one row per kept fingerprint of rows with at least ``window`` words, for each of these lengths."""
    hashed = df.select(*keep, F.transform(coarse_words(F.col(text)), lambda w: F.xxhash64(w)).alias("_h"))
    sizes = sorted({min(GRAM, w) for w in windows})
    grams = hashed.select(*keep, F.size("_h").alias("_n"), *(F.when(F.size("_h") >= g, _grams("_h", g)).alias(f"_g{g}") for g in sizes))  # no filter: it would compute the words twice

    def kept(window: int) -> Column:
        gram = min(GRAM, window)
        own = F.array_distinct(f"_g{gram}") if window == gram else _smallest(f"_g{gram}", window - gram + 1)
        found = F.transform(own, lambda x: F.struct(F.lit(window).alias("window"), x.alias("fp")))
        return F.when(F.col("_n") >= window, found).otherwise(F.array().cast("array<struct<window:int,fp:bigint>>"))

    return grams.select(*keep, F.explode(F.concat(*map(kept, windows))).alias("_f")).select(*keep, "_f.*")


def _named(window: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a window's words: 128 bits, so that no two windows share them in practice."""
    return [F.xxhash64(window).alias("_h0"), F.xxhash64(F.lit("#"), window).alias("_h1")]


def _bounded(df: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def matches(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, _th, hit ARRAY<INT>, items ARRAY<STRING>) of documents with hits: hit word places and the items found, sorted.

    ``_th`` is a hash of the text; with the key it names a document.
    """
    d = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    b = items.select(F.col(item).cast("string").alias("_item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    b = b.withColumn("_w", exact_words(F.col("_text"))).where(F.size("_w") > 0)
    b = b.withColumn("_len", F.least(F.size("_w"), F.lit(window)))
    sizes = [r[0] for r in b.groupBy("_len").agg(F.count("*")).orderBy("_len").collect()]  # at most `window` numbers
    if not sizes:
        return d.where("false").select(F.col("_key").alias(key), "_th", F.lit(None).cast("array<int>").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    own = reduce(DataFrame.unionByName, [fingerprints(b.where(F.col("_len") == n), [n], text="_text", keep=[]) for n in sizes]).distinct()
    theirs = fingerprints(d, sizes, text="_text", keep=["_key", "_th"])
    found = theirs.join(_bounded(own, 40 * own.count()), ["window", "fp"], "left_semi").select(F.col("_key").alias("_k"), F.col("_th").alias("_t")).distinct()

    at = F.sequence(F.lit(0), F.size("_w") - F.col("_len"))
    strings = F.transform(at, lambda i: F.array_join(F.slice(F.col("_w"), i + 1, F.col("_len")), " "))
    windows = b.select("_item", "_len", F.explode(strings).alias("_s")).select("_item", "_len", *_named(F.col("_s"))).distinct()
    both = d.join(found.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_th") == F.col("_t")))

    def places(words: Column) -> Column:
        """Every window of a document, named, for each window length of the items."""

        def of(size: int) -> Column:
            named = F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(size)), lambda i: _let(F.array_join(F.slice(words, i + 1, size), " "), lambda w: F.struct(F.lit(size).alias("_len"), i.alias("_place"), *_named(w))))
            return F.when(F.size(words) >= size, named).otherwise(F.array().cast("array<struct<_len:int,_place:int,_h0:bigint,_h1:bigint>>"))

        return F.concat(*map(of, sizes))

    spelt = both.select("_key", "_th", F.explode(_let(exact_words(F.col("_text")), places)).alias("_p")).select("_key", "_th", "_p.*")
    hit = spelt.join(_bounded(windows, 64 * windows.count()), ["_len", "_h0", "_h1"])
    every = hit.select("_key", "_th", "_item", F.explode(F.sequence(F.col("_place"), F.col("_place") + F.col("_len") - 1)).alias("_place")).groupBy("_key", "_th").agg(
        F.collect_set("_place").alias("hit"),
        F.concat(
            F.sort_array(F.collect_set("_item")),
            F.when(F.bool_or(F.col("_item").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")),
        ).alias("items"),
    )
    return every.withColumnRenamed("_key", key)


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(key, n_words, n_hit, items ARRAY<STRING>, contaminated) of every row of ``docs``."""
    hits = matches(docs, items, window=window, text=text, key=key, item=item)
    hits = hits.select(F.col(key).alias("_k"), F.col("_th").alias("_t"), F.size("hit").cast("long").alias("_n"), "items")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key), F.size(coarse_words(body)).cast("long").alias("n_words"), F.xxhash64(body).alias("_th"))
    out = rows.join(hits, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_th") == F.col("_t")), "left")
    return out.select(key, "n_words", F.coalesce("_n", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("_n").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, all columns; any names are fine, as rows travel packed."""
    hits = matches(docs, items, window=window, text=text, key=key, item=item).select(F.col(key).alias("_k"), F.col("_th").alias("_t"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_th"), packed(docs))
    return rows.join(hits, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_th") == F.col("_t")), "left_anti").select("_row.*")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), {WINDOW}) AS l FROM b WHERE len(w) > 0),
bp AS (SELECT item, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM bi),
bw AS (SELECT DISTINCT item, l, array_to_string(list_slice(w, i + 1, i + l), ' ') AS s FROM bp),
dl AS (SELECT doc_id, w, l FROM d JOIN (SELECT DISTINCT l FROM bi) ON len(w) >= l),
dp AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM dl),
dw AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i + 1, i + l), ' ') AS s FROM dp),
h AS (SELECT doc_id, item, dw.l, i FROM dw JOIN bw ON dw.l = bw.l AND dw.s = bw.s),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
