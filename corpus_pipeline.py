"""A training-data pipeline over ``documents``: five stages, each one operator of ``veilmatch.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns they got, extra ones included.

1. quality classifier: documents that score below 0.5 go.
2. SimHash near-dedup: candidates by 128-bit fingerprints of five-word shingles, links
   where the sets of shingles have a similarity of 0.8 or more; one document of each
   group stays, that of the smallest doc_id (null last).
3. suffix-array dedup: repeated strings of 51 words, and of 400 bytes (in whole
   characters), are cut, ``n_chars`` follows; a document of which nothing is left goes.
4. benchmark decontamination: documents that hold a window of an item go.
5. BPE encoding and decoding: token counts and digests of ids and decoded texts.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmatch.llm import bpe, decontamination, quality, simhash, suffixes
from veilmatch.llm.common import documents, fold, packed, share_code, write_table
from veilmatch.llm.queries import BYTE_VOCABULARY, vocabulary

#: No SQL expresses compressed sizes, XXH64 fingerprints or a BPE vocabulary.
ORACLE_SQL: str | None = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 and more.  Labels that teach nothing (see quality.py) reject nothing: all rows stay, with a warning."""
    share_code(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(fold(labels, 3) != 1))
    if not model.trained:
        warnings.warn("too few labelled texts to judge quality: no document is rejected", stacklevel=2)
        return docs
    return quality.score_documents(docs.select("text", packed(docs)), model, keep=("_row",)).where("score >= 0.5").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    return simhash.one_of_each_group(docs, words=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    rows = docs.select("text", F.struct(packed(docs.drop("text")), F.col("text").isNull().alias("none")).alias("_row"))
    cut = suffixes.remove_repeats(rows, length=400, keep=("_row",), whole_characters=True, words=51).where("n_removed = 0 or octet_length(kept) > 0")
    text = F.when(~F.col("_row.none"), F.col("kept").cast("string"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("_row._row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return cut.select(*[(new[c] if c in new else F.col(f"_row._row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_code(spark)
    return bpe.encoding_digests(docs, vocabulary(BYTE_VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
