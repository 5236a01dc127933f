"""The registered queries of the corpus operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmatch.llm import bpe, decontamination, fingerprints, licenses, lm, packing, prefix_trie, quality, search, sequences, simhash, suffixes, transducer
from veilmatch.llm.common import documents, fold, fresh_path, share_code

#: Vocabulary files are found by the package that ships them; the name is the parameter.
BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.score(docs, fold(docs, 7) == 2)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir), words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(documents(spark, sf_dir), length=400, words=51, cut_words=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_in_runs")


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(documents(spark, sf_dir), vocabulary(BYTE_VOCABULARY))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        "base_labels",
        "labels",
        "score",
        F.array_join("expressions", "; ").alias("expressions"),
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold(F, 3) == 1, F.lit(False))
    model = quality.fit(docs, labels.where(fold(labels, 3) != 1))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(documents(spark, sf_dir), vocabulary(WORD_VOCABULARY), limit=2048)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    files = sequences.write_sequences(docs, vocabulary(WORD_VOCABULARY), fresh_path(spark, "sequences"), end_id=2)
    return sequences.read_documents(files)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), vocabulary(BYTE_VOCABULARY), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(documents(spark, sf_dir))
    return search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_code(spark)
    turns = prefix_trie.turns_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.share_beginnings(turns))


_QUERIES = (
    op1_lm_scoring,
    op2_simhash_near_dedup,
    op3_suffix_array_dedup,
    op4_bpe_encoding,
    op5_license_scan,
    op6_benchmark_decontamination,
    op7_quality_classifier,
    op8_document_fingerprints,
    op9_token_counts,
    op10_token_files,
    op11_best_fit_packing,
    op12_ranked_search,
    op13_conversation_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_benchmark_decontamination": decontamination.ORACLE, "op12_ranked_search": search.ORACLE, "op13_conversation_trie": prefix_trie.ORACLE}
