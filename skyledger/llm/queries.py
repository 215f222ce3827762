"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.llm import importance, licences, merkle, quality, ranked, sql, vptree, warc
from skyledger.llm.columnbwt import remove_repeated_bytes
from skyledger.llm.decontam import find_contamination
from skyledger.llm.lzfactor import remove_shared_passages
from skyledger.llm.minhash import near_duplicates
from skyledger.llm.packing import pack
from skyledger.llm.triecount import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def op1_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance", 6).alias("distance"))


def op2_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per derived record of every page."""
    return warc.derivatives(warc.responses(table(spark, folder, "pages"))).select(
        "page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_payload_digest",
        "block_digest", F.octet_length("block").cast("long").alias("n_bytes"), "n_links", F.sha2("block", 256).alias("block_sha256"))


def op3_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Target: documents labelled as good and not toxic."""
    target = table(spark, folder, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return importance.resample(texts(spark, folder), target).select(
        "doc_id", "n_grams", "log_weight", F.col("selected").alias("kept"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_contamination(texts(spark, folder), table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_licence_index(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(texts(spark, folder))


def op6_lz_factors(spark: SparkSession, folder: str) -> DataFrame:
    return remove_shared_passages(texts(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_histogram_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(texts(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op8_trie_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(texts(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(texts(spark, folder))


def op10_column_bwt(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_bytes(texts(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vantage_points(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.search(table(spark, folder, "embeddings"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(texts(spark, folder), table(spark, folder, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.prove(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_robust_outliers, op2_warc_derivatives, op3_importance_resampling, op4_decontamination, op5_licence_index,
    op6_lz_factors, op7_histogram_packing, op8_trie_counts, op9_minhash, op10_column_bwt,
    op11_vantage_points, op12_ranked_search, op13_merkle_manifest,
)}
SQL = {
    "op4_decontamination": sql.CONTAMINATION, "op6_lz_factors": sql.SHARED_PASSAGES, "op9_minhash": sql.NEAR_DUPLICATES,
    "op10_column_bwt": sql.REPEATED_BYTES, "op12_ranked_search": sql.RANKED, "op13_merkle_manifest": sql.MERKLE,
}
