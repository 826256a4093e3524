"""One query per operator of this package, over whole tables, with its SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.llm import (
    alignment,
    language,
    mixing,
    packing,
    quality,
    quotes,
    repeats,
    secrets,
    sentencepieces,
    sharding,
    simhash,
    spelling,
    vafile,
)
from tremora.llm.common import settled
from tremora.sources.shared import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, folder, "documents"))


def op2_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vafile.top_k(_table(spark, folder, "embeddings"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, and pages, which have markup and addresses; the ids of either in their own column."""
    documents = language.document_languages(_table(spark, folder, "documents"))
    pages = language.page_languages(_table(spark, folder, "pages"))
    return documents.withColumn("table", F.lit("documents")).unionByName(
        pages.withColumn("table", F.lit("pages")), allowMissingColumns=True
    )


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix(_table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(_table(spark, folder, "documents"))


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.linked_conversations(_table(spark, folder, "conversations"))


def op7_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.findings(_table(spark, folder, "documents"), fresh_path(spark, "ledger"))
    return secrets.digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judged(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.withColumn("score", F.col("score").cast("long"))


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)
    found = settled(alignment.digest(alignment.aligned(_table(spark, folder, "documents"), a, b)), "aligned")
    return alignment.counted(found, alignment.width(b))


def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return sentencepieces.digest(sentencepieces.encoded(docs, public_tokenizers.path(PIECES)))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


registered: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_vector_search,
        op3_language_id,
        op4_source_mixing,
        op5_sharding,
        op6_chat_formatting,
        op7_secret_scans,
        op8_simhash_dedup,
        op9_best_fit_packing,
        op10_quality_rules,
        op11_tokenizer_alignment,
        op12_sentencepiece,
        op13_spelling_variants,
    )
}
