"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import (
    align,
    decontaminate,
    langid,
    linededup,
    neardup,
    neighbours,
    packing,
    pages,
    pii,
    quality,
    secrets,
    sharding,
    trie,
)
from wordloom.llm.common import table

SHARDS = 24


def op1_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing of doc_id."""
    return sharding.digest(table(spark, folder, "documents"), SHARDS)


def op2_byte_ppm(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by byte context trees."""
    return langid.digest(table(spark, folder, "documents"))


def op3_hyper_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return neardup.digest(table(spark, folder, "documents"))


def op4_string_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return decontaminate.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without passages that repeat."""
    return linededup.digest(table(spark, folder, "documents"))


def op6_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_attention_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by attention over its passages."""
    return quality.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(table(spark, folder, "documents"))


def op9_block_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page by a conditional random field over its blocks."""
    return pages.digest(table(spark, folder, "pages"))


def op10_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return neighbours.digest(table(spark, folder, "embeddings"))


def op11_centroid_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix trie of all conversations with sums over subtrees."""
    return trie.conversation_trie(table(spark, folder, "conversations"))


def op12_secret_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document by fixed patterns and a conditional random field."""
    return secrets.digest(table(spark, folder, "documents"))


def op13_pointer_jumping(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of tokens of two tokenizers that cover the same bytes, in every document."""
    names = "byte_bpe_50k.json", "piece_bpe_32k.model"
    return align.digest(table(spark, folder, "documents"), *map(public_tokenizers.path, names))


QUERIES = {
    f.__name__: f
    for f in (
        op1_jump_shards,
        op2_byte_ppm,
        op3_hyper_minhash,
        op4_string_tiles,
        op5_line_chunks,
        op6_sum_of_squares,
        op7_attention_quality,
        op8_personal_data,
        op9_block_crf,
        op10_multi_index,
        op11_centroid_trie,
        op12_secret_crf,
        op13_pointer_jumping,
    )
}
ORACLES = {"op1_jump_shards": sharding.digest_sql(SHARDS), "op5_line_chunks": linededup.DIGEST_SQL, "op11_centroid_trie": trie.DIGEST_SQL}
