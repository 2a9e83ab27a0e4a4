"""A cleaning and packing pipeline over ``documents``, made of the operators in ``wordloom.llm``.

Each stage takes (spark, docs, folder) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.llm import decontaminate, linededup, neardup, packing, quality
from wordloom.llm.common import prepared, quoted, table
from wordloom.session import checkpoint_folder

#: Similarity in per cent from which two documents are near duplicates.
SIMILAR = 80


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier, learned from their labels, does not reject."""
    prepared(spark)
    model = quality.fitted(docs, table(spark, folder, "labels"))
    return quality.score_documents(docs, model).where("predicted = 1").select(*quoted(docs.columns))


def fresh_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without passages that stand elsewhere already; those that held nothing else go."""
    prepared(spark)
    cleaned = linededup.without_repeats(docs)
    cleaned = cleaned.where((F.col("removed_lines") == 0) | F.col("text").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*quoted(docs.columns))


def distinct_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    prepared(spark)
    others = neardup.near_duplicates(docs, SIMILAR).where(~F.col("kept")).select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*quoted(docs.columns))


def unleaked_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepared(spark)
    marked = decontaminate.with_leaks(docs, table(spark, folder, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(*quoted(docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    prepared(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("near-duplicates", distinct_documents),
    ("decontamination", unleaked_documents),
    ("packing", packed_sequences),
]
#: No SQL expresses trained weights or the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the session's shared folder and read again."""
    store = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{store}/{i}")
        docs = spark.read.parquet(f"{store}/{i}")
    return STAGES[-1][1](spark, docs, folder)
