import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from session import local_session  # noqa: E402

from wordloom.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session(4, "4g"))
    yield session
    session.stop()


def token_rows(texts: dict[int, list[list[str]]]) -> list[tuple]:
    """(text_id, s_id, s_first, s_last, tok_no, pos, word) rows from texts given as lists of sentences."""
    rows, pos = [], 0
    for text_id, sentences in texts.items():
        at = 0
        for s_id, sentence in enumerate(sentences):
            for i, word in enumerate(sentence):
                rows.append((text_id, s_id, at, at + len(sentence) - 1, at + i, pos, word))
                pos += 1
            at += len(sentence)
    return rows


TOKEN_SCHEMA = "text_id long, s_id long, s_first long, s_last long, tok_no long, pos long, word string"


@pytest.fixture(scope="session")
def make_tokens(spark):
    from pyspark.sql import functions as F

    def build(texts, partitions=3):
        df = spark.createDataFrame(token_rows(texts), TOKEN_SCHEMA).repartition(partitions)
        return df.withColumn("lemma", F.lower("word")).withColumn("phon", F.col("word")).withColumn("orig", F.col("word"))

    return build
