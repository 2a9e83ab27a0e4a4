import pytest
from pyspark.sql import functions as F

from wordloom.llm.common import prepared

CLASHES = "score predicted lang_pred leaks pii redacted removed_lines shard kept n_blocks h size salt first last key".split()


@pytest.fixture(scope="session")
def lab(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def docs_of(lab):
    """Documents from texts (ids from 0), with columns whose names the operators use themselves."""

    def build(texts, langs=None, clashes=CLASHES):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s") for i, t in enumerate(texts)]
        frame = lab.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
        return frame.withColumns({c: F.lit("x") for c in clashes} | {"a.b": F.lit(1)})

    return build


ODD = [None, "", "   ", "\n\n", "x", "é", "\x00", "word " * 40_000, "\n".join(["line"] * 5000), "𝔘🙂 ‮", "same text", "same text"]
