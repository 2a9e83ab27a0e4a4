"""The pipeline on a fixture with planted cases, stage by stage, and the registered queries."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from wordloom.llm import queries

from .conftest import ODD


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_in_order(lab, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    clean = ["\n".join(prose(rng.randint(4, 40)) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    junk = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)]
    passage, item = prose(70), prose(40)
    base = [word() for _ in range(30)]
    near = [" ".join(base[:29] + [f"end{i}"]) for i in range(4)]
    planted = [f"{prose(20)}\n{passage}\n{prose(18)}" for _ in range(5)] + [f"{prose(12)}\n{item}\n{prose(12)}"] + near
    texts = [*clean, *junk, *planted, *ODD]
    docs = lab.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    first = len(clean) + len(junk)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < len(clean)), 0) for i in range(first)]
    lab.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    results, own = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(lab, own, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        own = lab.read.parquet(f"{tmp_path}/out{i}")
        if i < 4:
            assert own.columns == docs.columns
        results.append(own)
    good, fresh, distinct, unleaked, packed = results
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    assert not ids(good) & set(range(len(clean), first)) and set(range(len(clean))) <= ids(good)
    assert fresh.where(F.contains("text", F.lit(passage))).count() == 1
    assert set(range(len(clean))) <= ids(distinct)
    assert len(ids(distinct) & set(range(first + 6, first + 10))) == 1
    assert ids(distinct) - ids(unleaked) == {first + 5}
    assert ids(packed) == ids(unleaked)
    again = corpus_pipeline.run(lab, str(tmp_path))
    assert again.columns == packed.columns and again.count() == packed.count()


def test_copies_of_short_lines_leave_nothing(lab, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    short = lambda n: "\n".join(" ".join(word() for _ in range(rng.randint(2, 9))) for _ in range(n))
    first = [short(n) for n in (12, 20, 40, 80)]
    body = short(15)
    texts = [*first, *first, *first[:2], f"{word()}\n{body}\n{word()}", f"{word()}\n{body}"]
    docs = lab.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    fresh = {r.doc_id: r for r in corpus_pipeline.fresh_lines(lab, docs, str(tmp_path)).collect()}
    assert set(fresh) == {0, 1, 2, 3, 10, 11}
    assert all(fresh[i].text == texts[i] for i in (0, 1, 2, 3, 10)) and fresh[11].text == texts[11].split("\n")[0]
    assert all(r.n_chars == len(r.text) for r in fresh.values())


def test_stages_on_empty_tables(lab, tmp_path):
    docs = lab.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    lab.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(lab, docs, str(tmp_path)).count() == 0
