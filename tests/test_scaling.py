"""What is moved, written and read again no more often than the result needs."""

import re

import pytest
from pyspark.sql import functions as F

from wordloom import layout
from wordloom.operators import concordance, hits as hit_ops, ordering
from wordloom.operators.hits import find_hits
from wordloom.operators.patterns import Gap, Tok, form_test, word
from wordloom.operators.selection import Choice, Selection
from wordloom.plans import given
from wordloom.sources.tokens import context_blocks, document_blocks, from_runs, placed_in_order, save_runs, save_tokens, token_runs, tokenise

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, startpos long")


@pytest.mark.parametrize("unique", [True, False])
def test_blocks_from_documents_are_those_of_their_tokens(spark, unique):
    size = 2 * layout.BLOCK + 700
    long = " ".join(f"w{i}" for i in range(size))
    rows = [(1, long, 0), (2, "a b. c", size), (3, "", size + 4), (4, None, size + 4), (5, " ".join(["x"] * layout.BLOCK), size + 4)]
    rows += [] if unique else [(2, "z b y", size), (1, "v " * (layout.BLOCK + 60), 0)]
    docs = documents(spark, rows)
    tokens = tokenise(docs, "doc_id", "text", ("startpos",)).withColumn("pos", F.col("startpos") + F.col("tok_no"))
    shown = lambda blocks: sorted((r.text_id, r.block, r.first, tuple(r.word), r.bucket) for r in blocks.collect())
    made = document_blocks(docs, "doc_id", "text", layout.BUCKET_BITS, unique)
    assert shown(made) == shown(context_blocks(tokens)) and made.schema["first"].metadata
    assert not unique or "Exchange" not in plan(made)


def test_tokens_in_order_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """More files open than partitions: the session says so while the tokens are written, and no longer afterwards."""
    from pyspark.sql import DataFrameWriter

    from wordloom.sources.tokens import WRITERS_KEY, save_tokens

    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(WRITERS_KEY))), write(self, *a, **k))[1])
    tokens = tokenise(documents(spark, [(1, "a b", 0), (2, "c d e", 2)]), "doc_id", "text", ("startpos",))
    tokens = tokens.withColumn("pos", F.col("startpos") + F.col("tok_no"))
    before = spark.conf.get(WRITERS_KEY)
    save_tokens(tokens, f"{tmp_path}/a", in_order=True, bits=1)
    save_tokens(tokens, f"{tmp_path}/b", bits=1)
    assert seen[0] > 0 and seen[1] == int(before) == int(spark.conf.get(WRITERS_KEY))
    shown = lambda path: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{path}").select("bucket", "pos", "word").collect())
    assert shown("a") == shown("b") and len(shown("a")) == 5


def test_attributes_of_a_stored_corpus_follow_from_its_words(spark):
    corpus = given.docs_stored(spark, FOLDER)
    stored = [f for f in corpus.tokens.inputFiles()][:1]
    assert "lemma" not in spark.read.parquet(*stored).columns
    columns = ["text_id", "tok_no", "s_id", "s_first", "s_last", "word", "lemma", "pos_tag", "phon", "orig", "feats", "lang"]
    want = given.docs_tokens(spark, FOLDER).select(*columns)
    assert corpus.tokens.select(*columns).exceptAll(want).count() == 0 and corpus.tokens.count() == want.count()


def test_only_tokens_that_are_asked_for_are_moved(spark):
    tokens = given.docs_tokens(spark, FOLDER)
    hits = find_hits(tokens, [[word("of"), word("the")]])
    asked = hits.select("text_id", F.col("start").cast("int").alias("at"))
    passed = layout.asked_for(tokens, ("text_id", "tok_no"), asked, ("text_id", "at"))
    found = {(r.text_id, r.tok_no) for r in passed.collect()}
    want = {(r.text_id, r.at) for r in asked.collect()}
    assert want and want <= found and len(found) < len(want) + tokens.count() // 100
    for joined in (hit_ops.with_token(hits, tokens, F.col("end") + 1, {"word": "after"}), concordance.in_context(hits, tokens)):
        assert "_bits" in plan(joined)


def test_blocks_near_hits(spark):
    tokens = given.docs_tokens(spark, FOLDER)
    hits = find_hits(tokens, [[word("of"), word("the")]])
    near, every = context_blocks(tokens, near=hits), context_blocks(tokens)
    lines = lambda blocks: sorted(tuple(r) for r in concordance.concordance_lines(hits, blocks, longest=2).select("text_id", "start", "left_text", "right_text").collect())
    assert lines(near) == lines(every) and 0 < near.count() < every.count()


def test_hits_of_any_length_move_the_blocks_they_touch_only(spark, make_tokens):
    size = 2 * layout.BLOCK + 700
    tokens = make_tokens({n: [["x"] * 9 + ["from"] + ["y"] * (size - 20) + ["that"] + ["z"] * 9 if n == 3 else ["a", "b"]] for n in range(40)})
    blocks = context_blocks(tokens)
    hits = find_hits(tokens, [[word("from"), Gap(0), word("that")], [word("a"), word("b")]]).where("text_id in (3, 7)")
    made = concordance.concordance_lines(hits, blocks, context=50)
    # the search is written once, not run again for the hits of each kind
    assert "_number" in plan(made) and "Window" not in plan(made)
    found = {r.text_id: r for r in made.collect()}
    assert found[7].match_text == "a b" and len(found) == 2
    assert found[3].left_text == " ".join("x" * 9) and found[3].right_text == " ".join("z" * 9) and found[3].match_text.count(" ") == size - 19
    few = concordance.concordance_lines(F.broadcast(hits), blocks, context=50, few=True)
    assert "_number" not in plan(few) and {tuple(r) for r in few.collect()} == {tuple(r) for r in found.values()}


def test_cells_of_a_page_are_sent_to_the_hits(spark):
    tokens = given.docs_tokens(spark, FOLDER)
    keyed = find_hits(tokens, [[Tok(form_test("t", where="start"))]], keep=("word",)).withColumn("sort_key", F.col("word"))
    assert "SortMergeJoin" not in plan(ordering.hit_page(keyed, 3))


def test_a_sample_by_part_counts_the_parts_once(spark, monkeypatch):
    written, kept = [], ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df: (written.append(set(df.columns)), kept(df))[1])
    tokens = given.docs_tokens(spark, FOLDER)
    hits = find_hits(tokens, [[word("the")]], keep=("lang",)).withColumnRenamed("lang", "part")
    parts = tokens.groupBy(F.col("lang").alias("part")).agg(F.count(F.lit(1)).alias("n_tokens"))
    drawn = ordering.sample_hits_by_part(hits, 7, parts)
    assert {"part", "n_tokens"} in written and any("start" in columns for columns in written)
    assert "regexp_extract_all" not in plan(drawn) and 0 < drawn.count() <= 7


@pytest.mark.parametrize("bits", [1, 5, 20])
def test_runs_hold_all_tokens(spark, tmp_path, bits):
    """Sentences longer than a block or a partition, texts without tokens, and several of one id."""
    long = "w. " + " ".join(f"W{i}" for i in range(layout.BLOCK + 700 if bits > 1 else 40)) + "! z"
    rows = [(1, "A b. c?! d", 3), (2, long, 9), (3, "", 7), (4, None, 7), (5, "x", 7), (5, "y . Y", 7), (6, "e f", 4091), (7, "é", 4096)]
    docs = documents(spark, rows)
    tokens = tokenise(docs, "doc_id", "text", ("startpos",), neighbours=True)
    tokens = tokens.withColumn("pos", F.col("startpos") + F.col("tok_no")).withColumn("word_folded", F.lower("word"))
    want = tokens.withColumn("bucket", layout.bucket("pos", bits))
    runs = token_runs(docs, "doc_id", "text", ("startpos",), bits)
    assert runs.count() < want.count() and runs.agg(F.max(F.size("words"))).first()[0] <= 1 << min(bits, layout.BLOCK_BITS)
    save_runs(runs, f"{tmp_path}/runs")
    found = from_runs(spark.read.parquet(f"{tmp_path}/runs"))
    assert layout.bits_of(found) == bits and set(found.columns) == set(want.columns)
    shown = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))
    assert shown(found) == shown(want)


def test_a_stored_corpus_holds_its_words_once(spark, tmp_path):
    from pathlib import Path

    corpus = given.docs_stored(spark, FOLDER)
    files = [Path(f.removeprefix("file:")) for f in corpus.tokens.inputFiles()]
    ranges = given.docs_ranges(spark, FOLDER)
    flat = given.docs_placed_tokens(spark, FOLDER, ranges, in_order=True, neighbours=True)
    flat = flat.select("text_id", "lang", "startpos", "s_id", "s_first", "s_last", "tok_no", "word", "before", "after", "pos")
    save_tokens(flat, f"{tmp_path}/flat", in_order=True)
    assert sum(f.stat().st_size for f in files) * 2 < sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    columns = [*flat.columns, "word_folded", "bucket"]
    stored = spark.read.parquet(f"{tmp_path}/flat").select(*columns)
    assert stored.exceptAll(corpus.tokens.select(*columns)).isEmpty() and corpus.tokens.count() == stored.count()
    found = corpus.search([[word("of"), word("the")]], Selection({"source": Choice(("src3",))}))
    assert "dynamicpruning" in plan(found)
    # the neighbours of a token are not looked at by a search that does not ask for them
    read = re.search(r"FileScan parquet \[(.*?)\]", plan(corpus.search([[word("the")]]))).group(1)
    assert "words" in read and "before" not in read and "after" not in read


@pytest.mark.parametrize("kind", ["long", "string"])
def test_documents_are_moved_once_and_put_in_order(spark, kind):
    ids = [*range(300), None, 7, 7, 8]
    rows = [(i, f"t{n}" * (n % 9), n % 5) for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(5)
    ranges = layout.running_total(docs.select(F.col("doc_id").alias("text_id"), "n"), ["text_id", "n"], F.col("n"), "startpos")
    want = docs.join(ranges.select(F.col("text_id").alias("doc_id"), "startpos"), "doc_id")
    shown = lambda df: sorted(map(str, df.select("doc_id", "text", "n", "startpos").collect()))
    for bits in (2, 5, 30):
        placed = placed_in_order(docs, ranges, "doc_id", bits)
        assert shown(placed) == shown(want) and len(shown(want)) == 299 + 9 + 4 - 1
        parts = [r.ids for r in placed.groupBy(F.spark_partition_id()).agg(F.collect_list("doc_id").alias("ids")).collect()]
        assert all(p == sorted(p) for p in parts) and (bits == 30 or len(parts) > 1)
