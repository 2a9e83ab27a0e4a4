"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from wordloom.operators import concordance, ordering, stats
from wordloom.operators.hits import find_hits
from wordloom.operators.patterns import Gap, Tok, form_test, value_test, word
from wordloom.plans import given
from wordloom.sources.tokens import save_tokens

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "tokens")
    save_tokens(given.docs_tokens(spark, FOLDER), path)
    return spark.read.parquet(path)


def test_one_word_search_has_no_shuffle(stored):
    shown = plan(find_hits(stored, [[word("the")]]))
    assert "Exchange" not in shown and "Window" not in shown


def test_scan_reads_only_what_is_asked(stored):
    shown = plan(stats.frequency_list(find_hits(stored, [[Tok(value_test("word", ["the", "of"]))]], keep=("word",))))
    assert re.search(r"PushedFilters: \[.*In\(word, \[of,the\]\)", shown)
    schema = re.search(r"ReadSchema: struct<(.*?)>", shown).group(1)
    assert "lemma" not in schema and "feats" not in schema


def test_folded_words_reach_the_scan(stored):
    shown = plan(find_hits(stored, [[word("The")]]))
    assert re.search(r"PushedFilters: \[.*EqualTo\(word_folded,the\)", shown)
    assert find_hits(stored, [[word("The")]]).count() == find_hits(stored.drop("word_folded"), [[word("The")]]).count() > 0


def test_searches_group_by_more_than_the_text(stored):
    for pattern in ([word("of"), word("the")], [word("of"), Gap(0, 2), word("the")], [word("of"), Gap(1), word("the")]):
        shown = plan(find_hits(stored, [pattern]))
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", shown)
        assert keys and all(len(k.split(",")) > 2 for k in keys), keys
        assert "SinglePartition" not in shown


def test_fixed_patterns_combine_before_the_shuffle(stored):
    shown = plan(find_hits(stored, [[word("of"), word("the"), Tok(form_test("t", where="start"))]]))
    assert shown.count("Exchange") == 1 and "partial_bit_or" in shown and "Window" not in shown


def test_context_is_keyed_by_block(stored):
    hits = find_hits(stored, [[word("the")]])
    assert "Window" not in plan(concordance.in_context(hits, stored))
    page = ordering.hit_page(ordering.sort_keys(hits, stored), 1)
    assert "BroadcastHashJoin" in plan(concordance.in_context(page, stored))


def test_context_joins_exact_positions(stored):
    shown = plan(concordance.in_context(find_hits(stored, [[word("the")]]), stored))
    assert re.search(r"Join \[text_id#\d+L, tok_no#\d+L\]", shown)


def test_pages_and_samples_gather_no_more_than_they_return(stored):
    """What is taken in order has passed a filter on the row number, or on the bucket and rank of the draw."""
    hits = find_hits(stored, [[word("the")]])
    page = plan(ordering.hit_page(ordering.sort_keys(hits, stored), 2))
    assert page.count("TakeOrderedAndProject") == 1 and "_offset" in page
    for sample in (ordering.sample_hits(hits, 100), ordering.sample_hits(hits, 10_000_000)):
        assert "TakeOrderedAndProject" not in plan(sample) and "SinglePartition" not in plan(sample).split("Window")[0]


def test_numbering_moves_rows_once(stored):
    from wordloom.layout import number_rows

    shown = plan(number_rows(find_hits(stored, [[word("the")]]), ["text_id", "start", "end"]))
    full = [line for line in shown.split("\n") if "Exchange" in line and "_n" not in line and "Broadcast" not in line]
    assert not [line for line in full if "start" in line]


def test_a_page_reads_only_its_partitions(spark, monkeypatch, tmp_path):
    from wordloom import layout
    from wordloom.operators import hits as hit_ops
    from wordloom.plans.corpus import Corpus

    monkeypatch.setattr(layout, "BUCKET_BITS", 12)
    given.docs_ranges(spark, FOLDER).write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    placed = given.docs_placed_tokens(spark, FOLDER, texts)
    save_tokens(placed, f"{tmp_path}/tokens")
    corpus = Corpus(spark.read.parquet(f"{tmp_path}/tokens"), texts)
    assert "bucket" in corpus.tokens.columns
    for by in ("position", "left", "right"):
        page = corpus.page(hit_ops.settled(corpus.search([[word("of"), word("the")]])), 1, by)
        assert "dynamicpruning" in plan(page)
        plain = Corpus(placed, texts)
        want = plain.page(hit_ops.settled(plain.search([[word("of"), word("the")]])), 1, by)
        shown = lambda p: [(r.text_id, r.start, r.left_text, r.match_text, r.right_text) for r in p.collect()]
        assert shown(page) == shown(want)
