import pytest
from pyspark.sql import functions as F

from wordloom.layout import number_rows, running_total
from wordloom.operators import ordering
from wordloom.operators.hits import count_hits, find_hits
from wordloom.operators.patterns import Tok, form_test, word

SENTENCES = [["The", "dog", "saw", "the", "Cat"], ["the", "end"], ["a", "the"]]


@pytest.fixture(scope="module")
def tokens(make_tokens):
    return make_tokens({1: SENTENCES, 2: SENTENCES[1:], 3: SENTENCES[2:]})


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(0, 1000).select(
        (F.col("id") % 7).alias("text_id"), F.col("id").alias("start"), F.col("id").alias("end"), (F.col("id") % 3).alias("part")
    )


def starts(df):
    return [(r.text_id, r.start) for r in df.collect()]


def test_sorting(tokens):
    hits = find_hits(tokens, [[word("the")]])
    corpus = [(1, 0), (1, 3), (1, 5), (1, 8), (2, 0), (2, 3), (3, 1)]
    assert starts(ordering.sort_hits(hits, tokens)) == corpus
    # right neighbours: dog, cat, end, none
    assert starts(ordering.sort_hits(hits, tokens, "right")) == [(1, 3), (1, 0), (1, 5), (2, 0), (1, 8), (2, 3), (3, 1)]
    # in text 1 "end" and "a" follow on from the sentence before
    assert starts(ordering.sort_hits(hits, tokens, "left")) == [(1, 8), (2, 3), (3, 1), (1, 5), (1, 3), (1, 0), (2, 0)]
    # within the region the sentence-initial hits have no neighbour and come last, in corpus order
    assert starts(ordering.sort_hits(hits, tokens, "left", "s")) == [(1, 8), (2, 3), (3, 1), (1, 3), (1, 0), (1, 5), (2, 0)]
    pairs = find_hits(tokens, [[word("the"), Tok(form_test("", where="start"))]])
    assert starts(ordering.sort_hits(pairs, tokens, "match")) == [(1, 3), (1, 0), (1, 5), (2, 0)]
    with pytest.raises(ValueError):
        ordering.sort_hits(hits, tokens, "size")


def test_pages_make_the_whole(tokens, many):
    keyed = ordering.sort_keys(many, tokens)
    pages = [starts(ordering.hit_page(keyed, p, 300)) for p in (1, 2, 3, 4, 5)]
    assert [len(p) for p in pages] == [300, 300, 300, 100, 0]
    assert sum(pages, []) == starts(keyed.orderBy("text_id", "start"))
    assert tuple(ordering.page_count(many, 300).first()) == (1000, 4)
    first = ordering.first_pages(keyed)
    assert {r.page: r.n for r in first.groupBy("page").agg(F.count("*").alias("n")).collect()} == {1: 50, 2: 50}


def test_slices_of_any_depth(tokens, many):
    keyed = ordering.sort_keys(many, tokens)
    whole = starts(keyed.orderBy("text_id", "start"))
    assert starts(ordering.hit_page(keyed, 3)) == whole[100:150] and starts(ordering.hit_page(keyed, 20)) == whole[950:]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_numbers_do_not_depend_on_partitions(many, partitions):
    numbered = number_rows(many.repartition(5), ["text_id", F.desc("start")], "n", partitions).orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1000))
    assert [(r.text_id, -r.start) for r in numbered] == sorted((r.text_id, -r.start) for r in numbered)
    total = running_total(many, ["start"], F.col("part"), "before", partitions).orderBy("start").collect()
    assert [r.before for r in total] == [sum(i % 3 for i in range(k)) for k in range(1000)]


def test_samples(many):
    draw = lambda n, seed, parts=4: sorted(starts(ordering.sample_hits(many.repartition(parts), n, seed)))
    assert len(draw(100, 1)) == 100 and set(draw(100, 1)) < set(starts(many))
    assert draw(100, 1) == draw(100, 1) != draw(100, 2)
    assert draw(100, 1) == draw(100, 1, 9)
    assert draw(999, 5) == draw(999, 5, 1)
    assert len(draw(5000, 1)) == 1000


def test_sample_by_part(spark, many):
    parts = spark.createDataFrame([(0, 100), (1, 500), (2, 400)], "part long, n_tokens long")
    draw = lambda n: ordering.sample_hits_by_part(many.repartition(n), 101, parts, 3).select("part", "text_id", "start").collect()
    small = draw(3)
    assert len(small) == 101 and sorted(small) == sorted(draw(7))
    by_part = {p: sum(r.part == p for r in small) for p in range(3)}
    assert by_part[0] <= 11 and by_part[1] <= 51 and by_part[2] <= 41


def test_cap_and_count(many):
    assert ordering.capped(many).count() == 1000
    assert starts(ordering.capped(many, 3)) == [(0, 0), (0, 7), (0, 14)]
    assert count_hits(many).first().n_hits == 1000


def test_text_pages(spark):
    texts = spark.createDataFrame([(i, None if i % 10 == 0 else i % 3) for i in range(120)], "text_id long, k long")
    assert [r.text_id for r in ordering.text_page(texts, 3).collect()] == list(range(100, 120))
    assert ordering.text_page(texts, 0).count() == 120
    up = [r.k for r in ordering.text_page(texts, 0, "k").collect()]
    down = [r.k for r in ordering.text_page(texts, 0, "k", True).collect()]
    assert up[:12] == [None] * 12 and down[-12:] == [None] * 12 and down[0] == 2
    assert tuple(ordering.one_text(texts, 10, ["k"]).first()) == (10, "")
