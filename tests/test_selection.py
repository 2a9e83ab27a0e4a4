import pytest
from pyspark.sql import functions as F

from wordloom.functions.geo import in_polygon
from wordloom.operators import stats
from wordloom.operators.selection import (
    Choice,
    Dimension,
    Facet,
    Selection,
    facet_extent,
    in_ranges,
    narrowed_facets,
    select_by_facets,
    select_texts,
)
from wordloom.plans.corpus import Corpus
from wordloom.operators.patterns import word


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        ("t1", "en", "news", 1990, 10),
        ("t2", "en", None, 1995, 20),
        ("t3", "de", "prose", None, 30),
        ("t4", "de", "news", 2001, 0),
        ("t5", "en", "prose", 1995, 5),
    ]
    return spark.createDataFrame(rows, "text_id string, lang string, genre string, year long, n_tokens long")


@pytest.fixture(scope="module")
def dimensions(spark):
    authors = spark.createDataFrame([(1, "Ann", "f", 40), (2, "Bob", "m", 50), (3, "Cai", "m", 40)], "id long, name string, sex string, age long")
    bridge = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 2), ("t3", 3), ("t5", 1)], "text_id string, id long")
    return {"author": Dimension(authors, bridge)}


def ids(df):
    rows = [r.text_id for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def chosen(texts, dimensions, language=None, **choices):
    return ids(select_texts(texts, Selection({k.replace("__", "."): c for k, c in choices.items()}), dimensions, language))


def test_text_categories(texts, dimensions):
    pick = lambda **c: chosen(texts, dimensions, **c)
    assert pick() == {"t1", "t2", "t3", "t4", "t5"}
    assert pick(genre=Choice(("news",))) == {"t1", "t4"}
    assert pick(genre=Choice(("news",), exclude=True)) == {"t2", "t3", "t5"}
    assert pick(year=Choice(low=1995, high=2000)) == {"t2", "t5"}
    assert pick(year=Choice(high=1995)) == {"t1", "t2", "t5"}
    assert pick(year=Choice(low=1996)) == {"t4"}
    assert pick(genre=Choice(("news", "prose")), lang=Choice(("de",))) == {"t3", "t4"}
    assert pick(genre=Choice(("", " ", None))) == {"t1", "t2", "t3", "t4", "t5"}
    assert pick(genre=Choice(("none",))) == set()
    assert chosen(texts, dimensions, language="de") == {"t3", "t4"}


def test_many_to_many(texts, dimensions):
    pick = lambda **c: chosen(texts, dimensions, **c)
    assert pick(author__name=Choice(("Ann", "Bob"))) == {"t1", "t2", "t5"}
    assert pick(author__name=Choice(("Bob",), exclude=True)) == {"t3", "t4", "t5"}
    # both conditions hold for the same author
    assert pick(author__sex=Choice(("m",)), author__age=Choice(("40",))) == {"t3"}
    assert pick(author__sex=Choice(("m",)), author__name=Choice(("Ann",), exclude=True)) == {"t2", "t3"}


def test_counts_take_a_text_once(texts, dimensions):
    both = select_texts(texts, Selection({"author.name": Choice(("Ann", "Bob"))}), dimensions)
    assert tuple(stats.text_and_token_count(both).first()) == (3, 35)
    assert tuple(stats.text_and_token_count(texts.where("false")).first()) == (0, 0)


def test_facet_rule(texts, dimensions):
    selection = Selection({"lang": Choice(("en",)), "genre": Choice(("news",))})
    values = lambda c, s: [r.value for r in stats.distinct_values(texts, c, s, dimensions).collect()]
    assert values("genre", selection) == ["news", "prose"]
    assert values("lang", selection) == ["de", "en"]
    assert values("author.name", Selection({"author.name": Choice(("Ann",), exclude=True)})) == ["Bob", "Cai"]
    assert values("author.name", Selection({"author.sex": Choice(("m",)), "lang": Choice(("en",))})) == ["Bob"]
    low_high = stats.category_range(texts, "year", Selection({"year": Choice(low=2000), "lang": Choice(("en",))}))
    assert tuple(low_high.first()) == (1990, 1995)


def test_lists_and_table(texts, dimensions):
    listed = {r.text_id: r.name for r in stats.listed_values(dimensions["author"], "name").collect()}
    assert listed == {"t1": "Ann; Bob", "t2": "Bob", "t3": "Cai", "t5": "Ann"}
    table = stats.metadata_table(texts, ["genre", "year", "author.name"], Selection({"lang": Choice(("de",))}), dimensions)
    rows = {r.text_id: (r.genre, r.year, r.name) for r in table.collect()}
    assert rows == {"t3": ("prose", "", "Cai"), "t4": ("news", "2001", "")}


def test_facets_of_the_map(texts):
    pick = lambda **f: ids(select_by_facets(texts, f))
    assert pick(lang=Facet(("en", "de")), year=Facet(low=1990, high=1995)) == {"t1", "t2", "t5"}
    assert pick(year=Facet(low=1995, high=2005, nulls=True)) == {"t2", "t3", "t4", "t5"}
    assert pick(lang=Facet()) == set()
    assert tuple(facet_extent(texts, "year").first()) == (1990, 2001, True)
    full = {"lang": Facet(("en", "de")), "year": Facet(low=1990, high=2001, nulls=True)}
    assert set(narrowed_facets({**full, "lang": Facet(("de",))}, full)) == {"lang"}
    assert narrowed_facets({**full, "lang": Facet(("de", "en"))}, full) == {}


def test_ranges(spark):
    tokens = spark.range(0, 300).select(F.col("id").alias("pos"))
    ranges = spark.createDataFrame([(0, 4), (10, 32), (34, 34), (100, 250), (200, 260)], "start long, end long")
    wanted = {p for a, b in ((0, 4), (10, 32), (34, 34), (100, 260)) for p in range(a, b + 1)}
    for bits in (1, 4, 16):
        found = [r.pos for r in in_ranges(tokens, ranges, bits=bits).collect()]
        assert sorted(found) == sorted(wanted)


def test_spoken_search_stays_in_listed_ranges(spark):
    words = "a b a b a b".split()
    rows = [(1, i // 2, 2 * (i // 2), 2 * (i // 2) + 1, i, i, w) for i, w in enumerate(words)]
    tokens = spark.createDataFrame(rows, "text_id long, seg_id long, seg_first long, seg_last long, tok_no long, pos long, word string")
    speakers = spark.createDataFrame([("s1", "x"), ("s2", "y")], "text_id string, town string")
    ranges = spark.createDataFrame([("s1", 0, 1), ("s2", 4, 5)], "text_id string, start long, end long")
    corpus = Corpus(tokens, speakers, within="seg", spoken=True, ranges=ranges)
    found = lambda s: {r.start for r in corpus.search([[word("a"), word("b")]], s).collect()}
    assert found(Selection()) == {0, 4}
    assert found(Selection({"town": Choice(("y",))})) == {4}


def test_polygon(spark):
    points = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.9, 0.05), (-0.1, 0.5)], "lat double, lng double")
    square = [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert points.where(in_polygon("lat", "lng", square)).count() == 2


def test_corpus_questions(spark, make_tokens, texts, dimensions):
    tokens = make_tokens({1: [["a", "b"], ["a"]]}).withColumn("text_id", F.lit("t1"))
    corpus = Corpus(tokens, texts, dimensions, attributes=("lemma",))
    page = lambda **o: [tuple(r) for r in corpus.metadata_page(["genre", "author.name"], **o).collect()]
    assert page()[:2] == [("t1", "news", "Ann; Bob"), ("t2", "", "Bob")]
    assert [r[0] for r in page(by="year", descending=True)] == ["t4", "t2", "t5", "t1", "t3"]
    assert [r[0] for r in page(by="genre")] == ["t2", "t1", "t4", "t3", "t5"]
    assert [r[0] for r in page(by="author.name", descending=True)] == ["t3", "t2", "t1", "t5", "t4"]
    assert page(page=2) == [] and len(page(page=0, selection=Selection({"lang": Choice(("de",))}))) == 2
    assert [r.value for r in corpus.category_values("author.sex").collect()] == ["f", "m"]
    assert tuple(corpus.category_range("year").first()) == (1990, 2001)
    assert tuple(corpus.text_count(Selection({"lang": Choice(("en",))})).first()) == (3, 35)
    hits = corpus.search([[word("a")]])
    assert [tuple(r) for r in corpus.frequency_list(hits).collect()] == [("a", 2)]
    lines = [(r.left_text, r.match_text, r.right_text) for r in corpus.page(hits, by="right", context=1).collect()]
    assert lines == [("", "a", "b"), ("b", "a", "")]
    with pytest.raises(ValueError):
        corpus.geo_distribution(hits)


def test_spoken_counts_and_map(spark):
    tokens = spark.createDataFrame(
        [(1, 0, 0, 0, 0, 0, "a", "s1"), (1, 1, 1, 1, 1, 1, "a", "s2")],
        "text_id long, seg_id long, seg_first long, seg_last long, tok_no long, pos long, word string, speaker string",
    )
    speakers = spark.createDataFrame([("s1", "x", "Oslo"), ("s2", "y", None), ("s3", "y", "Bergen")], "text_id string, town string, place string")
    ranges = spark.createDataFrame([("s1", 0, 0), ("s2", 1, 1)], "text_id string, start long, end long")
    coords = spark.createDataFrame([("Oslo", 59.9, 10.7)], "place string, lat double, lng double")
    corpus = Corpus(tokens, speakers, within="seg", spoken=True, ranges=ranges, coords=coords)
    assert tuple(corpus.text_count().first()) == (3, 2)
    hits = corpus.search([[word("a")]], keep=("word", "speaker"))
    assert [tuple(r) for r in corpus.geo_distribution(hits).collect()] == [("a", "Oslo", 1)]
    shown = corpus.distribution(hits, "word", "town")
    assert {(r.value, r.n) for r in shown.cells.collect()} == {("x", 1), ("y", 1)}
    assert {(r.value, r.n_tokens, r.n_texts) for r in shown.totals.collect()} == {("x", 1, 1), ("y", 1, 2)}
