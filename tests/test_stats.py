import pytest
from pyspark.sql import functions as F

from wordloom.operators import exports, geo, stats
from wordloom.operators.hits import find_hits
from wordloom.operators.patterns import Gap, Tok, form_test, value_test, word
from wordloom.operators.selection import Choice, Selection
from wordloom.plans.corpus import Corpus
from wordloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def counted(spark):
    rows = [("x", 1, 4), ("x", 2, 4), ("y", 1, 3), ("z", 9, 5), ("w", 2, 1), ("w", 1, 1), ("w", 3, 0)]
    return spark.createDataFrame([r for r in rows if r[2]], "attr string, text_id long, n long")


@pytest.fixture(scope="module")
def tables(spark):
    values = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "text_id long, value string")
    texts = spark.createDataFrame([(1, 50), (2, 50), (3, 100), (9, 7)], "text_id long, n_tokens long")
    return values, texts


def test_values_per_text(spark, monkeypatch):
    """Distinct values of short, long, repeated and empty texts; values are not gathered before they are moved."""
    monkeypatch.setattr(stats, "PART_BITS", 3)
    rows = [(1, i, i // 4, f"w{i % 11}", f"l{i % 5}") for i in range(40)] + [(2, i, 0, "a", None) for i in range(8)] + [(3, i, i, None, None) for i in range(9)]
    rows += [(4, i, i // 2, f"W{i}", "l") for i in range(3)] * 2 + [(4, i, i, f"V{i % 9}", f"m{i}") for i in range(17)] + [(None, 0, 7, "x", "y")]
    tokens = spark.createDataFrame(rows, "text_id long, tok_no long, s_id long, word string, lemma string").repartition(3)
    found = stats.values_per_text(tokens, {"n_words": "word", "n_lemmas": "lemma"}, {"last_s": "s_id"})
    plain = tokens.groupBy("text_id").agg(
        F.count_distinct("word").alias("n_words"), F.count_distinct("lemma").alias("n_lemmas"), F.max("s_id").alias("last_s")
    )
    assert found.dtypes == plain.dtypes
    assert sorted(found.collect(), key=repr) == sorted(plain.collect(), key=repr)
    shown = QUERIES["src2_scan_default"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in shown[shown.index("REPARTITION_BY_COL") :]


def test_deviation(counted, tables):
    values, texts = tables
    totals = stats.category_totals(values, texts)
    cells = stats.distribution_cells(counted, values)
    scores = {r.attr: (r.total, r.dp) for r in stats.deviation_of_proportions(cells, totals, counted).collect()}
    # expected shares are 1/4, 1/4, 1/2
    assert scores["x"] == (8, pytest.approx((0.25 + 0.25 + 0.5) / 2))
    assert scores["y"] == (3, pytest.approx((0.75 + 0.25 + 0.5) / 2))
    assert scores["z"] == (0, None)
    assert all(dp is None or 0 <= dp <= 1 for _, dp in scores.values())
    total = stats.total_deviation(cells, totals).first()
    assert total.total == 13 and total.dp == pytest.approx((abs(0.25 - 8 / 13) + abs(0.25 - 5 / 13) + 0.5) / 2)


def test_even_spread_scores_zero(spark, tables):
    values, texts = tables
    even = spark.createDataFrame([("e", 1, 1), ("e", 2, 1), ("e", 3, 2)], "attr string, text_id long, n long")
    cells = stats.distribution_cells(even, values)
    assert stats.deviation_of_proportions(cells, stats.category_totals(values, texts)).first().dp == pytest.approx(0)


def test_zero_columns(counted, tables):
    values, texts = tables
    totals, cells = stats.category_totals(values, texts), stats.distribution_cells(counted, values)
    kept = [(r.value, r.n_hits, r.n_tokens) for r in stats.category_columns(cells, totals, True).collect()]
    assert kept == [("A", 8, 50), ("B", 5, 50), ("C", 0, 100)]
    assert [r.value for r in stats.category_columns(cells, totals, False).collect()] == ["A", "B"]


def test_margins_add_up(counted, tables):
    cells = stats.distribution_cells(counted, tables[0])
    margins = stats.distribution_totals(cells).groupBy("level").agg(F.sum("n").alias("n"))
    assert {r.level: r.n for r in margins.collect()} == {"attr": 13, "value": 13, "all": 13}


def test_removed_values(spark, counted):
    left = lambda e: {r.attr for r in stats.without_values(counted, e).collect()}
    assert left(["x", "y"]) == {"z", "w"}
    assert left([]) == {"x", "y", "z", "w"}
    assert left(spark.createDataFrame([("z",)], "attr string")) == {"x", "y", "w"}


def test_number_columns_in_number_order(spark, counted):
    values = spark.createDataFrame([(1, 10), (2, 9), (3, 100)], "text_id long, value long")
    texts = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "text_id long, n_tokens long")
    shown = stats.category_columns(stats.distribution_cells(counted, values), stats.category_totals(values, texts))
    assert [r.value for r in shown.collect()] == ["9", "10", "100"]


def test_distribution_export(counted, tables):
    values, texts = tables
    totals, cells = stats.category_totals(values, texts), stats.distribution_cells(counted, values)
    wide = exports.distribution_export(cells, totals, ["A", "B", "C"], counted)
    assert wide.columns == [
        "Attribute value", "A (50 tokens)", "B (50 tokens)", "C (100 tokens)", "Total (200 tokens)", "Deviation of proportions",
    ]
    rows = [tuple(r) for r in wide.collect()]
    assert rows[-1][:5] == ("Total", 8, 5, 0, 13)
    assert ("x", 4, 4, 0, 8, "0.50") in rows
    lines = [r.line.split("\t") for r in exports.distribution_lines(cells, totals, counted, keep_zero=True).collect()]
    assert lines[0] == wide.columns and lines[1:] == [[str(v) for v in r] for r in rows]
    assert "C (100 tokens)" not in exports.distribution_lines(cells, totals, counted).first().line


def test_export_of_thousands_of_values(spark):
    counted = spark.range(6000).select(F.lit("x").alias("attr"), F.col("id").alias("text_id"), F.lit(1).cast("bigint").alias("n"))
    values = spark.range(6000).select(F.col("id").alias("text_id"), F.col("id").alias("value"))
    texts = spark.range(6000).select(F.col("id").alias("text_id"), F.lit(5).cast("bigint").alias("n_tokens"))
    totals, cells = stats.category_totals(values, texts), stats.distribution_cells(counted, values)
    lines = [r.line.split("\t") for r in exports.distribution_lines(cells, totals, counted).collect()]
    assert [len(line) for line in lines] == [6003] * 3 and lines[0][1:4] == ["0 (5 tokens)", "1 (5 tokens)", "2 (5 tokens)"]
    assert lines[2][-2] == "6000"


@pytest.fixture(scope="module")
def tokens(make_tokens):
    return make_tokens({1: [["The", "cat", "of", "the", "cat"], ["the", "cat"]], 2: [["The", "of"]]})


def test_frequency_lists(tokens):
    hits = find_hits(tokens, [[word("the")]], keep=("word",))
    folded = {r.word: r.n for r in stats.frequency_list(hits).collect()}
    exact = {r.word: r.n for r in stats.frequency_list(hits, case_sensitive=True).collect()}
    assert folded == {"the": 4} and exact == {"The": 2, "the": 2}
    assert sum(folded.values()) == hits.count()


def test_match_parts(tokens):
    hits = find_hits(tokens, [[word("the"), Gap(0, 2), word("of")]])
    words = lambda first, last: {(r.text_id, r.start, r.word) for r in stats.match_part(hits, tokens, ["word"], first, last).collect()}
    assert words(None, None) == {(1, 0, "The cat of"), (2, 0, "The of")}
    assert words(2, None) == {(1, 0, "cat of"), (2, 0, "of")}
    assert words(2, 2) == {(1, 0, "cat"), (2, 0, "of")}
    assert words(None, 1) == {(1, 0, "The"), (2, 0, "The")}
    assert words(3, 9) == {(1, 0, "of"), (2, 0, "")}
    with pytest.raises(ValueError):
        stats.match_part(hits, tokens, ["word"], 3, 2)


def test_frequency_order(spark):
    counted = spark.createDataFrame([("b", 2), ("a", 2), ("Z", 2), ("c", 7)], "word string, n long")
    assert [r.word for r in stats.by_frequency(counted).collect()] == ["c", "b", "a", "Z"]


def test_distribution_of_a_corpus(spark, tokens):
    texts = spark.createDataFrame([(1, "x", 7), (2, None, 2)], "text_id long, genre string, n_tokens long")
    corpus = Corpus(tokens, texts)
    hits = corpus.search([[Tok(value_test("lemma", ["the", "cat", "of"]))]], keep=("lemma",))
    shown = corpus.distribution(hits, "lemma", "genre", excluded=("cat",))
    assert {(r.attr, r.value): r.n for r in shown.cells.collect()} == {("the", "x"): 3, ("of", "x"): 1}
    assert {r.attr: r.total for r in shown.scores().collect()} == {"the": 3, "of": 1}
    only = corpus.search([[word("the")]], Selection({"genre": Choice(("x",))}))
    assert {r.text_id for r in only.collect()} == {1}


def test_geo(spark):
    hits = spark.createDataFrame([("s1", "ei"), ("s1", "ei"), ("s2", "e"), ("s3", "ei"), ("s4", "e")], "text_id string, phon string")
    speakers = spark.createDataFrame([("s1", "Oslo"), ("s2", "Oslo"), ("s3", "Bergen"), ("s4", None)], "text_id string, place string")
    coords = spark.createDataFrame([("Oslo", 59.9, 10.7)], "place string, lat double, lng double")
    shown = geo.geo_distribution(hits, speakers, geo.form_attribute(("phon",)))
    assert {(r.form, r.place): r.n for r in shown.collect()} == {("ei", "Oslo"): 2, ("e", "Oslo"): 1, ("ei", "Bergen"): 1}
    assert [r.place for r in geo.unknown_places(shown, coords).collect()] == ["Bergen"]
    assert [(r.place, r.forms) for r in geo.places_with_forms(shown, coords).collect()] == [("Oslo", "e: 1; ei: 2")]
    per_form = {r.form: (r.places, r.total) for r in geo.forms_with_places(shown).collect()}
    assert per_form == {"ei": ("Oslo: 2; Bergen: 1", 3), "e": ("Oslo: 1", 1)}
    colours = geo.colour_table(shown, {"red": ["ei", "e"]})
    assert [(r.place, r.colour) for r in geo.marker_sets(shown, colours, coords).collect()] == [("Oslo", "red")]
    assert tuple(geo.speakers_and_places(speakers).first()) == (4, 2)


def test_undefined_first_token_is_blank(spark, make_tokens):
    tokens = make_tokens({1: [["a", "b"]]}).withColumn("phon", F.lit(None).cast("string"))
    hits = find_hits(tokens, [[Tok(form_test("a"))]], keep=("phon",))
    assert [(r.attr, r.n) for r in stats.attribute_by_text(hits, "phon").collect()] == [("", 1)]
