import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as text_functions
from wordloom.operators import concordance, exports, treebank
from wordloom.operators.hits import aligned_hits, find_hits
from wordloom.operators.patterns import Gap, Tok, form_test, value_test, word
from wordloom.plans.corpus import Corpus
from wordloom.sources import tables


@pytest.fixture(scope="module")
def tokens(make_tokens):
    words = [f"w{i}" for i in range(40)]
    return make_tokens({1: [["a", "x", "b"], ["x"]], 2: [words + ["x"] + words]})


def lines(hits, tokens, **options):
    found = concordance.concordance_lines(hits, tokens, **options).collect()
    return {(r.text_id, r.start): (r.left_text, r.match_text, r.right_text) for r in found}


def test_context(tokens):
    shown = lines(find_hits(tokens, [[word("x")]]), tokens)
    assert shown[(1, 1)] == ("a", "x", "b x")
    assert shown[(1, 3)] == ("a x b", "x", "")
    left, _, right = shown[(2, 40)]
    assert left.split() == [f"w{i}" for i in range(25, 40)] and right.split() == [f"w{i}" for i in range(15)]
    assert lines(find_hits(tokens, [[word("x")]]), tokens, context=0)[(1, 1)] == ("", "x", "")


def test_context_across_blocks(make_tokens):
    tokens = make_tokens({1: [[f"w{i}" for i in range(9000)]]})
    shown = lines(find_hits(tokens, [[word("w4094"), Gap(0, 4100), word("w8191")]]), tokens, context=2)
    left, match, right = shown[(1, 4094)]
    assert (left, right) == ("w4092 w4093", "w8192 w8193") and len(match.split()) == 8191 - 4094 + 1


def test_context_size():
    size = concordance.context_size
    assert (size(None), size(None, treebank=True), size(-1), size(7), size(99)) == (15, 25, 15, 7, 50)


def test_attributes_and_spaces(spark):
    rows = [(1, 0, 0, 1, 0, "New York", None), (1, 0, 0, 1, 1, "1 / 2", "half")]
    tokens = spark.createDataFrame(rows, "text_id long, s_id long, s_first long, s_last long, tok_no long, word string, lemma string")
    hits = find_hits(tokens, [[Tok(form_test("new", where="start")), Tok(form_test("1", where="start"))]])
    assert lines(hits, tokens, attributes=("word", "lemma"))[(1, 0)][1] == "New_York/ 1/2/half"


def test_two_line_export_and_rows(spark, make_tokens, tmp_path):
    tokens = make_tokens({1: [["A", "b"], ["c"]]}).withColumn("phon", F.concat(F.lit("/"), F.lower("word")))
    hits = find_hits(tokens, [[word("b")]])
    texts = spark.createDataFrame([(1, "news")], "text_id long, genre string")
    segment = F.concat_ws(".", F.col("text_id").cast("string"), F.col("s_id").cast("string"))
    pairs = exports.two_line_export(hits, tokens, ("lemma", "phon"), segment, texts, ["genre"])
    assert pairs.first().lines == ["1.0 news A b c", "1.0 news /a /b /c", ""]
    exports.write_two_line(pairs, str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["1.0 news A b c", "1.0 news /a /b /c", ""]
    with pytest.raises(ValueError):
        exports.two_line_export(hits, tokens, ("lemma",), segment)
    rows = concordance.original_and_corrected(hits, tokens.withColumn("orig", F.upper("word")), 1).orderBy("line").collect()
    assert [(r.line, r.left_text, r.match_text, r.right_text) for r in rows] == [(1, "A", "b", "c"), (2, "A", "B", "C")]


def test_metadata_by_segment_id(spark):
    found = spark.createDataFrame([("t1.s4.x",), ("t2",), ("t9.s1",)], "segment string")
    texts = spark.createDataFrame([("t1", 7), ("t2", None)], "text_id string, year long")
    rows = {r.segment: (r.text_id, r.year) for r in concordance.with_metadata(found, texts, ["year"], "segment").collect()}
    assert rows == {"t1.s4.x": ("t1", "7"), "t2": ("t2", ""), "t9.s1": ("t9", "")}


@pytest.fixture(scope="module")
def talk(spark):
    spoken = [("s1", ["yes", "well"]), ("s2", ["well"]), ("s1", ["no", "well", "yes"])]
    rows, segments, at = [], [], 0
    for seg, (speaker, words) in enumerate(spoken):
        segments.append((1, seg, speaker, seg * 10.0, seg * 10 + 9.0, "rec1"))
        rows += [(1, seg, at, at + len(words) - 1, at + i, w) for i, w in enumerate(words)]
        at += len(words)
    tokens = spark.createDataFrame(rows, "text_id long, seg_id long, seg_first long, seg_last long, tok_no long, word string")
    return tokens, spark.createDataFrame(segments, "text_id long, seg_id long, speaker string, from_s double, to_s double, av_file string")


def test_segments(talk):
    tokens, segments = talk
    hits = find_hits(tokens, [[word("no")]], "seg")
    near = concordance.segments_around(hits, segments, 1).orderBy("seg_id").collect()
    assert [(r.seg_id, r.is_match, r.line_no) for r in near] == [(1, False, 0), (2, True, 1)]
    whole = concordance.segments_around(hits, segments, None).orderBy("seg_id").collect()
    assert [(r.seg_id, r.line_no) for r in whole] == [(0, 0), (1, 1), (2, 2)]
    media = concordance.media_object(hits, segments, tokens, 1).first()
    assert (media.start_s, media.stop_s, media.match_at, media.last_line) == (10.0, 29.0, 1, 1)
    assert [t.word for t in media.segments[1].tokens] == ["no", "well", "yes"]
    assert concordance.chosen_hit(3, 4) == 104


def test_media(spark, talk):
    tokens, segments = talk
    flags = lambda names: concordance.with_media(
        find_hits(tokens, [[word("no")]], "seg"), segments,
        tables.media_manifest(spark.createDataFrame([(n,) for n in names], "path string")),
    ).select("audio", "has_video").first()
    assert tuple(flags(["/x/audio/rec1.mp3", "/x/video/rec1.mp4", "/x/readme.txt"])) == ("sound", True)
    assert tuple(flags(["/x/rec2.mp3"])) == (None, False)
    assert tuple(flags(["/x/_.mp3", "/x/rec1.mp3"])) == ("nosound", False)


def test_alignment(spark, make_tokens):
    left = make_tokens({1: [["a", "x"], ["a"], ["a"]]})
    right = make_tokens({11: [["b", "c"], ["d"]]})
    rows = [(1, 0, "de", 11, 0), (1, 1, "de", 11, 1)]
    alignment = spark.createDataFrame(rows, "src_text long, src_region long, tgt_lang string, tgt_text long, tgt_region long")
    hits = find_hits(left, [[word("a")]])
    kept = aligned_hits(hits, alignment, {"de": find_hits(right, [[word("b")]])})
    assert [(r.text_id, r.start) for r in kept.collect()] == [(1, 0)]
    assert aligned_hits(hits, alignment, {}).count() == 3
    both = left.withColumn("lang", F.lit("en")).unionByName(right.withColumn("lang", F.lit("de")))
    texts = spark.createDataFrame([(1, "en", 4), (11, "de", 3)], "text_id long, lang string, n_tokens long")
    asked = lambda **p: {r.start for r in Corpus(both, texts).aligned_search(p, alignment).collect()}
    assert asked(en=[[word("a")]], de=[[word("d")]]) == {2}
    assert asked(en=[[word("a")]], de=[[Tok()]]) == {0, 2, 3}
    shown = {r.start: r.aligned for r in concordance.aligned_text(hits, alignment, right, ["de"]).collect()}
    assert shown == {0: "b c", 2: "d"}
    assert concordance.shown_languages(["en", "de", "en", "fr"]) == ["de", "fr"]
    assert concordance.shown_languages(["org"]) == ["korr"] and concordance.shown_languages(["en"]) == []


def test_dependencies(spark):
    rows = [(1, 0, "the", 1, 2, "det"), (1, 0, "dog", 2, 3, "subj"), (1, 0, "ran", 3, 0, "root"), (1, 0, "away", 4, 3, "adv"), (1, 1, "go", 1, 0, "root")]
    tokens = spark.createDataFrame(rows, "text_id long, s_id long, word string, dep_index long, dep_head long, dep_fun string")
    edges = {(r.word, r.head_word, r.distance) for r in treebank.dependency_edges(tokens).collect()}
    assert edges == {("the", "dog", 1), ("dog", "ran", 1), ("away", "ran", 1)}
    assert {r.dep_head: r.sides for r in treebank.child_sides(tokens).collect()} == {2: "L", 3: "LR"}


def test_dependencies_of_long_and_repeated_regions(spark):
    """All pairs that a join gives, from one shuffle of the tokens."""
    rows = [(1, 0, f"w {i}", i, (i * 37) % 151, "a b" if i % 3 else None) for i in range(1, 151) if i % 10]
    rows += [(2, 0, w, i, i - 1, "f=") for i in (1, 2, 3) for w in ("", "= x", None)] + [(2, 0, "x", None, 2, ""), (2, 0, "y", 3, None, "f")]
    rows += [(None, 0, "a", 1, 0, "f"), (None, 0, "b", 2, 1, "f"), (3, None, "a", 1, 0, "f"), (3, None, "b", 2, 1, "f"), (4, 0, "a", -1, 2, "f"), (4, 0, "b", 2, -1, "f")]
    for number in ("long", "int"):
        tokens = spark.createDataFrame(rows, f"text_id long, s_id long, word string, dep_index {number}, dep_head {number}, dep_fun string").repartition(3)
        edges = treebank.dependency_edges(tokens)
        heads = tokens.select("text_id", "s_id", F.col("dep_index").alias("dep_head"), F.col("word").alias("head_word"))
        joined = tokens.where("dep_head <> 0").join(heads, ["text_id", "s_id", "dep_head"]).withColumn("distance", F.abs(F.col("dep_index") - F.col("dep_head")))
        asked = joined.select("text_id", "s_id", "dep_index", "word", "dep_fun", "dep_head", "head_word", "distance")
        assert edges.dtypes == asked.dtypes
        assert sorted(edges.collect(), key=repr) == sorted(asked.collect(), key=repr)
        shown = treebank.dependency_edges(tokens)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in shown and shown.count("Exchange hashpartitioning") == 1
        assert "Aggregate" not in shown[shown.index("Exchange hashpartitioning") :]


def test_text_functions(spark):
    row = lambda *columns: tuple(spark.range(1).select(*columns).first())
    f, lit = text_functions, F.lit
    assert row(f.truncated(lit("abcdefgh"), 10), f.truncated(lit("abcdefgh"), 11)) == ("abcdefgh...", "abcdefgh")
    assert row(f.truncated(lit("abcdefgh"), 8)) == ("abcdef...",)
    assert row(f.text_id_of(lit("t1.s2.x")), f.text_id_of(lit("t1")), f.text_id_of(lit("t1."))) == ("t1", "t1", "t1.")
    tip = f.tooltip([lit("w"), lit("l"), lit("__UNDEF__"), lit("-"), lit("pos")], lemma=1)
    assert row(tip) == ('w "l" pos',)
    links, none = row(f.links(lit("$https:!!!!a.b!!c$ $http:!!!!d")), f.links(lit("plain")))
    assert links == ["https://a.b/c", "http://d"] and none is None
