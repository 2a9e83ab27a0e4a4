"""Stored corpora: what is read, context blocks, neighbour words, vocabulary, pages and samples without moving all hits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wordloom import layout
from wordloom.operators import concordance, lexicon, ordering
from wordloom.operators.hits import find_hits, longest_hit
from wordloom.operators.patterns import AllOf, Condition, Gap, Tok, anything, form_test, value_test, word
from wordloom.operators.selection import Choice, Selection, in_ranges, in_texts, merged_ranges, select_texts
from wordloom.plans import given
from wordloom.plans.corpus import Corpus
from wordloom.sources.tokens import HALO, arranged, context_blocks, vocabulary, with_neighbours

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A stored corpus in partitions of 4096 positions."""
    before, layout.BUCKET_BITS = layout.BUCKET_BITS, 12
    path = str(tmp_path_factory.mktemp("corpus"))
    ranges = given.docs_ranges(spark, FOLDER)
    placed = given.docs_placed_tokens(spark, FOLDER, ranges, in_order=True, neighbours=True)
    yield Corpus.stored(placed, ranges, path, in_order=True)
    layout.BUCKET_BITS = before


@pytest.fixture(scope="module")
def plain(spark):
    ranges = given.docs_ranges(spark, FOLDER)
    return Corpus(given.docs_placed_tokens(spark, FOLDER, ranges), ranges)


def rows(hits):
    return sorted((r.text_id, r.start, r.end) for r in hits.select("text_id", "start", "end").collect())


# ---------------------------------------------------------------- selections


def test_a_selection_reads_its_partitions_only(corpus, plain):
    for choice in (Choice(("src3",)), Choice(("src3",), exclude=True)):
        selection = Selection({"source": choice})
        for pattern in ([word("the")], [word("of"), word("the")], [word("of"), Gap(0, 2), word("the")]):
            found = corpus.search([pattern], selection)
            assert "dynamicpruning" in plan(found)
            assert not re.search(r"hashpartitioning\(text_id#\d+L, \d+\)", plan(found))
            assert rows(found) == rows(plain.search([pattern], selection))
    assert rows(corpus.search([[word("the")]], Selection({"source": Choice(("nowhere",))}))) == []


def test_texts_are_no_key_by_themselves(spark, plain):
    chosen = plain.select(Selection({"lang": Choice(("en",))}))
    tokens = given.docs_tokens(spark, FOLDER)
    found = in_texts(tokens, chosen.select("text_id", "n_tokens"))
    assert "_block" in plan(found) and found.count() == tokens.where("lang = 'en'").count()
    hits = find_hits(tokens, [[word("the")]])
    assert rows(in_texts(hits, chosen.select("text_id", "n_tokens"))) == rows(in_texts(hits, chosen.select("text_id")))


@pytest.mark.parametrize("bits", [3, 6, 20])
def test_ranges_become_disjoint_ones(spark, bits, monkeypatch):
    monkeypatch.setattr(layout, "BUCKET_BITS", bits)
    rng = random.Random(bits)
    given_ranges = [(a := rng.randint(0, 900), a + rng.choice([-1, 0, 3, 40, 300])) for _ in range(1000)]
    ranges = spark.createDataFrame(given_ranges, "start long, end long").repartition(4)
    wanted = {p for a, b in given_ranges for p in range(a, b + 1)}
    merged = merged_ranges(ranges).collect()
    places = [p for r in merged for p in range(r.start, r.end + 1)]
    assert sorted(places) == sorted(wanted)
    for r in merged:
        # of one cell, and nothing of the cell stands right beside it
        assert r.start >> bits == r.end >> bits == r.cell
        assert not {p for p in (r.start - 1, r.end + 1) if p >> bits == r.cell} & wanted
    tokens = spark.range(0, 1300).select(F.col("id").alias("pos"))
    assert sorted(r.pos for r in in_ranges(tokens, ranges, bits=3).collect()) == sorted(wanted)


def test_many_ranges_are_not_sent_to_the_tokens(spark, monkeypatch):
    from wordloom.operators import selection

    tokens = spark.range(0, 5000).select(F.col("id").alias("pos"))
    ranges = spark.range(0, 1000).select((F.col("id") * 5).alias("start"), (F.col("id") * 5 + 1).alias("end"))
    few = in_ranges(tokens, ranges)
    monkeypatch.setattr(selection, "SENT_RANGES", 10)
    many = in_ranges(tokens, ranges)
    assert "BroadcastHashJoin" in plan(few) and "ResolvedHint" not in plan(many)
    assert few.count() == many.count() == 2000


def test_a_hot_text_is_many_keys_for_its_metadata(spark, monkeypatch):
    monkeypatch.setattr(concordance, "METADATA_BITS", 4)
    hits = spark.range(0, 300).select(F.lit(1).cast("long").alias("text_id"), F.col("id").alias("start"))
    hits = hits.unionByName(spark.createDataFrame([(2, 0), (3, 5)], "text_id long, start long"))
    texts = spark.createDataFrame([(1, 300, "a"), (2, 1, None), (4, 9, "d")], "text_id long, n_tokens long, genre string")
    found = concordance.with_metadata(hits, texts, ["genre"])
    assert "_part" in plan(found)
    counts = {(r.text_id, r.genre): r["count"] for r in found.groupBy("text_id", "genre").count().collect()}
    assert counts == {(1, "a"): 300, (2, ""): 1, (3, ""): 1}


# ---------------------------------------------------------------- context blocks


def lines(found):
    return sorted((r.text_id, r.start, r.end, r.left_text, r.match_text, r.right_text) for r in found.collect())


@pytest.mark.parametrize("longest", [True, False])
def test_contexts_from_blocks_are_those_of_the_tokens(corpus, plain, longest):
    for pattern, n in (([word("the")], None), ([word("of"), Gap(0, 40), word("the")], 50), ([word("of"), Gap(0), word("the")], 7), ([word("the")], 0)):
        hits = corpus.search([pattern])
        most = longest_hit([pattern]) if longest else None
        assert lines(corpus.lines(hits, n, most)) == lines(plain.lines(plain.search([pattern]), n))


def test_contexts_across_blocks(spark, make_tokens):
    """Hits at the edges of blocks, hits longer than blocks, contexts beyond the halo, several attributes."""
    size = 2 * layout.BLOCK + 700
    tokens = make_tokens({1: [[f"w{i}" for i in range(size)]], 2: [["a", "b"]]})
    blocks = context_blocks(tokens, ("word", "lemma"))
    ends = [(0, 0), (0, size - 1), (layout.BLOCK - 1, layout.BLOCK), (layout.BLOCK, layout.BLOCK), (10, 5000), (layout.BLOCK - 3, layout.BLOCK + 60), (size - 1, size - 1)]
    hits = spark.createDataFrame([(1, a, b) for a, b in ends] + [(2, 1, 1)], "text_id long, start long, end long")
    for n, most in ((0, 50), (50, 50), (60, None), (9000, None)):
        by_block = {(r.text_id, r.start, r.end): r for r in concordance.in_context(hits, blocks, ("word", "lemma"), n, most=most).collect()}
        assert len(by_block) == len(ends) + 1
        for (text, a, b), r in by_block.items():
            whole = [f"w{i}" for i in range(size)] if text == 1 else ["a", "b"]
            assert [t.word for t in r.left] == whole[max(0, a - n) : a] and [t.word for t in r.match] == whole[a : b + 1]
            assert [t.lemma for t in r.right] == [w.lower() for w in whole[b + 1 : b + 1 + n]]
            assert [t.tok_no for t in r.match] == list(range(a, b + 1))
            assert not r.right or r.right[0].tok_no == b + 1


def test_a_hit_meets_one_block(corpus):
    hits = corpus.search([[word("the")]])
    shown = plan(concordance.concordance_lines(hits, corpus.blocks, longest=1))
    assert "Aggregate" not in shown and "Generate" not in shown and "Window" not in shown


def test_blocks_hold_their_neighbours(make_tokens):
    tokens = make_tokens({1: [["x"] * (layout.BLOCK + 1)]})
    found = {r.block: (r.first, len(r.word)) for r in context_blocks(tokens).collect()}
    assert found == {0: (0, layout.BLOCK + 1), 1: (layout.BLOCK - HALO, HALO + 1)}


# ---------------------------------------------------------------- neighbours, order, samples


def test_stored_neighbours_sort_without_a_join(corpus, plain):
    pattern = [word("of"), Tok(form_test("t", where="start"))]
    for by in ("left", "right"):
        keyed = ordering.sort_keys(corpus.search([pattern], sortable=True), corpus.tokens, by)
        assert "Join" not in plan(keyed)
        joined = ordering.sort_keys(plain.search([pattern]), plain.tokens, by)
        show = lambda df: sorted((r.text_id, r.start, r.sort_key or "") for r in df.collect())
        assert show(keyed) == show(joined)


@pytest.mark.parametrize(
    "pattern",
    [
        [word("of"), Gap(0, 3), word("the")], [word("of"), Gap(1), word("the")], [anything(), word("the"), anything()],
        [Gap(0, 1), word("the"), Gap(1, 2)], [word("the")], [word("of"), word("the"), Gap(0), word("of")],
    ],
)
def test_attributes_of_the_last_token(corpus, pattern):
    hits = find_hits(corpus.tokens, [pattern], keep=("word",), keep_last=("word", "tok_no"))
    found = {(r.text_id, r.start): (r.word, r.last_word, r.last_tok_no, r.end) for r in hits.collect()}
    words = {(r.text_id, r.tok_no): r.word for r in corpus.tokens.select("text_id", "tok_no", "word").collect()}
    assert found
    for (text, start), (first, last, at, end) in found.items():
        assert (first, last, at) == (words[text, start], words[text, end], end)


def test_neighbours_of_any_table(make_tokens):
    size = layout.BLOCK + 2
    tokens = with_neighbours(make_tokens({1: [[f"w{i}" for i in range(size)]], 2: [["a"]]}))
    found = {(r.text_id, r.tok_no): (r.before, r.after) for r in tokens.collect()}
    assert found.pop((2, 0)) == (None, None) and len(found) == size
    for (_, i), pair in found.items():
        assert pair == (f"w{i - 1}" if i else None, f"w{i + 1}" if i + 1 < size else None)


@pytest.mark.parametrize("cell", [3, 40, 1 << 17])
def test_pages_by_order_statistics(spark, cell, monkeypatch):
    """Every page, with cells of all sizes, hot and missing keys and hits far apart."""
    monkeypatch.setattr(ordering, "CELL", cell)
    rng = random.Random(5)
    hits = [(rng.choice([1, 1, 1, 2, 9]), i * 40, i * 40 + rng.randint(0, 2), rng.choice([None, "a", "a", "b", "é"])) for i in range(400)]
    keyed = spark.createDataFrame(hits, "text_id long, start long, end long, sort_key string").repartition(5)
    order = sorted(hits, key=lambda h: (h[3] is None, h[3] or "", h[:3]))
    for page, size in ((1, 50), (4, 50), (8, 50), (9, 50), (3, 7), (57, 7), (1, 400)):
        found = [tuple(r) for r in ordering.hit_page(keyed, page, size).collect()]
        assert found == order[(page - 1) * size : page * size]
    assert ordering.hit_page(keyed.limit(0), 1).count() == 0


def test_pages_and_samples_write_no_hits(corpus, monkeypatch):
    """What is checkpointed are counts and the cells of a page, never the hits."""
    from wordloom import session

    written = []
    kept = session.cut

    def counted(df):
        out = kept(df)
        written.append(set(out.columns))
        return out

    for module in (ordering, layout):
        monkeypatch.setattr(module, "cut", counted)
    hits = corpus.search([[word("the")]], sortable=True)
    ordering.hit_page(ordering.sort_keys(hits, corpus.tokens, "right"), 2).collect()
    ordering.sample_hits(hits, 10).collect()
    assert written and not any("start" in columns for columns in written)


# ---------------------------------------------------------------- vocabulary


def test_patterns_run_on_the_vocabulary(corpus, plain):
    patterns = [
        [[Tok(value_test("word", ["Th.*", "[0-9]+"]))]],
        [[Tok(value_test("word", ["T.*"], negate=True)), word("the")]],
        [[Tok(form_test("in", where="middle")), Gap(0, 2), Tok(form_test("g", where="end"))]],
        [[Tok(AllOf((form_test("t", where="start"), Condition("lemma", "ends", ("e",)))))], [Tok(Condition("word", "wildcard", ("*ing",), True))]],
        [[anything(), Tok(form_test("the"))], [Gap(0, 1), Tok(form_test("of"))]],
        [[Tok(form_test("zzzz", where="middle"))]],
    ]
    for pattern in patterns:
        found = corpus.search(pattern)
        assert "RLIKE" not in plan(found) and "EndsWith(word" not in plan(found) and "Contains(word" not in plan(found)
        assert rows(found) == rows(plain.search(pattern))


def test_a_rare_word_reads_its_partitions(corpus):
    rare = corpus.words.groupBy("word").agg(F.sum("n").alias("n")).where("n = 1 and word rlike '^[a-z]{6,}$'").orderBy("word").first().word
    found = corpus.search([[word(rare)]])
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET|=)", plan(found)) or "bucket" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert found.count() == 1
    _, buckets = lexicon.resolved([[word(rare)]], corpus.words)
    assert len(buckets) == 1
    assert len(lexicon.resolved([[word(rare), anything()]], corpus.words)[1]) == 3
    assert lexicon.resolved([[word(rare), Gap(0), word("the")]], corpus.words)[1] is None


def test_tests_with_many_words_stay(corpus, plain, monkeypatch):
    monkeypatch.setattr(lexicon, "MOST_WORDS", 2)
    pattern = [[Tok(value_test("word", ["Th.*"]))]]
    found = corpus.search(pattern)
    assert "RLIKE" in plan(found) and rows(found) == rows(plain.search(pattern))
    monkeypatch.setattr(lexicon, "MOST_BUCKETS", 0)
    assert lexicon.resolved([[word("the")]], corpus.words)[1] is None


def test_vocabulary_counts(corpus):
    counted = vocabulary(corpus.tokens).groupBy("word").agg(F.sum("n").alias("n"))
    want = corpus.tokens.groupBy("word").count()
    assert counted.exceptAll(want.toDF("word", "n")).count() == 0


# ---------------------------------------------------------------- long patterns


@pytest.mark.parametrize("terms", [62, 63, 64, 65, 130])
def test_sequences_of_any_length(make_tokens, terms):
    words = [f"w{i % 7}" for i in range(200)]
    tokens = make_tokens({1: [words, words[:50]], 2: [["w0"] * 300]})
    pattern = [word(f"w{i % 7}") for i in range(terms)]
    hits = find_hits(tokens, [pattern], keep_last=("word",))
    assert rows(hits) == [(1, s, s + terms - 1) for s in range(0, 200 - terms + 1, 7)]
    assert {r.last_word for r in hits.collect()} == {f"w{(terms - 1) % 7}"}
    gapped = [*pattern[: terms // 2], Gap(0, 0), anything(), *pattern[terms // 2 + 1 :]]
    assert rows(find_hits(tokens, [gapped])) == rows(hits)


def test_the_width_of_partitions_follows_the_corpus(spark, corpus, plain, tmp_path, monkeypatch):
    """Few partitions allowed: they are wider, and what is read still knows their width."""
    assert layout.bits_for(1) == layout.BUCKET_BITS and layout.bits_of(corpus.tokens) == layout.BUCKET_BITS
    monkeypatch.setattr(layout, "MOST_BUCKETS", 4)
    wide = Corpus.stored(plain.tokens, plain.texts, str(tmp_path))
    total = plain.tokens.count()
    assert wide.tokens.select("bucket").distinct().count() == -(-total // (1 << layout.bits_of(wide.tokens))) <= 4
    assert layout.bits_of(wide.tokens) == layout.bits_of(wide.blocks) > layout.BUCKET_BITS
    selection, pattern = Selection({"source": Choice(("src3", "src5"))}), [word("of"), Gap(0, 2), word("the")]
    hits = wide.search([pattern], selection)
    assert "dynamicpruning" in plan(hits) and rows(hits) == rows(plain.search([pattern], selection))
    assert lines(wide.lines(hits)) == lines(plain.lines(plain.search([pattern], selection)))
    page = wide.page(wide.search([pattern]), 2, "right")
    shown = lambda p: [(r.text_id, r.start, r.left_text, r.right_text) for r in p.collect()]
    assert shown(page) == shown(plain.page(plain.search([pattern]), 2, "right"))
