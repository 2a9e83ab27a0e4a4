"""The registered queries: one or more per operator, each over whole tables. ``oracle.py`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.functions import text as text_functions
from wordloom.operators import concordance, exports, geo, hits as hit_ops, ordering, stats, treebank
from wordloom.operators.patterns import (
    AllOf,
    Gap,
    Condition,
    Tok,
    anything,
    category,
    form_test,
    sections,
    set_test,
    simple,
    value_test,
    with_forms,
    word,
)
from wordloom.operators.selection import (
    Choice,
    Facet,
    Selection,
    dimension_rows,
    facet_extent,
    in_ranges,
    in_span,
    in_texts,
    select_by_facets,
    with_value,
)
from wordloom.layout import number_rows
from wordloom.plans import given
from wordloom.plans.corpus import Corpus
from wordloom.sources import tables, tokens as token_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def rows_of(hits: DataFrame) -> DataFrame:
    return hits.select("text_id", F.col("start").alias("hit_start"), F.col("end").alias("hit_end"))


def per_text(hits: DataFrame) -> DataFrame:
    """Hits of a frequent pattern, condensed to count and sums per text."""
    return hits.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end")
    )


def docs_hits(spark, folder, *patterns, **options) -> DataFrame:
    return hit_ops.find_hits(given.docs_tokens(spark, folder), patterns, **options)


def full(column: str):
    """Text of a token array, word by word."""
    return concordance.as_text(column, ("word",))


# ---------------------------------------------------------------- flagship


@query
def words_after_the(spark, folder):
    """Words right after ``the`` in English documents, the twenty most frequent."""
    corpus = given.docs(spark, folder)
    hits = corpus.search([[word("the"), anything()]], Selection({"lang": Choice(("en",))}))
    after = hit_ops.with_token(hits, corpus.tokens, F.col("end"), {"word": "word"}, present=True)
    return stats.by_frequency(stats.frequency_list(after)).limit(20)


# ---------------------------------------------------------------- sources


@query
def src1_typed_metadata(spark, folder):
    """Metadata as strings with missing markers, typed by header names."""
    texts = given.docs_texts(spark, folder)
    blank = F.when(F.col("text_id") % 2 == 0, "").otherwise("\\N")
    raw = texts.select(
        F.col("text_id").cast("string").alias("tid"),
        "lang",
        F.when(F.col("lang") == "es", blank).otherwise(F.col("source")).alias("origin"),
        F.col("n_chars").cast("string").alias("size$num"),
        F.coalesce(F.col("quality").cast("string"), blank).alias("quality$n"),
    )
    return tables.typed_text_table(raw)


@query
def src2_scan_attributes(spark, folder):
    scanned = token_source.scan_tokens(given.docs_tokens(spark, folder), ["pos_tag", "phon"])
    return scanned.groupBy("pos_tag", F.coalesce("phon", F.lit("")).alias("phon")).agg(F.count(F.lit(1)).alias("n"))


@query
def src2_scan_default(spark, folder):
    scanned = token_source.scan_tokens(given.docs_tokens(spark, folder), declared=("lemma",))
    return stats.values_per_text(scanned, {"n_words": "word", "n_lemmas": "lemma"}, {"last_s": "s_id"})


@query
def src3_corpus_size(spark, folder):
    return token_source.corpus_sizes(given.docs_tokens(spark, folder), "lang")


@query
def src4_tokenise(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    return tokens.groupBy("text_id", "s_id").agg(
        F.min("s_first").alias("s_first"),
        F.max("s_last").alias("s_last"),
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("tok_no") + 1) * F.length("word")).alias("checksum"),
    )


@query
def src4_words(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    return tokens.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"), F.min("tok_no").alias("first_at"))


@query
def src5_text_positions(spark, folder):
    return given.docs_ranges(spark, folder).select("text_id", "n_tokens", "startpos", "endpos")


@query
def src5_counted_positions(spark, folder):
    """The same ranges from the token table alone."""
    tokens = given.docs_tokens(spark, folder)
    texts = given.table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"))
    return token_source.text_ranges(tokens, texts).select("text_id", "n_tokens", "startpos", "endpos")


@query
def src5_token_positions(spark, folder):
    placed = given.docs_placed_tokens(spark, folder, given.docs_ranges(spark, folder))
    return placed.groupBy("text_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(F.col("pos") * F.length("word")).alias("checksum")
    )


@query
def src6_speaker_bounds(spark, folder):
    return tables.parse_bounds(given.talk_bounds(given.talk_segments(spark, folder))).select(
        "text_id", F.col("start").alias("range_start"), F.col("end").alias("range_end")
    )


@query
def src7_coordinates(spark, folder):
    return given.coordinates(spark, folder)


@query
def src8_media_manifest(spark, folder):
    return tables.media_manifest(given.talk_files(spark, folder))


@query
def src9_pivot_values(spark, folder):
    values = given.event_values(spark, folder)
    return tables.pivot_values(values, ["click", "error", "purchase", "signup", "view"], ["ts", "event_id"])


@query
def src9_value_map(spark, folder):
    """Every event type there is, from a map per text."""
    maps = tables.value_map(given.event_values(spark, folder), ["ts", "event_id"])
    return maps.select("text_id", F.explode("values").alias("category", "value"))


@query
def src9_map_columns(spark, folder):
    """Columns taken from the maps."""
    maps = tables.value_map(given.event_values(spark, folder), ["ts", "event_id"])
    return tables.map_columns(maps, ["purchase", "view", "never seen"])


# ---------------------------------------------------------------- text selection


def selected(spark, folder, **choices) -> DataFrame:
    return given.docs(spark, folder).select(Selection(choices)).select("text_id", "n_tokens")


@query
def flt1_include(spark, folder):
    return selected(spark, folder, source=Choice(("src1", "src2", "src7")))


@query
def flt2_exclude_keeps_missing(spark, folder):
    return selected(spark, folder, quality=Choice((0,), exclude=True))


@query
def flt3_interval(spark, folder):
    return selected(spark, folder, n_chars=Choice(low=500, high=3000))


@query
def flt3_open_interval(spark, folder):
    low = selected(spark, folder, n_chars=Choice(low=5000)).withColumn("side", F.lit("low"))
    return low.unionByName(selected(spark, folder, n_chars=Choice(high=400)).withColumn("side", F.lit("high")))


@query
def flt4_combined(spark, folder):
    return selected(
        spark,
        folder,
        lang=Choice(("en", "de", "")),
        toxic=Choice((1,), exclude=True),
        n_chars=Choice(low=200),
        source=Choice(("", " ")),
    )


@query
def flt5_facet_values(spark, folder):
    selection = Selection({"lang": Choice(("en",)), "source": Choice(("src1", "src2"))})
    return stats.distinct_values(given.docs_texts(spark, folder), "lang", selection)


@query
def flt6_language(spark, folder):
    return given.docs(spark, folder).select(language="de").select("text_id", "lang", "n_tokens")


@query
def flt7_tokens_of_texts(spark, folder):
    corpus = given.docs(spark, folder)
    chosen = corpus.select(Selection({"source": Choice(("src3", "src4")), "quality": Choice((0,), exclude=True)}))
    return in_texts(corpus.tokens, chosen).groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))


@query
def flt7_texts_in_span(spark, folder):
    ranges = given.docs_ranges(spark, folder)
    whole = ranges.agg(F.max("endpos")).scalar()
    return in_span(ranges, F.floor(whole / 4), F.floor(whole / 2)).select("text_id", "startpos", "endpos")


@query
def flt8_speaker_ranges(spark, folder):
    corpus = given.talk(spark, folder)
    chosen = corpus.select(Selection({"role": Choice(("assistant",))}))
    ranges = corpus.ranges.join(chosen.select("text_id"), "text_id", "left_semi")
    return in_ranges(corpus.tokens, ranges).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


@query
def flt8_all_listed(spark, folder):
    corpus = given.talk(spark, folder)
    return in_ranges(corpus.tokens, corpus.ranges).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


@query
def flt9_present_values(spark, folder):
    return with_value(given.docs_texts(spark, folder), "quality").select("text_id", "quality")


@query
def flt10_removed_values(spark, folder):
    corpus = given.docs(spark, folder)
    hits = corpus.search([[Tok(value_test("lemma", ["the", "of", "and", "in"]))]], keep=("lemma",))
    shown = corpus.distribution(hits, "lemma", "source", excluded=("the", "of"))
    return shown.scores().select("attr", "total", F.round("dp", 9).alias("dp"))


RECTANGLE = [(31.0, -19.0), (31.0, 12.0), (51.0, 12.0), (51.0, -19.0)]
TRIANGLE = [(50.0, 0.0), (80.0, 20.0), (60.0, 60.0)]


@query
def flt11_in_polygons(spark, folder):
    return geo.places_in(given.coordinates(spark, folder), [RECTANGLE, TRIANGLE])


@query
def flt11_polygon_table(spark, folder):
    """Polygons as a table, some across the 180th meridian."""
    inside = geo.places_in_polygons(given.supplier_places(spark, folder), given.nation_polygons(spark, folder))
    return inside.select("place", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query
def flt11_no_polygon(spark, folder):
    return geo.places_in(given.coordinates(spark, folder), [])


@query
def flt12_facets(spark, folder):
    facets = {
        "lang": Facet(("en", "fr")),
        "quality": Facet(low=1, high=1, nulls=True),
        "n_chars": Facet(low=300, high=6000),
    }
    return select_by_facets(given.docs_texts(spark, folder), facets).select("text_id", "lang", "n_chars")


@query
def flt12_empty_facet(spark, folder):
    facets = {"lang": Facet(), "quality": Facet(low=0, high=1, nulls=True)}
    return select_by_facets(given.docs_texts(spark, folder), facets).select("text_id")


@query
def flt12_extent(spark, folder):
    return facet_extent(given.docs_texts(spark, folder), "quality")


# ---------------------------------------------------------------- joins


def shop_texts(spark, folder, **choices) -> DataFrame:
    keys = {k.replace("__", "."): c for k, c in choices.items()}
    corpus_texts, dimensions = given.shop_texts(spark, folder), given.shop_dimensions(spark, folder)
    return stats.select_texts(corpus_texts, Selection(keys), dimensions)


@query
def joi1_dimension_rows(spark, folder):
    choices = {"brand": Choice(("Brand#2", "Brand#7")), "size": Choice(low=10, high=20)}
    return dimension_rows(given.shop_dimensions(spark, folder)["part"], choices)


@query
def joi2_many_to_many_include(spark, folder):
    chosen = shop_texts(spark, folder, part__brand=Choice(("Brand#2", "Brand#7")), part__size=Choice(low=10, high=20))
    return chosen.select("text_id", "status", "n_tokens")


@query
def joi3_many_to_many_exclude(spark, folder):
    chosen = shop_texts(spark, folder, part__brand=Choice(("Brand#2", "Brand#7"), exclude=True), status=Choice(("O", "F")))
    return chosen.select("text_id", "status", "n_tokens")


@query
def joi4_hit_metadata(spark, folder):
    texts = given.docs_texts(spark, folder)
    hits = docs_hits(spark, folder, [word("the"), word("of")]).withColumn(
        "segment", F.concat_ws(".", F.col("text_id").cast("string"), F.col("s_id").cast("string"))
    )
    labelled = texts.withColumn("text_id", F.col("text_id").cast("string"))
    found = concordance.with_metadata(hits.drop("text_id"), labelled, ["source", "quality"], "segment")
    return found.select("segment", F.col("start").alias("hit_start"), "source", "quality")


@query
def joi4_hit_lists(spark, folder):
    """Many-to-many values of a hit's text as a list."""
    listed = stats.listed_values(given.shop_dimensions(spark, folder)["part"], "brand")
    hits = given.shop_line_hits(spark, folder).where("lemma = 'RF'")
    counted = hits.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))
    return concordance.with_metadata(counted, listed, ["brand"])


@query
def joi5_token_in_range(spark, folder):
    ranges = given.docs_ranges(spark, folder)
    placed = given.docs_placed_tokens(spark, folder, ranges)
    spanish = ranges.where("lang = 'es'").select(F.col("startpos").alias("start"), F.col("endpos").alias("end"))
    return in_ranges(placed, spanish).groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))


def talk_parts(spark, folder):
    segments = given.talk_segments(spark, folder)
    tokens = given.talk_tokens(spark, folder, segments)
    return segments, tokens


@query
def joi6_aligned_search(spark, folder):
    _, tokens = talk_parts(spark, folder)
    common = value_test("lemma", ["the", "der", "la", "de"])
    source = hit_ops.find_hits(tokens.where("role = 'user'"), [[Tok(common)]], "seg")
    target = hit_ops.find_hits(tokens.where("role = 'assistant'"), [[Tok(common), Tok(Condition("word", "ends", ("n",), True))]], "seg")
    return rows_of(hit_ops.aligned_hits(source, given.talk_alignment(spark, folder), {"assistant": target}, "seg"))


@query
def joi7_aligned_text(spark, folder):
    _, tokens = talk_parts(spark, folder)
    hits = hit_ops.find_hits(tokens.where("role = 'user'"), [[Tok(form_test("the", where="start"), initial=True)]], "seg")
    shown = concordance.aligned_text(hits, given.talk_alignment(spark, folder), tokens, ["assistant"], within="seg")
    return shown.select("text_id", F.col("start").alias("hit_start"), F.col("end").alias("hit_end"), "tgt_lang", "aligned")


@query
def joi8_hit_places(spark, folder):
    hits = given.shop_line_hits(spark, folder)
    return geo.geo_distribution(hits, given.shop_texts(spark, folder), "word")


def shop_geo(spark, folder) -> DataFrame:
    return geo.geo_distribution(given.shop_line_hits(spark, folder), given.shop_texts(spark, folder), "lemma")


@query
def joi9_placed(spark, folder):
    return geo.placed(shop_geo(spark, folder), given.coordinates(spark, folder))


@query
def joi9_unknown_places(spark, folder):
    return geo.unknown_places(shop_geo(spark, folder), given.coordinates(spark, folder))


@query
def joi10_media_flags(spark, folder):
    segments, tokens = talk_parts(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("the")]], "seg")
    manifest = tables.media_manifest(given.talk_files(spark, folder))
    flagged = concordance.with_media(hits, segments, manifest)
    return flagged.select("text_id", F.col("start").alias("hit_start"), "av_file", F.coalesce("audio", F.lit("none")).alias("audio"), "has_video")


@query
def joi10_silent_player(spark, folder):
    """One recording listed as silent makes the player silent for all."""
    segments, tokens = talk_parts(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("the")]], "seg")
    manifest = tables.media_manifest(given.talk_files(spark, folder)).withColumn("silent_player", F.col("av_file") == "rec6")
    flagged = concordance.with_media(hits, segments, manifest)
    return flagged.groupBy("audio", "has_video").agg(F.count(F.lit(1)).alias("n"))


@query
def joi11_dependency_edges(spark, folder):
    edges = treebank.dependency_edges(given.treebank_tokens(spark, folder))
    return edges.groupBy("text_id", "dep_fun").agg(
        F.count(F.lit(1)).alias("n"), F.sum("distance").alias("sum_distance"), F.sum(F.length("head_word")).alias("head_chars")
    )


@query
def joi11_child_sides(spark, folder):
    sides = treebank.child_sides(given.treebank_tokens(spark, folder))
    return sides.groupBy("text_id", "sides").agg(F.count(F.lit(1)).alias("n"), F.sum("dep_head").alias("sum_head"))


# ---------------------------------------------------------------- patterns


@query
def pat1_equals(spark, folder):
    folded = per_text(docs_hits(spark, folder, [word("The")])).withColumn("kind", F.lit("word"))
    exact = per_text(docs_hits(spark, folder, [word("the", is_phonetic=True)])).withColumn("kind", F.lit("phon"))
    return folded.unionByName(exact)


@query
def pat2_attribute_choice(spark, folder):
    parts = {
        "lemma": word("of", is_lemma=True, is_phonetic=True),
        "phon": word("and", is_phonetic=True, is_original=True),
        "orig": word("IN", is_original=True),
        "word": word("to"),
    }
    counted = [
        hit_ops.count_hits(docs_hits(spark, folder, [token])).withColumn("attribute", F.lit(name))
        for name, token in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


@query
def pat3_affixes(spark, folder):
    parts = [per_text(docs_hits(spark, folder, [word(f, where=w)])).withColumn("place", F.lit(w))
             for f, w in (("th", "start"), ("ING", "end"), ("oré", "middle"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def pat4_literal_characters(spark, folder):
    return per_text(docs_hits(spark, folder, [word("|")], [word("$", where="start")], [word("*")]))


@query
def pat5_wildcards(spark, folder):
    return rows_of(docs_hits(spark, folder, simple("  Th*n  of ")))


@query
def pat5_blank(spark, folder):
    """A blank search box finds every token."""
    return per_text(docs_hits(spark, folder, simple("  ")))


@query
def pat5_literal_wildcards(spark, folder):
    return per_text(docs_hits(spark, folder, simple("% *")))


@query
def pat6_regex(spark, folder):
    return per_text(docs_hits(spark, folder, [Tok(value_test("word", ["Th.*", "of|in", "[0-9]+"]))]))


@query
def pat6_vocabulary(spark, folder):
    """The regular expressions run on the distinct words of a stored corpus."""
    return per_text(given.docs_stored(spark, folder).search([[Tok(value_test("word", ["Th.*", "of|in", "[0-9]+"]))]]))


@query
def pat3_vocabulary(spark, folder):
    """Ends and middles of words, as parts of a sequence, from the vocabulary."""
    pattern = [Tok(form_test("ing", where="end")), Gap(0, 2), Tok(form_test("er", where="middle"))]
    return per_text(given.docs_stored(spark, folder).search([pattern]))


@query
def pat6_alternatives(spark, folder):
    return per_text(docs_hits(spark, folder, [Tok(value_test("word", ["de", "la", "der"]))]))


@query
def pat7_extra_forms(spark, folder):
    main = form_test("th", where="start")
    extra = [value_test("pos_tag", ["CAP"]), value_test("pos_tag", ["NUM"]), value_test("lemma", ["the", "that"], negate=True)]
    return per_text(docs_hits(spark, folder, [Tok(with_forms(main, extra))]))


@query
def pat8_category(spark, folder):
    noun = category("pos_tag", "CAP", [value_test("phon", ["the", "tha"]), value_test("lemma", ["the"], negate=True)])
    return per_text(docs_hits(spark, folder, [Tok(noun)]))


@query
def pat9_sections(spark, folder):
    wanted = [category("pos_tag", "CAP", [value_test("phon", ["the"])]), category("pos_tag", "NUM")]
    unwanted = [category("lemma", "the", negate=True), category("lemma", "then", negate=True)]
    return per_text(docs_hits(spark, folder, [Tok(sections([wanted, unwanted, []]))]))


@query
def pat10_sets(spark, folder):
    both = AllOf((set_test("feats", ["cap"]), set_test("feats", ["short"], negate=True)))
    return per_text(docs_hits(spark, folder, [Tok(both)]))


@query
def pat11_any_token(spark, folder):
    return rows_of(docs_hits(spark, folder, [anything(), word("the"), anything(), word("of"), anything()]))


@query
def pat11_everything(spark, folder):
    """Two to four tokens of any kind: one hit at every token that has a neighbour in its sentence."""
    return per_text(docs_hits(spark, folder, [anything(), Gap(0, 2), anything()]))


@query
def pat12_sequence(spark, folder):
    return rows_of(docs_hits(spark, folder, [word("of"), word("the")]))


@query
def pat12_three_terms(spark, folder):
    return rows_of(docs_hits(spark, folder, [Tok(form_test("t", where="start")), word("the"), Tok(form_test("e", where="end"))]))


@query
def pat13_gaps(spark, folder):
    return rows_of(docs_hits(spark, folder, [word("the"), Gap(0, 2), word("of"), Gap(1, 3), word("and")]))


@query
def pat13_long_gap(spark, folder):
    return rows_of(docs_hits(spark, folder, [word("in"), Gap(5, 40), word("of"), word("the")]))


@query
def pat13_open_gap(spark, folder):
    return rows_of(docs_hits(spark, folder, [word("that"), Gap(2), word("of"), Gap(0, 3), word("the")]))


@query
def pat13_leading_gap(spark, folder):
    return per_text(docs_hits(spark, folder, [anything(), Gap(0, 2), word("with")]))


@query
def pat14_edges(spark, folder):
    first = per_text(docs_hits(spark, folder, [Tok(form_test("the"), initial=True), anything()])).withColumn("edge", F.lit("first"))
    last = per_text(docs_hits(spark, folder, [word("the"), Tok(form_test("."), final=True)])).withColumn("edge", F.lit("last"))
    both = per_text(docs_hits(spark, folder, [Tok(form_test("."), initial=True, final=True)])).withColumn("edge", F.lit("both"))
    return first.unionByName(last).unionByName(both)


@query
def pat15_within_segment(spark, folder):
    _, tokens = talk_parts(spark, folder)
    return rows_of(hit_ops.find_hits(tokens, [[word("."), Gap(0, 3), word(".")]], "seg"))


@query
def pat16_alternatives(spark, folder):
    return rows_of(docs_hits(spark, folder, [word("of"), word("the")], [word("of"), Tok(form_test("th", where="start"))], simple("to the")))


@query
def pat17_in_selection(spark, folder):
    selection = Selection({"quality": Choice((0,), exclude=True), "n_chars": Choice(low=300)})
    return rows_of(given.docs(spark, folder).search([[word("the")]], selection, language="en"))


@query
def pat17_stored_selection(spark, folder):
    """The same search on a stored corpus, which is read only where the selected texts lie."""
    selection = Selection({"quality": Choice((0,), exclude=True), "n_chars": Choice(low=300)})
    return rows_of(given.docs_stored(spark, folder).search([[word("the")]], selection, language="en"))


@query
def pat17_in_speakers(spark, folder):
    corpus = given.talk(spark, folder)
    return rows_of(corpus.search([[Tok(form_test("e", where="end")), Tok(form_test("e", where="start"))]], Selection({"role": Choice(("user",))})))


@query
def pat18_count(spark, folder):
    return hit_ops.count_hits(docs_hits(spark, folder, [Tok(form_test("t", where="start")), Gap(0, 1), word("the")]))


# ---------------------------------------------------------------- concordance


def shown(lines: DataFrame) -> DataFrame:
    return lines.select(
        "text_id", F.col("start").alias("hit_start"), F.col("end").alias("hit_end"), "left_text", "match_text", "right_text"
    )


@query
def kwi1_context(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("of"), word("the")]])
    return shown(concordance.concordance_lines(hits, token_source.context_blocks(tokens, near=hits), longest=2))


@query
def kwi1_stored_context(spark, folder):
    """Hits of any length with their context, from the stored blocks of a corpus."""
    corpus = given.docs_stored(spark, folder)
    hits = corpus.search([[word("from"), Gap(0), word("that")]])
    return shown(corpus.lines(hits, context=50))


@query
def kwi1_by_position(spark, folder):
    """Contexts from a token table without blocks."""
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("from"), word("the")]])
    return shown(concordance.concordance_lines(hits, tokens))


@query
def kwi1_treebank(spark, folder):
    """The wider default of a treebank."""
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("from"), word("the")]])
    return shown(concordance.concordance_lines(hits, tokens, treebank=True))


@query
def kwi2_text_edges(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[Tok(form_test("th", where="start"))]])
    sized = hits.join(given.docs_texts(spark, folder).select("text_id", "n_tokens"), "text_id")
    at_edge = sized.where((F.col("start") == 0) | (F.col("start") >= F.col("n_tokens") - 3)).drop("n_tokens")
    return shown(concordance.concordance_lines(at_edge, tokens, context=60))


@query
def kwi3_segment_context(spark, folder):
    segments, tokens = talk_parts(spark, folder)
    hits = hit_ops.find_hits(tokens, [[Tok(form_test("th", where="start"), initial=True)]], "seg")
    near = concordance.segments_around(hits, segments, 1)
    return near.select("text_id", F.col("start").alias("hit_start"), "seg_id", "speaker", "from_s", "to_s", "is_match")


@query
def kwi4_attributes(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("of"), Gap(0, 2), word("that")]])
    return shown(concordance.concordance_lines(hits, tokens, ("word", "lemma", "phon", "pos_tag"), 3))


@query
def kwi5_multiword(spark, folder):
    names = given.table(spark, folder, "part").select(F.concat_ws(" ", "p_name", F.lit("1 / 2")).alias("name"))
    return names.select(text_functions.one_word(F.col("name")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def kwi6_fields(spark, folder):
    tokens = given.docs_placed_tokens(spark, folder, given.docs_ranges(spark, folder))
    hits = hit_ops.find_hits(tokens, [[word("from"), word("the")]])
    lines = concordance.concordance_lines(hits.withColumn("pos", F.col("startpos") + F.col("start")), tokens, context=5)
    segment = F.concat_ws(".", F.col("text_id").cast("string"), F.col("s_id").cast("string"))
    return lines.select("pos", segment.alias("segment"), "left_text", "match_text", "right_text")


@query
def kwi7_hidden_values(spark, folder):
    marked = F.coalesce(F.col("phon"), F.lit("__UNDEF__"))
    tip = text_functions.tooltip([F.col("word"), F.col("lemma"), marked], lemma=1)
    tokens = given.docs_tokens(spark, folder)
    return tokens.select("lang", tip.alias("tip")).groupBy("lang", "tip").agg(F.count(F.lit(1)).alias("n"))


@query
def kwi8_markup(spark, folder):
    pages = given.table(spark, folder, "pages")
    marked = F.replace("html", F.lit(" "), F.lit("&nbsp;"))
    return pages.select("page_id", F.md5(token_source.clean_ingest(marked)).alias("cleaned"))


@query
def kwi9_original_rows(spark, folder):
    tokens = given.docs_tokens(spark, folder).withColumn("orig", F.upper("word"))
    hits = hit_ops.find_hits(tokens, [[word("by"), word("the")]])
    rows = concordance.original_and_corrected(hits, tokens, 4)
    return rows.select("text_id", F.col("start").alias("hit_start"), "line", "left_text", "match_text", "right_text")


@query
def kwi10_media_object(spark, folder):
    segments, tokens = talk_parts(spark, folder)
    hits = hit_ops.find_hits(tokens, [[Tok(form_test("the"), initial=True)]], "seg")
    media = concordance.media_object(hits, segments, tokens, 1)
    lines = F.transform(
        "segments",
        lambda s: F.concat_ws("|", s["speaker"], s["from_s"].cast("string"), F.array_join(F.transform(s["tokens"], lambda t: t["word"]), " ")),
    )
    return media.select(
        "text_id", F.col("start").alias("hit_start"), "start_s", "stop_s", "match_at", "last_line",
        F.array_join(lines, "\n").alias("lines"),
    )


@query
def kwi10_whole_episode(spark, folder):
    """The episode of the tenth hit of the second page."""
    segments, tokens = talk_parts(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("the")]], "seg")
    n = concordance.chosen_hit(2, 9)
    one = ordering.ordered_slice(hits, list(ordering.CORPUS_ORDER), n, n, ordering.position_cells())
    return concordance.segments_around(one, segments, None).select("text_id", "seg_id", "line_no", "speaker", "is_match")


@query
def kwi11_links(spark, folder):
    pages = given.table(spark, folder, "pages")
    address = F.replace("url", F.lit("/"), F.lit("!!"))
    attribute = F.when(F.col("page_id") % 3 == 0, "plain").otherwise(F.concat(F.lit("$"), address, F.lit("$"), address, F.lit("?b$ ")))
    found = pages.select("page_id", text_functions.links(attribute).alias("links"))
    return found.select("page_id", F.coalesce(F.array_join("links", " "), F.lit("none")).alias("links"))


# ---------------------------------------------------------------- order, pages, samples


def sorted_page(spark, folder, by: str, page: int = 2) -> DataFrame:
    tokens = given.docs_tokens(spark, folder, neighbours=True)
    pattern = [word("of"), Tok(form_test("t", where="start"))]
    asked = {"match": {"match": ("word",)}, "left": {"keep": ("before",)}, "right": {"keep_last": ("after",)}}
    hits = hit_ops.find_hits(tokens, [pattern], **asked.get(by, {}))
    keyed = ordering.sort_keys(hit_ops.settled(hits), tokens, by)
    return ordering.hit_page(keyed, page).select("text_id", F.col("start").alias("hit_start"), F.coalesce("sort_key", F.lit("-")).alias("sort_key"))


@query
def srt1_by_position(spark, folder):
    return sorted_page(spark, folder, "position")


@query
def srt2_by_match(spark, folder):
    return sorted_page(spark, folder, "match")


@query
def srt3_by_left(spark, folder):
    return sorted_page(spark, folder, "left")


@query
def srt4_by_right(spark, folder):
    return sorted_page(spark, folder, "right")


@query
def srt5_edge_hits_last(spark, folder):
    """The last page of a spoken result: hits at the start of a segment follow all others."""
    _, tokens = talk_parts(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("the")]], "seg")
    keyed = ordering.sort_keys(hits, tokens, "left", "seg")
    pages = ordering.page_count(hits).first()["n_pages"]
    last = ordering.hit_page(keyed, pages)
    return last.select("text_id", F.col("start").alias("hit_start"), F.coalesce("sort_key", F.lit("-")).alias("sort_key"))


@query
def srt4_without_neighbours(spark, folder):
    """The same order where the words beside a token are not stored with it."""
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.settled(hit_ops.find_hits(tokens, [[word("of"), Tok(form_test("t", where="start"))]]))
    page = ordering.hit_page(ordering.sort_keys(hits, tokens, "right"), 2)
    return page.select("text_id", F.col("start").alias("hit_start"), F.coalesce("sort_key", F.lit("-")).alias("sort_key"))


@query
def srt6_by_frequency(spark, folder):
    hits = docs_hits(spark, folder, [Tok(form_test("th", where="start"))], keep=("word",))
    return stats.by_frequency(stats.frequency_list(hits)).limit(40)


@query
def srt7_metadata_order(spark, folder):
    texts, dimensions = given.shop_texts(spark, folder), given.shop_dimensions(spark, folder)
    keyed = texts.join(stats.sort_value(dimensions["part"], "brand"), "text_id", "left")
    up = ordering.text_page(texts, 3, "price").withColumn("sorted", F.lit("price"))
    down = ordering.text_page(keyed, 2, "sort_value", descending=True).withColumn("sorted", F.lit("brand"))
    columns = ["sorted", "text_id", "price"]
    return up.select(*columns).unionByName(down.select(*columns))


@query
def lim1_first_pages(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    keyed = ordering.sort_keys(hit_ops.find_hits(tokens, [[word("of"), word("the")]]), tokens)
    return ordering.first_pages(keyed).select("page", "text_id", F.col("start").alias("hit_start"))


@query
def lim1_page_count(spark, folder):
    return ordering.page_count(docs_hits(spark, folder, [word("of")]))


@query
def lim1_deep_slice(spark, folder):
    """A page by row number, the way pages far down are taken."""
    hits = docs_hits(spark, folder, [word("the")])
    numbered = number_rows(hits, list(ordering.CORPUS_ORDER), "hit_no")
    return numbered.where(F.col("hit_no").between(12000, 12049)).select("hit_no", "text_id", F.col("start").alias("hit_start"))


@query
def lim1_deep_page(spark, folder):
    """A page far down a result sorted by the next word, by order statistics on a stored corpus."""
    corpus = given.docs_stored(spark, folder)
    hits = corpus.search([[Tok(form_test("t", where="start"))]], sortable=True)
    page = ordering.hit_page(ordering.sort_keys(hits, corpus.tokens, "right"), 140)
    return page.select("text_id", F.col("start").alias("hit_start"), F.coalesce("sort_key", F.lit("-")).alias("sort_key"))


@query
def lim2_metadata_page(spark, folder):
    return ordering.text_page(given.docs_texts(spark, folder), 4).select("text_id", "source")


@query
def lim3_export_cap(spark, folder):
    hits = docs_hits(spark, folder, [word("of")])
    capped = rows_of(ordering.capped(hits, 500)).withColumn("cap", F.lit("500"))
    return capped.unionByName(rows_of(ordering.capped(hits)).withColumn("cap", F.lit("none")))


@query
def lim4_one_text(spark, folder):
    return ordering.one_text(given.docs_texts(spark, folder), 4, ["lang", "source", "quality", "toxic"])


@query
def smp1_random_hits(spark, folder):
    hits = docs_hits(spark, folder, [word("the")])
    return rows_of(ordering.sample_hits(hits, 1000, seed=42))


@query
def smp1_large_sample(spark, folder):
    """A sample of most hits."""
    hits = docs_hits(spark, folder, [word("the")])
    return rows_of(ordering.sample_hits(hits, 9000, seed=7))


@query
def smp2_random_by_part(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[Tok(value_test("lemma", ["the", "de", "der", "la"]))]], keep=("lang",))
    parts = token_source.corpus_sizes(tokens, "lang").withColumnRenamed("lang", "part")
    drawn = ordering.sample_hits_by_part(hits.withColumnRenamed("lang", "part"), 501, parts, seed=3)
    return drawn.select("part", "text_id", F.col("start").alias("hit_start"))


# ---------------------------------------------------------------- counts and lists


@query
def agg1_text_count(spark, folder):
    some = stats.text_and_token_count(shop_texts(spark, folder, status=Choice(("O",)), part__brand=Choice(("Brand#3",), exclude=True)))
    none = stats.text_and_token_count(shop_texts(spark, folder, status=Choice(("X",))))
    return some.withColumn("which", F.lit("some")).unionByName(none.withColumn("which", F.lit("none")))


@query
def agg2_speaker_count(spark, folder):
    segments = given.talk_segments(spark, folder)
    speakers, ranges = given.talk_speakers(segments), tables.parse_bounds(given.talk_bounds(segments))
    counted = stats.speaker_and_token_count(speakers, ranges).withColumn("which", F.lit("all"))
    users = stats.speaker_and_token_count(speakers.where("role = 'user'"), ranges)
    return counted.unionByName(users.withColumn("which", F.lit("user")))


@query
def agg3_category_range(spark, folder):
    selection = Selection({"price": Choice(low=1000, high=2000), "part.brand": Choice(("Brand#2",)), "status": Choice(("O",))})
    texts, dimensions = given.shop_texts(spark, folder), given.shop_dimensions(spark, folder)
    return stats.category_range(texts, "price", selection, dimensions)


@query
def agg4_distinct_values(spark, folder):
    """Types of the parts of a brand in open orders: both conditions on the part hold for the same part."""
    selection = Selection({"part.brand": Choice(("Brand#2",)), "part.type": Choice(("PROMO",)), "status": Choice(("O",))})
    texts, dimensions = given.shop_texts(spark, folder), given.shop_dimensions(spark, folder)
    return stats.distinct_values(texts, "part.type", selection, dimensions)


@query
def agg5_listed_values(spark, folder):
    return stats.listed_values(given.shop_dimensions(spark, folder)["part"], "brand")


@query
def agg6_metadata_table(spark, folder):
    texts, dimensions = given.shop_texts(spark, folder), given.shop_dimensions(spark, folder)
    selection = Selection({"status": Choice(("P",)), "part.type": Choice(("SMALL",), exclude=True)})
    table = stats.metadata_table(texts, ["status", "price", "part.brand"], selection, dimensions)
    page = ordering.text_page(table, 2, "price_key", descending=True)
    return page.select("text_id", "status", "price", "brand")


@query
def agg6_metadata_page(spark, folder):
    """The same page, cut before the lists are made."""
    corpus = Corpus(given.shop_line_hits(spark, folder), given.shop_texts(spark, folder), given.shop_dimensions(spark, folder))
    selection = Selection({"status": Choice(("P",)), "part.type": Choice(("SMALL",), exclude=True)})
    return corpus.metadata_page(["status", "price", "part.brand"], selection, 2, "price", descending=True)


@query
def agg7_frequency_list(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("of"), Gap(0, 1), Tok(form_test("t", where="start"))]])
    attributes = ["word", "pos_tag"]
    return stats.frequency_list(stats.match_part(hits, tokens, attributes), attributes)


@query
def agg7_sequence_list(spark, folder):
    """Every token of the hit is restricted, so the list is counted from the matching tokens alone."""
    pattern = [Tok(form_test("of")), Tok(form_test("t", where="start"))]
    return stats.frequency_list(stats.match_part(docs_hits(spark, folder, pattern, match=("word",)), None, ["word"]))


@query
def agg7_one_token_list(spark, folder):
    hits = docs_hits(spark, folder, [Tok(set_test("feats", ["cap"]))], keep=("lemma", "phon"))
    return stats.frequency_list(hits, ["lemma", "phon"])


@query
def agg7_default_attribute(spark, folder):
    """Without attributes the words are counted."""
    hits = docs_hits(spark, folder, [Tok(form_test("th", where="start"))], keep=("word",))
    return stats.frequency_list(hits, ())


@query
def agg8_case_sensitive(spark, folder):
    hits = docs_hits(spark, folder, [Tok(form_test("th", where="start"))], keep=("word",))
    return stats.frequency_list(hits, case_sensitive=True)


@query
def agg9_match_part(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("the"), Gap(0, 2), word("of"), Gap(1, 3), word("and")]])
    inner = stats.frequency_list(stats.match_part(hits, tokens, ["word"], 2, 3)).withColumn("part", F.lit("2-3"))
    tail = stats.frequency_list(stats.match_part(hits, tokens, ["word"], 3)).withColumn("part", F.lit("3-"))
    return inner.unionByName(tail)


def common_words(spark, folder, keep=("lemma",)) -> DataFrame:
    return docs_hits(spark, folder, [Tok(value_test("lemma", ["the", "of", "de", "la", "der", "un", "is"]))], keep=keep)


def docs_distribution(spark, folder, category_code: str = "source", selection: Selection = Selection()):
    corpus = given.docs(spark, folder)
    return corpus.distribution(common_words(spark, folder), "lemma", category_code, selection)


@query
def agg10_attribute_by_text(spark, folder):
    return stats.attribute_by_text(common_words(spark, folder), "lemma")


@query
def agg10_free_first_token(spark, folder):
    """What stands before ``the``: the first token of the pattern is free."""
    hits = docs_hits(spark, folder, [anything(), word("the")], keep=("lemma",))
    return stats.attribute_by_text(hits, "lemma")


@query
def agg11_category_totals(spark, folder):
    values = stats.category_values(given.docs_texts(spark, folder), "quality", facet=False)
    return stats.category_totals(values, given.docs_texts(spark, folder))


@query
def agg11_many_to_many_totals(spark, folder):
    texts, dimensions = given.shop_texts(spark, folder), given.shop_dimensions(spark, folder)
    selection = Selection({"status": Choice(("O",)), "part.size": Choice(low=1, high=25)})
    values = stats.category_values(texts, "part.brand", selection, dimensions, facet=False)
    return stats.category_totals(values, texts)


@query
def agg12_distribution(spark, folder):
    return docs_distribution(spark, folder).cells


@query
def agg12_many_to_many(spark, folder):
    texts, dimensions = given.shop_texts(spark, folder), given.shop_dimensions(spark, folder)
    values = stats.category_values(texts, "part.brand", Selection(), dimensions, facet=False)
    by_text = stats.attribute_by_text(given.shop_line_hits(spark, folder), "lemma")
    return stats.distribution_cells(by_text, values)


@query
def agg12_spoken(spark, folder):
    """Words of listed speakers by role."""
    corpus = given.talk(spark, folder)
    hits = corpus.search([[Tok(value_test("lemma", ["the", "der", "la", "de"]))]], keep=("lemma", "speaker"))
    shown = corpus.distribution(hits, "lemma", "role")
    shares = shown.cells.join(shown.totals, "value")
    return shares.select("attr", "value", "n", "n_tokens", "n_texts")


@query
def agg18_searched_forms(spark, folder):
    """The map of a search over the tokens of one kind of order."""
    corpus = given.shop(spark, folder)
    hits = corpus.search([[word("R"), word("N")], [word("A"), Gap(0, 1), word("N")]], Selection({"status": Choice(("P", "F"))}), keep=("word",))
    return corpus.geo_distribution(hits)


@query
def agg18_free_first_token(spark, folder):
    """The map of what stands before a line of one kind."""
    corpus = given.shop(spark, folder)
    hits = corpus.search([[anything(), word("N")]], Selection({"status": Choice(("P", "F"))}), keep=("word",))
    return corpus.geo_distribution(hits)


@query
def agg13_totals(spark, folder):
    margins = docs_distribution(spark, folder).margins()
    return margins.select("level", F.coalesce("attr", F.lit("")).alias("attr"), F.coalesce("value", F.lit("")).alias("value"), "n")


@query
def agg14_deviation(spark, folder):
    return docs_distribution(spark, folder).scores().select("attr", "total", F.round("dp", 9).alias("dp"))


@query
def agg14_outside_categories(spark, folder):
    """Values without any hit in a labelled text keep total 0 and have no score."""
    corpus = given.docs(spark, folder)
    hits = corpus.search([[Tok(form_test("thatin", where="start"))]], keep=("lemma",))
    scores = corpus.distribution(hits, "lemma", "toxic").scores()
    return scores.select("attr", "total", F.round("dp", 9).alias("dp"))


@query
def agg15_total_deviation(spark, folder):
    return docs_distribution(spark, folder).total_score().select("total", F.round("dp", 9).alias("dp"))


@query
def agg16_zero_columns(spark, folder):
    corpus = given.docs(spark, folder)
    hits = corpus.search([[word("der")]], keep=("lemma",))
    shown = corpus.distribution(hits, "lemma", "n_chars")
    kept = shown.columns(keep_zero=True).withColumn("zeros", F.lit("kept"))
    return kept.unionByName(shown.columns(keep_zero=False).withColumn("zeros", F.lit("dropped")))


@query
def agg17_number_order(spark, folder):
    """Columns of a number category: ordered as numbers, shown as text."""
    texts = given.docs_texts(spark, folder)
    totals = stats.category_totals(stats.category_values(texts, "n_chars", facet=False), texts)
    numbered = number_rows(totals, ["value"], "column_no")
    return numbered.select("column_no", F.col("value").cast("string").alias("value"), "n_tokens")


@query
def agg18_geo_distribution(spark, folder):
    form = geo.form_attribute(("pos_tag", "lemma"))
    return geo.geo_distribution(given.shop_line_hits(spark, folder), given.shop_texts(spark, folder), form)


@query
def agg19_places_with_forms(spark, folder):
    return geo.places_with_forms(shop_geo(spark, folder), given.coordinates(spark, folder))


@query
def agg20_forms_with_places(spark, folder):
    return geo.forms_with_places(shop_geo(spark, folder))


@query
def agg21_marker_sets(spark, folder):
    distribution = shop_geo(spark, folder)
    colours = geo.colour_table(distribution, {"red": ["RF", "AF"], "blue": ["NO", "RF"]})
    return geo.marker_sets(distribution, colours, given.coordinates(spark, folder))


@query
def agg22_speakers_and_places(spark, folder):
    facets = {"status": Facet(("O", "P")), "price": Facet(low=1000, high=150000)}
    return geo.speakers_and_places(select_by_facets(given.shop_texts(spark, folder), facets))


# ---------------------------------------------------------------- neighbours and sets


@query
def win1_neighbours(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("of"), word("the")]])
    before = hit_ops.with_token(hits, tokens, F.col("start") - 1, {"word": "before"})
    both = hit_ops.with_token(before, tokens, F.col("end") + 1, {"word": "after"})
    return rows_of_with(both, "before", "after")


def rows_of_with(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.select("text_id", F.col("start").alias("hit_start"), *(F.coalesce(c, F.lit("")).alias(c) for c in columns))


@query
def win2_context_frame(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("that"), word("the")]])
    framed = concordance.in_context(hits, tokens, ("word",), 2)
    return framed.select("text_id", F.col("start").alias("hit_start"), full("left").alias("left_text"), full("right").alias("right_text"))


@query
def win3_match_offsets(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("and"), Gap(1, 2), word("of")]])
    return rows_of_with(stats.match_part(hits, tokens, ["word"], 2, 2), "word")


@query
def set1_union_of_patterns(spark, folder):
    return per_text(docs_hits(spark, folder, [word("the")], [Tok(form_test("the", where="start"))], simple("*e")))


@query
def set3_difference(spark, folder):
    by_text = stats.attribute_by_text(common_words(spark, folder), "lemma")
    counts = by_text.groupBy("attr").agg(F.sum("n").alias("_n"))
    removed = counts.where(F.col("_n") > 0.2 * counts.agg(F.sum("_n")).scalar()).select("attr")
    return stats.without_values(by_text, removed)


@query
def set4_distinct(spark, folder):
    return stats.distinct_values(given.shop_texts(spark, folder), "place")


@query
def set5_whole_order(spark, folder):
    """All hits numbered in corpus order."""
    hits = docs_hits(spark, folder, [word("is")])
    return number_rows(hits, list(ordering.CORPUS_ORDER), "hit_no").select("hit_no", "text_id", F.col("start").alias("hit_start"))


# ---------------------------------------------------------------- scalar functions


@query
def fun_text_helpers(spark, folder):
    docs = given.table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        text_functions.truncated("text", 40).alias("short"),
        text_functions.text_id_of(F.concat_ws(".", "source", "lang", F.col("doc_id").cast("string"))).alias("source"),
        text_functions.two_decimals(F.col("n_chars") / 7).alias("seventh"),
    )


# ---------------------------------------------------------------- exports


@query
def snk1_concordance_export(spark, folder):
    ranges = given.docs_ranges(spark, folder)
    tokens = given.docs_placed_tokens(spark, folder, ranges)
    hits = hit_ops.find_hits(tokens, [[word("from"), word("the")]])
    placed = hits.withColumn("pos", F.col("startpos") + F.col("start"))
    lines = concordance.with_metadata(concordance.concordance_lines(placed, tokens), ranges, ["source", "quality"])
    segment = F.concat_ws(".", F.col("text_id").cast("string"), F.col("s_id").cast("string"))
    return exports.concordance_export(lines.withColumn("segment", segment), {"source": "Source", "quality": "Quality"})


@query
def snk2_two_lines(spark, folder):
    tokens = given.docs_tokens(spark, folder)
    hits = hit_ops.find_hits(tokens, [[word("from"), word("the")]])
    segment = F.concat_ws(".", F.col("text_id").cast("string"), F.col("s_id").cast("string"))
    pairs = exports.two_line_export(hits, tokens, ("lemma", "phon", "orig"), segment, given.docs_texts(spark, folder), ["source"], 5)
    return pairs.select("text_id", F.col("start").alias("hit_start"), F.array_join("lines", "\n").alias("lines"))


@query
def snk3_frequency_export(spark, folder):
    counted = stats.frequency_list(common_words(spark, folder, ("word", "lemma")), ["word", "lemma"], case_sensitive=True)
    return exports.frequency_export(stats.by_frequency(counted, ["word", "lemma"]), {"word": "Word form", "lemma": "Lemma"})


@query
def snk4_distribution_export(spark, folder):
    shown = docs_distribution(spark, folder, "lang")
    wide = exports.distribution_export(shown.cells, shown.totals, ["de", "en", "es", "fr"], shown.by_text)
    # titles hold token counts; plain names let the result be compared
    return wide.toDF("attribute_value", *(t.split(" ")[0] for t in wide.columns[1:-2]), "total", "dp")


@query
def snk4_distribution_lines(spark, folder):
    """The same export as lines of text, for any number of columns."""
    shown = docs_distribution(spark, folder, "lang")
    return exports.distribution_lines(shown.cells, shown.totals, shown.by_text)


@query
def snk4_distribution_titles(spark, folder):
    """The titles of the same export, one per row."""
    shown = docs_distribution(spark, folder, "lang")
    return shown.columns().select(F.concat("value", F.lit(" ("), F.col("n_tokens").cast("string"), F.lit(" tokens)")).alias("title"))


@query
def snk5_running_text(spark, folder):
    corpus = given.docs(spark, folder)
    chosen = corpus.select(Selection({"lang": Choice(("en", "es"))}))
    pieces = exports.running_text(in_texts(corpus.tokens, chosen), "lemma")
    return pieces.select("text_id", "block", F.md5("value").alias("text_md5"), F.length("value").cast("bigint").alias("n_chars"))
