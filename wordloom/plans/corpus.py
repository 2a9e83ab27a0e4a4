"""A corpus as a set of tables, and the questions a user asks of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from wordloom.layout import BUCKET, bits_for, bits_of
from wordloom.operators import concordance, geo, hits as hit_ops, lexicon, ordering, stats
from wordloom.operators.patterns import Gap, Tok, is_blank
from wordloom.operators.selection import Dimension, Selection, in_ranges, select_texts
from wordloom.session import cut
from wordloom.sources.tokens import NEIGHBOURS, corpus_sizes, save_blocks, save_runs, save_tokens, stored_tokens, vocabulary

Patterns = Iterable[Iterable[Tok | Gap]]


@dataclass(frozen=True)
class Corpus:
    """``tokens`` and ``texts`` with what goes with them; ``within`` is the region a hit may not leave.

    ``tokens`` has ``text_id``, ``tok_no`` (from 0 in each text), ``<within>_id``, ``<within>_first``, ``<within>_last``,
    ``word`` and the other attributes, and ``pos`` or ``startpos`` if corpus positions are wanted. ``texts`` has
    ``text_id``, ``n_tokens`` and the categories.

    In a written corpus a text has its tokens under the same ``text_id``. In a spoken one ``texts`` are speakers,
    ``tokens.text_id`` is the recording, ``speaker`` the speaker of a token, and ``ranges`` their corpus positions.

    ``blocks`` (``context_blocks``) serve contexts of words, ``words`` (``vocabulary``) tests on words; ``stored`` makes both.
    """

    tokens: DataFrame
    texts: DataFrame
    dimensions: Mapping[str, Dimension] = field(default_factory=dict)
    attributes: tuple[str, ...] = ()
    within: str = "s"
    spoken: bool = False
    treebank: bool = False
    ranges: DataFrame | None = None
    coords: DataFrame | None = None
    blocks: DataFrame | None = None
    words: DataFrame | None = None

    @staticmethod
    def stored(
        tokens: DataFrame | Callable[[int], DataFrame], texts: DataFrame, path: str, in_order: bool = False,
        blocks: Callable[[int], DataFrame] | None = None, **options,
    ) -> "Corpus":
        """Write the tables of a corpus to ``path`` and read them: tokens with their neighbours, context blocks, vocabulary.

        ``in_order`` says that tokens come from documents arranged by id (``sources.tokens.arranged``). ``blocks`` makes the
        context blocks for a width of storage partitions; without it they are put together from the stored tokens. A function
        as ``tokens`` makes their runs (``sources.tokens.token_runs``) for such a width, which are stored instead of them.
        """
        spark = texts.sparkSession
        texts.write.parquet(f"{path}/texts")
        last = spark.read.parquet(f"{path}/texts").agg(F.max("endpos")).first()[0] if "endpos" in texts.columns else None
        if callable(tokens):
            save_runs(tokens(bits_for(1 if last is None else last + 1)), f"{path}/tokens")
        else:
            save_tokens(tokens, f"{path}/tokens", in_order=in_order, bits=None if last is None else bits_for(last + 1))
        kept = stored_tokens(spark.read.parquet(f"{path}/tokens"))
        save_blocks(kept, f"{path}/blocks", blocks=None if blocks is None else blocks(bits_of(kept)))
        vocabulary(kept).write.parquet(f"{path}/words")
        return Corpus.opened(spark, path, **options)

    @staticmethod
    def opened(spark, path: str, **options) -> "Corpus":
        """A corpus that ``stored`` has written."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return Corpus(stored_tokens(read("tokens")), read("texts"), blocks=read("blocks"), words=read("words"), **options)

    # ------------------------------------------------------------ texts

    def select(self, selection: Selection = Selection(), language: str | None = None) -> DataFrame:
        return select_texts(self.texts, selection, self.dimensions, language)

    def sizes(self, by: str = "lang") -> DataFrame:
        return corpus_sizes(self.tokens, by)

    def text_count(self, selection: Selection = Selection()) -> DataFrame:
        """Number of selected texts (or speakers) and of their tokens."""
        chosen = self.select(selection)
        return stats.speaker_and_token_count(chosen, self.ranges) if self.spoken else stats.text_and_token_count(chosen)

    def category_values(self, category: str, selection: Selection = Selection()) -> DataFrame:
        return stats.distinct_values(self.texts, category, selection, self.dimensions)

    def category_range(self, category: str, selection: Selection = Selection()) -> DataFrame:
        return stats.category_range(self.texts, category, selection, self.dimensions)

    def metadata_page(
        self,
        columns: Iterable[str],
        selection: Selection = Selection(),
        page: int = 1,
        by: str = "text_id",
        descending: bool = False,
    ) -> DataFrame:
        """AGG-6. A page of the metadata table, sorted by a column of ``texts`` or a many-to-many one (``dimension.column``).

        The page is cut first, from texts with their sort key alone; values and lists are then looked up for its texts.
        """
        columns = list(columns)
        chosen = self.select(selection)
        if "." in by:
            name, column = by.split(".")
            keyed = chosen.select("text_id").join(stats.sort_value(self.dimensions[name], column), "text_id", "left")
            key = "sort_value"
        else:
            key = by
            keyed = chosen.select("text_id", *([] if by == "text_id" else [by]))
        cut_page = ordering.text_page(keyed, page, key, descending)
        place = [] if key == "text_id" else [F.col(key).alias("_key")]
        own = [c for c in columns if "." not in c]
        values = self.texts.select("text_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own))
        rows = cut_page.select("text_id", *place).join(values, "text_id")
        listed = stats.with_lists(rows, columns, self.dimensions, few=page > 0)
        order = ordering.text_order("text_id" if key == "text_id" else "_key", descending)
        return listed.orderBy(*order).select("text_id", *(c.split(".")[-1] for c in columns))

    def one_text(self, text_id, columns: list[str]) -> DataFrame:
        return ordering.one_text(self.texts, text_id, columns)

    # ------------------------------------------------------------ hits

    def search(
        self,
        patterns: Patterns,
        selection: Selection = Selection(),
        language: str | None = None,
        keep: tuple[str, ...] = (),
        match: tuple[str, ...] = (),
        sortable: bool = False,
    ) -> DataFrame:
        """PAT-17. Hits in the selected texts; in speech only in the ranges of the selected (or all listed) speakers.

        Of a stored corpus with positions only the partitions are read that the selection and the words of the patterns lie
        in. ``sortable`` lets hits carry the words beside them, if they are stored, for sorting without a join.
        """
        tokens, patterns = self.tokens, [list(p) for p in patterns]
        keep_last: tuple[str, ...] = ()
        if sortable and set(NEIGHBOURS) <= set(tokens.columns):
            keep, keep_last = (*keep, "before"), ("after",)
        if self.words is not None:
            patterns, buckets = lexicon.resolved(patterns, self.words)
            tokens = tokens if buckets is None else tokens.where(F.col(BUCKET).isin(buckets))
        if self.spoken:
            chosen = self.select(selection, language).select("text_id")
            tokens = in_ranges(tokens, self.ranges.join(chosen, "text_id", "left_semi"))
            return hit_ops.find_hits(tokens, patterns, self.within, keep=keep, match=match, keep_last=keep_last)
        everything = not selection.choices and language is None
        texts = None if everything else self.select(selection, language)
        return hit_ops.find_hits(tokens, patterns, self.within, texts, keep, match, keep_last)

    def lines(self, hits: DataFrame, context: int | None = None, longest: int | None = None, few: bool = False) -> DataFrame:
        """KWI-1. Hits with their context as text, from the context blocks if there are any; see ``in_context``.

        ``few`` says that there are no more hits than a page or a sample of some thousands has: they are sent to the blocks.
        """
        source = self.tokens if self.blocks is None else self.blocks
        hits = F.broadcast(hits) if few and self.blocks is not None else hits
        return concordance.concordance_lines(hits, source, context=context, treebank=self.treebank, longest=longest, few=few)

    def aligned_search(
        self, patterns: Mapping[str, list], alignment: DataFrame, selection: Selection = Selection()
    ) -> DataFrame:
        """JOI-6 over tokens with a ``lang`` column: language to its patterns, the language of the hits first.

        Further languages with blank patterns are ignored.
        """
        (first, wanted), *others = patterns.items()
        of = lambda language: self.tokens.where(F.col("lang") == language)
        hits = hit_ops.find_hits(of(first), wanted, self.within, self.select(selection, first))
        asked = {code: p for code, p in others if not all(is_blank(items) for items in p)}
        found = {code: hit_ops.find_hits(of(code), p, self.within) for code, p in asked.items()}
        return hit_ops.aligned_hits(hits, alignment, found, self.within)

    def frequency_list(
        self,
        hits: DataFrame,
        attributes: tuple[str, ...] = ("word",),
        case_sensitive: bool = False,
        first: int | None = None,
        last: int | None = None,
    ) -> DataFrame:
        """AGG-7..9 in the order of SRT-6."""
        parts = stats.match_part(hits, self.tokens, attributes, first, last)
        return stats.by_frequency(stats.frequency_list(parts, attributes, case_sensitive), attributes)

    def _per_text(self, hits: DataFrame) -> DataFrame:
        return hits.withColumn("text_id", F.col("speaker")) if self.spoken else hits

    def geo_distribution(self, hits: DataFrame, place: str = "place") -> DataFrame:
        """AGG-18. Hits have to carry the form (phonetic if there is one) and, in speech, the speaker."""
        if self.coords is None:
            raise ValueError("a corpus without coordinates has no map")
        form = geo.form_attribute(self.attributes)
        return geo.geo_distribution(self._per_text(hits), self.texts.withColumn("place", F.col(place)), form)

    def page(self, hits: DataFrame, page: int = 1, by: str = "position", context: int | None = None) -> DataFrame:
        """One page of the concordance. The page is cut first; only its hits are joined with the tokens.

        The hits are read a few times, so pass ``hits.settled(...)`` where a search is dear, or to look at several pages.
        """
        within = self.within if self.spoken else None
        keyed = ordering.sort_keys(hits, self.tokens, by, within)
        # the rows of one page, written once, tell how long its hits are
        found = cut(ordering.hit_page(keyed, page))
        longest = found.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0]
        return self.lines(found, context, longest, few=True).orderBy(*ordering.hit_order())

    def distribution(
        self,
        hits: DataFrame,
        attribute: str,
        category: str,
        selection: Selection = Selection(),
        excluded: Iterable[str] = (),
    ) -> "Distribution":
        """AGG-10..16 for hits that carry ``attribute``.

        The counts per text and the category totals are written to the checkpoint folder once: cells, margins and scores
        are then all taken from them, and the tokens are read a single time.
        """
        counted = stats.attribute_by_text(self._per_text(hits), attribute)
        by_text = cut(stats.without_values(counted, excluded))
        values = stats.category_values(self.texts, category, selection, self.dimensions, facet=False)
        sized = self.texts
        if self.spoken:
            sized = self.ranges.groupBy("text_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n_tokens"))
        totals = cut(stats.category_totals(values, sized))
        return Distribution(by_text, stats.distribution_cells(by_text, values), totals)


@dataclass(frozen=True)
class Distribution:
    """Attribute by category: counts per text, non-zero cells in long form, and the totals of the category values."""

    by_text: DataFrame
    cells: DataFrame
    totals: DataFrame

    def scores(self) -> DataFrame:
        return stats.deviation_of_proportions(self.cells, self.totals, self.by_text)

    def total_score(self) -> DataFrame:
        return stats.total_deviation(self.cells, self.totals)

    def columns(self, keep_zero: bool = False) -> DataFrame:
        return stats.category_columns(self.cells, self.totals, keep_zero)

    def margins(self) -> DataFrame:
        return stats.distribution_totals(self.cells)
