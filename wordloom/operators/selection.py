"""Choosing texts by metadata (FLT-1..9, FLT-12, JOI-1..3)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom import layout
from wordloom.layout import BUCKET, bits_of, block, bucket, unfolded
from wordloom.session import cut

#: Ranges that are sent to the tokens; more of them meet the tokens in a shuffle by block.
SENT_RANGES = 1 << 18


@dataclass(frozen=True)
class Choice:
    """What is wanted of one category: listed values (or all but these), or a number interval."""

    values: tuple = ()
    exclude: bool = False
    low: int | None = None
    high: int | None = None

    def __post_init__(self):
        wanted = tuple(v for v in self.values if v is not None and str(v).strip())
        object.__setattr__(self, "values", wanted)

    @property
    def empty(self) -> bool:
        return not self.values and self.low is None and self.high is None


@dataclass(frozen=True)
class Dimension:
    """A many-to-many category table: ``table`` has ``id`` and value columns, ``bridge`` has ``text_id`` and ``id``."""

    table: DataFrame
    bridge: DataFrame


@dataclass(frozen=True)
class Selection:
    """Category to choice. A key is a column of ``texts``, or ``dimension.column``."""

    choices: Mapping[str, Choice] = field(default_factory=dict)

    def of_texts(self) -> dict[str, Choice]:
        return {k: c for k, c in self.choices.items() if "." not in k and not c.empty}

    def of_dimensions(self, exclude: bool) -> dict[str, dict[str, Choice]]:
        """Dimension name to the choices for its columns, either the included or the excluded ones."""
        grouped: dict[str, dict[str, Choice]] = {}
        for key, choice in self.choices.items():
            if "." in key and not choice.empty and choice.exclude == exclude:
                name, column = key.split(".")
                grouped.setdefault(name, {})[column] = choice
        return grouped

    def for_facet(self, category: str) -> "Selection":
        """FLT-5. The selection for listing a category's own values: its own filter is left out.

        An excluded many-to-many value stays excluded, because it excludes texts and not values.
        """
        keep = lambda k, c: k != category or ("." in k and c.exclude)
        return replace(self, choices={k: c for k, c in self.choices.items() if keep(k, c)})


def matches(column: Column, choice: Choice) -> Column:
    """FLT-1 and FLT-3: the value is listed, or lies in the interval (both ends inclusive)."""
    if choice.low is not None and choice.high is not None:
        return column.between(choice.low, choice.high)
    if choice.low is not None:
        return column >= choice.low
    if choice.high is not None:
        return column <= choice.high
    return column.isin(*choice.values)


def text_predicate(column: Column, choice: Choice) -> Column:
    """FLT-2 for an excluded list, where texts without a value are kept; else ``matches``."""
    if choice.exclude and choice.values:
        return column.isNull() | ~column.isin(*choice.values)
    return matches(column, choice)


def all_of(predicates: list[Column]) -> Column:
    """FLT-4. Categories are AND-ed; no predicate means everything."""
    return reduce(and_, predicates, F.lit(True))


def dimension_rows(dimension: Dimension, choices: Mapping[str, Choice]) -> DataFrame:
    """JOI-1. (text_id, value columns) of a many-to-many table, with all choices on the same row of it."""
    wanted = dimension.table.where(all_of([matches(F.col(c), ch) for c, ch in choices.items()]))
    return dimension.bridge.join(wanted, "id").drop("id")


def texts_with(dimension: Dimension, choices: Mapping[str, Choice]) -> DataFrame:
    """Ids of texts that have a row matching all choices."""
    wanted = dimension.table.where(all_of([matches(F.col(c), ch) for c, ch in choices.items()]))
    return dimension.bridge.join(wanted.select("id"), "id", "left_semi").select("text_id")


def select_texts(
    texts: DataFrame,
    selection: Selection,
    dimensions: Mapping[str, Dimension] | None = None,
    language: str | None = None,
) -> DataFrame:
    """FLT-1..6, JOI-2, JOI-3. The texts of a selection, one row each.

    Predicates on ``texts`` reach the scan. An included many-to-many value is a left-semi join and an excluded one a
    left-anti join, so a text is never repeated and texts without any value survive an exclusion.
    """
    predicates = [text_predicate(F.col(k), c) for k, c in selection.of_texts().items()]
    if language is not None:
        predicates.append(F.col("lang") == language)
    chosen = texts.where(all_of(predicates))
    for name, choices in selection.of_dimensions(exclude=False).items():
        chosen = chosen.join(texts_with(dimensions[name], choices), "text_id", "left_semi")
    for name, choices in selection.of_dimensions(exclude=True).items():
        for column, choice in choices.items():
            chosen = chosen.join(texts_with(dimensions[name], {column: choice}), "text_id", "left_anti")
    return chosen


def in_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """FLT-7. Rows (tokens or hits) of the given texts.

    Tokens with corpus positions are found by the ranges of the texts (``startpos``, ``endpos``), so a stored table is read
    only where they lie. Without positions the key is (text, block of tokens), from ``n_tokens`` of the texts, which must
    then be known; a text alone is the key only where the rows have no token number.
    """
    at = next((c for c in ("tok_no", "start") if c in rows.columns), None)
    if "pos" in rows.columns and {"startpos", "endpos"} <= set(texts.columns):
        return in_ranges(rows, texts.select(F.col("startpos").alias("start"), F.col("endpos").alias("end")))
    if at is None or "n_tokens" not in texts.columns:
        return rows.join(texts.select("text_id"), "text_id", "left_semi")
    last = block(F.col("n_tokens").cast("long") - 1)
    blocks = unfolded(texts.select("text_id", "n_tokens"), F.lit(0).cast("long"), last, "_block").drop("n_tokens")
    return rows.withColumn("_block", block(F.col(at))).join(blocks, ["text_id", "_block"], "left_semi").drop("_block")


def in_span(texts: DataFrame, low: int | Column, high: int | Column) -> DataFrame:
    """FLT-7. Texts that lie inside the corpus positions ``low`` to ``high``."""
    return texts.where((F.col("startpos") >= low) & (F.col("endpos") <= high))


def merged_ranges(ranges: DataFrame, bits: int | None = None) -> DataFrame:
    """The union of ranges (start, end), ends inclusive, as disjoint ones (cell, start, end) that do not touch in a cell.

    Ranges are cut at cells of ``2 ** bits`` positions (default: those of the storage partitions) and put together within
    each: of all that start at one place only the longest counts, so a cell never has more rows than places.
    """
    bits = layout.BUCKET_BITS if bits is None else bits
    cells = unfolded(ranges.select("start", "end"), block("start", bits), block("end", bits), "cell")
    low = F.shiftleft("cell", bits)
    pieces = cells.where(F.col("start") <= F.col("end")).select(
        "cell", F.greatest("start", low).alias("start"), F.least(F.col("end"), low + ((1 << bits) - 1)).alias("end")
    )
    longest = pieces.groupBy("cell", "start").agg(F.max("end").alias("end"))
    in_order = W.partitionBy("cell").orderBy("start")
    reach = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0)
    islands = longest.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(in_order))
    return islands.groupBy("cell", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def in_ranges(tokens: DataFrame, ranges: DataFrame, position: str = "pos", bits: int = 10) -> DataFrame:
    """FLT-8, JOI-5. Tokens whose position lies in one of the ranges (start, end), ends inclusive.

    Overlapping ranges are merged first, and what is left is listed by blocks of ``2 ** bits`` positions, so a token meets
    one row at most, whatever the number and the length of the ranges. The list is written once, as its size decides:
    up to ``SENT_RANGES`` ranges are sent to the tokens, and of a stored table only the partitions they lie in are read;
    more than that are shuffled with the tokens by block.
    """
    merged = merged_ranges(ranges, max(bits, layout.BUCKET_BITS))
    pieces = unfolded(merged, block("start", bits), block("end", bits), "_block")
    low = F.shiftleft("_block", bits)
    span = F.struct(F.greatest("start", low).alias("start"), F.least(F.col("end"), low + ((1 << bits) - 1)).alias("end"))
    place = bucket(F.shiftleft("_block", bits), bits_of(tokens))
    listed = cut(pieces.groupBy(place, "_block").agg(F.collect_list(span).alias("_spans")))
    n_spans = listed.agg(F.sum(F.size("_spans"))).first()[0] or 0
    stored = BUCKET in tokens.columns and position == "pos" and bits <= bits_of(tokens)
    keys = [BUCKET, "_block"] if stored else ["_block"]
    # Spark prunes partitions by a joined table only if that table is filtered; every list passes
    wanted = listed.select(*keys, "_spans").where(F.size("_spans") > 0)
    wanted = F.broadcast(wanted) if n_spans <= SENT_RANGES else wanted
    inside = F.exists("_spans", lambda s: F.col(position).between(s["start"], s["end"]))
    return tokens.withColumn("_block", block(position, bits)).join(wanted, keys).where(inside).select(*tokens.columns)


def with_value(rows: DataFrame, column: str) -> DataFrame:
    """FLT-9. Rows that have a value; the loaders turn every missing marker into NULL."""
    return rows.where(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))


@dataclass(frozen=True)
class Facet:
    """Active values of one category on the map: a list, or a range of whole numbers with or without NULL."""

    values: tuple = ()
    low: int | None = None
    high: int | None = None
    nulls: bool = False

    def test(self, column: Column) -> Column:
        active = F.coalesce(column.isin(*self.values), F.lit(False)) if self.values else F.lit(False)
        if self.low is not None and self.high is not None:
            active = active | F.coalesce(column.between(self.low, self.high), F.lit(False))
        return active | column.isNull() if self.nulls else active


def select_by_facets(texts: DataFrame, facets: Mapping[str, Facet]) -> DataFrame:
    """FLT-12, SET-2. Union of the active values inside a category, intersection between categories.

    A category without active values selects nothing.
    """
    return texts.where(all_of([f.test(F.col(c)) for c, f in facets.items()]))


def facet_extent(texts: DataFrame, column: str) -> DataFrame:
    """Full range of a number category: ``low, high, nulls``."""
    return texts.agg(
        F.min(column).cast("bigint").alias("low"),
        F.max(column).cast("bigint").alias("high"),
        F.coalesce(F.bool_or(F.col(column).isNull()), F.lit(False)).alias("nulls"),
    )


def narrowed_facets(facets: Mapping[str, Facet], full: Mapping[str, Facet]) -> dict[str, Facet]:
    """FLT-12. Only the categories that are not at their full range any more are returned as filters."""
    as_set = lambda f: (frozenset(f.values), f.low, f.high, f.nulls)
    return {c: f for c, f in facets.items() if as_set(f) != as_set(full[c])}
