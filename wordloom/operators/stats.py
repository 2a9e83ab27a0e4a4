"""Counts, frequency lists and metadata distributions (AGG-1..17, FLT-10)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.operators.hits import with_match
from wordloom.operators.selection import Dimension, Selection, dimension_rows, select_texts

#: Bits of the neighbouring tokens whose distinct values are found in one group.
PART_BITS = 16

# ---------------------------------------------------------------- texts and categories


def text_and_token_count(texts: DataFrame) -> DataFrame:
    """AGG-1. Selected texts and their tokens; one row of zeros for an empty selection."""
    return texts.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
    )


def speaker_and_token_count(speakers: DataFrame, ranges: DataFrame) -> DataFrame:
    """AGG-2. Selected speakers and the tokens in their ranges; a speaker without ranges still counts as one."""
    sizes = ranges.groupBy("text_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("_n"))
    return speakers.select("text_id").join(sizes, "text_id", "left").agg(
        F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_tokens")
    )


def values_per_text(tokens: DataFrame, counts: Mapping[str, str], largest: Mapping[str, str]) -> DataFrame:
    """Per text the number of distinct values of token attributes, and the largest value of others: ``{name: attribute}``.

    Tokens are moved once, by (text, 2^16 neighbouring tokens), and are not gathered before: a task would have to hold the
    values of all its texts. A text of up to 2^16 tokens is then one group and only numbers are left of it; the values of a
    longer one meet by themselves. Token numbers have no gaps, so a text is longer if it has the token that begins the second
    part, which therefore also goes to the first.
    """
    part = F.shiftright("tok_no", PART_BITS)
    own = F.struct(part.alias("_part"), (part > 0).alias("_long"))
    first = F.struct((part - part).alias("_part"), F.lit(True).alias("_long"))
    places = F.when(F.col("tok_no") == 1 << PART_BITS, F.array(own, first)).otherwise(F.array(own))
    used = [c for c in dict.fromkeys([*largest.values(), *counts.values()])]
    moved = tokens.select("text_id", F.explode(places).alias("_place"), *(F.col(c).alias(f"_{c}") for c in used))
    moved = moved.select("text_id", "_place.*", *(f"_{c}" for c in used)).repartition("text_id", "_part")
    parts = moved.groupBy("text_id", "_part").agg(
        F.bool_or("_long").alias("_long"),
        *(F.collect_set(f"_{c}").alias(f"_set_{name}") for name, c in counts.items()),
        *(F.max(f"_{c}").alias(name) for name, c in largest.items()),
    )
    number = {name: F.lit(k) for k, name in enumerate(counts)}
    size = lambda name: F.struct(number[name].alias("which"), F.lit(None).cast("string").alias("value"), F.size(f"_set_{name}").cast("bigint").alias("n"))
    each = lambda name: F.transform(f"_set_{name}", lambda v: F.struct(number[name].alias("which"), v.cast("string").alias("value"), F.lit(1).cast("bigint").alias("n")))
    sizes = F.array(*map(size, counts))
    # one row at least, as a long text without values is a text too
    found = F.when(F.col("_long"), F.concat(*map(each, counts), F.array(F.struct(F.lit(-1).alias("which"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n"))))).otherwise(sizes)
    items = parts.select("text_id", *largest, F.explode(found).alias("_f")).select("text_id", "_f.*", *largest)
    once = items.groupBy("text_id", "which", "value").agg(F.max("n").alias("n"), *(F.max(c).alias(c) for c in largest))
    return once.groupBy("text_id").agg(
        *(F.coalesce(F.sum(F.when(F.col("which") == number[name], F.col("n"))), F.lit(0)).alias(name) for name in counts),
        *(F.max(c).alias(c) for c in largest),
    )


def category_values(
    texts: DataFrame,
    category: str,
    selection: Selection = Selection(),
    dimensions: Mapping[str, Dimension] | None = None,
    facet: bool = True,
) -> DataFrame:
    """Distinct (text_id, value) of a category in the selected texts, values present only.

    For a many-to-many category, choices for other columns of the same table hold for the same row of it.
    """
    selection = selection.for_facet(category) if facet else selection
    chosen = select_texts(texts, selection, dimensions)
    if "." not in category:
        pairs = chosen.select("text_id", F.col(category).alias("value"))
        return pairs.where(F.col("value").isNotNull())
    name, column = category.split(".")
    rows = dimension_rows(dimensions[name], selection.of_dimensions(exclude=False).get(name, {}))
    pairs = rows.select("text_id", F.col(column).alias("value")).where(F.col("value").isNotNull())
    return pairs.join(chosen.select("text_id"), "text_id", "left_semi").distinct()


def category_range(texts: DataFrame, category: str, selection: Selection = Selection(), dimensions=None) -> DataFrame:
    """AGG-3. Smallest and largest value of a number category; its own filter does not count."""
    return category_values(texts, category, selection, dimensions).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


def distinct_values(texts: DataFrame, category: str, selection: Selection = Selection(), dimensions=None) -> DataFrame:
    """AGG-4, SET-4. The values a user can choose, in order; the category's own filter does not count."""
    return category_values(texts, category, selection, dimensions).select("value").distinct().orderBy("value")


def listed_values(dimension: Dimension, column: str, ids: DataFrame | None = None) -> DataFrame:
    """AGG-5. One row per text with its many-to-many values in order, separated by ``'; '``; a repeated value repeats.

    ``ids`` (text_id) limits the lists to these texts, before the values are looked up.
    """
    if ids is not None:
        dimension = Dimension(dimension.table, dimension.bridge.join(ids, "text_id", "left_semi"))
    rows = dimension_rows(dimension, {}).select("text_id", F.col(column).alias("_value"))
    listed = rows.where(F.col("_value").isNotNull()).groupBy("text_id")
    return listed.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_value")), lambda v: v.cast("string")), "; ").alias(column)
    )


def metadata_table(
    texts: DataFrame,
    columns: Iterable[str],
    selection: Selection = Selection(),
    dimensions: Mapping[str, Dimension] | None = None,
) -> DataFrame:
    """AGG-6. One row per selected text with columns and many-to-many lists as strings, blank where missing.

    Typed columns of ``texts`` keep their own name with the suffix ``_key`` for sorting.
    """
    columns = list(columns)
    own = [c for c in columns if "." not in c]
    table = select_texts(texts, selection, dimensions).select(
        "text_id",
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in own),
        *(F.col(c).alias(f"{c}_key") for c in own),
    )
    lists = []
    for key in (c for c in columns if "." in c):
        name, column = key.split(".")
        lists.append(column)
        table = table.join(listed_values(dimensions[name], column), "text_id", "left")
    return table.na.fill("", lists)


def with_lists(
    page: DataFrame, columns: Iterable[str], dimensions: Mapping[str, Dimension], few: bool = True
) -> DataFrame:
    """AGG-6. Rows of texts with the lists of the asked many-to-many columns (``dimension.column``), blank where missing.

    Lists are made for the given texts only; ``few`` says that there are no more of them than a page has.
    """
    ids = page.select("text_id")
    ids = F.broadcast(ids) if few else ids
    lists = [key.split(".") for key in columns if "." in key]
    for name, column in lists:
        page = page.join(listed_values(dimensions[name], column, ids), "text_id", "left")
    return page.na.fill("", [column for _, column in lists])


def sort_value(dimension: Dimension, column: str) -> DataFrame:
    """SRT-7. The value by which texts are sorted on a many-to-many column: the smallest one."""
    rows = dimension_rows(dimension, {})
    return rows.groupBy("text_id").agg(F.min(column).alias("sort_value"))


# ---------------------------------------------------------------- frequency lists


def match_part(
    hits: DataFrame, tokens: DataFrame, attributes: Iterable[str], first: int | None = None, last: int | None = None
) -> DataFrame:
    """AGG-9, WIN-3. Hits with each attribute of tokens ``first`` to ``last`` of the match (from 1), space-separated.

    Open bounds are the ends of the match, and both are clipped to it.
    """
    attributes = list(attributes)
    if first is not None and last is not None and first > last:
        raise ValueError("the first token must not come after the last")
    full = with_match(hits, tokens, attributes) if "match" not in hits.columns else hits
    begin = max(first or 1, 1)
    stop = F.size("match") if last is None else F.least(F.size("match"), F.lit(last))
    part = F.slice("match", F.lit(begin), F.greatest(stop - begin + 1, F.lit(0)))
    joined = [F.array_join(_values("_part", a), " ").alias(a) for a in attributes]
    return full.withColumn("_part", part).select(*hits.columns, *joined)


def _values(array: str, attribute: str) -> Column:
    return F.transform(array, lambda t: F.coalesce(t[attribute].cast("string"), F.lit("")))


def frequency_list(rows: DataFrame, attributes: Iterable[str] = ("word",), case_sensitive: bool = False) -> DataFrame:
    """AGG-7, AGG-8. Count of every combination of attribute values, undefined values blank.

    ``rows`` are hits that carry the attributes: from ``find_hits(keep=...)`` for one-token matches, from
    ``match_part`` for longer ones or a part of them. Without attributes the words are counted.
    """
    attributes = tuple(attributes) or ("word",)
    shown = lambda a: F.coalesce(F.col(a).cast("string"), F.lit(""))
    keys = [(shown(a) if case_sensitive else F.lower(shown(a))).alias(a) for a in attributes]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def by_frequency(counted: DataFrame, attributes: Iterable[str] = ("word",)) -> DataFrame:
    """SRT-6. Highest count first, equal counts by value descending in byte order."""
    return counted.orderBy(F.desc("n"), F.concat_ws("\t", *(tuple(attributes) or ("word",))).desc())


# ---------------------------------------------------------------- distributions


def attribute_by_text(hits: DataFrame, attribute: str) -> DataFrame:
    """AGG-10. Hits per attribute value of the first token (blank if undefined) and text, case-sensitive."""
    value = F.coalesce(F.col(attribute).cast("string"), F.lit(""))
    return hits.groupBy(value.alias("attr"), "text_id").agg(F.count(F.lit(1)).alias("n"))


def without_values(counted: DataFrame, excluded: Iterable[str] | DataFrame) -> DataFrame:
    """FLT-10, SET-3. Attribute values the user removed, taken out before totals and scores.

    A list becomes a predicate; a table of values (column ``attr``) an anti join.
    """
    if isinstance(excluded, DataFrame):
        return counted.join(excluded, "attr", "left_anti")
    excluded = list(excluded)
    return counted.where(~F.col("attr").isin(*excluded)) if excluded else counted


def category_totals(values: DataFrame, texts: DataFrame) -> DataFrame:
    """AGG-11. Per category value the texts and tokens; a text with two values counts under both.

    ``values`` are (text_id, value) pairs from ``category_values``, ``texts`` has ``n_tokens``; a speaker without ranges
    has none there and counts as a text without tokens.
    """
    return (
        values.join(texts.select("text_id", "n_tokens"), "text_id", "left")
        .groupBy("value")
        .agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"))
    )


def distribution_cells(by_text: DataFrame, values: DataFrame) -> DataFrame:
    """AGG-12. Non-zero cells (attr, value, n) of the attribute by category matrix.

    Hits were counted per (attr, text) before this join, so it carries counts and not hits.
    """
    return by_text.join(values, "text_id").groupBy("attr", "value").agg(F.sum("n").alias("n"))


def distribution_totals(cells: DataFrame) -> DataFrame:
    """AGG-13. Totals per attribute value, per category value and overall; ``level`` says which."""
    return cells.groupingSets([["attr"], ["value"], []], "attr", "value").agg(
        F.when(F.grouping("attr") == 0, "attr").when(F.grouping("value") == 0, "value").otherwise("all").alias("level"),
        F.sum("n").alias("n"),
    )


def expected_shares(totals: DataFrame) -> DataFrame:
    """Share of every category value in all tokens, as ``expected``."""
    whole = totals.agg(F.sum("n_tokens")).scalar()
    return totals.select("value", (F.col("n_tokens") / whole).alias("expected"))


def _score(expected: Column, observed: Column) -> Column:
    """Deviation of proportions (Gries 2008) over the non-zero cells.

    Half the sum of |expected - observed| over all values; a zero cell adds its expected share, and these shares add
    up to one less those of the non-zero cells.
    """
    return (1 + F.sum(F.abs(expected - observed) - expected)) / 2


def deviation_of_proportions(cells: DataFrame, totals: DataFrame, by_text: DataFrame | None = None) -> DataFrame:
    """AGG-14. (attr, total, dp) per attribute value.

    With ``by_text`` values that occur only outside the listed categories are kept, with total 0 and NULL score.
    """
    whole = cells.groupBy("attr").agg(F.sum("n").alias("total"))
    known = cells.join(whole, "attr").join(expected_shares(totals), "value")
    scores = known.groupBy("attr").agg(
        F.max("total").alias("total"), _score(F.col("expected"), F.col("n") / F.col("total")).alias("dp")
    )
    if by_text is None:
        return scores
    everything = by_text.select("attr").distinct()
    return everything.join(scores, "attr", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def total_deviation(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """AGG-15. The same score on the column totals: one row (total, dp)."""
    columns = cells.groupBy("value").agg(F.sum("n").alias("n"))
    whole = columns.agg(F.sum("n")).scalar()
    joined = columns.join(expected_shares(totals), "value")
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), _score(F.col("expected"), F.col("n") / whole).alias("dp")
    )


def category_columns(cells: DataFrame, totals: DataFrame, keep_zero: bool = True) -> DataFrame:
    """AGG-16, AGG-17. Category values with hits and tokens, in the order of their type, shown as text.

    Without ``keep_zero`` values that have no hits are dropped; the token total of the corpus still counts them.
    """
    typed = typed_columns(cells, totals, keep_zero)
    return typed.orderBy("value").select(F.col("value").cast("string").alias("value"), "n_hits", "n_tokens", "n_texts")


def typed_columns(cells: DataFrame, totals: DataFrame, keep_zero: bool = True) -> DataFrame:
    """The same in no order, with values of their own type."""
    hits = cells.groupBy("value").agg(F.sum("n").alias("n_hits"))
    joined = totals.join(hits, "value", "left" if keep_zero else "inner")
    return joined.select("value", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "n_tokens", "n_texts")
