"""Export rows and files (SNK-1..5)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.functions.text import two_decimals
from wordloom.layout import block
from wordloom.operators.concordance import in_context
from wordloom.operators.ordering import CORPUS_ORDER
from wordloom.operators.stats import deviation_of_proportions, total_deviation, typed_columns

# Column titles of the exports.
POSITION, SENTENCE_ID, SPEAKER_ID = "Corpus position", "Sentence ID", "Informant ID"
LEFT, MATCH, RIGHT = "Left context", "Match", "Right context"
COUNT, ATTRIBUTE_VALUE, DP, TOTAL = "Count", "Attribute value", "Deviation of proportions", "Total"


def write_table(table: DataFrame, path: str, format: str = "tsv", header: bool = True) -> None:
    """SNK-1, SNK-3, SNK-4. Tab- or comma-separated files; CSV quotes every text, and missing values stay empty."""
    if format not in ("tsv", "csv"):
        raise ValueError(f"unknown table format: {format}")
    options = {"sep": "\t", "quote": "", "emptyValue": ""} if format == "tsv" else {"sep": ",", "quoteAll": "true", "escape": '"'}
    table.write.options(header=str(header).lower(), **options).csv(path)


def concordance_export(
    lines: DataFrame, categories: Mapping[str, str] | None = None, spoken: bool = False, segment: str = "segment"
) -> DataFrame:
    """SNK-1. Concordance lines (with ``pos`` and joined metadata) under the titles of the export, in corpus order.

    ``categories`` maps metadata columns to titles.
    """
    chosen = [F.col(c).alias(title) for c, title in (categories or {}).items()]
    return lines.orderBy(*CORPUS_ORDER).select(
        F.col("pos").alias(POSITION),
        F.col(segment).alias(SPEAKER_ID if spoken else SENTENCE_ID),
        *chosen,
        F.col("left_text").alias(LEFT),
        F.col("match_text").alias(MATCH),
        F.col("right_text").alias(RIGHT),
    )


def two_line_export(
    hits: DataFrame,
    tokens: DataFrame,
    declared: Iterable[str],
    segment: Column,
    texts: DataFrame | None = None,
    categories: Iterable[str] = (),
    context: int | None = None,
) -> DataFrame:
    """SNK-2. Per hit one line of words and one of phonetic (else original) forms, each after id and metadata.

    The column ``lines`` holds both lines and, for the blank line between hits, an empty third one.
    """
    second = next((a for a in ("phon", "orig") if a in tuple(declared)), None)
    if second is None:
        raise ValueError("the two-line export needs a phon or an orig attribute")
    categories = list(categories)
    shown = in_context(hits, tokens, ("word", second), context)
    if categories:
        values = texts.select("text_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in categories))
        shown = shown.join(values, "text_id", "left").na.fill("", categories)
    everything = F.concat("left", "match", "right")

    def line(attribute: str) -> Column:
        forms = F.transform(everything, lambda t: F.coalesce(t[attribute], F.lit("")))
        return F.concat_ws(" ", segment, *categories, F.array_join(forms, " "))

    return shown.select(*CORPUS_ORDER, F.array(line("word"), line(second), F.lit("")).alias("lines"))


def write_two_line(export: DataFrame, path: str) -> None:
    """SNK-2. The line pairs as text files in corpus order."""
    export.orderBy(*CORPUS_ORDER).select(F.array_join("lines", "\n").alias("value")).write.text(path)


def frequency_export(ordered: DataFrame, attributes: Mapping[str, str]) -> DataFrame:
    """SNK-3. Frequency list under the titles ``Count`` and the attribute names."""
    return ordered.select(F.col("n").alias(COUNT), *(F.col(a).alias(title) for a, title in attributes.items()))


def distribution_export(
    cells: DataFrame, totals: DataFrame, values: list[str], by_text: DataFrame | None = None
) -> DataFrame:
    """SNK-4. Wide matrix: a column for each of the ``values`` of the category, row total, score with two decimals, and
    a last row of totals.

    The caller names the columns, as for any table; ``distribution_lines`` writes a matrix of all values there are.
    """
    rendered = _rendered(cells, totals, by_text, True)
    row = lambda v: F.coalesce(F.get(F.filter("cells", lambda c: c["value"] == v), 0)["n"], F.lit(0)).cast("bigint")
    tokens = {str(r["value"]): r["n_tokens"] for r in totals.where(F.col("value").cast("string").isin(values)).collect()}
    whole = totals.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return rendered.orderBy("last", "attr").select(
        F.col("attr").alias(ATTRIBUTE_VALUE),
        *(row(v).alias(f"{v} ({tokens.get(v, 0)} tokens)") for v in values),
        F.col("total").cast("bigint").alias(f"{TOTAL} ({whole} tokens)"),
        F.col("dp").alias(DP),
    )


def _rendered(cells: DataFrame, totals: DataFrame, by_text: DataFrame | None, keep_zero: bool) -> DataFrame:
    """(last, attr, cells, total, dp) of every line: its non-zero cells as an array of (value, n), score as text.

    The last line holds the totals of the columns. An array has at most one entry per category value.
    """
    pair = F.struct(F.col("value").cast("string").alias("value"), F.col("n").cast("bigint").alias("n"))
    own = cells.groupBy("attr").agg(F.collect_list(pair).alias("cells"))
    lines = deviation_of_proportions(cells, totals, by_text).join(own, "attr", "left").select(
        F.lit(0).alias("last"), "attr", "cells", F.col("total").cast("bigint").alias("total"), two_decimals("dp").alias("dp")
    )
    columns = typed_columns(cells, totals, keep_zero).select(F.col("value"), F.col("n_hits").alias("n"))
    foot = columns.agg(F.collect_list(pair).alias("cells"))
    last = total_deviation(cells, totals).select(
        F.lit(1).alias("last"), F.lit(TOTAL).alias("attr"), foot.scalar().alias("cells"), F.col("total").cast("bigint").alias("total"), two_decimals("dp").alias("dp")
    )
    return lines.unionByName(last)


def distribution_lines(
    cells: DataFrame, totals: DataFrame, by_text: DataFrame | None = None, keep_zero: bool = False, separator: str = "\t"
) -> DataFrame:
    """SNK-4. The export as lines of text (``line``), titles first and totals last, for any number of category values.

    The ordered list of columns is a subquery of one row that every line uses; neither the values nor the matrix go to
    the driver.
    """
    columns = typed_columns(cells, totals, keep_zero)
    title = F.concat(F.col("value").cast("string"), F.lit(" ("), F.col("n_tokens").cast("string"), F.lit(" tokens)"))
    column = F.struct("value", title.alias("title"))
    listed = columns.agg(F.array_sort(F.collect_list(column)).alias("_columns"))
    whole = totals.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("string")).scalar()
    total = F.concat(F.lit(f"{TOTAL} ("), whole, F.lit(" tokens)"))
    joined = lambda first, middle, *rest: F.array_join(F.concat(F.array(first), middle, F.array(*rest)), separator)
    head = listed.select(
        F.lit(-1).alias("last"),
        F.lit("").alias("attr"),
        joined(F.lit(ATTRIBUTE_VALUE), F.transform("_columns", lambda c: c["title"]), total, F.lit(DP)).alias("line"),
    )
    counts = F.map_from_entries(F.coalesce("cells", F.array().cast("array<struct<value:string,n:bigint>>")))
    shown = lambda c: F.coalesce(F.try_element_at("_map", c["value"].cast("string")), F.lit(0)).cast("string")
    body = _rendered(cells, totals, by_text, keep_zero).withColumn("_map", counts).withColumn("_columns", listed.scalar())
    dp = F.coalesce("dp", F.lit(""))
    lines = body.select(
        "last", "attr", joined(F.col("attr"), F.transform("_columns", shown), F.col("total").cast("string"), dp).alias("line")
    )
    return head.unionByName(lines).orderBy("last", "attr").select("line")


def running_text(tokens: DataFrame, attribute: str, bits: int = 12) -> DataFrame:
    """SNK-5. All tokens of one attribute in corpus order, one per line, in pieces of one block: (text_id, block, value).

    A text of any length is many rows of at most 4096 tokens.
    """
    value = F.coalesce(F.col(attribute).cast("string"), F.lit("__UNDEF__"))
    pieces = tokens.groupBy("text_id", block("tok_no", bits).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("tok_no", value.alias("value")))).alias("_tokens")
    )
    joined = F.array_join(F.transform("_tokens", lambda t: t["value"]), "\n")
    return pieces.select("text_id", "block", joined.alias("value"))


def write_running_text(pieces: DataFrame, path: str) -> None:
    """SNK-5. The pieces as text files without header; files and lines follow corpus order."""
    ordered = pieces.repartitionByRange("text_id", "block").sortWithinPartitions("text_id", "block")
    ordered.select("value").write.text(path)
