"""Hits in context (KWI-1..11, JOI-4, JOI-7, JOI-10)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.functions.text import rendered_token, text_id_of
from wordloom.layout import BLOCK, BLOCK_BITS, BUCKET, asked_for, bits_of, block, bucket, unfolded
from wordloom.operators.hits import spans
from wordloom.session import cut
from wordloom.sources.tokens import HALO

# Context sizes in words.
CONTEXT = 15
TREEBANK_CONTEXT = 25
MAX_CONTEXT = 50


def context_size(asked: int | None, treebank: bool = False, most: int | None = MAX_CONTEXT) -> int:
    """KWI-1. Words of context: the default if not asked or negative, else what is asked, at most ``most`` (None: all)."""
    if asked is None:
        return TREEBANK_CONTEXT if treebank else CONTEXT
    if asked < 0:
        return CONTEXT
    return asked if most is None else min(asked, most)


def in_context(
    hits: DataFrame,
    tokens: DataFrame,
    attributes: Iterable[str] = ("word",),
    context: int | None = None,
    treebank: bool = False,
    most: int | None = MAX_CONTEXT,
    longest: int | None = None,
) -> DataFrame:
    """KWI-1, KWI-2, WIN-2. Hits with ``left``, ``match`` and ``right``, arrays of token structs.

    ``tokens`` may be a token table or context blocks (``sources.tokens.context_blocks``). Blocks are best for many hits:
    a hit meets the one row its context lies in, and nothing is grouped by hit. Hits that reach beyond their block (longer
    than ``HALO`` tokens with their context) meet all blocks they touch; ``longest``, the most tokens a hit can have
    (``hits.longest_hit``), says that there are none, else the hits are written once for both kinds, and of the blocks only
    those are moved that pass a filter made of them.

    With a token table a page or a sample of hits is sent to the tokens; more hits than that meet the tokens by exact
    position. The text id is part of the join, so context never runs into another text. ``context`` beyond ``most`` words is
    cut to it.
    """
    n = context_size(context, treebank, most)
    if "block" in tokens.columns:
        return _in_blocks(hits, tokens, tuple(attributes), n, longest, _token_arrays)
    around = spans(hits, tokens, F.col("start") - n, F.col("end") + n, attributes, "_around")
    before = F.col("start") - F.element_at("_around", 1)["tok_no"]
    length = F.col("end") - F.col("start") + 1
    part = lambda first, size: F.slice("_around", first.cast("int"), size.cast("int"))
    return around.select(
        *hits.columns,
        part(F.lit(1), before).alias("left"),
        part(before + 1, length).alias("match"),
        part(before + length + 1, F.size("_around") - before - length).alias("right"),
    )


def _in_blocks(
    hits: DataFrame, blocks: DataFrame, attributes: tuple[str, ...], n: int, longest: int | None, shown: Callable, few: bool = False
) -> DataFrame:
    """``shown`` makes a column of each side from the slices of its arrays and the number of its first token."""
    own = block("start")
    fits = (F.col("end") + n < F.shiftleft(own, BLOCK_BITS) + BLOCK + HALO) & F.lit(n <= HALO)
    near = lambda rows: _framed(_beside(rows.withColumn("_block", own), blocks, attributes).where(fits), hits, attributes, n, shown)
    if longest is not None and longest - 1 + n <= HALO:
        return near(hits)
    wanted = F.greatest(F.col("start") - n, F.lit(0))
    if not few:
        # hits of both kinds and the filter of blocks are taken from what is written of the search
        hits = cut(hits)
        touched = unfolded(hits, block(wanted), block(F.col("end") + n), "_block")
        blocks = asked_for(blocks, ("text_id", "block"), touched, ("text_id", "_block"))
    found = near(hits)
    # every block such a hit touches, without what it holds of its neighbours, put together again
    far = unfolded(hits.where(~fits), block(wanted), block(F.col("end") + n), "_block")
    low = F.shiftleft("_block", BLOCK_BITS)
    from_, to = F.greatest(wanted, low), F.least(F.col("end") + n, low + (BLOCK - 1))
    parts = [F.slice(f"_{a}", (from_ - F.col("first") + 1).cast("int"), F.greatest(to - from_ + 1, F.lit(0)).cast("int")).alias(f"_{a}") for a in attributes]
    pieces = _beside(far, blocks, attributes).select(*hits.columns, F.struct("_block", from_.alias("first"), *parts).alias("_part"))
    joined = pieces.groupBy(*hits.columns).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    whole = joined.select(
        *hits.columns, F.col("_parts")[0]["first"].alias("first"), *(F.flatten(f"_parts._{a}").alias(f"_{a}") for a in attributes)
    )
    return found.unionByName(_framed(whole, hits, attributes, n, shown))


def _beside(hits: DataFrame, blocks: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Hits with ``_block`` and the arrays of that block, as ``first`` and ``_<attribute>``.

    With stored blocks and known start positions the storage partition is a key, so that others are not read.
    """
    keys = ["text_id", "_block"]
    if BUCKET in blocks.columns and "startpos" in hits.columns:
        placed = bucket(F.col("startpos") + F.shiftleft("_block", BLOCK_BITS), bits_of(blocks))
        # Spark prunes partitions by a joined table only if that table is filtered; every block passes
        hits, keys = hits.withColumn(BUCKET, placed).where(F.col("_block") >= 0), [*keys, BUCKET]
    wanted = blocks.withColumnRenamed("block", "_block").select(*keys, "first", *(F.col(a).alias(f"_{a}") for a in attributes))
    return hits.join(wanted, keys)


def _framed(rows: DataFrame, hits: DataFrame, attributes: tuple[str, ...], n: int, shown: Callable) -> DataFrame:
    """Left, match and right as slices of the arrays ``_<attribute>``, whose first token has the number ``first``."""
    last = F.col("first") + F.size(f"_{attributes[0]}") - 1
    start, end = F.col("start"), F.col("end")
    bounds = {"left": (F.greatest(start - n, F.col("first")), start - 1), "match": (start, end), "right": (end + 1, F.least(end + n, last))}
    sides = []
    for side, (low, high) in bounds.items():
        size = F.greatest(high - low + 1, F.lit(0)).cast("int")
        sides.append(shown(side, low, {a: F.slice(f"_{a}", (low - F.col("first") + 1).cast("int"), size) for a in attributes}))
    return rows.select(*hits.columns, *sides)


def _token_arrays(side: str, low: Column, slices: dict[str, Column]) -> Column:
    """Array of (tok_no, attributes)."""
    zipped = F.arrays_zip(*(c.alias(a) for a, c in slices.items()))
    return F.transform(zipped, lambda t, i: F.struct((low + i).alias("tok_no"), *(t[a].alias(a) for a in slices))).alias(side)


def _token_text(side: str, low: Column, slices: dict[str, Column]) -> Column:
    """The same as text, as ``as_text`` writes it."""
    if len(slices) == 1:
        rendered = F.transform(next(iter(slices.values())), lambda t: rendered_token([t]))
    else:
        zipped = F.arrays_zip(*(c.alias(a) for a, c in slices.items()))
        rendered = F.transform(zipped, lambda t: rendered_token([t[a] for a in slices]))
    return F.array_join(rendered, " ").alias(f"{side}_text")


def as_text(array: Column | str, attributes: Iterable[str] = ("word",)) -> Column:
    """KWI-4, KWI-5, KWI-6. Token array to text: ``word/attr/attr`` per token, tokens separated by a space."""
    attributes = tuple(attributes)
    return F.array_join(F.transform(array, lambda t: rendered_token([t[a] for a in attributes])), " ")


def concordance_lines(
    hits: DataFrame,
    tokens: DataFrame,
    attributes: Iterable[str] = ("word",),
    context: int | None = None,
    treebank: bool = False,
    most: int | None = MAX_CONTEXT,
    longest: int | None = None,
    few: bool = False,
) -> DataFrame:
    """KWI-6. Hits with ``left_text``, ``match_text`` and ``right_text``. ``few`` hits are sent to all blocks of their partitions."""
    attributes = tuple(attributes)
    if "block" in tokens.columns:
        return _in_blocks(hits, tokens, attributes, context_size(context, treebank, most), longest, _token_text, few)
    lines = in_context(hits, tokens, attributes, context, treebank, most)
    return lines.select(*hits.columns, *(as_text(c, attributes).alias(f"{c}_text") for c in ("left", "match", "right")))


def original_and_corrected(hits: DataFrame, tokens: DataFrame, context: int | None = None) -> DataFrame:
    """KWI-9. Two rows per hit: ``line = 1`` with the words, ``line = 2`` with the original forms."""
    lines = in_context(hits, tokens, ("word", "orig"), context)
    rows = [F.struct(F.lit(k).alias("line"), *_texts(a)) for k, a in ((1, "word"), (2, "orig"))]
    return lines.withColumn("_row", F.explode(F.array(*rows))).select(*hits.columns, "_row.*")


def _texts(attribute: str) -> list[Column]:
    return [as_text(c, (attribute,)).alias(f"{c}_text") for c in ("left", "match", "right")]


#: Tokens of a text that share a key when lines meet their metadata.
METADATA_BITS = 20


def with_metadata(lines: DataFrame, texts: DataFrame, categories: Iterable[str], segment: str | None = None) -> DataFrame:
    """JOI-4. Lines with metadata of their text, blank where missing.

    ``segment`` names a column of segment ids whose part before the first dot is the text id. Many-to-many values must
    have been joined to lists before (``stats.listed_values``). Lines that start at a token of a text whose ``n_tokens`` is
    known meet a copy of the metadata per 2 ** METADATA_BITS tokens, so the lines of a very long text are many keys.
    """
    categories = list(categories)
    values = [F.col(c).cast("string").alias(c) for c in categories]
    keyed = lines if segment is None else lines.withColumn("text_id", text_id_of(segment))
    if "start" in lines.columns and "n_tokens" in texts.columns:
        own = texts.select("text_id", *values, F.col("n_tokens").cast("long").alias("_n"))
        last = block(F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)) - 1, METADATA_BITS)
        copies = unfolded(own, F.lit(0).cast("long"), last, "_part").drop("_n")
        joined = keyed.withColumn("_part", block("start", METADATA_BITS)).join(copies, ["text_id", "_part"], "left").drop("_part")
    else:
        joined = keyed.join(texts.select("text_id", *values), "text_id", "left")
    return joined.na.fill("", categories)


def aligned_text(
    hits: DataFrame,
    alignment: DataFrame,
    tokens: DataFrame,
    languages: Iterable[str],
    attributes: Iterable[str] = ("word",),
    within: str = "s",
) -> DataFrame:
    """JOI-7. One row per hit and shown language with the text of the aligned region; no row if it is unaligned.

    ``alignment`` has (src_text, src_region, tgt_lang, tgt_text, tgt_region) and a region is ``<within>_id`` of a text.
    """
    attributes = tuple(attributes)
    shown = alignment.where(F.col("tgt_lang").isin(*languages))
    source = hits.select("text_id", F.col(f"{within}_id").alias("region"), "start", "end")
    pairs = source.join(
        shown.select(
            F.col("src_text").alias("text_id"), F.col("src_region").alias("region"), "tgt_lang", "tgt_text", "tgt_region"
        ),
        ["text_id", "region"],
    )
    wanted = tokens.select(
        F.col("text_id").alias("tgt_text"),
        F.col(f"{within}_id").alias("tgt_region"),
        F.struct("tok_no", *attributes).alias("_token"),
    )
    # the text of a region is put together once, however many hits are aligned to it
    regions = pairs.select("tgt_text", "tgt_region").distinct().join(wanted, ["tgt_text", "tgt_region"])
    texts = (
        regions.groupBy("tgt_text", "tgt_region")
        .agg(F.array_sort(F.collect_list("_token")).alias("_tokens"))
        .select(
            "tgt_text", "tgt_region", F.element_at("_tokens", 1)["tok_no"].alias("_at"), as_text("_tokens", attributes).alias("_text")
        )
    )
    keys = ["text_id", "start", "end", "tgt_lang"]
    shown = F.array_sort(F.collect_list(F.struct("_at", "_text")))
    found = pairs.join(texts, ["tgt_text", "tgt_region"]).groupBy(*keys).agg(shown.alias("_texts"))
    return found.select(*keys, F.array_join(F.transform("_texts", lambda t: t["_text"]), " ").alias("aligned"))


def shown_languages(queried: list[str]) -> list[str]:
    """JOI-7. Languages shown next to a hit: the other ones queried; original and corrected always show each other."""
    first = queried[0]
    if first in ("org", "korr"):
        return ["korr" if first == "org" else "org"]
    return sorted(set(queried) - {first})


def with_media(hits: DataFrame, segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """JOI-10. Hits with ``audio`` (``sound``, ``nosound`` or NULL) and ``has_video`` from their segment's file.

    A recording listed as silent player makes the player available without sound for all hits.
    """
    silent = F.coalesce(manifest.agg(F.bool_or("silent_player")).scalar(), F.lit(False))
    files = segments.select("text_id", "seg_id", "av_file").join(
        manifest.select("av_file", "has_audio", "has_video"), "av_file", "left"
    )
    return (
        hits.join(files, ["text_id", "seg_id"], "left")
        .withColumn(
            "audio",
            F.when(silent, "nosound").when(F.coalesce("has_audio", F.lit(False)), "sound"),
        )
        .withColumn("has_video", F.coalesce("has_video", F.lit(False)))
        .drop("has_audio")
    )


def segments_around(hits: DataFrame, segments: DataFrame, context: int | None) -> DataFrame:
    """KWI-3, KWI-10. One row per hit and speech segment up to ``context`` segments away; None is the whole episode.

    ``is_match`` marks the segment of the hit and ``line_no`` counts the shown segments from 0. A context is joined by
    (text, segment); a whole episode is meant for one chosen hit.
    """
    asked = hits.select("text_id", "start", "end", F.col("seg_id").alias("_hit_seg"))
    if context is None:
        shown = asked.join(segments, "text_id").withColumn("_first", F.lit(0))
    else:
        near = asked.withColumn("_first", F.greatest(F.col("_hit_seg") - context, F.lit(0)))
        near = near.withColumn("seg_id", F.explode(F.sequence("_first", F.col("_hit_seg") + context)))
        shown = near.join(segments, ["text_id", "seg_id"])
    return (
        shown.withColumn("is_match", F.col("seg_id") == F.col("_hit_seg"))
        .withColumn("line_no", F.col("seg_id") - F.col("_first"))
        .drop("_hit_seg", "_first")
    )


def media_object(
    hits: DataFrame, segments: DataFrame, tokens: DataFrame, context: int, attributes: Iterable[str] = ("word",)
) -> DataFrame:
    """KWI-10. One row per hit: its segments as an ordered array, overall times, and the place of the match.

    Meant for one chosen hit or a page; the array has at most ``2 * context + 1`` segments.
    """
    attributes = tuple(attributes)
    shown = segments_around(hits, segments, context)
    wanted = tokens.select("text_id", "seg_id", F.struct("tok_no", *attributes).alias("_token"))
    keys = ["text_id", "start", "end"]
    lines = (
        shown.join(wanted, ["text_id", "seg_id"], "left")
        .groupBy(*shown.columns)
        .agg(F.array_sort(F.collect_list("_token")).alias("tokens"))
    )
    parts = F.array_sort(
        F.collect_list(F.struct("seg_id", "speaker", "from_s", "to_s", "is_match", "av_file", "tokens"))
    )
    return (
        lines.groupBy(*keys)
        .agg(parts.alias("segments"), F.min("from_s").alias("start_s"), F.max("to_s").alias("stop_s"))
        .withColumn("match_at", (F.array_position(F.transform("segments", lambda s: s["is_match"]), True) - 1).cast("int"))
        .withColumn("last_line", F.size("segments") - 1)
    )


def chosen_hit(page: int, row: int, size: int = 50) -> int:
    """KWI-10. Number of the hit at a row of a page (pages from 1, rows from 0)."""
    return (page - 1) * size + row
