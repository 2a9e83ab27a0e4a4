"""Finding pattern hits in the token table (PAT-12..18, SET-1, JOI-6).

A hit is (text_id, start, end) in token numbers of the text, with its region. There is one hit per start token and
alternative, with the shortest end that fits; hits may overlap and never cross their region.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.layout import BLOCK_BITS, BUCKET, asked_for, bits_of, block, bucket
from wordloom.operators.patterns import Gap, Steps, Tok, normalise
from wordloom.operators.selection import in_texts
from wordloom.session import cut

KEYS = ("text_id", "start", "end")
#: What attributes of a hit's last token are called: ``last_<attribute>``.
LAST = "last_"
OPEN_GAP_BITS = 16
#: Terms whose votes fit one number.
VOTE_BITS = 62
# Distances beyond this many tokens are looked up like open ones, so that no block grows with the pattern.
LONG_GAP = 1 << 14


def find_hits(
    tokens: DataFrame,
    patterns: Iterable[Iterable[Tok | Gap]],
    within: str = "s",
    texts: DataFrame | None = None,
    keep: tuple[str, ...] = (),
    match: tuple[str, ...] = (),
    keep_last: tuple[str, ...] = (),
) -> DataFrame:
    """Hits of any of the patterns: ``text_id, start, end, <within>_id, _first, _last`` (and ``startpos`` if known).

    ``within`` names the region (columns ``<within>_id``, ``<within>_first``, ``<within>_last`` of the token table).
    ``texts`` limits the search to those texts. ``keep`` asks for attributes of the hit's first token, ``keep_last`` for
    those of its last one (as ``last_<attribute>``), ``match`` for the array of all its tokens with these attributes. Where the pattern restricts every token of the hit they come from the
    matching tokens themselves, so counting them needs no second read of the token table.
    """
    if "pos" in tokens.columns and "startpos" not in tokens.columns:
        tokens = tokens.withColumn("startpos", F.col("pos") - F.col("tok_no"))
    alternatives = [normalise(pattern) for pattern in patterns]
    if not alternatives:
        raise ValueError("no pattern given")
    carried = match if all(steps.contiguous for forms in alternatives for steps in forms) else ()
    found = []
    for forms in alternatives:
        matched = [_match(tokens, steps, within, texts, keep, carried, keep_last) for steps in forms]
        parts = reduce(DataFrame.unionByName, matched)
        if len(forms) > 1:
            # two normal forms of one pattern: still one hit per start
            lasts = [f"{LAST}{c}" for c in keep_last]
            same = [c for c in parts.columns if c != "end" and c not in lasts]
            parts = parts.groupBy(*same).agg(F.min("end").alias("end"), *(F.min_by(c, "end").alias(c) for c in lasts))
        found.append(parts)
    hits = reduce(DataFrame.unionByName, found)
    # PAT-16, SET-1: rows that agree on the keys agree on everything else
    hits = hits if len(found) == 1 else hits.distinct()
    return with_match(hits, tokens, match) if match and not carried else hits


def count_hits(hits: DataFrame) -> DataFrame:
    """PAT-18."""
    return hits.agg(F.count(F.lit(1)).alias("n_hits"))


def _carried(tokens: DataFrame, within: str, keep: tuple[str, ...]) -> list[str]:
    region = [f"{within}_id", f"{within}_first", f"{within}_last"]
    return region + [c for c in ("startpos",) if c in tokens.columns] + list(keep)


def _match(
    tokens: DataFrame,
    steps: Steps,
    within: str,
    texts: DataFrame | None,
    keep: tuple[str, ...],
    match: tuple[str, ...],
    keep_last: tuple[str, ...],
) -> DataFrame:
    # the first or last token of a pattern that begins or ends with free ones is looked up afterwards
    later, keep = (keep, ()) if steps.lead else ((), keep)
    later_last, keep_last = (keep_last, ()) if steps.trail else ((), keep_last)
    carried = _carried(tokens, within, keep)
    tests = [t.column(within, frozenset(tokens.columns)) for t in steps.terms]
    first, last = f"{within}_first", f"{within}_last"
    # only tokens that fit some term, in a region long enough, ever leave their scan task
    long_enough = F.col(last) - F.col(first) + 1 >= steps.min_length
    wanted = reduce(or_, tests) if steps.min_length == 1 else reduce(or_, tests) & long_enough
    candidates = tokens.where(wanted)
    if texts is not None:
        candidates = in_texts(candidates, texts)
    if len(steps.terms) == 1:
        begun = candidates.select(
            "text_id",
            F.col("tok_no").alias("start"),
            F.col("tok_no").alias("end"),
            *carried,
            *([F.array(F.struct("tok_no", *match)).alias("match")] if match else []),
            *(F.col(c).alias(f"{LAST}{c}") for c in keep_last),
        )
    elif steps.fixed:
        begun = _match_fixed(candidates, steps, tests, carried, within, match, keep_last)
    else:
        begun = _match_gaps(candidates, steps, tests, carried, within, keep_last)
    if not steps.lead and not steps.trail:
        return begun
    moved = begun.withColumn("start", F.col("start") - steps.lead).withColumn("end", F.col("end") + steps.trail)
    inside = moved.where((F.col("start") >= F.col(first)) & (F.col("end") <= F.col(last)))
    inside = with_token(inside, tokens, F.col("start"), {c: c for c in later}, present=True) if later else inside
    lasts = {c: f"{LAST}{c}" for c in later_last}
    return with_token(inside, tokens, F.col("end"), lasts, present=True) if lasts else inside


def _match_fixed(
    candidates: DataFrame,
    steps: Steps,
    tests: list[Column],
    carried: list[str],
    within: str,
    match: tuple[str, ...],
    keep_last: tuple[str, ...],
) -> DataFrame:
    """Terms at fixed distances: every token votes for the start it would belong to.

    One bit per term, in as many numbers as the terms need; a start with all bits is a hit. Groups have at most one row per
    term, whatever the skew, and the votes are combined before the shuffle.
    """
    offsets = [0]
    for low, _ in steps.gaps:
        offsets.append(offsets[-1] + low)
    terms = len(tests)
    votes = F.array(
        *(
            F.when(test, F.struct((F.col("tok_no") - offset).alias("start"), F.lit(k).alias("term")))
            for k, (test, offset) in enumerate(zip(tests, offsets))
        )
    )
    # attributes are those of the first or last term's token
    first = {c: F.when(F.col("_v.term") == 0, F.col(c)) for c in carried}
    last = {f"{LAST}{c}": F.when(F.col("_v.term") == terms - 1, F.col(c)) for c in keep_last}
    region = [f"{within}_id", f"{within}_first", f"{within}_last"]
    # one token per term at most, so the array is as short as the pattern
    gathered = [F.array_sort(F.collect_list(F.struct("tok_no", *match))).alias("match")] if match else []
    words = range(0, terms, VOTE_BITS)
    bit = F.expr(f"shiftleft(1L, _v.term % {VOTE_BITS})")
    in_word = lambda low: bit if terms <= VOTE_BITS else F.when(F.floor(F.col("_v.term") / VOTE_BITS) == low // VOTE_BITS, bit)
    full = [F.col(f"_bits{low}") == (1 << min(VOTE_BITS, terms - low)) - 1 for low in words]
    return (
        candidates.withColumn("_v", F.explode(votes))
        .where(
            F.col("_v").isNotNull()
            & (F.col("_v.start") >= F.col(f"{within}_first"))
            & (F.col("_v.start") + offsets[-1] <= F.col(f"{within}_last"))
        )
        .groupBy("text_id", F.col("_v.start").alias("start"))
        .agg(
            *(F.bit_or(in_word(low)).alias(f"_bits{low}") for low in words),
            *(F.max(F.col(c) if c in region else first[c]).alias(c) for c in carried),
            *(F.max(value).alias(c) for c, value in last.items()),
            *gathered,
        )
        .where(reduce(and_, full))
        .select(
            "text_id", "start", (F.col("start") + offsets[-1]).alias("end"), *carried, *(["match"] if match else []), *last
        )
    )


def _match_gaps(
    candidates: DataFrame, steps: Steps, tests: list[Column], carried: list[str], within: str, keep_last: tuple[str, ...]
) -> DataFrame:
    """Variable distances: from the last term back to the first, the nearest end reachable from every token.

    For a token that fits term k the nearest end is the smallest one among the tokens that fit term k+1 at an allowed
    distance: a sliding minimum in token order. Only candidate tokens take part.
    """
    terms = len(tests)
    # attributes of the last token travel with its number, by which alone ends are compared: no two tokens share one
    closed = F.struct(F.col("tok_no").alias("at"), *(F.col(c).alias(f"{LAST}{c}") for c in keep_last))
    rows = candidates.select(
        "text_id", "tok_no", *carried, *(t.alias(f"_t{k}") for k, t in enumerate(tests)), closed.alias("_closed")
    ).withColumn("_end", F.when(F.col(f"_t{terms - 1}"), F.col("_closed"))).drop("_closed")
    level = terms - 2
    while level >= 0:
        if _is_long(steps.gaps[level]):
            rows = _step_open(rows, level, *steps.gaps[level], within)
            level -= 1
        else:
            run = [level]
            while run[-1] > 0 and not _is_long(steps.gaps[run[-1] - 1]):
                run.append(run[-1] - 1)
            rows = _steps_bounded(rows, [(k, *steps.gaps[k]) for k in run], within)
            level = run[-1] - 1
    return rows.where(F.col("_end").isNotNull()).select(
        "text_id", F.col("tok_no").alias("start"), F.col("_end.at").alias("end"), *carried, *(f"_end.{LAST}{c}" for c in keep_last)
    )


def _is_long(gap: tuple[int, int | None]) -> bool:
    return gap[1] is None or gap[1] > LONG_GAP


def _steps_bounded(rows: DataFrame, levels: list[tuple[int, int, int]], within: str) -> DataFrame:
    """Several bounded distances in one pass over blocks.

    A block is as long as several times the reach of the pattern, and tokens near its start are also given to the
    block before, so every block can be worked on alone. A region of any length is thus never one group.
    """
    reach = sum(high for _, _, high in levels)
    bits = max(BLOCK_BITS, (4 * reach).bit_length())
    first = f"{within}_first"
    own = block("tok_no", bits)
    near_start = (F.col("tok_no") - F.shiftleft(own, bits) < reach) & (block(first, bits) < own)
    rows = (
        rows.withColumn("_own", own)
        .withColumn("_block", F.explode(F.array(own, F.when(near_start, own - 1))))
        .where(F.col("_block").isNotNull())
    )
    order = W.partitionBy("text_id", first, "_block").orderBy("tok_no")
    for level, low, high in levels:
        nearest = F.min("_end").over(order.rangeBetween(low, high))
        rows = rows.withColumn("_end", F.when(F.col(f"_t{level}"), nearest))
    return rows.where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def _step_open(rows: DataFrame, level: int, low: int, high: int | None, within: str) -> DataFrame:
    """A distance with a far limit or none: the nearest token of the next term, up to the end of the region.

    The nearest such token has the smallest end, because ends never decrease from left to right; so a limit only has to
    be tested on it. Inside a block it is a running minimum from the right. A region of several blocks adds one row per
    block for the nearest token of the blocks further right.
    """
    region = ["text_id", f"{within}_first"]
    asked = F.struct(
        (F.col("tok_no") + low).alias("at"), F.lit(None).cast(rows.schema["_end"].dataType).alias("end"), F.lit(True).alias("ask")
    )
    given = F.struct(F.col("tok_no").alias("at"), F.col("_end").alias("end"), F.lit(False).alias("ask"))
    nearest = F.when(~F.col("_e.ask"), F.struct("_e.at", "_e.end"))
    events = (
        rows.withColumn("_e", F.explode(F.array(asked, F.when(F.col("_end").isNotNull(), given))))
        .where(F.col("_e").isNotNull())
        .withColumn("_block", block("_e.at", OPEN_GAP_BITS))
    )
    from_right = (
        W.partitionBy(*region, "_block").orderBy(F.desc("_e.at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    here = events.withColumn("_here", F.min(nearest).over(from_right)).where("_e.ask").drop("_e")
    further_right = W.partitionBy(*region).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    later = (
        events.where(block(f"{within}_first", OPEN_GAP_BITS) < block(f"{within}_last", OPEN_GAP_BITS))
        .groupBy(*region, "_block")
        .agg(F.min(nearest).alias("_min"))
        .withColumn("_later", F.min("_min").over(further_right))
        .where(F.col("_later").isNotNull())
        .drop("_min")
    )
    found = F.coalesce("_here", "_later")
    near = F.lit(True) if high is None else found["at"] <= F.col("tok_no") + high
    return (
        here.join(later, [*region, "_block"], "left")
        .withColumn("_end", F.when(F.col(f"_t{level}") & near, found["end"]))
        .drop("_block", "_here", "_later")
    )


def with_match(hits: DataFrame, tokens: DataFrame, attributes: Iterable[str]) -> DataFrame:
    """Hits with ``match``, the array of the hit's tokens as (tok_no, attributes) in order."""
    return spans(hits, tokens, F.col("start"), F.col("end"), attributes, "match")


def spans(
    hits: DataFrame, tokens: DataFrame, first: Column, last: Column, attributes: Iterable[str], name: str
) -> DataFrame:
    """Hits with the array ``name`` of the tokens numbered ``first`` to ``last`` in the hit's text.

    A hit is unfolded to the token numbers it wants, so the join makes no row but those that are wanted. Of a table
    without storage partitions only tokens that pass a filter made of these numbers are moved; the hits are written for it.
    """
    attributes, hits = tuple(attributes), _kept(hits, tokens)
    ranges = hits.withColumn("_first", F.greatest(first, F.lit(0))).withColumn("_last", last)
    wanted = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last"))
    keyed = ranges.withColumn("tok_no", F.explode(wanted)).drop("_first", "_last")
    keyed, keys = _with_bucket(keyed, tokens, "tok_no")
    tokens = _wanted(tokens, keyed, "tok_no", keys)
    inside = tokens.select(*keys, F.struct("tok_no", *attributes).alias("_token")).join(keyed, keys)
    return inside.groupBy(*hits.columns).agg(F.array_sort(F.collect_list("_token")).alias(name))


def _kept(hits: DataFrame, tokens: DataFrame) -> DataFrame:
    """Hits that are looked at twice, for the filter of ``_wanted`` and for the join, and so written once before."""
    return hits if BUCKET in tokens.columns and "startpos" in hits.columns else cut(hits)


def _wanted(tokens: DataFrame, keyed: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """Tokens that some row may ask for; with a storage partition among the keys Spark prunes the scan instead."""
    return tokens if BUCKET in keys else asked_for(tokens, ("text_id", "tok_no"), keyed, ("text_id", at))


def _with_bucket(keyed: DataFrame, tokens: DataFrame, at: str) -> tuple[DataFrame, list[str]]:
    """Rows that ask for token ``at`` of their text, and the keys of their join with the tokens.

    With stored tokens and known start positions the storage partition is a key, so that others are not read.
    """
    if BUCKET in tokens.columns and "startpos" in keyed.columns:
        placed = keyed.withColumn(BUCKET, bucket(F.col("startpos") + F.col(at), bits_of(tokens)))
        # Spark prunes partitions by a joined table only if that table is filtered; every token number passes
        return placed.where(F.col(at) >= 0), ["text_id", at, BUCKET]
    return keyed, ["text_id", at]


def with_token(
    hits: DataFrame, tokens: DataFrame, position: Column, attributes: Mapping[str, str], present: bool = False
) -> DataFrame:
    """WIN-1. Hits with attributes of the one token at ``position`` of their text, NULL where there is none.

    ``attributes`` maps a token attribute to the name it gets. Every hit is also joined to its own last token, which
    exists, so the join is an inner one: an outer join could never send few hits to the tokens. If the position is known
    to be ``present`` (inside the hit) that is not needed. Hits are written and tokens filtered as ``spans`` does it.
    """
    hits = _kept(hits, tokens)
    place = [F.col(BUCKET)] if BUCKET in tokens.columns else []
    values = [F.col(a).alias(n) for a, n in attributes.items()]
    narrowed = lambda keyed, keys: _wanted(tokens, keyed, "_at", keys).select("text_id", F.col("tok_no").alias("_at"), *place, *values)
    if present:
        keyed, keys = _with_bucket(hits.withColumn("_at", position), tokens, "_at")
        wanted = narrowed(keyed, keys).drop(*(set([BUCKET]) - set(keys)))
        return keyed.join(wanted, keys).select(*hits.columns, *attributes.values())
    asked = hits.withColumn("_asked", position)
    own = F.col("end")
    keyed, keys = _with_bucket(
        asked.withColumn("_at", F.explode(F.array_distinct(F.array(own, F.coalesce("_asked", own))))), tokens, "_at"
    )
    at_asked = lambda name: F.max(F.when(F.col("_at") == F.col("_asked"), F.col(name))).alias(name)
    return keyed.join(narrowed(keyed, keys), keys).groupBy(*hits.columns).agg(*map(at_asked, attributes.values()))


def longest_hit(patterns: Iterable[Iterable[Tok | Gap]]) -> int | None:
    """Most tokens a hit of any of the patterns can have; None if a pattern has an open gap."""
    most = 0
    for pattern in patterns:
        for steps in normalise(pattern):
            if any(high is None for _, high in steps.gaps):
                return None
            most = max(most, 1 + sum(high for _, high in steps.gaps) + steps.lead + steps.trail)
    return most


def settled(hits: DataFrame) -> DataFrame:
    """A search result written to the checkpoint folder, for sorting and paging it repeatedly."""
    return cut(hits)


def aligned_hits(hits: DataFrame, alignment: DataFrame, others: Mapping[str, DataFrame], within: str = "s") -> DataFrame:
    """JOI-6. Hits whose region is aligned, for every other language, to a region with a hit of that language.

    ``alignment`` has (src_text, src_region, tgt_lang, tgt_text, tgt_region). The regions that qualify are found first
    and made distinct, so the last join compares a hit with one row at most.
    """
    for language, found in others.items():
        matched = found.select(
            F.col("text_id").alias("tgt_text"), F.col(f"{within}_id").alias("tgt_region")
        ).distinct()
        regions = (
            alignment.where(F.col("tgt_lang") == language)
            .join(matched, ["tgt_text", "tgt_region"], "left_semi")
            .select(F.col("src_text").alias("text_id"), F.col("src_region").alias(f"{within}_id"))
            .distinct()
        )
        hits = hits.join(regions, ["text_id", f"{within}_id"], "left_semi")
    return hits
