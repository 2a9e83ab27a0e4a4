"""Sorting, paging and sampling of hits and texts (SRT-1..7, LIM-1..4, SMP-1, SMP-2, SET-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.layout import block, running_total
from wordloom.operators.hits import LAST, with_match, with_token
from wordloom.session import cut

# Page sizes.
HITS_PER_PAGE = 50
FIRST_REQUEST = 100
TEXTS_PER_PAGE = 50
CORPUS_ORDER = ("text_id", "start", "end")
#: Rows of a cell that are ordered by one task; larger cells are divided by the next column first.
CELL = 1 << 17


def sort_keys(hits: DataFrame, tokens: DataFrame, by: str = "position", within: str | None = None) -> DataFrame:
    """SRT-1..5. Hits with ``sort_key``: the folded match, or the folded word before or after it.

    With ``within`` (speech) a neighbour outside the hit's region does not count. Hits without a neighbour have NULL. Hits
    that carry the words stored beside their first and last token (``before``, ``last_after``) are not joined with tokens.
    """
    if by == "position":
        return hits.withColumn("sort_key", F.lit(None).cast("string"))
    if by == "match":
        texts = hits if "match" in hits.columns else with_match(hits, tokens, ["word"])
        joined = F.array_join(F.transform("match", lambda t: t["word"]), " ")
        return texts.withColumn("sort_key", F.lower(joined)).select(*hits.columns, "sort_key")
    if by not in ("left", "right"):
        raise ValueError(f"unknown sort key: {by}")
    at = F.col("start") - 1 if by == "left" else F.col("end") + 1
    inside = F.lit(True)
    if within is not None:
        inside = F.col("start") > F.col(f"{within}_first") if by == "left" else F.col("end") < F.col(f"{within}_last")
        at = F.when(inside, at)
    stored = "before" if by == "left" else f"{LAST}after"
    if stored in hits.columns:
        return hits.withColumn("sort_key", F.when(inside, F.lower(stored)))
    return with_token(hits, tokens, at, {"word": "sort_key"}).withColumn("sort_key", F.lower("sort_key"))


def hit_order() -> list[Column]:
    """By sort key, hits without one last, ties in corpus order."""
    return [F.col("sort_key").asc_nulls_last(), *(F.col(c).asc() for c in CORPUS_ORDER)]


def sort_hits(hits: DataFrame, tokens: DataFrame, by: str = "position", within: str | None = None) -> DataFrame:
    """SRT-1..5, SET-5. All hits in the asked order."""
    return sort_keys(hits, tokens, by, within).orderBy(*hit_order())


def ordered_slice(rows: DataFrame, order: list, start: int, end: int, cells: tuple) -> DataFrame:
    """LIM-1. Rows number ``start`` to ``end`` (0-based, inclusive) in a unique order, by order statistics.

    ``cells`` are columns that divide the rows in the same order, coarse ones first, each as (name, value, order). Rows are
    counted per cell; only cells the slice lies in are kept, at most as many as the slice has rows, and divided by the next
    column while one of them has more than ``CELL`` rows. What is left is sorted cell by cell. Neither the rows before the
    slice nor those behind it are ever sorted, moved or written, however deep it is; they are read once per level.
    """
    kept, before, levels, wanted = rows, 0, [], None
    # every cell kept holds a row of the slice
    few = end - start < CELL
    for level in cells:
        name, value, _ = level
        # the cells kept follow one another, so a level counts on from the first of them
        divided = (kept if wanted is None else _in_cells(kept, wanted.drop("_offset", "_n"), few)).withColumn(name, value)
        keys = [*(n for n, _, _ in levels), name]
        sizes = cut(divided.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
        cell_order = [o for _, _, o in (*levels, level)]
        if sizes.count() <= CELL:
            # so few counts are added up by one task
            earlier = F.sum("_n").over(W.orderBy(*cell_order).rowsBetween(W.unboundedPreceding, -1))
            placed = sizes.withColumn("_passed", F.coalesce(earlier, F.lit(0)))
        else:
            placed = running_total(sizes, cell_order, F.col("_n"), "_passed")
        placed = placed.withColumn("_offset", F.col("_passed") + before).drop("_passed")
        inside = (F.col("_offset") <= end) & (F.col("_offset") + F.col("_n") > start)
        n_cells, first, most = placed.agg(F.count(F.lit(1)), F.min(F.when(inside, F.col("_offset"))), F.max(F.when(inside, F.col("_n")))).first()
        if n_cells == 1:
            # a column that divides nothing, such as the key of hits in corpus order
            continue
        kept, before, wanted, levels = divided, first, placed.where(inside), [*levels, level]
        if most is None or most <= CELL:
            break
    if wanted is None:
        numbered = kept.withColumn("_no", F.row_number().over(W.orderBy(*order)) - 1)
    else:
        in_cell = F.row_number().over(W.partitionBy(*(n for n, _, _ in levels)).orderBy(*order))
        numbered = _in_cells(kept, wanted.drop("_n"), few).withColumn("_no", in_cell - 1 + F.col("_offset"))
    found = numbered.where(F.col("_no").between(start, end))
    # the limit states the size of the result, and the order is that of the slice
    return found.orderBy("_no").limit(max(end - start + 1, 0)).select(*rows.columns)


def _in_cells(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    """Rows of the given cells, with what these carry; NULL is a cell of its own. ``few`` cells are sent to the rows."""
    keys = [c for c in cells.columns if c != "_offset"]
    other = cells.select(*(F.col(k).alias(f"{k}_cell") for k in keys), *(c for c in cells.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_cell")) for k in keys]
    return rows.join(F.broadcast(other) if few else other, same).drop(*(f"{k}_cell" for k in keys))


def position_cells() -> tuple:
    """Cells of hits in corpus order: the text, then blocks of its tokens."""
    return (
        ("_text", F.col("text_id"), F.col("_text").asc()),
        ("_block", block("start"), F.col("_block").asc()),
    )


def hit_cells() -> tuple:
    """Cells of ``hit_order``."""
    return (("_key", F.col("sort_key"), F.col("_key").asc_nulls_last()), *position_cells())


def hit_page(keyed_hits: DataFrame, page: int, size: int = HITS_PER_PAGE) -> DataFrame:
    """LIM-1. One page (1-based) of hits that carry ``sort_key``."""
    return ordered_slice(keyed_hits, hit_order(), (page - 1) * size, page * size - 1, hit_cells())


def first_pages(keyed_hits: DataFrame) -> DataFrame:
    """LIM-1. The two pages of a first request, with their page number."""
    top = ordered_slice(keyed_hits, hit_order(), 0, FIRST_REQUEST - 1, hit_cells())
    place = F.row_number().over(W.orderBy(*hit_order())) - 1
    return top.withColumn("page", F.floor(place / HITS_PER_PAGE) + 1)


def page_count(hits: DataFrame, size: int = HITS_PER_PAGE) -> DataFrame:
    """LIM-1. Number of hits and of pages."""
    return hits.agg(F.count(F.lit(1)).alias("n_hits")).withColumn("n_pages", F.ceil(F.col("n_hits") / size))


def text_order(column: str = "text_id", descending: bool = False) -> list[Column]:
    """SRT-7. Any column in either direction, ties by text id; texts without a value come first when ascending."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    return [key] if column == "text_id" else [key, F.col("text_id").asc()]


def text_page(texts: DataFrame, page: int, column: str = "text_id", descending: bool = False) -> DataFrame:
    """LIM-2, SRT-7. Page of the metadata table, 1-based; page 0 is everything."""
    order = text_order(column, descending)
    if page == 0:
        return texts.orderBy(*order)
    by_id = ("_text", F.col("text_id"), F.col("_text").desc() if descending and column == "text_id" else F.col("_text").asc())
    key = F.col("_key").desc_nulls_last() if descending else F.col("_key").asc_nulls_first()
    cells = (by_id,) if column == "text_id" else (("_key", F.col(column), key), by_id)
    return ordered_slice(texts, order, (page - 1) * TEXTS_PER_PAGE, page * TEXTS_PER_PAGE - 1, cells)


def one_text(texts: DataFrame, text_id, columns: list[str]) -> DataFrame:
    """LIM-4. The asked columns of one text as strings, blank where a value is missing."""
    row = texts.where(F.col("text_id") == text_id).limit(1)
    return row.select("text_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def capped(hits: DataFrame, cap: int | None = None) -> DataFrame:
    """LIM-3. Hits up to an explicit cap in corpus order; without one all hits."""
    if cap is None:
        return hits
    return ordered_slice(hits, [F.col(c) for c in CORPUS_ORDER], 0, cap - 1, position_cells())


def _draw(seed: int | str) -> Column:
    """Reproducible random rank of a hit: the same seed gives the same draw on any partitioning and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in CORPUS_ORDER)))


def sample_hits(hits: DataFrame, n: int, seed: int | str = 0) -> DataFrame:
    """SMP-1. Exactly ``n`` hits at random, or all if there are fewer; bring them into order with ``sort_hits``."""
    drawn = hits.withColumn("_draw", _draw(seed)).withColumn("_quota", F.lit(n))
    return _lowest(drawn, []).drop("_draw", "_quota")


def sample_hits_by_part(hits: DataFrame, n: int, parts: DataFrame, seed: int | str = 0) -> DataFrame:
    """SMP-2. ``n`` hits spread over parts in proportion to their tokens.

    ``parts`` has (part, n_tokens) and ``hits`` has ``part``. Each part gets its share of ``n`` rounded up; what this
    gives beyond ``n`` is trimmed at random.
    """
    # the parts are counted once, and what each gives (its share and no more) is written for the trimming
    parts = cut(parts.select("part", "n_tokens"))
    total = parts.agg(F.sum("n_tokens")).scalar()
    quotas = parts.select("part", F.ceil(F.lit(n) * F.col("n_tokens") / total).alias("_quota"))
    drawn = hits.join(quotas, "part").withColumn("_draw", _draw(seed))
    picked = cut(_lowest(drawn, ["part"]).drop("_quota"))
    return _lowest(picked.withColumn("_quota", F.lit(n)), []).drop("_draw", "_quota")


def _lowest(drawn: DataFrame, strata: list[str]) -> DataFrame:
    """The ``_quota`` rows of each stratum with the lowest draw, by threshold: nothing near all rows is moved or written.

    Rows are counted by the first four digits of the draw. Buckets that fit the quota as a whole are taken, and only
    the one bucket that crosses it is ranked; all other rows stop at the scan. The rows are read twice. The counts of one
    stratum (at most 65536) come to the driver, those of several are written once.
    """
    drawn = drawn.withColumn("_bucket", F.substring("_draw", 1, 4))
    counts = drawn.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.max("_quota").alias("_q"))
    if strata:
        before = W.partitionBy(*strata).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        placed = cut(
            counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .where(F.col("_before") < F.col("_q"))
            .select(*strata, "_bucket", "_before", (F.col("_before") + F.col("_n") <= F.col("_q")).alias("_whole"))
        )
        kept = drawn.join(placed, [*strata, "_bucket"])
    else:
        passed, last, fits = 0, None, True
        for bucket, n, quota in sorted(tuple(r) for r in counts.collect()):
            if passed >= quota:
                break
            last, fits = bucket, passed + n <= quota
            passed += n if fits else 0
            if not fits:
                break
        crossing = F.col("_bucket") == F.lit(last)
        kept = drawn.where(F.col("_bucket") <= F.lit(last)).withColumns(
            {"_before": F.lit(passed), "_whole": F.lit(True) if fits else ~crossing}
        )
    # a row of a bucket that is taken whole is never ranked behind another one: it is a group of its own
    group = [*strata, "_bucket", F.when(F.col("_whole"), F.col("_draw"))]
    rank = F.row_number().over(W.partitionBy(*group).orderBy("_draw", *CORPUS_ORDER))
    ranked = kept.withColumn("_rank", rank)
    fitting = F.col("_whole") | (F.col("_before") + F.col("_rank") <= F.col("_quota"))
    return ranked.where(fitting).drop("_bucket", "_before", "_whole", "_rank")
