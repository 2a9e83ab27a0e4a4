"""Repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses the chunk boundaries, so the same lines give the same chunks
wherever they stand. A line of two screen lines or more (``WIDTH`` characters each) is a passage that was never wrapped:
it is a chunk of its own. Chunks that occur more than once in the whole table are compared byte by byte with their first
occurrence. A passage is a run of chunks that stand side by side, two and two, somewhere earlier, or a single chunk that
does; it goes on at both ends over the lines of the next chunks as far as those beside its first occurrence are the same. A
passage of two screen lines or more goes. Its first occurrence stays, so of equal lines the first is always kept.

Everything is column expressions, linear in the lines of a text. Arrays that are looked into line by line are made by a
generator of one row first (``_fixed``): a plain column would be put into the expression that looks and made anew for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.llm.common import cut, quoted
from wordloom.llm.skew import sieved, skew_join

#: Characters of a screen line; a passage has at least two. One rolling hash in ``EVERY`` ends a chunk.
WIDTH, EVERY = 80, 2
#: Chunks on either side over which a passage may go on. A passage that stands after other lines may have one more boundary
#: after its first line there, so the lines before the first common boundary are two chunks at most.
BESIDE = 2
#: About how many bytes of the copies of one chunk are compared by one task.
PART_BYTES = 8 << 20
#: Low bits of a line's key that hold its length.
SIZE_MASK = 255
#: Names that no table has, for columns that live within one expression.
GONE, KEY = "__repeated_ranges", "__text_key"
DOC = ["doc_id", KEY]


def _fixed(frame: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the given columns, each made once per row."""
    return frame.select(*quoted(keep), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _part(array: str, first: Column, last: Column) -> Column:
    return F.slice(array, first + 1, last - first + 1)


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with an id, and the key that tells texts of one id apart."""
    return docs.where(F.col("doc_id").isNotNull()).withColumn(KEY, F.xxhash64("text"))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, key, first, last, size, h of every chunk, and the lines of ``BESIDE`` chunks on both sides of it.

    ``before`` begins with the line right before the chunk, ``after`` with the one right after it; a line is 56 bits of its
    hash and its length up to 255. ``size`` is in characters. Rows without a text have none.
    """
    lined = _fixed(docs.where(F.col("text").isNotNull()), DOC, lines=F.split("text", "\n"))
    line_key = lambda x: F.xxhash64(x).bitwiseAND(F.lit(~SIZE_MASK)).bitwiseOR(F.least(F.length(x), F.lit(SIZE_MASK)).cast("long"))
    hashed = _fixed(
        lined,
        DOC,
        rolled=F.transform("lines", _line_hash),
        sizes=F.transform("lines", lambda x: F.length(x)),
        keys=F.transform("lines", line_key),
    )

    def ends(i: Column) -> Column:
        wide = (F.get("sizes", i) >= 2 * WIDTH) | (F.get("sizes", i + 1) >= 2 * WIDTH)
        roll = (F.get("rolled", F.greatest(i - 1, F.lit(0))) * 31 + F.get("rolled", i)) % 4294967296
        return (i == F.size("sizes") - 1) | F.coalesce(wide, F.lit(False)) | (roll % EVERY == 0)

    arrays = [*DOC, "sizes", "keys"]
    ended = _fixed(hashed, arrays, ends=F.filter(F.sequence(F.lit(0), F.size("sizes") - 1), ends))
    begins = F.concat(F.array(F.lit(0)), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda i: i + 1))
    bounded = _fixed(ended, [*arrays, "ends"], begins=begins)

    def chunk(k: Column) -> Column:
        first, last = F.get("begins", k), F.get("ends", k)
        own = F.aggregate(_part("sizes", first, last), F.lit(0), lambda a, x: a + x) + last - first
        before = F.when(k > 0, F.reverse(_part("keys", F.get("begins", F.greatest(k - BESIDE, F.lit(0))), first - 1)))
        after = F.when(last < F.size("sizes") - 1, _part("keys", last + 1, F.get("ends", F.least(k + BESIDE, F.size("ends") - 1))))
        names = (first, "first"), (last, "last"), (own, "size"), (F.xxhash64(_part("keys", first, last)), "h"), (before, "before"), (after, "after")
        return F.struct(*(c.alias(n) for c, n in names))

    return bounded.select(*DOC, F.inline(F.transform(F.sequence(F.lit(0), F.size("begins") - 1), chunk)))


def _place() -> Column:
    return F.struct(*DOC, "first")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Every occurrence of chunks that occur more than once by hash and size, with their number and ``origin``, the first.

    Occurrences are ordered by (doc_id, key, first); rows that repeat a document's id and text are one document.
    """
    found = cut(chunks(docs))
    counted = found.groupBy("h", "size").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("origin")).where("n > 1")
    return cut(skew_join(found, counted, ["h", "size"], ["doc_id", "first"]).dropDuplicates([*DOC, "first"]))


def _shared(a: str, b: str) -> Column:
    """How many values two arrays begin with alike."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.coalesce(F.when(differ == 0, F.size(a)).otherwise(differ - 1), F.lit(0)).cast("int")


def _runs(found: DataFrame) -> DataFrame:
    """Chunks that stand somewhere earlier, with the number ``run`` of their passage and where it begins and ends there."""
    in_text = W.partitionBy(*DOC).orderBy("first")
    following = F.lead(F.struct("first", "h", "size")).over(in_text)
    pairs = found.select(*DOC, "first", "last", "h", "size", following.alias("f")).where(F.col("f.first") == F.col("last") + 1)
    pairs = pairs.select(*DOC, "first", "h", "size", F.col("f.h").alias("h2"), F.col("f.size").alias("size2"))
    kinds = ["h", "size", "h2", "size2"]
    earliest = pairs.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n2"), F.min(_place()).alias("pair_origin")).where("n2 > 1")
    links = skew_join(pairs, earliest, kinds, ["doc_id", "first"]).where(_place() != F.col("pair_origin"))
    linked = found.join(links.select(*DOC, "first", "pair_origin"), [*DOC, "first"], "left")
    told = linked.withColumn("p", F.lag(F.struct("last", "first", "pair_origin")).over(in_text))
    follows = (F.col("p.last") == F.col("first") - 1) & F.col("p.pair_origin").isNotNull()
    told = told.withColumn("goes_on", F.coalesce(follows, F.lit(False)))
    told = told.where(F.col("pair_origin").isNotNull() | F.col("goes_on") | (_place() != F.col("origin")))
    # where the chunks at the begin and the end of a passage stand where it stood first
    second = F.struct(*(F.col(f"p.pair_origin.{c}") for c in DOC), (F.col("p.pair_origin.first") + F.col("first") - F.col("p.first")).alias("first"))
    return told.select(
        *DOC, "first", "last", "size", "h", "n", "origin", "before", "after",
        F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(in_text).alias("run"),
        F.coalesce("pair_origin", "origin").alias("at_begin"),
        F.when(F.col("goes_on"), second).otherwise(F.col("origin")).alias("at_end"),
    )


def _extended(told: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, key, run, first, last of every passage that fills two screen lines, with the lines it goes on over."""
    runs = told.groupBy(*DOC, "run").agg(
        F.min_by(F.struct("at_begin", "before"), "first").alias("b"),
        F.max_by(F.struct("at_end", "after"), "first").alias("e"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        (F.sum(F.col("size") + 1) - 1).alias("size"),
    )
    place = [*DOC, "first"]
    runs = runs.select(
        *DOC, "run", "first", "last", "size", *(F.col(f"b.at_begin.{c}").alias(f"b_{c}") for c in place), "b.before",
        *(F.col(f"e.at_end.{c}").alias(f"e_{c}") for c in place), "e.after",
    )
    at = lambda side, lines: found.select(*(F.col(c).alias(f"{side}_{c}") for c in place), F.col(lines).alias(f"{side}_lines"))
    sides = skew_join(cut(runs), at("b", "before"), [f"b_{c}" for c in place], ["doc_id", "first"], "left")
    sides = skew_join(cut(sides), at("e", "after"), [f"e_{c}" for c in place], ["doc_id", "first"], "left")
    sides = sides.withColumn("more_before", _shared("before", "b_lines")).withColumn("more_after", _shared("after", "e_lines"))
    size = lambda x: x.bitwiseAND(F.lit(SIZE_MASK)) + 1
    length = lambda lines, n: F.coalesce(F.aggregate(F.slice(lines, F.lit(1), F.col(n)), F.lit(0).cast("long"), lambda a, x: a + size(x)), F.lit(0))
    whole = F.col("size") + length("before", "more_before") + length("after", "more_after")
    ranges = (F.col("first") - F.col("more_before")).alias("first"), (F.col("last") + F.col("more_after")).alias("last")
    return cut(sides.where(whole >= 2 * WIDTH).select(*DOC, "run", *ranges))


def _unequal(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, key, run of passages with a chunk whose bytes are not those of the chunk's first occurrence.

    Only texts that hold such chunks are moved, to the marks of their chunks; only the chunks' bodies travel on to be
    compared. The copies of a frequent or long chunk are dealt over as many parts as they need.
    """
    own = told.select(*DOC, "first", "last", "h", "size", "n", F.lit(False).alias("is_origin"))
    origin_last = (F.col("origin.first") + F.col("last") - F.col("first")).alias("last")
    origins = told.select("origin.*", origin_last, "h", "size", "n", F.lit(True).alias("is_origin")).distinct()
    marks = cut(own.unionByName(origins).groupBy(*DOC).agg(F.collect_list(F.struct("first", "last", "h", "size", "n", "is_origin")).alias("marks")))
    holding = sieved(docs, marks, DOC).where("__maybe").drop("__maybe")
    lined = _fixed(holding.join(marks, DOC), [*DOC, "marks"], lines=F.split("text", "\n"))
    body = lambda m: F.array_join(_part("lines", m["first"], m["last"]), "\n")
    bodies = lined.select(*DOC, F.inline(F.transform("marks", lambda m: F.struct(m.alias("m"), body(m).alias("body")))))
    bodies = bodies.select(*DOC, "m.*", "body")
    parts = F.ceil(F.col("n") * (F.col("size") + 64) / PART_BYTES).cast("int")
    others = bodies.where("not is_origin").withColumn("part", F.pmod(F.xxhash64("doc_id", "first"), parts).cast("int"))
    originals = bodies.where("is_origin").select("h", "size", F.col("body").alias("original"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).distinct()
    same = others.join(originals, ["h", "size", "part"]).where(F.col("body") == F.col("original")).select(*DOC, "first").distinct()
    return told.join(same, [*DOC, "first"], "left_anti").select(*DOC, "run").distinct()


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, key, first, last of every passage that stands earlier already and fills two screen lines. ``docs``: ``keyed``.

    Narrow rows of chunks find the passages by hashes; what they found is then compared byte by byte.
    """
    found = repeated_chunks(docs)
    told = cut(_runs(found))
    whole = _extended(told, found)
    kept = cut(told.select(*DOC, "run", "first", "last", "size", "h", "n", "origin").join(whole.select(*DOC, "run"), [*DOC, "run"], "left_semi"))
    return whole.join(_unequal(docs, kept), [*DOC, "run"], "left_anti").select(*DOC, "first", "last")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows, ``text`` without the passages that stand earlier already, and ``removed_lines``.

    The first occurrence of a passage (least doc_id, then key of the text, then line) stays. Null texts and rows without
    doc_id stay as they are. Rows that repeat a doc_id and text are one document, rows of one doc_id with other texts are
    others. A text of repeats alone becomes empty. A column ``removed_lines`` is replaced, all others are kept. Only
    documents that lose lines are moved.
    """
    own = docs.select(*quoted([c for c in docs.columns if c != "removed_lines"]))
    named = keyed(own)
    gone = cut(passages(named.select("doc_id", "text", KEY)).groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias(GONE)))
    seen = sieved(named, gone, DOC)
    joined = seen.where("__maybe").drop("__maybe").join(gone, DOC, "left")
    numbers = F.array_distinct(F.flatten(F.transform(GONE, lambda g: F.sequence(g["first"], g["last"]))))
    looked = _fixed(joined, named.columns, __lines=F.when(F.col(GONE).isNotNull(), F.split("text", "\n")), __drop=numbers)
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.transform(F.array_except(every, "__drop"), lambda i: F.get("__lines", i))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.when(F.col("__drop").isNotNull(), F.size("__drop")), F.lit(0)).cast("bigint").alias("removed_lines")
    cleaned = looked.select(*(text.alias("text") if c == "text" else quoted([c])[0] for c in own.columns), removed)
    none = F.lit(0).cast("bigint").alias("removed_lines")
    untouched = seen.where("not __maybe").select(*quoted(own.columns), none)
    return cleaned.unionByName(untouched).unionByName(own.where(F.col("doc_id").isNull()).withColumn("removed_lines", none))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, removed_lines and the cleaned text of every document."""
    return without_repeats(docs.select("doc_id", "text"))


_ALIKE = (
    "coalesce(list_position(list_transform(range(1, greatest(len({0}), len({1})) + 1), lambda k: coalesce({0}[k] = {1}[k], false)),"
    " false) - 1, len({0}), 0)"
)
_SUM = "coalesce(list_sum(list_transform({0}[1:{1}], lambda x: length(x) + 1)), 0)"
DIGEST_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), ended AS (
  SELECT *, lead(line) OVER w IS NULL OR length(line) >= {2 * WIDTH} OR length(lead(line) OVER w) >= {2 * WIDTH}
            OR ((coalesce(lag(h) OVER w, h) * 31 + h) % 4294967296) % {EVERY} = 0 AS ends
  FROM hashed WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM ended
), chunk AS (
  SELECT doc_id, text, c, min(i) AS a, max(i) AS z, list(line ORDER BY i) AS body FROM numbered GROUP BY doc_id, text, c
), placed AS (
  SELECT *, lead(body) OVER w AS next_body, list_reverse(list_concat(coalesce(lag(body, 2) OVER w, []), lag(body) OVER w)) AS before,
         list_concat(lead(body) OVER w, coalesce(lead(body, 2) OVER w, [])) AS after
  FROM chunk WINDOW w AS (PARTITION BY doc_id, text ORDER BY c)
), numbers AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, text, c) AS no FROM placed
), told AS (
  SELECT *, min(no) OVER (PARTITION BY body) AS origin, min(no) OVER (PARTITION BY body, next_body) AS pair_origin,
         next_body IS NOT NULL AS has_next
  FROM numbers
), linked AS (
  SELECT *, has_next AND pair_origin < no AS link,
         coalesce(lag(has_next AND pair_origin < no) OVER (PARTITION BY doc_id, text ORDER BY c), false) AS goes_on,
         lag(pair_origin) OVER (PARTITION BY doc_id, text ORDER BY c) + 1 AS second
  FROM told
), runs AS (
  SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id, text ORDER BY c) AS run
  FROM linked WHERE link OR goes_on OR origin < no
), passage AS (
  SELECT doc_id, text, run, min(a) AS a, max(z) AS z, sum(length(array_to_string(body, chr(10))) + 1) - 1 AS size,
         arg_min(CASE WHEN link THEN pair_origin ELSE origin END, c) AS b_no, arg_max(CASE WHEN goes_on THEN second ELSE origin END, c) AS e_no,
         arg_min(no, c) AS first_no, arg_max(no, c) AS last_no
  FROM runs GROUP BY doc_id, text, run
), sides AS (
  SELECT p.*, f.before, l.after, {_ALIKE.format("f.before", "b.before")} AS more_before, {_ALIKE.format("l.after", "e.after")} AS more_after
  FROM passage p JOIN numbers f ON f.no = first_no JOIN numbers l ON l.no = last_no
  JOIN numbers b ON b.no = b_no JOIN numbers e ON e.no = e_no
), gone AS (
  SELECT DISTINCT doc_id, text, unnest(range(a - more_before, z + more_after + 1)) AS i FROM sides
  WHERE size + {_SUM.format("before", "more_before")} + {_SUM.format("after", "more_after")} >= {2 * WIDTH}
), kept AS (
  SELECT l.doc_id, l.text AS whole, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(g.i) AS removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       coalesce(k.removed, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.whole
ORDER BY doc_id
"""
