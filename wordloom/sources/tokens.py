"""Token table: tokenising, sentence regions, corpus positions, storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DataType

from wordloom.layout import BITS_KEY, BLOCK, BLOCK_BITS, BUCKET, asked_for, bits_of, block, bucket, running_total
from wordloom.session import cut, settings

# The token pattern and the tokens that end a sentence.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}]"
SENTENCE_ENDS = (".", "!", "?")
#: Words next to a token in its text, stored with it so that sorting hits by them needs no look at other tokens.
NEIGHBOURS = ("before", "after")
#: Tokens of the neighbouring blocks that a context block holds on both sides: the largest context in use.
HALO = 50
#: Compression of stored tables, and files a task may have open at once when it writes tokens in order.
CODEC = "zstd"
WRITERS_KEY, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", 16
#: Positions of a task that writes a stored corpus: some partitions of positions.
TASK_BITS = 21
#: Settings under which rows that were dealt out by one key of a join stay where they are.
PLACED = dict.fromkeys(
    (
        "spark.sql.requireAllClusterKeysForDistribution",
        "spark.sql.requireAllClusterKeysForCoPartition",
        "spark.sql.adaptive.coalescePartitions.enabled",
    ),
    "false",
)


def tokenise(
    documents: DataFrame, text_id: str, text: str, carry: tuple[str, ...] = (), neighbours: bool = False
) -> DataFrame:
    """SRC-4. One row per token: ``text_id, <carry>, s_id, s_first, s_last, tok_no, word``.

    ``tok_no`` counts from 0 in each text; ``s_first`` and ``s_last`` are the first and last token of the sentence.
    Everything is computed inside the document's own row and then expanded, so there is no shuffle and no grouping
    by text. A sentence ends after each ``.``, ``!`` or ``?`` token. ``neighbours`` adds the words ``before`` and ``after``
    in the text, NULL at its ends.
    """
    tokens = lambda begin, last: F.slice("_tokens", begin + 1, last - begin + 1).alias("word")
    # from the token before a sentence to the one after it, once
    framed = lambda begin, last: [
        F.slice("_framed", begin + 1 + shift, last - begin + 1).alias(name) for shift, name in ((1, "word"), (0, "before"), (2, "after"))
    ]
    sentences = _sentences(documents, text_id, text, carry, framed if neighbours else lambda begin, last: [tokens(begin, last)], neighbours)
    words = ("word", *NEIGHBOURS) if neighbours else ("word",)
    body = F.arrays_zip(*(f"_s.{w}" for w in words)) if neighbours else F.col("_s.word")
    taken = [F.col(f"_w.{w}").alias(w) for w in words] if neighbours else [F.col("_w").alias("word")]
    return sentences.select(
        "text_id",
        *carry,
        F.col("s_id").cast("bigint").alias("s_id"),
        "_s.s_first",
        "_s.s_last",
        F.posexplode(body).alias("_i", "_w"),
    ).select("text_id", *carry, "s_id", "s_first", "s_last", (F.col("s_first") + F.col("_i")).alias("tok_no"), *taken)


def _sentences(
    documents: DataFrame, text_id: str, text: str, carry: tuple[str, ...], fields: Callable[[Column, Column], list[Column]], framed: bool = False
) -> DataFrame:
    """One row per sentence: ``text_id, <carry>, s_id`` and ``_s`` with ``s_first``, ``s_last`` and what ``fields`` makes of both.

    ``fields`` may use the array ``_tokens`` of the text's tokens, and ``_framed``, the same between two NULLs.
    """
    rows = documents.select(
        F.col(text_id).alias("text_id"), *carry, F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)).alias("_tokens")
    )
    # last token number of every sentence; the text's last token always closes one
    is_end = lambda t, i: t.isin(*SENTENCE_ENDS) | (i == F.size("_tokens") - 1)
    ends = rows.withColumn("_ends", F.array_compact(F.transform("_tokens", lambda t, i: F.when(is_end(t, i), i))))
    edge = F.array(F.lit(None).cast("string"))
    ends = ends.withColumn("_framed", F.concat(edge, "_tokens", edge)) if framed else ends
    begin = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get("_ends", k - 1)) + 1
    bounds = lambda last, k: F.struct(begin(k).cast("bigint").alias("s_first"), last.cast("bigint").alias("s_last"), *fields(begin(k), last))
    return ends.select("text_id", *carry, F.posexplode(F.transform("_ends", bounds)).alias("s_id", "_s"))


def token_runs(documents: DataFrame, text_id: str, text: str, carry: tuple[str, ...], bits: int) -> DataFrame:
    """The tokens of ``tokenise`` as runs, for storing: one row per sentence, or part of it in one block of positions.

    ``text_id, <carry>, s_id, s_first, s_last, skip, words, before, after`` and the storage partition: ``skip`` tokens of the
    sentence stand before the run, ``before`` and ``after`` are the words beside it. What a run says once a token table
    says for each token, and the words of tokens, their neighbours and their folded form are stored once. ``carry`` has
    ``startpos``; ``bits`` is the width of a partition of positions. ``from_runs`` makes tokens of it.
    """
    fields = lambda begin, last: [
        F.slice("_tokens", begin + 1, last - begin + 1).alias("words"), F.get("_tokens", begin - 1).alias("before"), F.get("_tokens", last + 1).alias("after")
    ]
    sentences = _sentences(documents, text_id, text, carry, fields).select(
        "text_id", *carry, F.col("s_id").cast("bigint").alias("s_id"), "_s.*"
    )
    # no run crosses a partition, and a sentence of any length is many runs
    part = min(bits, BLOCK_BITS)
    place = lambda c: block(F.col("startpos") + F.col(c), part)
    parts = sentences.withColumn("_part", F.explode(F.sequence(place("s_first"), place("s_last"))))
    low = F.greatest(F.shiftleft("_part", part) - F.col("startpos") - F.col("s_first"), F.lit(0)).cast("int")
    high = F.least(F.shiftleft(F.col("_part") + 1, part) - F.col("startpos"), F.col("s_last") + 1) - F.col("s_first")
    cut_off = parts.withColumn("_low", low).withColumn("_high", high.cast("int"))
    return cut_off.select(
        "text_id",
        *carry,
        "s_id",
        "s_first",
        "s_last",
        F.col("_low").cast("bigint").alias("skip", metadata={BITS_KEY: bits}),
        F.slice("words", F.col("_low") + 1, F.col("_high") - F.col("_low")).alias("words"),
        F.when(F.col("_low") > 0, F.get("words", F.col("_low") - 1)).otherwise(F.col("before")).alias("before"),
        F.when(F.col("_high") < F.size("words"), F.get("words", F.col("_high"))).otherwise(F.col("after")).alias("after"),
        bucket(F.shiftleft("_part", part), bits),
    )


def from_runs(runs: DataFrame) -> DataFrame:
    """Tokens with ``pos``, neighbours and folded words from stored ``token_runs``; columns that are not asked for cost nothing."""
    own = ["s_id", "s_first", "s_last", "skip", "words", *NEIGHBOURS, BUCKET]
    carry = [c for c in runs.columns if c not in ("text_id", *own)]
    rows = runs.select("text_id", *carry, *own, F.posexplode("words").alias("_i", "word"))
    number = F.col("s_first") + F.col("skip") + F.col("_i")
    return rows.select(
        "text_id",
        *carry,
        "s_id",
        "s_first",
        "s_last",
        number.alias("tok_no"),
        "word",
        F.when(F.col("_i") == 0, F.col("before")).otherwise(F.get("words", F.col("_i") - 1)).alias("before"),
        F.when(F.col("_i") == F.size("words") - 1, F.col("after")).otherwise(F.get("words", F.col("_i") + 1)).alias("after"),
        (F.col("startpos") + number).alias("pos", metadata={BITS_KEY: bits_of(runs)}),
        F.lower("word").alias("word_folded"),
        BUCKET,
    )


def stored_tokens(stored: DataFrame) -> DataFrame:
    """The token table of what ``save_tokens`` or ``save_runs`` has written."""
    return from_runs(stored) if "skip" in stored.columns else stored


def text_ranges(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """SRC-5. ``texts`` with ``n_tokens``, ``startpos`` and inclusive ``endpos``; texts follow each other by id.

    A text without tokens has ``endpos = startpos - 1``.
    """
    counts = tokens.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    sized = texts.join(counts, "text_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    placed = running_total(sized, ["text_id"], F.col("n_tokens"), "startpos")
    return placed.withColumn("endpos", F.col("startpos") + F.col("n_tokens") - 1)


def scan_tokens(tokens: DataFrame, attributes: list[str] | None = None, declared: tuple[str, ...] = ()) -> DataFrame:
    """SRC-2. Token keys plus the asked attributes (default: ``word`` and the declared ones), nothing else is read."""
    keys = [c for c in ("text_id", "tok_no", "s_id") if c in tokens.columns]
    return tokens.select(*keys, *(attributes or ["word", *declared]))


def corpus_sizes(tokens: DataFrame, by: str) -> DataFrame:
    """SRC-3. Tokens per corpus, or per language of a multilingual corpus."""
    return tokens.groupBy(by).agg(F.count(F.lit(1)).alias("n_tokens"))


def clean_ingest(word):
    """KWI-8. The one mark-up repair a structured table still needs: a non-breaking-space entity becomes ``_``."""
    return F.replace(word, F.lit("&nbsp;"), F.lit("_"))


def arranged(documents: DataFrame, text_id: str, partitions: int | None = None) -> DataFrame:
    """Documents in range partitions sorted by id, for ``save_tokens(..., in_order=True)``.

    Ordering whole documents before they are expanded moves far less than ordering their tokens afterwards.
    """
    dealt = [] if partitions is None else [partitions]
    return documents.repartitionByRange(*dealt, F.col(text_id)).sortWithinPartitions(text_id)


def placed_in_order(documents: DataFrame, ranges: DataFrame, text_id: str, bits: int) -> DataFrame:
    """Documents with the ``startpos`` of their text in ``ranges``, in partitions of ``2 ** bits`` positions sorted by id, kept.

    It is what ``arranged`` makes of their join by id, but the documents are moved once: ranges tell the first id of each part
    (one row per part, sent to both sides), and both sides are dealt out by part and joined where they then are.
    """
    spark = documents.sparkSession
    firsts = ranges.where(F.col("text_id").isNotNull()).groupBy(F.shiftright("startpos", bits)).agg(F.min("text_id").alias("id"))
    # texts of one id may lie in two parts; they stay together
    bounds = sorted({row.id for row in firsts.collect()})[1:]
    part = lambda c: _number_up_to(F.col(c), bounds, ranges.schema["text_id"].dataType).alias("_part")
    # parts are dealt out by hash: twice the tasks, so that few get several
    tasks = max(spark.sparkContext.defaultParallelism, 2 * (len(bounds) + 1))
    texts = documents.where(F.col(text_id).isNotNull()).select("*", part(text_id)).repartition(tasks, "_part")
    starts = ranges.where(F.col("text_id").isNotNull()).select(F.col("text_id").alias(text_id), "startpos", part("text_id")).repartition(tasks, "_part")
    placed = texts.join(starts, ["_part", text_id]).sortWithinPartitions("_part", text_id).drop("_part")
    # rows of one part lie together, so Spark need not deal them out again by all keys of the join, or to more tasks
    with settings(spark, PLACED | {"spark.sql.shuffle.partitions": str(tasks)}):
        return cut(placed)


def _number_up_to(value: Column, bounds: list, kind: DataType) -> Column:
    """How many of the sorted ``bounds`` are not above ``value``: looked up in steps of 64 and then in one step."""
    if not bounds:
        return F.lit(0)
    listed = lambda values: F.array(*map(F.lit, values)).cast(ArrayType(kind))
    up_to = lambda array: F.size(F.filter(array, lambda b: b <= value))
    steps = up_to(listed(bounds[63::64])) * 64 if len(bounds) > 63 else F.lit(0)
    return steps + up_to(F.slice(listed(bounds), steps + 1, 64))


def with_neighbours(tokens: DataFrame) -> DataFrame:
    """Any token table with the words ``before`` and ``after`` in the text, NULL at its ends.

    Windows run over blocks of a text; the first and last token of a block are also given to the block beside it, so a text
    of any length is many groups.
    """
    own = block("tok_no")
    at = F.col("tok_no") - F.shiftleft(own, BLOCK_BITS)
    sides = F.array_compact(F.array(own, F.when((at == 0) & (own > 0), own - 1), F.when(at == BLOCK - 1, own + 1)))
    order = W.partitionBy("text_id", "_block").orderBy("tok_no")
    framed = (
        tokens.withColumn("_block", F.explode(sides))
        .withColumn("before", F.lag("word").over(order))
        .withColumn("after", F.lead("word").over(order))
    )
    return framed.where(F.col("_block") == block("tok_no")).drop("_block")


def context_blocks(tokens: DataFrame, attributes: tuple[str, ...] = ("word",), near: DataFrame | None = None) -> DataFrame:
    """KWI-1. One row per 4096 tokens of a text: ``text_id, block, first`` and an array per attribute.

    The arrays also hold ``HALO`` tokens of the blocks on either side; ``first`` is the number of their first token. A hit
    with its context is then a slice of one row. Token numbers have no gaps in a text. For contexts of the hits ``near`` alone
    the blocks these start in are made (and some others): tokens of the rest are not moved. It serves hits that fit their
    block (``in_context`` with ``longest``).
    """
    own = block("tok_no")
    at = F.col("tok_no") - F.shiftleft(own, BLOCK_BITS)
    sides = F.array_compact(F.array(own, F.when((at < HALO) & (own > 0), own - 1), F.when(at >= BLOCK - HALO, own + 1)))
    start = [F.min(F.col("pos") - F.col("tok_no")).alias("_start")] if "pos" in tokens.columns else []
    dealt = tokens.withColumn("_own", own).withColumn("block", F.explode(sides))
    if near is not None:
        dealt = asked_for(dealt, ("text_id", "block"), near.withColumn("_block", block("start")), ("text_id", "_block"))
    blocks = (
        dealt.groupBy("text_id", "block")
        .agg(
            F.max(F.col("_own") == F.col("block")).alias("_real"),
            F.array_sort(F.collect_list(F.struct("tok_no", *attributes))).alias("_t"),
            *start,
        )
        .where("_real")
    )
    bits = bits_of(tokens)
    place = [bucket(F.col("_start") + F.shiftleft("block", BLOCK_BITS), bits)] if start else []
    first = F.col("_t")[0]["tok_no"].alias("first", metadata={BITS_KEY: bits})
    return blocks.select("text_id", "block", first, *(F.col(f"_t.{a}").alias(a) for a in attributes), *place)


def document_blocks(documents: DataFrame, text_id: str, text: str, bits: int, unique: bool = False) -> DataFrame:
    """The ``context_blocks`` of the words of documents that have a ``startpos``, cut from their rows: no token is moved.

    ``bits`` is the width of a partition of positions. Documents of one id share their blocks, as their tokens would;
    ``unique`` says that there are none, and then blocks are not moved either.
    """
    rows = documents.select(
        F.col(text_id).alias("text_id"), F.col("startpos").alias("_start"), F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)).alias("_tokens")
    ).where(F.size("_tokens") > 0)
    low = lambda b: F.greatest(F.shiftleft(b, BLOCK_BITS) - HALO, F.lit(0))
    high = lambda b: F.least(F.shiftleft(b, BLOCK_BITS) + (BLOCK + HALO), F.size("_tokens"))
    part = lambda b: F.struct(
        b.cast("bigint").alias("block"), low(b).cast("bigint").alias("first"), F.slice("_tokens", low(b) + 1, high(b) - low(b)).alias("word")
    )
    numbers = F.sequence(F.lit(0), F.shiftright(F.size("_tokens") - 1, BLOCK_BITS))
    parts = rows.select("text_id", "_start", F.explode(F.transform(numbers, part)).alias("_p")).select("text_id", "_start", "_p.*")
    place = bucket(F.col("_start") + F.shiftleft("block", BLOCK_BITS), bits)
    if unique:
        return parts.select("text_id", "block", F.col("first").alias("first", metadata={BITS_KEY: bits}), "word", place)
    gathered = parts.groupBy("text_id", "block").agg(F.min("_start").alias("_start"), F.collect_list(F.struct("first", "word")).alias("_parts"))
    numbered = lambda p: F.transform(p["word"], lambda w, i: F.struct((p["first"] + i).alias("tok_no"), w.alias("word")))
    shared = F.array_sort(F.flatten(F.transform("_parts", numbered)))
    words = F.when(F.size("_parts") == 1, F.col("_parts")[0]["word"]).otherwise(F.transform(shared, lambda t: t["word"]))
    return gathered.select(
        "text_id",
        "block",
        F.array_min(F.col("_parts.first")).alias("first", metadata={BITS_KEY: bits}),
        words.alias("word"),
        place,
    )


def save_blocks(tokens: DataFrame, path: str, attributes: tuple[str, ...] = ("word",), blocks: DataFrame | None = None) -> None:
    """Store the context blocks of a token table, partitioned by corpus position if it has positions.

    ``blocks`` are these blocks where they have been made otherwise (``document_blocks``).
    """
    blocks = context_blocks(tokens, attributes) if blocks is None else blocks
    blocks.write.partitionBy(*([BUCKET] if BUCKET in blocks.columns else [])).option("compression", CODEC).parquet(path)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """PAT-3, PAT-6. Distinct words with their number of tokens, per storage partition if the table has them.

    Patterns are run on these few rows instead of on every token; counts are combined before the shuffle.
    """
    place = [BUCKET] if BUCKET in tokens.columns else []
    return tokens.where(F.col("word").isNotNull()).groupBy("word", *place).agg(F.count(F.lit(1)).alias("n"))


def save_tokens(
    tokens: DataFrame, path: str, partition_by: tuple[str, ...] = (), in_order: bool = False, bits: int | None = None
) -> None:
    """Store a token table as Parquet with neighbouring tokens in the same file.

    Min/max statistics on ``text_id`` and ``tok_no`` then let a scan skip what it does not need. Tokens expanded from
    arranged documents are written as they are; any others are range-partitioned by (text, block) and sorted, so a very
    long text fills several files. Tokens with a corpus position ``pos`` are also partitioned by it (``BUCKET``), and
    words are stored in lower case too, so that a search without regard to case skips row groups. ``bits`` is the width of
    a partition of positions (``layout.bits_for``).
    """
    if "word" in tokens.columns:
        tokens = tokens.withColumn("word_folded", F.lower("word"))
    if "pos" in tokens.columns:
        bits = bits_of(tokens) if bits is None else bits
        tokens = tokens.withColumn("pos", F.col("pos").alias("pos", metadata={BITS_KEY: bits})).withColumn(BUCKET, bucket(F.col("pos"), bits))
        partition_by = (*partition_by, BUCKET)
    if not in_order:
        keys = [F.col(c) for c in (*partition_by, "text_id")]
        tokens = tokens.repartitionByRange(*keys, block("tok_no")).sortWithinPartitions(*keys, "tok_no")
    _save(tokens, path, partition_by, in_order)


def save_runs(runs: DataFrame, path: str) -> None:
    """Store ``token_runs`` of arranged documents, partitioned by corpus position."""
    _save(runs, path, (BUCKET,), True)


def _save(rows: DataFrame, path: str, partition_by: tuple[str, ...], in_order: bool) -> None:
    # rows in order fill one partition after the other, so a task keeps a few files open instead of sorting its rows
    with settings(rows.sparkSession, {WRITERS_KEY: str(WRITERS)} if in_order else {}):
        rows.write.partitionBy(*partition_by).option("compression", CODEC).parquet(path)
