"""Corpora made from the given tables: written ``docs``, many-to-many ``shop`` and spoken ``talk``."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.layout import number_rows, running_total
from wordloom.operators.selection import Dimension
from wordloom.plans.corpus import Corpus
from wordloom.session import checkpoint_folder, spread, tune
from wordloom.sources.tokens import TASK_BITS, TOKEN_PATTERN, arranged, document_blocks, placed_in_order, token_runs, tokenise

UNLISTED_ROLE = "system"
#: Stored corpora this process has written.
_written: set[str] = set()
PLACES_WITHOUT_COORDINATES = (3, 7, 11)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def token_count(text: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))).cast("bigint")


# ---------------------------------------------------------------- docs


def annotated(tokens: DataFrame) -> DataFrame:
    """Token attributes by simple rules; columns a query does not use are never computed."""
    word = F.col("word")
    punctuation = ~word.rlike(r"^[\p{L}\p{N}]")
    number = word.rlike(r"^\p{N}+$")
    capital = word.rlike(r"^\p{Lu}")
    tags = [F.when(capital, "cap"), F.when(number, "num"), F.when(F.length("word") <= 3, "short")]
    return tokens.select(
        "*",
        F.lower("word").alias("lemma"),
        F.when(punctuation, "PUNCT").when(number, "NUM").when(capital, "CAP").otherwise("WORD").alias("pos_tag"),
        F.when(~punctuation, F.lower(F.substring("word", 1, 3))).alias("phon"),
        word.alias("orig"),
        F.array_compact(F.array(*tags)).alias("feats"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))


def docs_tokens(spark: SparkSession, folder: str, neighbours: bool = False) -> DataFrame:
    return annotated(tokenise(documents(spark, folder), "doc_id", "text", ("lang",), neighbours))


def docs_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of the documents; labels are NULL for most of them. Tokens are counted inside each row."""
    docs = spread(table(spark, folder, "documents"))
    labels = table(spark, folder, "labels")
    return docs.select(
        F.col("doc_id").alias("text_id"), "lang", "source", "n_chars", token_count("text").alias("n_tokens")
    ).join(
        labels.select(
            F.col("doc_id").alias("text_id"), F.col("quality").cast("bigint"), F.col("toxic").cast("bigint")
        ),
        "text_id",
        "left",
    )


def docs_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """``docs_texts`` with corpus positions."""
    placed = running_total(docs_texts(spark, folder), ["text_id"], F.col("n_tokens"), "startpos")
    return placed.withColumn("endpos", F.col("startpos") + F.col("n_tokens") - 1)


def placed_documents(spark: SparkSession, folder: str, ranges: DataFrame) -> DataFrame:
    return documents(spark, folder).join(ranges.select(F.col("text_id").alias("doc_id"), "startpos"), "doc_id")


def docs_placed_tokens(
    spark: SparkSession, folder: str, ranges: DataFrame, in_order: bool = False, neighbours: bool = False
) -> DataFrame:
    """Tokens with ``startpos`` and ``pos``. The start is joined to the documents, one row each, before they are expanded:
    joined to the tokens, a long text would be one hot key."""
    placed = placed_documents(spark, folder, ranges)
    if in_order:
        placed = arranged(placed, "doc_id")
    tokens = tokenise(placed, "doc_id", "text", ("lang", "startpos"), neighbours)
    return annotated(tokens.withColumn("pos", F.col("startpos") + F.col("tok_no")))


def docs_stored(spark: SparkSession, folder: str) -> Corpus:
    """The same corpus as stored tables, in the shared folder of the session; written at the first call for a folder.

    Documents are put in order once; runs of tokens and blocks are both cut from what is kept of that. Tokens are made of
    their runs, and attributes that follow from the word computed, when they are asked for.
    """
    path = f"{checkpoint_folder(tune(spark))}/docs-{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}-{spark.sparkContext.applicationId}"
    options = {"attributes": ("lemma", "pos_tag", "phon", "orig", "feats")}
    if path in _written:
        corpus = Corpus.opened(spark, path, **options)
        return replace(corpus, tokens=annotated(corpus.tokens))
    ranges = docs_ranges(spark, folder)
    ordered = placed_in_order(table(spark, folder, "documents").select("doc_id", "lang", "text"), ranges, "doc_id", TASK_BITS)
    runs = lambda bits: token_runs(ordered, "doc_id", "text", ("lang", "startpos"), bits)
    unique = not ranges.groupBy("text_id").count().where("count > 1").limit(1).count()
    blocks = lambda bits: document_blocks(ordered, "doc_id", "text", bits, unique)
    corpus = Corpus.stored(runs, ranges, path, in_order=True, blocks=blocks, **options)
    _written.add(path)
    return replace(corpus, tokens=annotated(corpus.tokens))


def docs(spark: SparkSession, folder: str) -> Corpus:
    return Corpus(
        docs_tokens(spark, folder), docs_texts(spark, folder), attributes=("lemma", "pos_tag", "phon", "orig", "feats")
    )


# ---------------------------------------------------------------- shop


def shop_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as texts, their lines as tokens, the customer's nation as place."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("text_id")).agg(
        F.count(F.lit(1)).alias("n_tokens")
    )
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return orders.select(
        F.col("o_orderkey").alias("text_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.round("o_totalprice").cast("bigint").alias("price"),
        F.col("n_name").alias("place"),
    ).join(lines, "text_id", "left").na.fill(0, ["n_tokens"])


def shop_dimensions(spark: SparkSession, folder: str) -> dict[str, Dimension]:
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
        F.col("p_size").cast("bigint").alias("size"),
    )
    bridge = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("text_id"), F.col("l_partkey").alias("id")
    ).distinct()
    return {"part": Dimension(parts, bridge)}


def shop_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Lines in the order of all their columns (keys repeat; equal lines are interchangeable); the order is the region."""
    lines = table(spark, folder, "lineitem")
    columns = [c for c in lines.columns if c != "l_orderkey"]
    numbered = number_rows(lines, ["l_orderkey", *columns], "pos")
    starts = numbered.groupBy("l_orderkey").agg(F.min("pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    return numbered.join(starts, "l_orderkey").select(
        F.col("l_orderkey").alias("text_id"),
        "pos",
        (F.col("pos") - F.col("_start")).alias("tok_no"),
        F.lit(0).cast("bigint").alias("s_id"),
        F.lit(0).cast("bigint").alias("s_first"),
        (F.col("_n") - 1).alias("s_last"),
        F.col("l_returnflag").alias("word"),
        F.col("l_linestatus").alias("pos_tag"),
        F.concat("l_returnflag", "l_linestatus").alias("lemma"),
    )


def shop(spark: SparkSession, folder: str) -> Corpus:
    return Corpus(
        shop_tokens(spark, folder),
        shop_texts(spark, folder),
        shop_dimensions(spark, folder),
        attributes=("pos_tag", "lemma"),
        coords=coordinates(spark, folder),
    )


def shop_line_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every line as a one-token hit with its attributes, for counts that need no token order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("text_id"),
        F.col("l_returnflag").alias("word"),
        F.col("l_linestatus").alias("pos_tag"),
        F.concat("l_returnflag", "l_linestatus").alias("lemma"),
    )


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").where(~F.col("n_nationkey").isin(*PLACES_WITHOUT_COORDINATES))
    return nation.select(
        F.col("n_name").alias("place"),
        (F.col("n_nationkey") * 2 + 30).cast("double").alias("lat"),
        (F.col("n_nationkey") * 3 - 20).cast("double").alias("lng"),
    )


def supplier_places(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers spread over the globe by their number."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        key.cast("string").alias("place"),
        ((key * 37 % 1700) / 10.0 - 85).alias("lat"),
        ((key * 73 % 3600) / 10.0 - 180).alias("lng"),
    )


def nation_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """A hexagon around a point for every nation; some lie on the 180th meridian, where longitudes jump."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    corners = [(1.0, 0.0), (0.5, 1.0), (-0.5, 1.0), (-1.0, 0.0), (-0.5, -1.0), (0.5, -1.0)]
    lat = lambda c: key * 6 - 70 + F.lit(c[0]) * (5 + region)
    lng = lambda c: key * 15 - 180 + F.lit(c[1]) * (8 + region)
    on_globe = lambda x: F.when(x < -180, x + 360).when(x >= 180, x - 360).otherwise(x)
    rows = [F.struct(F.lit(i).cast("long").alias("corner"), lat(c).alias("lat"), on_globe(lng(c)).alias("lng")) for i, c in enumerate(corners)]
    return table(spark, folder, "nation").select(key.cast("long").alias("polygon"), F.explode(F.array(*rows)).alias("c")).select("polygon", "c.*")


# ---------------------------------------------------------------- talk


def talk_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as speech segments of a recording, with their token numbers and corpus positions."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("text_id"), F.col("turn").alias("seg_id"), "role", token_count("text").alias("_n")
    )
    placed = running_total(turns, ["text_id", "seg_id"], F.col("_n"), "startpos")
    starts = placed.groupBy("text_id").agg(F.min("startpos").alias("_start"))
    first = F.col("startpos") - F.col("_start")
    name = F.col("text_id").cast("string")
    return placed.join(starts, "text_id").select(
        "text_id",
        "seg_id",
        "role",
        F.concat_ws("_", name, "role").alias("speaker"),
        (F.col("seg_id") * 10.0).alias("from_s"),
        (F.col("seg_id") * 10.0 + 9.5).alias("to_s"),
        F.concat(F.lit("rec"), name).alias("av_file"),
        F.concat_ws("-", name, F.col("seg_id").cast("string")).alias("message_id"),
        first.alias("seg_first"),
        (first + F.col("_n") - 1).alias("seg_last"),
        "startpos",
        (F.col("startpos") + F.col("_n") - 1).alias("endpos"),
    )


def talk_tokens(spark: SparkSession, folder: str, segments: DataFrame | None = None) -> DataFrame:
    segments = talk_segments(spark, folder) if segments is None else segments
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("text_id"), F.col("turn").alias("seg_id"), "text"
    )
    placed = turns.join(
        segments.select("text_id", "seg_id", "seg_first", "seg_last", "startpos", "role", "speaker"), ["text_id", "seg_id"]
    )
    words = F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).alias("_i", "word")
    exploded = placed.select("text_id", "seg_id", "seg_first", "seg_last", "startpos", "role", "speaker", words)
    return annotated(
        exploded.select(
            "text_id",
            "seg_id",
            "seg_first",
            "seg_last",
            "role",
            "speaker",
            (F.col("seg_first") + F.col("_i")).alias("tok_no"),
            (F.col("startpos") + F.col("_i")).alias("pos"),
            "word",
        )
    )


def talk_speakers(segments: DataFrame) -> DataFrame:
    """Listed speakers, one row each."""
    listed = segments.where(F.col("role") != UNLISTED_ROLE)
    return listed.select(F.col("speaker").alias("text_id"), "role").distinct()


def talk_bounds(segments: DataFrame) -> DataFrame:
    """Speakers with ``bounds`` in the notation of the input files, at most 64 segments to a row."""
    bounds = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("start", "end"))),
            lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string")),
        ),
        ":",
    )
    listed = segments.where(F.col("role") != UNLISTED_ROLE).select(
        F.col("speaker").alias("text_id"),
        F.shiftright("seg_id", 6).alias("_part"),
        F.when(F.col("startpos") <= F.col("endpos"), F.col("startpos")).alias("start"),
        F.col("endpos").alias("end"),
    )
    spoken = listed.where(F.col("start").isNotNull()).groupBy("text_id", "_part").agg(bounds.alias("bounds"))
    silent = listed.where(F.col("start").isNull()).select("text_id", "_part", F.lit("").alias("bounds"))
    return spoken.unionByName(silent).drop("_part")


def talk_ranges(segments: DataFrame) -> DataFrame:
    """The same ranges as rows (speaker, start, end)."""
    listed = segments.where((F.col("role") != UNLISTED_ROLE) & (F.col("startpos") <= F.col("endpos")))
    return listed.select(F.col("speaker").alias("text_id"), F.col("startpos").alias("start"), F.col("endpos").alias("end"))


def talk(spark: SparkSession, folder: str) -> Corpus:
    segments = talk_segments(spark, folder)
    return Corpus(
        talk_tokens(spark, folder, segments),
        talk_speakers(segments),
        within="seg",
        spoken=True,
        ranges=talk_ranges(segments),
    )


def talk_files(spark: SparkSession, folder: str) -> DataFrame:
    """File list: sound for even recordings, video for every third."""
    recordings = table(spark, folder, "conversations").select("conv_id").distinct()
    path = lambda kind: F.concat(F.lit(f"/media/{kind}/rec"), F.col("conv_id").cast("string"), F.lit(f".mp{kind}"))
    files = F.array_compact(
        F.array(F.when(F.col("conv_id") % 2 == 0, path(3)), F.when(F.col("conv_id") % 3 == 0, path(4)))
    )
    return recordings.select(F.explode(files).alias("path"))


def talk_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn is aligned to the assistant turn right after it."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    source = turns.where("role = 'user'").select("conv_id", "turn")
    target = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return source.join(target, ["conv_id", "turn"], "left_semi").select(
        F.col("conv_id").alias("src_text"),
        F.col("turn").alias("src_region"),
        F.lit("assistant").alias("tgt_lang"),
        F.col("conv_id").alias("tgt_text"),
        (F.col("turn") + 1).alias("tgt_region"),
    )


# ---------------------------------------------------------------- treebank and events


def treebank_tokens(spark: SparkSession, folder: str) -> DataFrame:
    index = F.col("tok_no") - F.col("s_first") + 1
    return docs_tokens(spark, folder).select(
        "text_id",
        "s_id",
        "word",
        index.alias("dep_index"),
        F.floor(index / 2).alias("dep_head"),
        F.col("pos_tag").alias("dep_fun"),
    )


def event_values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("text_id"), F.col("event_type").alias("category"), "value", "ts", "event_id"
    )
