"""Dependency edges (JOI-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from wordloom.layout import block

#: Bits of the neighbouring indices of a region that meet in one group.
NEAR_BITS = 6


def dependency_edges(tokens: DataFrame, within: str = "s") -> DataFrame:
    """One row per token that has a head: the head's token, the distance, and the side the child stands on.

    The head's index belongs to the same region, so tokens meet by (text, region, 64 neighbouring indices): fine-grained, and
    a token is shuffled once, as head and child at the same time, unless its head stands among other neighbours.
    Root tokens (head 0) have no edge.
    """
    region = f"{within}_id"
    types = {f.name: f.dataType for f in tokens.schema}
    near = lambda index: block(index.cast("bigint"), NEAR_BITS)
    index, head = F.col("dep_index"), F.when(F.col("dep_head") != 0, F.col("dep_head"))
    own, other = near(index), near(head)
    places = F.when(own == other, F.array(own)).otherwise(F.array_compact(F.array(own, other)))
    dealt = tokens.where(F.col("text_id").isNotNull() & F.col(region).isNotNull()).select(
        "text_id", region, F.explode(places).alias("_near"), _packed(index, head).alias("_token")
    )
    # neighbours are moved as they are and put together afterwards: before, a task would have to sort or hold all its tokens
    groups = dealt.repartition("text_id", region, "_near").groupBy("text_id", region, "_near").agg(F.collect_list("_token").alias("_tokens"))
    # split once each, in a step of its own
    parted = groups.withColumn("_parts", F.transform("_tokens", lambda t: F.split(t, " ", 4)))
    tokens = parted.withColumn("_tokens", F.transform("_parts", lambda parts: _unpacked(parts, types["dep_fun"])))
    heads = F.sort_array(F.transform(F.filter("_tokens", lambda t: near(t["index"]) == F.col("_near")), lambda t: F.struct(t["index"], t["word"])))
    placed = tokens.withColumn("_heads", heads).select(
        "text_id",
        region,
        F.col("_heads.index").alias("_at"),
        F.reverse(F.col("_heads.index")).alias("_back"),
        F.col("_heads.word").alias("_words"),
        F.filter("_tokens", lambda t: near(t["head"]) == F.col("_near")).alias("_children"),
    )
    children = placed.select("text_id", region, "_at", "_back", "_words", F.explode("_children").alias("_c"))
    # the heads of one index stand side by side, from the first to the last place that has it
    first = F.array_position("_at", F.col("_c.head"))
    last = F.size("_at") + 1 - F.array_position("_back", F.col("_c.head"))
    found = F.when(first > 0, F.slice("_words", first.cast("int"), (last - first + 1).cast("int")))
    edges = children.select(
        "text_id",
        region,
        F.col("_c.index").cast(types["dep_index"]).alias("dep_index"),
        F.col("_c.word").alias("word"),
        F.col("_c.fun").alias("dep_fun"),
        F.col("_c.head").cast(types["dep_head"]).alias("dep_head"),
        F.explode(found).alias("head_word"),
    )
    return edges.withColumn("distance", F.abs(F.col("dep_index") - F.col("dep_head")))


def _packed(index: Column, head: Column) -> Column:
    """Index, head, function and word of a token as one string, which takes fewer bytes of a shuffle than four columns.

    Numbers end in a blank, the first three may be missing; the function's length says where the word begins.
    """
    fun = F.col("dep_fun").cast("string")
    numbers = [F.coalesce(n.cast("string"), F.lit("")) for n in (index.cast("bigint"), head.cast("bigint"), F.length(fun))]
    marked = F.coalesce(F.concat(F.lit("="), "word"), F.lit(""))
    return F.concat(*(part for n in numbers for part in (n, F.lit(" "))), F.coalesce(fun, F.lit("")), marked)


def _unpacked(parts: Column, fun_type: DataType) -> Column:
    """What ``_packed`` was made of, from its parts between the first three blanks."""
    size, rest = parts[2].try_cast("int"), parts[3]
    before = F.coalesce(size, F.lit(0))
    word = F.when(F.length(rest) > before, F.substring(rest, before + 2, F.length(rest)))
    return F.struct(
        parts[0].try_cast("bigint").alias("index"),
        parts[1].try_cast("bigint").alias("head"),
        F.substring(rest, F.lit(1), size).cast(fun_type).alias("fun"),
        word.alias("word"),
    )


def child_sides(tokens: DataFrame, within: str = "s") -> DataFrame:
    """Per head token whether its children stand left, right or on both sides of it (``L``, ``R``, ``LR``)."""
    children = tokens.where(F.col("dep_head") != 0)
    sides = children.groupBy("text_id", f"{within}_id", "dep_head").agg(
        F.bool_or(F.col("dep_index") < F.col("dep_head")).alias("_left"),
        F.bool_or(F.col("dep_index") > F.col("dep_head")).alias("_right"),
    )
    side = F.when(F.col("_left") & F.col("_right"), "LR").when(F.col("_left"), "L").otherwise("R")
    return sides.select("text_id", f"{within}_id", "dep_head", side.alias("sides"))
