"""Joins on keys that may hold a third of all rows, and on few keys of many."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key that stay together, and the most keys that are split. A key beyond them has less than one row in
#: ``MOST_KEYS`` and stays whole; the table of split keys that is broadcast never has more rows.
TOGETHER, MOST_KEYS = 1 << 16, 10_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose ``keys`` are unique, where a key of ``left`` may be very frequent.

    Frequent keys are counted first; their rows of ``left`` are dealt over as many salts as they need by a hash of
    ``spread``, and the one row of ``right`` is copied to each. Only copies of matched rows are made, nothing is dropped.
    ``left`` is read twice, so it should be a written table. Rows with a null key match nothing.
    """
    many = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > TOGETHER)
    most = many.orderBy(F.desc("__n"), *keys).limit(MOST_KEYS)
    hot = F.broadcast(most.select(*keys, F.ceil(F.col("__n") / TOGETHER).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
    copied = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("__salts").join(copied.drop("__salts"), [*keys, "__salt"], how).drop("__salt")


def sieved(frame: DataFrame, ids: DataFrame, keys: list[str], bits: int = 22) -> DataFrame:
    """``frame`` with ``__maybe``: false for most rows whose ``keys`` are not among ``ids``, true for all whose are.

    One bit of 2 ** ``bits`` for a hash of each id; the bits, of that size whatever there is, are sent to the rows.
    """
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    marked = ids.select(*keys).withColumn("__word", F.shiftright(h, 6)).withColumn("__bit", (h % 64).cast("int"))
    words = marked.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    placed = frame.withColumn("__word", F.shiftright(h, 6)).withColumn("__bit", (h % 64).cast("int"))
    seen = placed.join(F.broadcast(words), "__word", "left")
    return seen.withColumn("__maybe", F.expr("coalesce(shiftright(__bits, __bit) & 1L, 0L) = 1L")).drop("__word", "__bit", "__bits")
