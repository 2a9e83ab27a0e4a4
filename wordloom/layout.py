"""How token positions are cut into blocks, and distributed running totals.

A text may hold a third of all tokens, so no shuffle key is ever a text alone: keys are (text_id, block) with a
block of 4096 neighbouring tokens, or finer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.session import cut

# Stored token tables are partitioned by corpus position, so a page of hits reads only the partitions it lies in.
# A partition has 2 ** BUCKET_BITS positions, more where a corpus would fill more than MOST_BUCKETS of them; how many stands
# in the metadata of the stored columns.
BUCKET, BUCKET_BITS, MOST_BUCKETS, BITS_KEY = "bucket", 20, 1 << 14, "bucket_bits"
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: Bits of the filter that keeps rows nobody asks for from being moved.
FILTER_BITS = 26


def block(position: Column | str, bits: int = BLOCK_BITS) -> Column:
    """Block number of a token position."""
    return F.shiftright(position, bits)


def bucket(position: Column | str, bits: int | None = None) -> Column:
    """Storage partition of a corpus position."""
    return F.shiftright(position, BUCKET_BITS if bits is None else bits).cast("int").alias(BUCKET)


def bits_for(positions: int) -> int:
    """Bits of a partition of a corpus of so many positions."""
    return max(BUCKET_BITS, ((positions - 1) // MOST_BUCKETS).bit_length())


def bits_of(stored: DataFrame) -> int:
    """Bits of the partitions of a stored table."""
    found = (field.metadata.get(BITS_KEY) for field in stored.schema.fields if field.metadata)
    return next((bits for bits in found if bits is not None), BUCKET_BITS)


def unfolded(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row for every whole number from ``first`` to ``last``, as column ``name``; none for an empty range.

    It is done in two steps of at most 1024 numbers where the range is that short, so a long range is no long array of one row.
    """
    coarse = df.withColumn("_low", first).withColumn("_high", last).where(F.col("_low") <= F.col("_high"))
    coarse = coarse.withColumn("_step", F.explode(F.sequence(F.shiftright("_low", 10), F.shiftright("_high", 10))))
    lower, upper = F.shiftleft("_step", 10), F.shiftleft("_step", 10) + 1023
    numbers = F.sequence(F.greatest("_low", lower), F.least("_high", upper))
    return coarse.withColumn(name, F.explode(numbers)).drop("_low", "_high", "_step")


def asked_for(rows: DataFrame, keys: tuple[str, str], asked: DataFrame, asked_keys: tuple[str, str]) -> DataFrame:
    """Rows whose keys (text, number) some row of ``asked`` may have: what passes a filter of fixed size, before a shuffle.

    The filter has ``2 ** FILTER_BITS`` bits, one per hash of the keys, in numbers of 64; so many numbers at most are sent
    to the rows. It never drops a row that is asked for, but may pass others, so a join has to follow.
    """
    # one hash whatever the types of both sides
    place = lambda columns: F.xxhash64(F.col(columns[0]).cast("string"), F.col(columns[1]).cast("bigint")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(_hash & 63 as int))")
    number = F.shiftright("_hash", 6).alias("_number")
    bits = asked.select(place(asked_keys).alias("_hash")).groupBy(number).agg(F.bit_or(bit).alias("_bits"))
    hashed = rows.withColumn("_hash", place(keys)).withColumn("_number", number)
    passed = hashed.join(F.broadcast(bits), "_number").where(F.col("_bits").bitwiseAND(bit) != 0)
    return passed.select(*rows.columns)


def running_total(df: DataFrame, order: list, weight: Column, name: str, partitions: int | None = None) -> DataFrame:
    """Sum of ``weight`` over all rows before a row in the total order ``order``, as column ``name``.

    Rows are range-partitioned on ``order`` (which must be unique), each partition is summed, and the totals of the
    partitions (one row each, so their number is bounded by ``partitions``) give each partition its offset.
    The partitioned rows are checkpointed because the offsets hold only for that one partitioning.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.withColumn("_w", weight).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_part")
        .agg(F.sum("_w").alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .drop("_part", "_w", "_offset")
    )


def number_rows(df: DataFrame, order: list, name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """0-based number of every row in a total order, without a single-task window.

    Rows are range-partitioned and sorted once; a row's number is its place in its partition plus the rows of the
    partitions before, one count each. The placed rows are checkpointed, because the places hold only for them.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Spark's increasing ids: partition number above 33 bits, place in the partition below
    placed = cut(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + place).drop("_part", "_id", "_offset")
