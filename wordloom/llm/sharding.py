"""Sharding: jump consistent hashing (Lamping and Veach) maps stable keys to shards without a ring table.

When a shard is appended, a key either stays or moves to the new shard; of n + 1 shards' rows one in n + 1 moves.
Everything is column expressions: a row's shard needs no other row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed values of the method: multiplier of its generator, and the same in pieces for products that fit 63 bits.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_WORD = 0xFFFFFFFF
#: Rows of a shard are numbered in 16 ** SLOT_DIGITS buckets, so no task sorts a shard.
SLOT_DIGITS = 3


def _times_low(x: Column, factor: int) -> Column:
    """Lower 32 bits of x * factor for 32-bit x."""
    return (x * F.lit(factor & 0xFFFF) + F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(
        F.lit(_WORD)
    )


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2 ** 64 on 32-bit halves: no product overflows, also under ANSI rules."""
    upper = low * F.lit(_LOW >> 16)
    rest = low * F.lit(_LOW & 0xFFFF) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(rest, 32) + F.shiftright(upper, 16)
    new_high = (carry + _times_low(high, _LOW) + _times_low(low, _HIGH)).bitwiseAND(F.lit(_WORD))
    return new_high, rest.bitwiseAND(F.lit(_WORD))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. ``shards`` - 1 of a 64-bit integer key; a null key counts as 0.

    The method jumps ahead at most ``shards`` times (about ln(shards) on average): the remaining steps keep the state.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    begin = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_WORD)).alias("low"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        ahead = F.floor(
            (state["next"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))
        ).cast("long")
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("at"), ahead.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, step, lambda s: s["at"].cast("int"))


def with_slots(rows: DataFrame, shard: str, order: list[str], key: str, name: str = "slot") -> DataFrame:
    """Gapless number of every row within its shard, from 0, as column ``name``.

    Rows of a shard are dealt over buckets by a digest of ``key`` and numbered there; counts per (shard, bucket), at
    most 4096 a shard, give each bucket its offset. ``rows`` should be narrow: they are shuffled once. Equal rows get
    neighbouring numbers.
    """
    bucket = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, SLOT_DIGITS)
    keyed = rows.withColumn("__bucket", bucket)
    counts = keyed.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(shard).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "__bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(shard, "__bucket").orderBy(*order)
    numbered = keyed.withColumn("__no", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [shard, "__bucket"]).withColumn(name, F.col("__no") + F.col("__offset")).drop(
        "__bucket", "__no", "__offset"
    )


def shard_rows(rows: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """All rows with the shard of their integer ``key``, as column ``name`` (replaced if there).

    Nulls count as key 0, equal keys share a shard, an empty table stays empty, and other columns are kept.
    """
    return rows.withColumn(name, jump_shard(F.col(key), shards))


def digest(rows: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of documents in ``shards`` shards, law ``key``."""
    narrow = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = shard_rows(narrow, "doc_id", shards)
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], "doc_id").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )


def digest_sql(shards: int) -> str:
    """The same in DuckDB: the generator on 128-bit integers, a checksum over hexadecimal digits."""
    moved = f"(s.key * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT"
    ahead = f"(s.next + 1)::DOUBLE * (2147483648::DOUBLE / ((({moved}) // 8589934592::HUGEINT) + 1)::DOUBLE)"

    def jump(n: int) -> str:
        begin = (
            "{key: CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE"
            " coalesce(doc_id, 0)::HUGEINT END, here: -1::BIGINT, next: 0::BIGINT}"
        )
        step = f"CASE WHEN s.next < {n} THEN {{key: {moved}, here: s.next, next: floor({ahead})::BIGINT}} ELSE s END"
        return f"list_reduce(list_transform(range({n} + 1), lambda i: {begin}), lambda s, x: {step}).here::INTEGER"

    table = (
        "SELECT list(list_reduce(list_transform(range(9), lambda i: b), lambda c, x:"
        " CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY b) AS crc"
        " FROM range(256) AS r(b)"
    )
    crc = (
        "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all("
        "hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),"
        " lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])))"
    )
    return f"""
WITH t AS ({table}),
placed AS (
  SELECT doc_id, (coalesce(strlen(text), 0) + 8)::BIGINT AS size, {crc} AS text_crc32, {jump(shards)} AS shard,
         {jump(shards + 1)} AS grown_shard
  FROM documents, t
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {SLOT_DIGITS}),
                          doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed ORDER BY doc_id
"""
