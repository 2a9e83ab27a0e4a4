"""Approximate nearest neighbours by multi-index hashing (Norouzi, Punjani and Fleet).

Vectors get binary codes from learned rotations (ITQ). Codes are split into 16-bit substrings, and each substring is
indexed. If two codes differ in at most ``radius`` bits, then by the pigeonhole principle some substring differs in at
most ``radius // substrings`` bits, so probing every substring's directory at that distance retrieves every code within
the radius. These candidates are reranked by the inner product of the original vectors in double precision.

Largest inner products are made nearest angles by one more component, sqrt(M^2 - |x|^2), where M is the largest norm. The
radius is set by exact searches for a fixed number of calibration queries over all rows, and so is the measured recall.
Queries and rows meet in blocks: each task indexes one block of rows and answers one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wordloom.llm.common import cut, rows_in

NEIGHBOURS = 20
#: Bits of a code, of a substring, rows the rotations are learned on, calibration queries, share of true neighbours the
#: radius must hold, rows of a block, and queries of a block.
BITS, PART, SAMPLE, CALIBRATION, SHARE, ROWS, QUERIES = 256, 16, 4096, 128, 0.97, 16384, 4096
FOUND = "query_id bigint, vec_id bigint, score double"


class Codes(NamedTuple):
    """Dimension of the vectors, largest norm, and one rotation per ``dimension + 1`` bits."""

    dimension: int
    norm: float
    rotations: np.ndarray


def learn(sample: np.ndarray, norm: float, bits: int = BITS, rounds: int = 12) -> Codes:
    """Rotations by iterative quantization on the sample: B = sign(X R), then R from the SVD of B' X."""
    x = augmented(sample, norm)
    d, rng, out = x.shape[1], np.random.default_rng(3), []
    while len(out) * d < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        out.append(r)
    return Codes(sample.shape[1], norm, np.concatenate(out, axis=1)[:, :bits])


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    """Vectors of equal length ``norm`` whose angles with (q, 0) order as the inner products with q do."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def encode(codes: Codes, x: np.ndarray, query: bool) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    full = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else augmented(x, codes.norm)
    return np.packbits(full @ codes.rotations >= 0, axis=1).view(np.uint64)


class BlockIndex:
    """Substring indexes of a block of codes: for each substring its distinct values, and the rows of each value."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, parts = words, words.view(np.uint16)
        self.directories = []
        for j in range(parts.shape[1]):
            order = np.argsort(parts[:, j], kind="stable")
            values, starts = np.unique(parts[order, j], return_index=True)
            self.directories.append((values, order, np.append(starts, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits, in order."""
        parts, n = code.view(np.uint16), len(self.directories)
        each, rest = divmod(radius, n)
        if each >= PART:
            hit = np.ones(len(self.words), bool)
        else:
            hit = np.zeros(len(self.words), bool)
            for j, (values, order, starts) in enumerate(self.directories):
                # by the sharper principle, only the first rest + 1 substrings need the full distance
                most = each if j <= rest else each - 1
                near = np.bitwise_count(values ^ parts[j]) <= most
                if near.all():
                    hit[:] = True
                    break
                hit[order[np.repeat(near, np.diff(starts))]] = True
                if hit.all():
                    break
        rows = np.flatnonzero(hit)
        distance = np.bitwise_count(self.words[rows] ^ code).sum(axis=1, dtype=np.int64)
        return rows[distance <= radius]


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed in the same order wherever it stands."""
    return (rows * query).sum(axis=1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _finite(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of rows with an id and a vector of finite components, not all zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", v.alias("vector")).where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.where(F.exists("vector", lambda x: x != 0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (double array) of rows that take part.

    Left out: rows without id, null, empty or zero vectors, vectors with null or non-finite components, and vectors of
    another dimension than most have (the larger one if equally many).
    """
    rows = _finite(vectors)
    sizes = rows.groupBy(F.size("vector").alias("_d")).count().orderBy(F.desc("count"), F.desc("_d")).limit(1).select("_d")
    return rows.join(F.broadcast(sizes), F.size("vector") == F.col("_d")).drop("_d")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(query_ids, ids, scores) -> pa.RecordBatch:
    columns = (np.asarray(query_ids, np.int64), np.asarray(ids, np.int64), np.asarray(scores, np.float64))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of what the blocks found for each query, at most k from each block."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The ``k`` nearest of every row but the query's own, for a bounded number of queries, by comparing all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = shared.value
        for batch in rows_in(batches):
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for query_id, query in zip(own_ids, own):
                scores = np.where(ids == query_id, -np.inf, products(x, query))
                top = best(ids, scores, k)
                top = top[np.isfinite(scores[top])]
                yield _packed(np.full(len(top), query_id), ids[top], scores[top])

    return _top(rows.mapInArrow(work, FOUND), k)


def calibrated(rows: DataFrame, codes: Codes, k: int, share: float = SHARE, n: int = CALIBRATION) -> tuple[int, float]:
    """Radius that holds ``share`` of the true neighbours of ``n`` queries drawn from all rows, and the recall there."""
    once = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    drawn = once.orderBy(F.xxhash64("vec_id", F.lit("radius")), "vec_id").limit(n).toArrow()
    query_ids, queries = drawn["vec_id"].to_numpy(), _matrix(drawn["vector"])
    # at most n * k rows: of repeated ids one vector stands for all
    near = exact(rows, query_ids, queries, k).select("query_id", "vec_id").distinct().join(once, "vec_id").select("query_id", "vector").toArrow()
    if not near.num_rows:
        return 0, 1.0
    place = {q: i for i, q in enumerate(query_ids.tolist())}
    owner = np.array([place[q] for q in near["query_id"].to_pylist()])
    bits = encode(codes, _matrix(near["vector"]), False) ^ encode(codes, queries, True)[owner]
    distances = np.sort(np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
    radius = int(distances[min(int(np.ceil(share * len(distances))), len(distances)) - 1])
    return radius, float((distances <= radius).mean())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row of ``queries`` (same columns).

    A row is never its own neighbour. Queries with fewer than ``k`` candidates within the radius are searched again over
    all rows, so every query has ``k`` results if there are as many rows. Rows that ``usable`` leaves out take no part.
    Repeated ids are separate rows; queries with one id are one query, the least of their vectors. Other columns are not
    read. The rotations are learned on about ``SAMPLE`` different vectors, at most four times as many.
    """
    rows = cut(usable(vectors))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not size["n"]:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = rows.where(F.pmod(F.xxhash64("vector", F.lit("codes")), F.lit(1 << 30)) <= F.lit(SAMPLE / size["n"] * (1 << 30)))
    x = _matrix(sample.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(4 * SAMPLE).toArrow()["vector"])
    if not len(x):
        x = _matrix(rows.limit(1).select("vector").toArrow()["vector"])
    codes = learn(x, float(np.sqrt(size["m"])), bits)
    radius, _ = calibrated(rows, codes, k)
    asked = usable_queries(queries, codes.dimension)
    found = cut(_search(rows, asked, codes, radius, k, size["n"]))
    counts = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("_n"))
    few = F.coalesce("_n", F.lit(0)) < min(k, size["n"] - 1)
    short = cut(asked.join(counts, "vec_id", "left").where(few).select("vec_id", "vector"))
    if not short.isEmpty():
        # the whole code length as radius: every row is a candidate
        again = _search(rows, short, codes, codes.rotations.shape[1], k, size["n"])
        kept = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
        found = kept.unionByName(again)
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def usable_queries(queries: DataFrame, dimension: int) -> DataFrame:
    """Queries of the table's dimension, however many have another."""
    own = _finite(queries).where(F.size("vector") == dimension)
    return own.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _search(rows: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int, n: int) -> DataFrame:
    row_blocks = max(1, -(-n // ROWS))
    query_blocks = max(1, -(-queries.count() // QUERIES))
    shared = rows.sparkSession.sparkContext.broadcast((codes, radius))

    def deal(frame: DataFrame, key: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        """Rows with their own block, once for each block of the other side."""
        block = F.pmod(F.xxhash64(key, F.lit(own)), F.lit(own_blocks)).cast("int")
        return frame.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    left = deal(asked, "query_id", "_query_block", query_blocks, "_row_block", row_blocks)
    right = deal(rows, "vec_id", "row_block", row_blocks, "query_block", query_blocks)

    def work(asked: pa.Table, block: pa.Table) -> pa.Table:
        codes, radius = shared.value
        ids, x = block["vec_id"].to_numpy(), _matrix(block["vector"])
        out = [_packed([], [], [])]
        if len(ids) and asked.num_rows:
            index = BlockIndex(encode(codes, x, False))
            query_ids, queries = asked["query_id"].to_numpy(), _matrix(asked["query"])
            for query_id, query, code in zip(query_ids, queries, encode(codes, queries, True)):
                near = index.within(code, radius)
                near = near[ids[near] != query_id]
                scores = products(x[near], query)
                top = best(ids[near], scores, k)
                out.append(_packed(np.full(len(top), query_id), ids[near][top], scores[top]))
        return pa.Table.from_batches(out)

    pairs = left.groupBy("_query_block", "_row_block").cogroup(right.groupBy("query_block", "row_block"))
    return pairs.applyInArrow(work, FOUND)


def digest(vectors: DataFrame) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
