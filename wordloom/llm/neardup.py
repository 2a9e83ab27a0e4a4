"""Near-duplicate documents by HyperMinHash (Yu and Weber), banding and exact verification.

1. Each document's distinct word shingles are hashed. Documents with equal sets form a class, and one of them stands for
   it from here on, so copies cost nothing more however many there are.
2. A sketch has ``BUCKETS`` registers; each stores the leading zeros of its bucket's least hash and ``MANTISSA`` bits after
   them. Empty registers borrow from others for banding. ``BANDS`` bands of four registers give each document its keys.
3. Documents that share a key meet in cells of bounded size. There the registers alone are compared first: a pair goes on
   if a link at the limit has so few equal registers, or fewer, with a probability above ``MISSED`` (binomial; collisions
   are subtracted), and only at the first band that both share, so a pair is looked at once.
4. For documents with such a partner the full sets are made, and cells confirm links on them. Within a cell, documents
   already connected are not compared again, so a dense group costs few comparisons and gives few links.
5. A key whose documents fill more than one cell is gone over again: what is not in the key's main component by then is
   compared with all other cells of the key.

A link at similarity 0.8 shares no key with a probability of 5e-8, one at 0.85 with 6e-11; the registers miss one at the
limit with a probability below 1e-11 more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import cut, flat, mixed, rows_in, shingle_hashes, splits, word_hashes

BUCKET_BITS, MANTISSA, BANDS = 7, 10, 32
BUCKETS = 1 << BUCKET_BITS
ROWS = BUCKETS // BANDS
#: Documents and shingles of a cell.
CELL_DOCS, CELL_SHINGLES = 2048, 2_000_000
SPAN = 1 << 20
#: Probability that the register test drops a link at the limit.
MISSED = 1e-11
U64 = np.uint64
_BORROW = np.random.default_rng(20).integers(0, BUCKETS, (BUCKETS, 64))


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for at, to in splits(len(bounds) - 1, np.diff(bounds), SPAN):
        own = bounds[at : to + 1]
        hashes, edges = shingle_hashes(*word_hashes(raw[own[0] : own[-1]], own - own[0]), k)
        for i in range(to - at):
            yield np.unique(hashes[edges[i] : edges[i + 1]])


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of hashes; 0 is an empty register, otherwise zeros + 1, then the mantissa."""
    first = np.searchsorted(shingles, np.arange(BUCKETS, dtype=U64) << U64(64 - BUCKET_BITS))
    full = first < np.append(first[1:], len(shingles))
    least = shingles[np.minimum(first, len(shingles) - 1)] << U64(BUCKET_BITS)
    zeros = np.clip(53 - np.frexp((least >> U64(11)).astype(np.float64))[1], 0, 53)
    after = (least << zeros.astype(U64)) << U64(1)
    value = ((zeros + 1) << MANTISSA) | (after >> U64(64 - MANTISSA)).astype(np.int64)
    return np.where(full, value, 0).astype(np.uint16)


def borrowed(sketches: np.ndarray) -> np.ndarray:
    """Sketches without empty registers: each tries others in an order of its own until one is full."""
    out, empty = sketches.copy(), sketches == 0
    for attempt in range(_BORROW.shape[1]):
        if not empty.any():
            break
        rows, places = np.nonzero(empty)
        found = sketches[rows, _BORROW[places, attempt]]
        out[rows, places] = found
        empty[rows, places] = found == 0
    rows = np.flatnonzero(empty.any(axis=1))
    if len(rows):
        out[rows] = np.where(empty[rows], sketches[rows].max(axis=1)[:, None], out[rows])
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band of every sketch."""
    quads = np.ascontiguousarray(borrowed(sketches)).view(np.uint64).reshape(len(sketches), BANDS)
    return mixed(quads ^ mixed(np.arange(1, BANDS + 1, dtype=U64))).view(np.int64)


def estimates(one: np.ndarray, others: np.ndarray, n_one: int, n_others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of a sketch against others, and the registers each rests on."""
    used = np.maximum(((one > 0) | (others > 0)).sum(axis=1), 1)
    matches = ((one == others) & (one > 0)).sum(axis=1)
    # expected chance matches of registers, the authors' approximation for sets of different sizes
    ratio = np.minimum(n_one, n_others) / np.maximum(n_one, n_others)
    chance = 0.169919487159739 * (BUCKETS / 2.0 ** (BUCKET_BITS + MANTISSA)) * 4 * ratio / (1 + ratio) ** 2
    return (matches - chance) / used, used


@cache
def _least_matches(limit: float) -> np.ndarray:
    """For each number of used registers the most equal ones that a link at ``limit`` falls short of with at most ``MISSED``."""
    out = np.zeros(BUCKETS + 1, np.int64)
    for used in range(1, BUCKETS + 1):
        terms = [math.comb(used, m) * limit**m * (1 - limit) ** (used - m) for m in range(used + 1)]
        out[used] = np.searchsorted(np.cumsum(terms), MISSED, "right")
    return out


def _candidates(i: int, sketches, full, sizes, band: int, limit: float) -> np.ndarray:
    """Whether each other document goes on as a partner of ``i`` in a cell of ``band``."""
    estimate, used = estimates(sketches[i], sketches, int(sizes[i]), sizes)
    near = estimate * used > _least_matches(limit)[used] - 0.5
    rows = np.flatnonzero(near)
    earlier = (full[rows, :band] == full[i, :band]).any(axis=1) if band else np.zeros(len(rows), bool)
    near[rows[earlier]] = False
    return near


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _by_registers(limit: float) -> Callable[[pa.Table], pa.Table]:
    """Cell of registers -> its rows that have a partner to verify."""

    def work(cell: pa.Table) -> pa.Table:
        sketches, sizes = _sketches(cell["registers"]), cell["n"].to_numpy()
        full = np.ascontiguousarray(borrowed(sketches)).view(np.uint64).reshape(len(sketches), BANDS)
        left, right = (cell[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
        comp, ids, band = cell["comp"].to_numpy(), cell["doc_id"].to_numpy(), cell["band"][0].as_py()
        wanted = np.zeros(len(ids), bool)
        for i in np.flatnonzero(left):
            near = _candidates(i, sketches, full, sizes, band, limit) & right & (comp != comp[i]) & (ids != ids[i])
            wanted |= near
            wanted[i] |= near.any()
        return cell.filter(pa.array(wanted)).drop_columns(["registers"])

    return work


def _by_sets(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Cell of sets -> links that connect what is linked, each confirmed on full sets; no link within a component."""

    def work(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("doc_id")
        sketches, sizes = _sketches(cell["registers"]), cell["n"].to_numpy()
        full = np.ascontiguousarray(borrowed(sketches)).view(np.uint64).reshape(len(sketches), BANDS)
        left, right = (cell[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("left", "right"))
        ids, band = cell["doc_id"].to_numpy(), cell["band"][0].as_py()
        root = np.unique(cell["comp"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(x.as_buffer(), U64) for x in cell["shingles"].combine_chunks()]
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(left):
            near = _candidates(i, sketches, full, sizes, band, percent / 100) & right & (root != root[i])
            # sizes alone rule out many
            near &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
            others = np.flatnonzero(near)
            for at in range(0, len(others), 256):
                part = others[at : at + 256]
                joined = np.concatenate([sets[j] for j in part])
                place = np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)
                ends = np.cumsum([len(sets[j]) for j in part])
                shared = np.diff(np.cumsum(sets[i][place] == joined)[ends - 1], prepend=0)
                linked = 100 * shared >= percent * (len(sets[i]) + np.diff(ends, prepend=0) - shared)
                for j in part[linked]:
                    if root[j] != root[i]:
                        found.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
        a, b = (np.array([f[x] for f in found], np.int64) for x in (0, 1))
        return pa.table({"a": a, "b": b})

    return work


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in ``links`` (a, b), by alternating large and small stars.

    Each round is two groupings and joins of narrow rows; the number of rounds grows with the logarithm of the number of
    nodes. Links are written to the checkpoint folder after every round.
    """
    both = links.where(F.col("a") != F.col("b"))
    edges = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        every = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # larger neighbours move to the least neighbour
        large = every.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node keeps its least neighbour, to which its other smaller ones move
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if tuple(total) == state:
            break
        state = tuple(total)
    lows = edges.groupBy("u").agg(F.min("v").alias("component"))
    return lows.select(F.col("u").alias("node"), "component").unionByName(
        lows.select(F.col("component").alias("node"), "component").distinct()
    )


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            n, one, two, made = [], [], [], []
            for own in shingle_sets(*flat(batch.column(1)), k):
                n.append(len(own))
                one.append(own.sum(dtype=U64))
                two.append(mixed(own).sum(dtype=U64))
                made.append(registers(own).tobytes() if len(own) else None)
            prints = (pa.array(np.array(x, U64).view(np.int64)) for x in (one, two))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *prints, pa.array(made, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "registers"],
            )

    return docs.mapInArrow(work, "doc_id bigint, n bigint, f1 bigint, f2 bigint, registers binary")


def _keys(reps: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            keys = band_keys(_sketches(batch.column(3)))
            columns = [pa.array(np.repeat(batch.column(i).to_numpy(), BANDS)) for i in range(3)]
            bands = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bands), pa.array(keys.ravel())], names=["doc_id", "f1", "n", "band", "key"])

    return reps.select("doc_id", "f1", "n", "registers").mapInArrow(work, "doc_id bigint, f1 bigint, n bigint, band int, key bigint")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Full shingle sets of the wanted (doc_id, f1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            made = list(shingle_sets(*flat(batch.column(1)), k))
            prints = np.array([x.sum(dtype=U64) for x in made], U64).view(np.int64)
            packed = pa.array([x.tobytes() for x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), packed], names=["doc_id", "f1", "shingles"])

    own = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    made = own.mapInArrow(work, "doc_id bigint, f1 bigint, shingles binary")
    return made.join(wanted.select("doc_id", "f1").distinct(), ["doc_id", "f1"], "left_semi")


CELL = "cell bigint, band int, doc_id bigint, f1 bigint, n bigint, comp bigint, left boolean, right boolean"


def _links(docs: DataFrame, reps: DataFrame, cells: DataFrame, percent: int, k: int) -> DataFrame:
    """Confirmed links of all cells (columns of ``CELL``)."""
    sketches = reps.select("doc_id", "f1", "registers")
    near = cut(
        cells.join(sketches, ["doc_id", "f1"]).groupBy("cell").applyInArrow(_by_registers(percent / 100), CELL)
    )
    full = cut(_sets(docs, near, k))
    ready = near.join(sketches, ["doc_id", "f1"]).join(full, ["doc_id", "f1"])
    return cut(ready.groupBy("cell").applyInArrow(_by_sets(percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, linked where 100 * shared >= percent * united shingles.

    Words are parted by ASCII blanks, with A-Z as a-z; shingles are ``k`` words, a shorter text is one shingle as a whole.
    ``component_id`` is the least doc_id reachable by links. Null, empty and blank texts have no shingles and no links;
    a row without doc_id is not linked, has no component and is kept. Texts under one doc_id count as one document, and
    repeated rows are all returned. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    signed = cut(_signatures(docs, k))
    linkable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "registers"))
    classes = linkable.groupBy("f1", "f2", "n").agg(first.alias("_first")).select("f1", "f2", "n", "_first.*")
    reps = cut(classes)
    keyed = _keys(reps)
    fill = F.greatest(F.ceil(F.col("_m") / CELL_DOCS), F.ceil(F.col("_n") / CELL_SHINGLES))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("_n")).where("_m > 1").select("key", fill.alias("_cells"))
    met = cut(keyed.join(shared, "key"))
    block = F.pmod(F.xxhash64("doc_id", "key"), F.col("_cells"))
    once = met.select(
        F.xxhash64("key", block).alias("cell"), "band", "doc_id", "f1", "n",
        F.xxhash64("doc_id", "f1").alias("comp"), F.lit(True).alias("left"), F.lit(True).alias("right"),
    )
    links = _links(docs, reps, once, percent, k)
    # one document under several texts, and one text under several documents, are connected anyway
    large = met.where("_cells > 1")
    if not large.isEmpty():
        rest = _beyond_cells(large, components(links))
        if not rest.isEmpty():
            links = links.unionByName(_links(docs, reps, rest, percent, k))
    found = components(links)
    own = signed.join(reps.select("f1", "f2", "n", F.col("doc_id").alias("node")), ["f1", "f2", "n"], "left")
    # a doc_id with several texts connects their classes
    return (
        own.join(found, "node", "left")
        .withColumn("component_id", F.coalesce("component", "node", "doc_id"))
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def _beyond_cells(large: DataFrame, found: DataFrame) -> DataFrame:
    """Cells of what is outside the main component of a key against all other documents of that key."""
    placed = large.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("comp", F.coalesce("component", "doc_id"))
    counts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_s"))
    most = F.max_by(F.struct("comp", "_s"), F.struct("_c", "comp"))
    main = counts.groupBy("key").agg(most.alias("_first"), F.sum("_c").alias("_all"), F.max("_c").alias("_most"), F.sum("_s").alias("_sum"))
    outer = F.greatest(F.ceil((F.col("_all") - F.col("_most")) / CELL_DOCS), F.ceil((F.col("_sum") - F.col("_first._s")) / CELL_SHINGLES))
    main = main.where("_all > _most").select("key", F.col("_first.comp").alias("_main"), outer.alias("_outer"))
    placed = cut(placed.join(main, "key"))
    row, column = F.pmod(F.xxhash64("doc_id", "key"), F.col("_outer")), F.pmod(F.xxhash64("doc_id", "key"), F.col("_cells"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    left = placed.where("comp != _main").withColumn("_r", row).withColumn("_c", each(F.col("_cells")))
    right = placed.withColumn("_c", column).withColumn("_r", each(F.col("_outer")))
    rows = [
        side.select(F.xxhash64("key", "_r", "_c", F.lit("rest")).alias("cell"), "band", "doc_id", "f1", "n", "comp", F.lit(is_left).alias("left"), F.lit(not is_left).alias("right"))
        for side, is_left in ((left, True), (right, False))
    ]
    return rows[0].unionByName(rows[1])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's query: a similarity of 0.85."""
    return near_duplicates(docs, 85)
