"""Benchmark passages in documents by greedy string tiling (Wise).

Words of documents and benchmark items that start equal runs of ``MIN_MATCH`` words are the seeds, found by a rolling hash
over word hashes (Karp-Rabin). Seeds on one diagonal grow into matches. The longest match whose words are still free is
marked in both texts, again and again, until none of ``MIN_MATCH`` words is left, so a passage is found also if its parts
stand in another order. An item counts as contained if the tiles cover at least ``COVERAGE`` of its words.

A benchmark of up to ``BLOCK_BYTES`` is sent to all tasks, and documents are read once and never shuffled. A larger one
stays a table: its grams are joined with those grams of the documents that pass a filter of fixed size, and the texts of
the pairs found that way meet in tasks, where the same tiling runs pair by pair.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wordloom.llm.common import cut, flat, folded, mapped, quoted, rows_in, splits, word_hashes
from wordloom.llm.skew import sieved

MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes of benchmark text sent to all tasks at once, and bytes of documents handled at once.
BLOCK_BYTES, SPAN = 4 << 20, 1 << 20
#: Words of 64 bits of the filter that a larger benchmark sends to the documents: 8 MB.
WORD_BITS = 20
U64 = np.uint64
_FILTER_BITS = 20

#: Words are runs of letters, digits and all other bytes above ASCII: punctuation and layout don't hide a passage.
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[65:91] = BREAKS[97:123] = False
BREAKS[128:] = False


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of the ``k`` words from each place on (Karp-Rabin on 64-bit word hashes)."""
    out = np.zeros(max(len(words) - k + 1, 0), U64)
    for i in range(k):
        out = out * U64(0x9E3779B97F4A7C15) + words[i : i + len(out)]
    return out


class Tile(NamedTuple):
    document_word: int
    item_word: int
    length: int


def tile(document: np.ndarray, item: np.ndarray, at_document: np.ndarray, at_item: np.ndarray, k: int = MIN_MATCH) -> list[Tile]:
    """Tiles from seeds (places of equal ``k``-grams), longest first; ties by place in the document, then in the item."""
    same = np.ones(len(at_document), bool)
    for i in range(k):
        same &= document[at_document + i] == item[at_item + i]
    at_document, at_item = at_document[same], at_item[same]
    if not len(at_document):
        return []
    diagonal = at_document - at_item
    order = np.lexsort((at_document, diagonal))
    d, i, g = at_document[order], at_item[order], diagonal[order]
    begin = np.flatnonzero(np.append(True, (np.diff(g) != 0) | (np.diff(d) != 1)))
    length = np.diff(np.append(begin, len(d))) + k - 1
    heap = [(-int(n), int(d[b]), int(i[b])) for b, n in zip(begin, length)]
    heapq.heapify(heap)
    # only the stretch of the document that has seeds is marked
    low = int(d.min())
    taken_document, taken_item = np.zeros(int(d.max()) + k - low, bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        taken = taken_document[x - low : x - low + n] | taken_item[y : y + n]
        if not taken.any():
            taken_document[x - low : x - low + n] = True
            taken_item[y : y + n] = True
            out.append(Tile(x, y, n))
            continue
        # what is still free of this match stays a candidate
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= k:
                heapq.heappush(heap, (-(b - a), x + a, y + a))
    return out


class Items:
    """Items of a block: word hashes and the seeds of all items, by gram."""

    def __init__(self, rows: list[tuple[int, str]], k: int) -> None:
        self.k, self.ids = k, [r[0] for r in rows]
        raw, bounds = flat(pa.array([r[1] for r in rows], pa.string()))
        words, edges = word_hashes(folded(raw), bounds, BREAKS)
        self.words = [words[a:b] for a, b in zip(edges[:-1], edges[1:])]
        made = [grams(w, k) for w in self.words]
        gram = np.concatenate(made) if made else np.zeros(0, U64)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.item = np.repeat(np.arange(len(made)), [len(g) for g in made])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in made])[order] if made else np.zeros(0, np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.gram >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def matches(self, raw: np.ndarray, bounds: np.ndarray, coverage: float) -> list[list[tuple[int, float, list[Tile]]]]:
        """For each text (item id, coverage, tiles) of the items it contains, in order of the items."""
        words, edges = word_hashes(folded(raw), bounds, BREAKS)
        out: list[list] = [[] for _ in range(len(bounds) - 1)]
        own = grams(words, self.k)
        if not len(own) or not len(self.gram):
            return out
        places = np.flatnonzero(self.maybe[(own >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        text = np.searchsorted(edges, places, "right") - 1
        inside = places + self.k <= edges[text + 1]
        places, text = places[inside], text[inside]
        first, last = (np.searchsorted(self.gram, own[places], side) for side in ("left", "right"))
        n = last - first
        pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        places, text, item, at_item = np.repeat(places, n), np.repeat(text, n), self.item[pick], self.place[pick]
        order = np.lexsort((item, text))
        places, text, item, at_item = places[order], text[order], item[order], at_item[order]
        begin = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(item) != 0))) if len(text) else []
        for a, b in zip(begin, [*begin[1:], len(text)]):
            t, i = int(text[a]), int(item[a])
            document = words[edges[t] : edges[t + 1]]
            tiles = tile(document, self.words[i], places[a:b] - edges[t], at_item[a:b], self.k)
            share = sum(x.length for x in tiles) / len(self.words[i])
            if share >= coverage:
                out[t].append((self.ids[i], share, tiles))
        return out


def item_blocks(items: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items with id and text in blocks of about ``most_bytes``: dealt by a hash, or one item that alone is larger."""
    usable = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most_bytes)
    for block in range(n):
        dealt = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield sorted((r.item_id, r.text) for r in dealt.toLocalIterator())


LEAK = "array<struct<item_id: bigint, coverage: double, tiles: array<struct<document_word: int, item_word: int, length: int>>>>"
LEAK_TYPE = pa.struct([
    ("item_id", pa.int64()), ("coverage", pa.float64()),
    ("tiles", pa.list_(pa.struct([("document_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))),
])
#: A name that no table has.
FOUND = "__found_leaks"
_items: dict[str, Items] = {}


def with_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, k: int = MIN_MATCH) -> DataFrame:
    """All rows with ``leaks``: the items a text contains, with the share of the item's words covered, and the tiles.

    Items of fewer than ``k`` words are too short to tell and are never found; null items, null and empty texts have no
    matches. Repeated items are found each, repeated rows alike. A column ``leaks`` is replaced, all others are kept.
    """
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAK))
    place, last = out.columns.index("text"), len(out.columns) - 1
    kind = pa.list_(LEAK_TYPE)

    def add(frame: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared, key = frame.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _items:
                _items.clear()
                _items[key] = Items(shared.value, k)
            for batch in rows_in(batches):
                raw, bounds = flat(batch.column(place))
                found = batch.column(last).to_pylist()
                for at, to in splits(batch.num_rows, np.diff(bounds), SPAN):
                    own = bounds[at : to + 1]
                    for i, leaks in enumerate(_items[key].matches(raw[own[0] : own[-1]], own - own[0], coverage)):
                        found[at + i] += [{"item_id": j, "coverage": c, "tiles": [t._asdict() for t in tiles]} for j, c, tiles in leaks]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, FOUND])

        return mapped(frame, work, f"{FOUND} {LEAK}").drop("leaks").withColumnRenamed(FOUND, "leaks")

    usable = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BLOCK_BYTES:
        return _with_joined_leaks(docs.drop("leaks"), usable, coverage, k)
    for block in item_blocks(items):
        out = add(out, block)
    return out


def _grams_of(frame: DataFrame, keys: list[str], k: int, passing: np.ndarray | None = None) -> DataFrame:
    """(keys, gram, places, n_words): distinct grams of every text; with a filter those alone that pass it.

    ``frame`` has two long columns before the text.
    """
    shared = frame.sparkSession.sparkContext.broadcast(passing)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = shared.value
        for batch in rows_in(batches):
            raw, bounds = flat(batch.column(2))
            for at, to in splits(batch.num_rows, np.diff(bounds), SPAN):
                words, edges = word_hashes(folded(raw[bounds[at] : bounds[to]]), bounds[at : to + 1] - bounds[at], BREAKS)
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    gram, places = np.unique(grams(words[a:b], k), return_counts=True)
                    if passing is not None:
                        held = (passing[(gram >> U64(64 - WORD_BITS)).astype(np.int64)] >> ((gram >> U64(58 - WORD_BITS)) & U64(63))) & U64(1)
                        gram, places = gram[held > 0], places[held > 0]
                    if len(gram):
                        own = [pa.array([batch.column(c)[at + i].as_py()] * len(gram), pa.int64()) for c in (0, 1)]
                        columns = [*own, pa.array(gram.view(np.int64)), pa.array(places), pa.array(np.full(len(gram), b - a))]
                        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "gram", "places", "n_words"])

    return frame.mapInArrow(work, f"{keys[0]} bigint, {keys[1]} bigint, gram bigint, places bigint, n_words bigint")


def _filter_of(item_grams: DataFrame) -> np.ndarray:
    """A bit for each value of the first bits of a gram, in 2 ** WORD_BITS words of 64: of one size whatever the benchmark holds."""
    word, bit = F.shiftrightunsigned("gram", 64 - WORD_BITS), F.shiftrightunsigned("gram", 58 - WORD_BITS).bitwiseAND(F.lit(63))
    marked = item_grams.select(word.alias("word"), bit.cast("int").alias("bit"))
    rows = marked.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << WORD_BITS, U64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(U64)
    return out


def _with_joined_leaks(docs: DataFrame, items: DataFrame, coverage: float, k: int) -> DataFrame:
    """``with_leaks`` for a benchmark of any size. Leaks depend on the text alone, so equal texts are looked at once.

    A tile of n >= k words has n - k + 1 seeds, a k-th of its words or more, so a text that contains an item shares the grams
    of at least a k-th of the item's words that have to be covered. Leaving out the item's most frequent grams as long as
    they stand at fewer places than that loses no item; texts that share one of the others are tiled.
    """
    text_key = {"t1": F.xxhash64("text"), "t2": F.octet_length("text").cast("long")}
    own_text = F.xxhash64("text").alias("i2")
    pieces = items.select(F.col("item_id").cast("long").alias("item_id"), own_text, "text")
    pieces = cut(pieces.groupBy("item_id", "i2", "text").agg(F.count(F.lit(1)).cast("int").alias("copies")))
    item_grams = cut(_grams_of(pieces.select("item_id", "i2", "text"), ["item_id", "i2"], k))
    texts = docs.where(F.col("text").isNotNull()).select(*(c.alias(n) for n, c in text_key.items()), "text")
    found = cut(_grams_of(texts, ["t1", "t2"], k, _filter_of(item_grams)).select("t1", "t2", "gram").distinct())
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    passed = F.sum("places").over(W.partitionBy("item_id", "i2").orderBy(F.desc("often"), "gram"))
    some = item_grams.join(often, "gram").withColumn("passed", passed).where(F.col("passed") * k >= F.col("n_words") * coverage)
    pairs = cut(found.join(some.select("item_id", "i2", "gram"), "gram").select("t1", "t2", "item_id", "i2").distinct())
    held = sieved(texts, pairs, ["t1", "t2"]).where("__maybe").groupBy("t1", "t2").agg(F.min("text").alias("text"))
    both = held.join(pairs, ["t1", "t2"]).join(pieces.withColumnRenamed("text", "item_text"), ["item_id", "i2"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            out = []
            for t1, t2, text, item_id, item_text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                (leaks,) = Items([(item_id, item_text)], k).matches(*flat(pa.array([text])), coverage)
                out += [(t1, t2, {"item_id": j, "coverage": c, "tiles": [t._asdict() for t in tiles]}) for j, c, tiles in leaks] * copies
            t1, t2, leak = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(leak, LEAK_TYPE)], names=["t1", "t2", "leak"]
            )

    tiled = both.select("t1", "t2", "text", "item_id", "item_text", "copies").mapInArrow(work, f"t1 bigint, t2 bigint, leak {LEAK[6:-1]}")
    leaks = cut(tiled.groupBy("t1", "t2").agg(F.array_sort(F.collect_list("leak")).alias(FOUND)))
    seen = sieved(docs.withColumns({f"__{n}": c for n, c in text_key.items()}), leaks.toDF("__t1", "__t2", FOUND), ["__t1", "__t2"])
    names, none = quoted(docs.columns), F.array().cast(LEAK)
    hit = seen.where("__maybe").join(leaks.toDF("__t1", "__t2", FOUND), ["__t1", "__t2"], "left")
    return hit.select(*names, F.coalesce(FOUND, none).alias("leaks")).unionByName(seen.where("not __maybe").select(*names, none.alias("leaks")))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles and longest tile of every item that a document contains."""
    found = with_leaks(docs.select("doc_id", "text"), items).select("doc_id", F.explode("leaks").alias("l"))
    longest = F.array_max(F.transform("l.tiles", lambda t: t["length"])).cast("bigint")
    tiles = F.size("l.tiles").cast("bigint")
    return found.select("doc_id", "l.item_id", "l.coverage", tiles.alias("n_tiles"), longest.alias("longest_tile"))
