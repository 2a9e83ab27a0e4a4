"""What the training-data operators share: tables, Arrow text buffers and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from wordloom.session import cut, tune

__all__ = ["cut", "flat", "folded", "mapped", "mixed", "prepared", "quoted", "rows_in", "shingle_hashes", "splits", "table", "word_hashes"]

#: Rows and bytes of one Arrow batch: a batch of long texts must fit a Python worker several times.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes hashed at once; longer spans only where one word is longer.
SPAN = 1 << 19
U64 = np.uint64


def prepared(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, besides the settings of the library."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def mapped(frame: DataFrame, work: Callable, added: str) -> DataFrame:
    """``frame.mapInArrow(work)`` with further columns (DDL); ``work`` sees the columns as c0, c1, ...

    Column names that hold dots would not be found by their names.
    """
    new = T.StructType.fromDDL(added).fields
    own = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(frame.schema.fields)]
    plain = frame.toDF(*(f.name for f in own))
    return plain.mapInArrow(work, T.StructType([*own, *new])).toDF(*frame.columns, *(f.name for f in new))


def quoted(names: list[str]) -> list[str]:
    """Column names that may hold dots, for use in ``select``."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows."""
    return (b for b in batches if b.num_rows)


def splits(n: int, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with at most ``most`` bytes together, or one row that alone is larger."""
    at, total = 0, 0
    for i in range(n):
        if i > at and total + sizes[i] > most:
            yield at, i
            at, total = i, 0
        total += sizes[i]
    if n > at:
        yield at, n


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and their n + 1 bounds; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def folded(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin letters, byte by byte."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    if len(raw) > 1:
        accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][accented] += 32
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every bit over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _keys(n: int, seed: int) -> np.ndarray:
    return mixed((np.arange(n, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


_BYTE = _keys(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_PLACE = _keys(64, 977) | U64(1)
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SPAN + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 4 * SPAN:
            return have  # one huge word: not kept
        _powers[base] = have
    return have[:n]


def word_bounds(raw: np.ndarray, bounds: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 byte of every word; ``breaks`` says for each byte value whether it stands between words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(
    raw: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACES, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and the bounds of each text in them. ``fold``: A-Z count as a-z."""
    begins, ends = word_bounds(raw, bounds, breaks)
    hashes = np.empty(len(begins), U64)
    values = _FOLDED if fold else _BYTE
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + SPAN, "right")))
        base, end = begins[at], ends[to - 1]
        sums = np.zeros(end - base + 1, U64)
        np.cumsum(values[raw[base:end]] * _power(_BASE, int(end - base)), out=sums[1:])
        first = begins[at:to] - base
        hashes[at:to] = (sums[ends[at:to] - base] - sums[first]) * _power(_INVERSE, int(end - base))[first]
        at = to
    return mixed(hashes), np.searchsorted(begins, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles and each text's bounds in them; a text of fewer words is one shingle."""
    counts = np.diff(bounds)
    n = len(words)
    made = np.zeros(max(n - k + 1, 0), U64)
    for i in range(k):
        made += words[i : n - k + 1 + i] * _PLACE[i] if len(made) else U64(0)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(counts)), sizes)
    start = bounds[:-1][owner] + np.arange(len(owner)) - out_bounds[:-1][owner]
    out = np.zeros(len(owner), U64)
    whole = counts[owner] >= k
    out[whole] = made[start[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = np.append(own * _PLACE[: len(own)], _PLACE[60 - len(own)]).sum(dtype=U64)
    return mixed(out), out_bounds
