"""Best-fit packing by sum of squares: a piece goes where the squared counts of open bins per residual gap stay smallest.

Token ids are made where the text is; only narrow rows (a piece's key and length) are shuffled. Pieces are packed in
groups of ``GROUP`` rows, longest first. Sequences that a group leaves unfilled are opened again and packed in fewer,
larger groups, as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import cut, rows_in
from wordloom.llm.tokens import tokenizer

SIZE = 4096
END_ID = 1
#: Rows packed by one call at first and at most, and the fill from which a sequence is left alone by the following levels.
GROUP, MOST_GROUP = 8192, 65536
FULL = 0.995
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint"


def cut_ids(ids: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Pieces of at most ``size`` ids; only the last may be shorter."""
    return [ids[at : at + size] for at in range(0, len(ids), size)]


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every length, in the order given, and the number of bins.

    N(g) counts open bins with gap g. Moving a bin from gap g to g - s changes the sum of N squared by
    2 (N(g - s) - N(g) + 1), filling it up by 1 - 2 N(g), a new bin by 2 N(size - s) + 1. The least change wins, an open
    bin before a new one, the smaller gap before the larger.
    """
    counts = np.zeros(size + 1, np.int64)
    bins_of: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        change = never
        if s < size:
            open_bins = counts[s:size]
            changes = np.where(open_bins > 0, 2 * (counts[: size - s] - open_bins + 1), never)
            if open_bins[0]:
                changes[0] = 1 - 2 * open_bins[0]
            gap = int(changes.argmin())
            change, gap = changes[gap], gap + s
        if change < never and change <= 2 * counts[size - s] + 1:
            at = bins_of[gap].pop()
            counts[gap] -= 1
        else:
            at, gap, made = made, size, made + 1
        bins[i], offsets[i] = at, size - gap
        if gap > s:
            counts[gap - s] += 1
            bins_of[gap - s].append(at)
    return bins, offsets, made


def pieces_of(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, and ``deal``, a random number.

    A null or empty text gives the end id alone. Repeated rows give repeated pieces. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = tokenizer(vocabulary), 0
        for batch in rows_in(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(made.ids(text or ""), np.uint32(END_ID))
                for n, own in enumerate(cut_ids(ids, size)):
                    doc.append(doc_id)
                    piece.append(n)
                    start.append(n * size)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
            # drawn once: what follows reads the written pieces
            deal = np.random.default_rng([seen, crc[0], len(crc)]).integers(0, 1 << 62, len(crc))
            seen += 1
            columns = (doc, pa.int64()), (piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, kind) for x, kind in columns), pa.array(deal)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, PIECES)


def _pack_level(rows: DataFrame, groups: int, level: int, size: int) -> DataFrame:
    """``rows`` with sequence_id, offset and the tokens in its sequence, packed in ``groups`` groups."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("deal", "ascending")])
        lengths = group["length"].to_numpy()
        bins, offsets, made = sum_of_squares(lengths, size)
        filled = np.bincount(bins, lengths, made).astype(np.int64)
        number = group["_group"][0].as_py()
        ids = (np.int64(level) << 58) + (np.int64(number) << 20) + bins
        table = group.drop_columns(["_group"])
        for name, values in (("sequence_id", ids), ("offset", offsets), ("filled", filled[bins])):
            table = table.append_column(name, pa.array(values))
        return table

    group = F.pmod(F.xxhash64("deal", F.lit(level)), F.lit(groups)).cast("long")
    return (
        rows.withColumn("_group", group)
        .groupBy("_group")
        .applyInArrow(work, f"{PIECES}, sequence_id bigint, offset bigint, filled bigint")
    )


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Every row of ``pieces`` (columns of ``pieces_of``) with the sequence it goes to and its place there.

    Groups grow fourfold a level, up to ``MOST_GROUP`` rows. It ends with one group, or when a level of such groups saves
    less than one sequence in 200 (pieces that just don't fit together). Narrow rows are written to the checkpoint folder
    once per level. An empty table stays empty.
    """
    left, done, level, open_before = cut(pieces), None, 0, None
    n = left.count()
    while True:
        groups = max(1, -(-n // group))
        packed = _pack_level(left, groups, level, size)
        if groups == 1:
            break
        packed = cut(packed)
        open_again = F.col("filled") < int(FULL * size)
        begins = F.col("offset") == 0
        made, made_open, n = packed.agg(F.count_if(begins), F.count_if(begins & open_again), F.count_if(open_again)).first()
        if group >= MOST_GROUP and open_before is not None and made > 0.995 * open_before:
            break
        kept = packed.where(~open_again)
        done = kept if done is None else done.unionByName(kept)
        left = packed.where(open_again).select(*(c.split()[0] for c in PIECES.split(", ")))
        open_before, level, group = made_open, level + 1, min(4 * group, max(group, MOST_GROUP))
    packed = packed if done is None else done.unionByName(packed)
    return packed.drop("deal", "filled")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: as few sequences of ``size`` tokens as the method finds."""
    return pack(pieces_of(docs, vocabulary, size), size, group)
