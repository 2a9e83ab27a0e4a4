"""Alignment of a byte-level and a piece tokenizer by pointer jumping.

Both tokenizers cut the same bytes. Every token points to its farthest-right overlapping token; doubling all pointers at
once (succ = succ[succ]) ends when each token has the last token of its component, which labels its group. Groups end
where both tokenizers end a token, so each has one link: the last token of either side.

Texts are cut where a word ends before a blank, which no token of either vocabulary spans; each distinct word is encoded
and aligned once, all new words of a batch together. Corpus-wide counts of linked id pairs are taken over chunks of
documents: a chunk has a list of its distinct pairs, and only these lists are shuffled, not the links.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from wordloom.llm.common import mapped, quoted, rows_in, splits
from wordloom.session import checkpoint_folder

#: Characters of which both tokenizers make the same bytes whatever stands around; other texts are encoded whole.
PLAIN = re.compile(r"[\t\n\x20-\x7e\xa1-ſ‐-‧‰-⁞€]*+")
UNIT = re.compile(r"[ \t\n]*+[^ \t\n]++|[ \t\n]++")
#: Characters of words remembered per worker: half of them are forgotten at a time, those not met lately.
MEMORY = 4_000_000
#: Bytes of text of a chunk, and those aligned at once; a longer text is taken by itself.
CHUNK_BYTES, SLICE_BYTES = 6 << 20, 1 << 19


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last token of the component of every token, as numbers of B tokens, for A tokens and for B tokens.

    ``ends`` are the increasing end offsets of two tokenizations of the same bytes, none of them empty.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    starts_a, starts_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    to_b = np.searchsorted(starts_b, ends_a) - 1  # reaches as far as the A token itself at least
    to_a = np.searchsorted(starts_a, ends_b) - 1
    farther = ends_a[to_a] > ends_b
    succ = np.concatenate([n_a + to_b, np.where(farther, to_a, n_a + np.arange(n_b))])
    while True:
        ahead = succ[succ]
        if (ahead == succ).all():
            return succ[:n_a] - n_a, succ[n_a:] - n_a
        succ = ahead


#: Groups as ``a1,a2|b1;a3|b2,b3``, linked id pairs as packed int64 (A id above 32 bits), numbers of A and B tokens.
Aligned = tuple[str, bytes, int, int]
#: Words encoded by one call.
RUN = 16


def _packed(found: Aligned | None) -> tuple[str, bytes, int] | None:
    """What is remembered of a word: both numbers of tokens in one."""
    return found and (found[0], found[1], (found[2] << 32) + found[3])


def _table(n: int, ends: str) -> np.ndarray:
    """Decimal numbers below ``n`` with each of the ends."""
    out = np.empty((len(ends) + 1, n), object)
    for row, end in zip(out, ("", *ends)):
        row[:] = [f"{i}{end}" for i in range(n)]
    return out


class Aligner:
    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        of_piece = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        self.bytes_b = [of_piece(i, p) for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.shown_a, self.shown_b = _table(len(self.bytes_a), ",|"), _table(len(pieces), ",;")
        crossing = any(re.search(r"[^\s▁][▁ \t\n]", p) for p in pieces)
        self.mark = self.b.piece_to_id("▁x")
        self.by_words = not crossing and self.mark != self.b.unk_id()
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.held = 0

    def aligned(self, raw: bytes, ids_a: list[int], ids_b: list[int], ends: np.ndarray) -> list[Aligned] | None:
        """Alignment of every part of ``raw``, all at once; None if either side has other bytes or spans a part's end."""
        if not raw:
            return None
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join(map(known.__getitem__, ids)) != raw:
                return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        to_a, to_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        if (ends_a[to_a] != ends).any() or (ends_b[to_b] != ends).any():
            return None
        of_a, of_b = terminals(ends_a, ends_b)
        is_last_a, is_last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        last_a, last_b = np.flatnonzero(is_last_a), np.flatnonzero(is_last_b)
        links = ((a[last_a] << 32) | b[last_b]).tobytes()
        # groups side by side: first a group's A tokens, then its B tokens, each with the sign that follows it
        shown = np.empty(len(a) + len(b), object)
        group_a = np.cumsum(is_last_a) - is_last_a
        group_b = np.cumsum(is_last_b) - is_last_b
        sign_b = is_last_b + 1
        sign_b[to_b] = 0
        shown[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = self.shown_a[is_last_a + 1, a]
        shown[np.arange(len(b)) + (last_a + 1)[group_b]] = self.shown_b[sign_b, b]
        parts = shown.tolist()
        to_group = (8 * (group_b[to_b] + 1)).tolist()
        to_a, to_b = (to_a + 1).tolist(), (to_b + 1).tolist()
        out, g0, a0, b0 = [], 0, 0, 0
        for g1, a1, b1 in zip(to_group, to_a, to_b):
            out.append(("".join(parts[a0 + b0 : a1 + b1]), links[g0:g1], a1 - a0, b1 - b0))
            g0, a0, b0 = g1, a1, b1
        return out

    def learn(self, words: Iterable[str]) -> None:
        """After this ``young`` holds all ``words``."""
        wanted = set(words).difference(self.young)
        for word in wanted & self.old.keys():
            self.young[word] = self.old[word]
        new = list(wanted.difference(self.young))
        full, blank = [], []
        for word in new:
            (blank if word.isspace() else full).append(word)
        if full:
            # words follow one another here as they do in a text; a first one keeps the piece tokenizer from adding a blank
            runs = ["".join(full[i : i + RUN]) for i in range(0, len(full), RUN)]
            ids_a = [i for e in self.a.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids]
            ids_b = [i for ids in self.b.encode(["x" + r for r in runs], num_threads=1) for i in ids[1:]]
            sizes = pc.binary_length(pa.array(full, pa.string())).to_numpy()
            found = self.aligned("".join(runs).encode(), ids_a, ids_b, np.cumsum(sizes))
            self.young.update(zip(full, map(_packed, found or map(self._one, full))))
        self.young.update((w, _packed(self._one(w))) for w in blank)
        self.held += sum(map(len, wanted))

    def _one(self, word: str) -> Aligned | None:
        ids_a = self.a.encode(word, add_special_tokens=False).ids
        raw = word.encode()
        found = self.aligned(raw, ids_a, self.b.encode("x" + word, num_threads=1)[1:], np.array([len(raw)]))
        return found[0] if found else None

    def forget(self) -> None:
        if self.held > MEMORY // 2:
            self.old, self.young, self.held = self.young, {}, 0

    def texts(self, texts: pa.Array) -> Iterator[Aligned | None]:
        """Alignment of space + text for every text; None for null and empty ones and where the bytes differ."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for a, b in splits(len(texts), sizes, SLICE_BYTES):
            yield from self._slice(texts[a:b].to_pylist())

    def _slice(self, texts: list[str | None]) -> Iterator[Aligned | None]:
        words = [UNIT.findall(" " + t) if t and self.by_words and PLAIN.fullmatch(t) else None for t in texts]
        self.forget()
        self.learn(w for own in words if own for w in own)
        for text, own in zip(texts, words):
            yield self._joined(own) if own else self._whole(text) if text else None

    def _joined(self, words: list[str]) -> Aligned | None:
        found = list(map(self.young.__getitem__, words))
        if None in found:
            return None
        # both numbers of tokens are summed at once
        n_a, n_b = divmod(sum([f[2] for f in found]), 1 << 32)
        return ";".join([f[0] for f in found]), b"".join([f[1] for f in found]), n_a, n_b

    def _whole(self, text: str) -> Aligned | None:
        raw, ids_a = (" " + text).encode(), self.a.encode(" " + text, add_special_tokens=False).ids
        found = self.aligned(raw, ids_a, self.b.encode(text, num_threads=1), np.array([len(raw)]))
        return found[0] if found else None


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per Python worker and pair of files."""
    return Aligner(byte_path, piece_path)


def with_alignment(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """All rows with ``alignment`` (the groups as ``a1,a2|b1;a3|b2,b3``), ``n_a`` and ``n_b``.

    Texts that are null or empty, or that either tokenizer does not give back byte by byte, have an empty alignment and no
    tokens. Columns of these three names are replaced, all others kept; repeated rows are treated alike.
    """
    kept = docs.select(*quoted([c for c in docs.columns if c not in ("alignment", "n_a", "n_b")]))
    place = kept.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(byte_path, piece_path)
        for batch in rows_in(batches):
            found = list(made.texts(batch.column(place)))
            columns = (
                pa.array([f[0] if f else "" for f in found], pa.string()),
                pa.array([f[2] if f else 0 for f in found], pa.int64()),
                pa.array([f[3] if f else 0 for f in found], pa.int64()),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "alignment", "n_a", "n_b"])

    return mapped(kept, work, "alignment string, n_a bigint, n_b bigint")


# ---------------------------------------------------------------- corpus-wide counts

CHUNK = (
    "chunk string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, sha array<string>,"
    " upto array<bigint>, pair array<int>, times array<int>, a array<int>, b array<int>, n array<bigint>"
)


def _chunk_of(docs: list[tuple]) -> pa.RecordBatch:
    """One row for documents (id, n_a, n_b, digest, links): the distinct pairs of all, and per document pair numbers and counts."""
    ids, n_a, n_b, shas, links = zip(*docs)
    distinct, pair, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
    pair = pair.astype(np.int32)
    ends = np.cumsum([len(x) for x in links])
    own = [np.unique(pair[e - len(x) : e], return_counts=True) for x, e in zip(links, ends)]
    number = lambda values, kind: pa.array([np.asarray(values)], pa.list_(kind))
    columns = [
        pa.array([uuid.uuid4().hex]),
        pa.array([ids], pa.list_(pa.int64())),
        number(n_a, pa.int64()),
        number(n_b, pa.int64()),
        number([len(x) for x in links], pa.int64()),
        pa.array([shas], pa.list_(pa.string())),
        number(np.cumsum([len(p) for p, _ in own]), pa.int64()),
        number(np.concatenate([p for p, _ in own]), pa.int32()),
        number(np.concatenate([t for _, t in own]).astype(np.int32), pa.int32()),
        number((distinct >> 32).astype(np.int32), pa.int32()),
        number((distinct & 0xFFFFFFFF).astype(np.int32), pa.int32()),
        number(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CHUNK.split(", ")])


NO_TOKENS = (0, 0, "", np.zeros(0, np.int64))


def chunks_of(docs: DataFrame, byte_path: str, piece_path: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Aligned documents in chunks of neighbouring rows, as rows of ``CHUNK``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, docs_held, held = aligner(byte_path, piece_path), [], 0
        for batch in rows_in(batches):
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for doc_id, own, found in zip(batch.column(0).to_pylist(), sizes, made.texts(batch.column(1))):
                if docs_held and held + own > size:
                    yield _chunk_of(docs_held)
                    docs_held, held = [], 0
                told = NO_TOKENS
                if found:
                    groups, links, n_a, n_b = found
                    told = (n_a, n_b, hashlib.sha256(groups.encode()).hexdigest(), np.frombuffer(links, np.int64))
                docs_held.append((doc_id, *told))
                held += own
        if docs_held:
            yield _chunk_of(docs_held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, CHUNK)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a, b, count, best): links of every id pair in all chunks, and whether no other A id has more with this B id."""
    pairs = chunks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.a", "p.b", "p.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


DIGEST = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,"
    " groups_sha256 string"
)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows with the count and rank of their pairs to rows of DIGEST."""
    for batch in rows_in(batches):
        for i in range(batch.num_rows):
            get = lambda name: batch.column(batch.schema.get_field_index(name))[i].values
            upto, pair, times = (get(c).to_numpy() for c in ("upto", "pair", "times"))
            count, best = np.zeros(len(get("a")), np.int64), np.zeros(len(get("a")), np.int64)
            if len(count):
                told = get("told")
                at = told.field("k").to_numpy()
                count[at] = told.field("count").to_numpy()
                best[at] = told.field("best").to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], upto])
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x * times.astype(np.int64))])[bounds])
            groups = get("n_groups")
            columns = [
                get("doc_id"), get("n_a"), get("n_b"), groups, groups, pa.array(total(best[pair])), pa.array(total(count[pair])), get("sha")
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DIGEST.split(", ")])


def digest(docs: DataFrame, byte_path: str, piece_path: str, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    Chunks are written once to the shared folder, so texts are encoded a single time. A pair has one row per chunk at most
    in every shuffle. Documents without tokens have zeros and an empty digest; repeated rows are repeated; an empty table
    stays empty.
    """
    spark = docs.sparkSession
    store = f"{checkpoint_folder(spark)}/align-{uuid.uuid4().hex}"
    chunks_of(docs, byte_path, piece_path, size).write.parquet(store)
    chunks = spark.read.parquet(store)
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("k", "p")).select("chunk", "k", "p.a", "p.b")
    told = (
        pairs.join(pair_counts(chunks), ["a", "b"])
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("k", "count", "best")).alias("told"))
    )
    return chunks.join(told, "chunk", "left").mapInArrow(_told, DIGEST)
