"""Tokenizer alignment against plain encodings of whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wordloom.llm import align

from .conftest import ODD

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    *ODD, "two  blanks", " leading", "trailing ", "a\n b\n\n  c\t\td", "<|endoftext|> <s> </s> <unk>", "▁mark", "naïve — “quoted” …", "日本語 text",
    "don't we'll it's", "x" * 5000, "tab\tand\rreturn\r\n", "a\xa0b\x85c", "é ​ zero", "123 4567 8.9", "ſtrange K", "'''s 's's", "€ 5 ‰",
]


@pytest.fixture(scope="module")
def plain():
    """(groups, links) of one text, from sets of end offsets."""
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    alphabet = align.byte_alphabet()

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def work(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = (" " + text).encode()
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [of_b(i) for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == raw:
            return None
        sides = []
        for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
            ends, at = {}, 0
            for i, p in zip(ids, parts):
                at += len(p)
                ends[at] = i
            sides.append(ends)
        cuts = sorted(set(sides[0]) & set(sides[1]))
        inside = lambda ends, lo, hi: ",".join(str(i) for e, i in ends.items() if lo < e <= hi)
        if len(cuts) < 3000:
            groups = ";".join(f"{inside(sides[0], lo, hi)}|{inside(sides[1], lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        else:
            groups = None
        return groups, [(sides[0][e], sides[1][e]) for e in cuts], len(ids_a), len(ids_b)

    return work


def test_texts_are_aligned_as_whole_ones(plain):
    made = align.Aligner(BYTE, PIECE)
    assert made.by_words
    rng = random.Random(3)
    parts = ["a", "the", "Ünö", " ", "  ", "\n", "\t", ".", "'s", "12", "é", "-", "—", "x1", "WORD", "(", "ß", "…", "'", "¡"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)]
    for text, found in zip(texts, made.texts(pa.array(texts))):
        want = plain(text)
        assert (found is None) == (want is None), repr(text[:80])
        if want:
            links = np.frombuffer(found[1], np.int64)
            assert [(c >> 32, c & 0xFFFFFFFF) for c in links.tolist()] == want[1] and found[2:] == want[2:]
            assert want[0] is None or found[0] == want[0]


def test_words_are_forgotten(monkeypatch, plain):
    monkeypatch.setattr(align, "MEMORY", 40)
    made = align.Aligner(BYTE, PIECE)
    for text in ["some words here", "other words there", "some words here", "and more of them", "some other"]:
        assert next(made.texts(pa.array([text])))[0] == plain(text)[0]
    assert len(made.young) + len(made.old) < 12


@pytest.mark.parametrize("seed", range(3))
def test_pointers_reach_the_last_token_of_a_component(seed):
    rng = np.random.default_rng(seed)
    n = 4000
    share = [0.3, 0.02, 0.9][seed]
    ends = [np.append(np.flatnonzero(rng.random(n - 1) < s) + 1, n) for s in (share, 0.4)]
    of_a, of_b = align.terminals(*ends)
    common = np.intersect1d(*ends)
    last = np.searchsorted(ends[1], common)
    for mine, found in zip(ends, (of_a, of_b)):
        assert (found == last[np.searchsorted(common, mine)]).all()
    # one side far coarser than the other, and no end in common but the last
    of_a, of_b = align.terminals(np.arange(2, 2002, 2), np.append(np.arange(1, 2000, 2), 2000))
    assert set(of_a) == set(of_b) == {1000}


@pytest.mark.parametrize("size", [align.CHUNK_BYTES, 200])
def test_digests_and_counts(lab, docs_of, plain, size):
    lab.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    texts = [*TEXTS, "the cat and the dog", "the cat", "The cat"] * 2
    found = {r.doc_id: r for r in align.digest(docs_of(texts), BYTE, PIECE, size).collect()}
    lab.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    wanted = [plain(t) for t in texts]
    counts = Counter(p for w in wanted if w for p in w[1])
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    assert len(found) == len(texts)
    for i, want in enumerate(wanted):
        r = found[i]
        if want is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        links = want[1]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (*want[2:], len(links), len(links))
        assert r.n_best == sum(counts[p] == best[p[1]] for p in links) and r.count_sum == sum(counts[p] for p in links)
        assert want[0] is None or r.groups_sha256 == hashlib.sha256(want[0].encode()).hexdigest()


def test_tables_without_rows_or_tokens(lab, docs_of):
    assert align.digest(docs_of(["a"]).limit(0), BYTE, PIECE).count() == 0
    rows = align.digest(docs_of([None, ""]), BYTE, PIECE).collect()
    assert sorted(tuple(r) for r in rows) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]


def test_general_rows_keep_their_columns(docs_of, plain):
    docs = docs_of(["one two", None], clashes=("alignment", "n_a", "h"))
    found = {r.doc_id: r for r in align.with_alignment(docs, BYTE, PIECE).collect()}
    assert found[0].alignment == plain("one two")[0] and found[0]["a.b"] == 1 and found[0].h == "x"
    assert (found[1].alignment, found[1].n_a, found[1].text) == ("", 0, None)
