"""Word-wise encoding against the whole tokenizer."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from wordloom.llm import tokens

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return tokens.WordTokenizer(PATH)


def test_ids_are_those_of_the_whole_text(words):
    assert words.same
    rng = random.Random(1)
    parts = ["it's", "don't", " ", "\n", "x1", "É", "İ", "ß", "'ll", "...", "(a)", "½", "²3", "º", "ſt", "¡Hola!", "<|", "a-b", "12ab", "\t", "\r\n", "'S", "_", "__", "'re'", "ŉ", "\x01", "日", "\xa0"]
    chars = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x180)]]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choices(chars, k=rng.randint(1, 30))) for _ in range(4000)]
    texts += [t for t in ODD if t] + [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()]
    for text in texts:
        assert words.ids(text).tolist() == words.whole.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_words_are_forgotten_by_halves(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 30)
    few = tokens.WordTokenizer(PATH)
    for text in ["some words here", "other words there", "some words here", "and more of them"] * 3:
        assert few.ids(text).tolist() == few.whole.encode(text, add_special_tokens=False).ids
    assert len(few.young) + len(few.old) < 12


def test_a_vocabulary_that_does_not_fit_is_used_as_a_whole(words):
    other = tokens.WordTokenizer(PATH)
    other.same = False
    assert np.array_equal(other.ids("Some Words"), words.ids("Some Words")) and not other.young
