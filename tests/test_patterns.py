"""Pattern search against a brute-force matcher on small random corpora."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import token_rows
from wordloom.operators import hits as hit_ops
from wordloom.operators.hits import find_hits, with_match
from wordloom.operators.patterns import (
    AllOf,
    Gap,
    Condition,
    Tok,
    anything,
    category,
    form_test,
    normalise,
    sections,
    set_test,
    simple,
    value_test,
    with_forms,
    word,
)


def fits(tok, row):
    _, _, first, last, tok_no, _, form = row
    if tok.initial and tok_no != first:
        return False
    if tok.final and not tok.initial and tok_no != last:
        return False
    return tok.condition is None or form.lower() == tok.condition.values[0].lower()


def brute_force(rows, pattern):
    """Shortest end for every start token, by trying everything."""
    at = {(r[0], r[4]): r for r in rows}
    found = set()

    def ends(text_id, position, last, items):
        if not items:
            yield position - 1
            return
        item, rest = items[0], items[1:]
        if isinstance(item, Gap):
            high = last - position + 1 if item.high is None else item.high
            for skip in range(item.low, high + 1):
                if position + skip - 1 <= last:
                    yield from ends(text_id, position + skip, last, rest)
        elif position <= last and fits(item, at[(text_id, position)]):
            yield from ends(text_id, position + 1, last, rest)

    for text_id, _, _, last, tok_no, _, _ in rows:
        reached = [e for e in ends(text_id, tok_no, last, list(pattern)) if e >= tok_no]
        if reached:
            found.add((text_id, tok_no, min(reached)))
    return found


def spark_hits(tokens, *patterns, **options):
    return {tuple(r) for r in find_hits(tokens, patterns, **options).select("text_id", "start", "end").collect()}


def random_corpus(seed):
    rng = random.Random(seed)
    return {
        t: [[rng.choice("abcAB") for _ in range(rng.randint(1, n))] for _ in range(rng.randint(1, 4))]
        for t, n in ((1, 4), (2, 9), (3, 40), (4, 1))
    }


PATTERNS = [
    [word("a")],
    [word("a"), word("b")],
    [word("a"), word("a"), word("a")],
    [word("a"), anything(), word("b")],
    [anything(), word("a"), anything(), anything()],
    [anything(), anything(), word("c")],
    [word("a"), Gap(0, 2), word("b")],
    [word("a"), Gap(1, 3), word("b"), Gap(0, 1), word("c")],
    [word("a"), Gap(2, 2), word("b")],
    [word("a"), Gap(0, 6), word("c"), word("b"), Gap(1, 2), word("a")],
    [word("c"), Gap(), word("b")],
    [word("a"), Gap(3), word("b"), Gap(0, 2), word("c")],
    [word("a"), Gap(0, 2), word("b"), Gap(2), word("c")],
    [word("a"), Gap(1), word("b"), Gap(0), word("a"), word("b")],
    [anything(), Gap(0, 2), word("c")],
    [anything(), Gap(1), word("c"), anything()],
    [Gap(1, 2), word("c")],
    [Gap(0, 2), word("c"), word("a")],
    [word("a"), Gap(1, 2)],
    [word("a"), Gap(0, 2), anything()],
    [Tok(form_test("a"), initial=True), Gap(0, 3), word("b")],
    [word("a"), Gap(0, 3), Tok(form_test("b"), final=True)],
    [Tok(initial=True), word("a")],
    [word("a"), Gap(0, 4), Tok(final=True)],
    [Tok(form_test("a"), initial=True, final=True)],
    [word("a"), Gap(1, 100_000), word("b"), Gap(0, 20_000), word("c")],
    [anything()],
    [anything(), Gap(1, 2), anything()],
]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bits,long", [(12, 1 << 14), (1, 1 << 14), (2, 1)])
def test_against_brute_force(make_tokens, monkeypatch, seed, bits, long):
    """With tiny blocks every region is cut many times; distances beyond ``long`` are looked up like open ones."""
    monkeypatch.setattr(hit_ops, "LONG_GAP", long)
    monkeypatch.setattr(hit_ops, "BLOCK_BITS", bits)
    monkeypatch.setattr(hit_ops, "OPEN_GAP_BITS", bits)
    texts = random_corpus(seed)
    rows, tokens = token_rows(texts), make_tokens(texts).cache()
    for pattern in PATTERNS if bits < 12 else PATTERNS[::3]:
        assert spark_hits(tokens, pattern) == brute_force(rows, pattern), pattern
    tokens.unpersist()


def test_alternatives_are_one_set(make_tokens):
    texts = random_corpus(5)
    rows, tokens = token_rows(texts), make_tokens(texts)
    patterns = [[word("a"), word("b")], [word("a"), Gap(0, 1), word("b")], [word("c")]]
    found = find_hits(tokens, patterns).select("text_id", "start", "end").collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == set().union(*(brute_force(rows, p) for p in patterns))


def test_carried_match_is_the_joined_match(make_tokens):
    tokens = make_tokens(random_corpus(8))
    pattern = [word("a"), word("b")]
    carried = find_hits(tokens, [pattern], match=("word",))
    joined = with_match(find_hits(tokens, [pattern]), tokens, ["word"])
    as_set = lambda df: {(r.text_id, r.start, tuple(map(tuple, r.match))) for r in df.collect()}
    assert as_set(carried) == as_set(joined)
    gapped = find_hits(tokens, [[word("a"), Gap(0, 1), word("b")]], match=("word",))
    assert all(len(r.match) == r.end - r.start + 1 for r in gapped.collect())


def test_result_does_not_depend_on_partitions(make_tokens):
    texts = random_corpus(3)
    pattern = [word("a"), Gap(0, 3), word("b"), Gap(1), word("c")]
    assert spark_hits(make_tokens(texts, 1), pattern) == spark_hits(make_tokens(texts, 7), pattern)


def test_one_hot_text_and_sentence(make_tokens):
    """A single sentence that spans many blocks, as text without sentence marks does."""
    words = ["a" if i % 5 == 0 else "b" if i % 7 == 3 else "x" for i in range(20000)]
    texts = {1: [words], 2: [["a", "b"]]}
    rows = {(1, i) for i in range(0, 20000, 5)}
    found = spark_hits(make_tokens(texts), [word("a"), Gap(0, 9), word("b")])
    ends = [i for i, w in enumerate(words) if w == "b"]
    expected = set()
    for _, p in rows:
        reach = [e for e in ends if p < e <= p + 10]
        if reach:
            expected.add((1, p, reach[0]))
    assert found == expected | {(2, 0, 1)}


def test_case_folding(make_tokens):
    tokens = make_tokens({1: [["École", "école", "ecole", "ÉCOLE"]]})
    assert len(spark_hits(tokens, [word("éCOLE")])) == 3
    assert len(spark_hits(tokens, [word("école", is_phonetic=True)])) == 1


def test_conditions(spark):
    rows = [
        (1, 0, 0, 4, 0, "Hund", "n", "sg", ["anim"]),
        (1, 0, 0, 4, 1, "bellen", "v", "pl", ["act", "loud"]),
        (1, 0, 0, 4, 2, "a.c", "x", None, []),
        (1, 0, 0, 4, 3, "abc", None, "sg", ["loud"]),
        (1, 0, 0, 4, 4, "50%_", "n", "pl", None),
    ]
    tokens = spark.createDataFrame(
        rows, "text_id long, s_id long, s_first long, s_last long, tok_no long, word string, pos_tag string, num string, feats array<string>"
    ).withColumn("lemma", F.lower("word"))
    at = lambda condition: {s for _, s, _ in spark_hits(tokens, [Tok(condition)])}
    assert at(form_test("a.c")) == {2}
    assert at(form_test("a", "start")) == {2, 3}
    assert at(form_test("N", "end")) == {1}
    assert at(form_test("ELL", "middle")) == {1}
    assert at(value_test("word", ["a.c"])) == {2, 3}
    assert at(value_test("pos_tag", ["n", "v"])) == {0, 1, 4}
    # an undefined value is not one of the excluded values
    assert at(value_test("pos_tag", ["n"], negate=True)) == {1, 2, 3}
    assert at(set_test("feats", ["loud"])) == {1, 3}
    assert at(set_test("feats", ["loud"], negate=True)) == {0, 2, 4}
    assert at(category("pos_tag", "n", [value_test("num", ["sg", "du"])])) == {0}
    assert at(sections([[category("pos_tag", "n"), category("pos_tag", "v")], [category("num", "pl")]])) == {1, 4}
    assert at(sections([[category("pos_tag", "n", negate=True), category("pos_tag", "v", negate=True)]])) == {2, 3}
    assert at(with_forms(form_test("h", "start"), [value_test("num", ["pl"]), value_test("num", ["sg"])])) == {0}
    assert at(AllOf((value_test("pos_tag", ["n"]), Condition("word", "wildcard", ("*%_",))))) == {4}
    assert {s for _, s, _ in spark_hits(tokens, simple("*E*"))} == {1}


def test_simple_box(make_tokens):
    tokens = make_tokens({1: [["The", "catalogue", "of", "the", "cats", "of"]]})
    assert spark_hits(tokens, simple(" the cat*  OF ")) == {(1, 0, 2), (1, 3, 5)}


def test_blank_patterns_find_every_token(make_tokens):
    tokens = make_tokens({1: [["a", "b", "c"], ["d"]], 2: [["e", "f"]]})
    found = lambda pattern: sorted((r.text_id, r.start, r.end) for r in find_hits(tokens, [pattern]).collect())
    every = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 0, 0), (2, 1, 1)]
    assert found(simple("  ")) == found([anything()]) == found([Gap(1, 2)]) == found([Gap(0)]) == every
    pairs = [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    assert found([anything(), anything()]) == found([anything(), Gap(0, 2), anything()]) == pairs
    assert found([anything(), Gap(1), anything()]) == [(1, 0, 2)]
    assert find_hits(tokens, [[word("a")], [anything()]]).count() == 6
    kept = find_hits(tokens, [[anything(), word("c")]], keep=("word",)).collect()
    assert [(r.start, r.end, r.word) for r in kept] == [(1, 2, "b")]


def test_empty_patterns_are_refused(make_tokens):
    tokens = make_tokens({1: [["a"]]})
    with pytest.raises(ValueError):
        find_hits(tokens, [[word("a")], []])
    with pytest.raises(ValueError):
        find_hits(tokens, [])
    with pytest.raises(ValueError):
        Gap(3, 1)


def test_normal_form():
    steps = normalise([anything(), word("a"), anything(), Gap(0, 2), word("b"), anything(), Gap(1, 4)])[0]
    assert (steps.lead, steps.trail, steps.gaps) == (1, 2, ((2, 4),))
    assert not steps.fixed and steps.min_length == 6
