"""Patterns on words run on the vocabulary instead of the tokens (PAT-3, PAT-6).

A corpus has far fewer distinct words than tokens. Tests on words are run on these once; the search then looks for the
words that passed, as a plain list of values, and in the storage partitions that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from wordloom.layout import BUCKET
from wordloom.operators.hits import longest_hit
from wordloom.operators.patterns import AllOf, AnyOf, Condition, Gap, Tok

#: Words a test may be replaced by, and storage partitions a search may name. Tests with more words stay as they are and
#: searches in more partitions read all: both give the same hits.
MOST_WORDS, MOST_BUCKETS = 10_000, 10_000
ATTRIBUTE = "word"

Patterns = list[list[Tok | Gap]]


def _leaves(condition) -> list[Condition]:
    if isinstance(condition, (AllOf, AnyOf)):
        return [leaf for part in condition.parts for leaf in _leaves(part)]
    return [condition] if condition is not None and condition.attr == ATTRIBUTE else []


def _changed(condition, change: Callable[[Condition], Condition]):
    if isinstance(condition, (AllOf, AnyOf)):
        return type(condition)(tuple(_changed(part, change) for part in condition.parts))
    return change(condition) if condition is not None and condition.attr == ATTRIBUTE else condition


def words_of(tests: list[Condition], words: DataFrame) -> dict[Condition, set[str]]:
    """The words that pass each test, for tests that at most ``MOST_WORDS`` pass.

    All tests run in one pass over the vocabulary; words come to the driver only for tests that are known to have few.
    """
    plain = [replace(t, negate=False) for t in tests]
    distinct = words.select(ATTRIBUTE).distinct().select(ATTRIBUTE, *(F.coalesce(t.column(), F.lit(False)).alias(f"_{k}") for k, t in enumerate(plain)))
    sizes = distinct.agg(*(F.count_if(f"_{k}").alias(f"_{k}") for k in range(len(plain)))).first()
    few = [k for k in range(len(plain)) if sizes[k] <= MOST_WORDS]
    if not few:
        return {}
    passed = distinct.where(reduce(or_, [F.col(f"_{k}") for k in few])).select(ATTRIBUTE, *(f"_{k}" for k in few)).collect()
    return {plain[k]: {row[0] for row in passed if row[f"_{k}"]} for k in few}


def resolved(patterns: Iterable[Iterable[Tok | Gap]], words: DataFrame) -> tuple[Patterns, list[int] | None]:
    """Patterns with their tests on words as lists of values, and the storage partitions hits can lie in (None: any).

    ``words`` is a vocabulary (``sources.tokens.vocabulary``). Partitions are known if every pattern has a token whose words
    are known and hits have a longest length; the partitions beside those of the words are read too where a pattern has
    several tokens.
    """
    patterns = [list(p) for p in patterns]
    tests = list(dict.fromkeys(leaf for p in patterns for item in p if isinstance(item, Tok) for leaf in _leaves(item.condition)))
    if not tests:
        return patterns, None
    known = words_of(tests, words)
    listed = lambda t: known.get(replace(t, negate=False))

    def as_list(test: Condition) -> Condition:
        found = listed(test)
        if found is None or test.kind == "one_of" and not test.fold:
            return test
        return Condition(ATTRIBUTE, "one_of", tuple(sorted(found)), negate=test.negate)

    changed = [[replace(i, condition=_changed(i.condition, as_list)) if isinstance(i, Tok) else i for i in p] for p in patterns]
    needed = []
    for pattern in patterns:
        lists = [listed(i.condition) for i in pattern if isinstance(i, Tok) and isinstance(i.condition, Condition) and i.condition.attr == ATTRIBUTE and not i.condition.negate]
        lists = [found for found in lists if found is not None]
        if not lists or BUCKET not in words.columns or longest_hit([pattern]) is None:
            return changed, None
        needed.append((min(lists, key=len), len(pattern) > 1))
    return changed, _buckets(needed, words)


def _buckets(needed: list[tuple[set[str], bool]], words: DataFrame) -> list[int] | None:
    """Partitions of any of the words, and those beside them where asked; None if there are too many to name."""
    out: set[int] = set()
    for found, beside in needed:
        rows = words.where(F.col(ATTRIBUTE).isin(*found)).select(BUCKET).distinct().limit(MOST_BUCKETS + 1).collect()
        own = {row[0] for row in rows}
        out |= own | ({b + d for b in own for d in (-1, 1)} if beside else set())
        if len(own) > MOST_BUCKETS or len(out) > MOST_BUCKETS:
            return None
    return sorted(out)
