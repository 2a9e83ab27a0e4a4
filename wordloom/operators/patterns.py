"""Token patterns: tests on one token, sequences, gaps and alternatives (PAT-1..16)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

REGEX_CHARACTERS = re.compile(r"[.*+?^${}()|\[\]\\]")


#: Suffix of a stored lower-case copy of an attribute.
FOLDED = "_folded"


@dataclass(frozen=True)
class Condition:
    """One condition on a token attribute.

    ``kind`` is ``equals``, ``starts``, ``ends``, ``contains``, ``wildcard``, ``regex``, ``one_of`` or ``in_set``.
    A missing attribute fails every condition and so passes every negated one.
    """

    attr: str
    kind: str
    values: tuple[str, ...]
    fold: bool = False
    negate: bool = False

    def column(self, stored: frozenset[str] = frozenset()) -> Column:
        """``stored`` names the columns there are: a stored folded form is compared as it is, so it reaches the scan."""
        ready = self.fold and f"{self.attr}{FOLDED}" in stored
        value = F.col(f"{self.attr}{FOLDED}") if ready else F.lower(self.attr) if self.fold else F.col(self.attr)
        wanted = [F.lit(v.lower()) if ready else F.lower(F.lit(v)) if self.fold else F.lit(v) for v in self.values]
        if self.kind == "equals":
            test = value == wanted[0]
        elif self.kind == "starts":
            test = value.startswith(wanted[0])
        elif self.kind == "ends":
            test = value.endswith(wanted[0])
        elif self.kind == "contains":
            test = value.contains(wanted[0])
        elif self.kind == "wildcard":
            test = value.like(_like(self.values[0].lower() if self.fold else self.values[0]))
        elif self.kind == "regex":
            flags = "(?iu)" if self.fold else ""
            test = F.col(self.attr).rlike(rf"{flags}\A(?:{'|'.join(self.values)})\z")
        elif self.kind == "one_of":
            test = value.isin(*(v.lower() if self.fold else v for v in self.values))
        elif self.kind == "in_set":
            test = reduce(or_, [F.array_contains(self.attr, v) for v in self.values])
        else:
            raise ValueError(f"unknown test: {self.kind}")
        # a plain comparison reaches the Parquet scan; NULL only needs a value where it is negated
        return ~F.coalesce(test, F.lit(False)) if self.negate else test


def _like(wildcards: str) -> str:
    r"""``*`` to ``%``, with LIKE's own characters taken literally."""
    return re.sub(r"([\\%_])", r"\\\1", wildcards).replace("*", "%")


@dataclass(frozen=True)
class AllOf:
    parts: tuple

    def column(self, stored: frozenset[str] = frozenset()) -> Column:
        return reduce(and_, [p.column(stored) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class AnyOf:
    parts: tuple

    def column(self, stored: frozenset[str] = frozenset()) -> Column:
        return reduce(or_, [p.column(stored) for p in self.parts])


@dataclass(frozen=True)
class Tok:
    """One token of a pattern; without a condition it is any token."""

    condition: Condition | AllOf | AnyOf | None = None
    initial: bool = False
    final: bool = False

    @property
    def unrestricted(self) -> bool:
        return self.condition is None and not self.initial and not self.final

    def column(self, within: str, stored: frozenset[str] = frozenset()) -> Column:
        """The condition; PAT-14 looks at the token's place in its region (initial wins if both are asked)."""
        test = self.condition.column(stored) if self.condition is not None else F.lit(True)
        if self.initial:
            return test & (F.col("tok_no") == F.col(f"{within}_first"))
        if self.final:
            return test & (F.col("tok_no") == F.col(f"{within}_last"))
        return test


@dataclass(frozen=True)
class Gap:
    """``low`` to ``high`` unrestricted tokens; without ``high`` up to the end of the region."""

    low: int = 0
    high: int | None = None

    def __post_init__(self):
        if self.low < 0 or (self.high is not None and self.high < self.low):
            raise ValueError(f"gap bounds out of order: {self.low}, {self.high}")


def form_test(
    form: str,
    where: str = "whole",
    is_lemma: bool = False,
    is_phonetic: bool = False,
    is_original: bool = False,
) -> Condition:
    """PAT-1..4. A literal form, its place in the word, and the attribute it belongs to.

    Lemma goes before phonetic, phonetic before original, and word is the default; only phonetic forms keep case.
    """
    attr = "lemma" if is_lemma else "phon" if is_phonetic else "orig" if is_original else "word"
    kind = {"whole": "equals", "start": "starts", "end": "ends", "middle": "contains"}[where]
    return Condition(attr, kind, (form,), fold=attr != "phon")


def value_test(attr: str, values: Iterable[str], negate: bool = False) -> Condition:
    """PAT-6, PAT-7. Full-value regular expressions as alternatives; plain values become a value list."""
    values = tuple(sorted(set(values)))
    kind = "regex" if any(REGEX_CHARACTERS.search(v) for v in values) else "one_of"
    return Condition(attr, kind, values, negate=negate)


def set_test(attr: str, values: Iterable[str], negate: bool = False) -> Condition:
    """PAT-10. A multi-valued attribute contains, or does not contain, one of the values."""
    return Condition(attr, "in_set", tuple(values), negate=negate)


def with_forms(main: Condition | None, extra: Iterable[Condition]) -> AllOf:
    """PAT-7. Extra forms AND-ed with the main form; repeated forms of one attribute are merged into one list."""
    merged: dict[str, Condition] = {}
    for test in extra:
        known = merged.get(test.attr)
        values = (*known.values, *test.values) if known else test.values
        negate = known.negate if known else test.negate
        merged[test.attr] = value_test(test.attr, values, negate)
    return AllOf(((main,) if main else ()) + tuple(merged.values()))


def category(attr: str, value: str, subcategories: Iterable[Condition] = (), negate: bool = False) -> AllOf:
    """PAT-8. A main category together with its subcategories, each a list of alternative values."""
    return AllOf((value_test(attr, (value,), negate), *subcategories))


def sections(groups: Iterable[Iterable[AllOf]]) -> AllOf:
    """PAT-9. Categories of a section are alternatives, or all required if the section excludes; sections are AND-ed.

    A section excludes as a whole: categories that exclude and others in one section are refused.
    """
    combined = []
    for group in groups:
        group = tuple(group)
        if group:
            excluding = group[0].parts[0].negate
            if any(c.parts[0].negate != excluding for c in group):
                raise ValueError("a section either excludes all its categories or none")
            combined.append(AllOf(group) if excluding else AnyOf(group))
    return AllOf(tuple(combined))


def word(form: str, **options) -> Tok:
    return Tok(form_test(form, **options))


def anything() -> Tok:
    """PAT-11."""
    return Tok()


def simple(text: str) -> list[Tok]:
    """PAT-5. Words of the simple search box: ``*`` is any run of characters, case does not matter."""
    return [
        Tok(Condition("word", "wildcard" if "*" in w else "equals", (w,), fold=True)) if w else Tok()
        for w in re.split(r"\s+", text.strip())
    ]


@dataclass(frozen=True)
class Steps:
    """A pattern in normal form: restricted terms, the token distance to the next one, and free tokens at the edges."""

    terms: tuple[Tok, ...]
    gaps: tuple[tuple[int, int | None], ...]
    lead: int
    trail: int

    @property
    def fixed(self) -> bool:
        return all(low == high for low, high in self.gaps)

    @property
    def contiguous(self) -> bool:
        """Every token of a hit is restricted by a term of its own."""
        return not self.lead and not self.trail and all(gap == (1, 1) for gap in self.gaps)

    @property
    def min_length(self) -> int:
        return 1 + sum(low for low, _ in self.gaps) + self.lead + self.trail


def is_blank(items: Iterable[Tok | Gap]) -> bool:
    """Nothing but unrestricted tokens and gaps."""
    return not any(isinstance(i, Tok) and not i.unrestricted for i in items)


def normalise(items: Iterable[Tok | Gap]) -> list[Steps]:
    """PAT-12, PAT-13. Sequence to normal form; unrestricted tokens inside become part of the distances.

    A gap before the first term that may be empty gives two alternatives, one without the gap.
    """
    items = list(items)
    if not items:
        raise ValueError("a pattern needs at least one token")
    if is_blank(items):
        # PAT-11: any token starts a hit; of gaps the shortest end counts
        length = sum(i.low if isinstance(i, Gap) else 1 for i in items)
        return [Steps((Tok(),), (), 0, max(length - 1, 0))]
    if isinstance(items[0], Gap):
        gap, rest = items[0], items[1:]
        if gap.high == 0:
            return normalise(rest)
        opened = [Tok(), Gap(max(gap.low, 1) - 1, None if gap.high is None else gap.high - 1), *rest]
        return normalise(opened) + (normalise(rest) if gap.low == 0 else [])
    lead = 0
    while items[0].unrestricted and isinstance(items[1], Tok):
        lead, items = lead + 1, items[1:]
    trail = 0
    while isinstance(items[-1], Gap) or items[-1].unrestricted:
        # the shortest end is wanted, so a closing gap takes its smallest size
        trail += items[-1].low if isinstance(items[-1], Gap) else 1
        items = items[:-1]
    terms, gaps, low, high = [], [], 1, 1
    for item in items:
        if isinstance(item, Gap) or (item.unrestricted and terms):
            more = (item.low, item.high) if isinstance(item, Gap) else (1, 1)
            low, high = low + more[0], None if high is None or more[1] is None else high + more[1]
        else:
            if terms:
                gaps.append((low, high))
            terms.append(item)
            low = high = 1
    return [Steps(tuple(terms), tuple(gaps), lead, trail)]
