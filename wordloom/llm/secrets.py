"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that tags further ones.

Tokens of a line are tagged as begin, inside or outside of a secret from their shape, the words beside them and traits of
the whole text; weights are learned on labelled lines (``training_secrets``) by maximum likelihood, and Viterbi finds the
best tags. Every token of every line is scored and decoded: the weights of a distinct token are added up once, those of a
token in its line are sums of array lookups, and lines are decoded side by side.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import mapped, quoted, rows_in
from wordloom.llm.training_secrets import training_lines

# The base kinds in the order that decides between spans with the same start, and their patterns.
KINDS = ("assign", "access", "hex")
ADDED = "tagged"
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e4
#: A dot or equals sign belongs to a token only inside or at the end of an encoded value.
TOKEN = re.compile(r"[\w+/~-]+(?:\.[\w+/~-]+)*(?:==?(?![\w+/~=-]))?|[^\s\w+/~-]")
#: Words that make the tokens after them more likely secrets.
TELLING = ("passw", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "passphrase", "private", "://")
_TELLING = re.compile("|".join(map(re.escape, TELLING)), re.IGNORECASE)
_TELLING_AT = re.compile(f"(?=({_TELLING.pattern}))", re.IGNORECASE)
#: Letters that equal one of a to z without regard to case, but not by their small letter.
_ODD_CASE = re.compile("[\u0130\u0131\u017f]")
#: Tokens scored at once (more where a line has more), distinct tokens whose rows are remembered, and length of those.
TOKENS_AT_ONCE, REMEMBERED, REMEMBERED_LENGTH = 200_000, 1 << 19, 64
#: Kinds of tokens with the same weights whose rows are remembered.
ALIKE = 1 << 14
#: Fewer lines than this are decoded one by one.
SIDE_BY_SIDE = 24


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Model(NamedTuple):
    """Weights of begin and inside per feature (outside has 0), of steps between tags and of the first tag."""

    weights: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float, float], ...]
    begin: tuple[float, float, float]


# ---------------------------------------------------------------- features


def file_traits(text: str) -> str:
    """How much of the text is made of the signs of code and settings: 0, 1 or 2."""
    signs = sum(map(text.count, "={};:<>"))
    return str(min(2, int(40 * signs / max(1, len(text)))))


_CLASS = str.maketrans(
    {c: "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0" for c in "0123456789"}
)


@lru_cache(maxsize=None)
def _terms(n: int) -> list[float]:
    """Parts of the entropy of ``n`` characters, at most 256, by how often one occurs."""
    return [0.0, *(c / n * math.log2(c / n) for c in range(1, n + 1))]


def _spread(head: str) -> int:
    """Twice the entropy of the characters."""
    terms = _terms(len(head))
    return int(2 * -sum([terms[head.count(c)] for c in dict.fromkeys(head)]))


_RUN = re.compile(r"(.)\1+")


@lru_cache(maxsize=20_000)
def _own(token: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return ("sign", f"sign={token}")
    head = token[:256]
    shape = _RUN.sub(r"\1", head.translate(_CLASS))
    size = min(7, int(math.log2(n + 1) * 1.4))
    if head.isdigit():
        kind = "digits"
    elif head.isalpha():
        kind = "lower" if head.islower() else "upper" if head.isupper() else "title" if head[1:].islower() else "mixed"
    elif all(c in "0123456789abcdefABCDEF" for c in head):
        kind = "hex"
    else:
        kind = "alnum" if head.isalnum() else "other"
    found = [f"size={size}", f"kind={kind}", f"kind={kind}&size={size}", f"shape={shape if len(shape) <= 5 else 'long'}"]
    if n >= 8:
        found += [f"spread={_spread(head)}", f"turns={min(9, 10 * len(shape) // len(head))}&kind={kind}"]
        found += [f"dots={min(3, head.count('.'))}", f"slashes={min(3, head.count('/'))}"]
        if kind not in ("lower", "title", "digits"):
            found += [f"first={head[:3]}", f"first={head[:4]}"]
    return tuple(found)


@lru_cache(maxsize=None)
def _own_of_word(shape: str) -> tuple[str, ...]:
    """The same of a word of less than eight ASCII letters, which are told apart by case alone."""
    return _own(shape)


def features(tokens: list[str], i: int, file: str) -> list[str]:
    """All features of token ``i`` of a stretch in a text with the traits ``file``."""
    own = _own(tokens[i])
    found = ["bias", *own, f"file={file}&{own[1]}"]
    for step in (1, 2, 3):
        if i - step >= 0:
            before = tokens[i - step]
            # file names of long values are of no use as neighbours
            found.append(f"{-step}={before.lower() if len(before) < 24 else 'long'}")
        else:
            found.append(f"{-step}=^")
    near = "".join(tokens[max(0, i - 4) : i])
    if _TELLING.search(near):
        found += ["near", f"near&{own[1]}", f"near&{own[0]}"]
    after = tokens[i + 1] if i + 1 < len(tokens) else "$"
    found.append(f"+1={after if len(after) == 1 else _own(after)[1]}")
    found.append(f"-1{_own(tokens[i - 1])[1]}" if i else "-1^")
    return found


# ---------------------------------------------------------------- the field


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis, keepdims=True)
    return (high + np.log(np.exp(x - high).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(scores: np.ndarray, steps: np.ndarray, begin: np.ndarray, tags: np.ndarray, mask: np.ndarray):
    """Log-likelihood of the tags of all lines, and its gradients for scores, steps and begin.

    ``scores`` are lines x places x tags; ``mask`` says which places a line has, from its first on.
    """
    n, length, k = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + begin
    for t in range(1, length):
        new = _logsum(forward[:, t - 1, :, None] + steps, 1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        new = _logsum(steps + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
    total = _logsum(forward[:, -1], 1)
    chosen = np.eye(k)[tags] * mask[..., None]
    p = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
    step_p = np.zeros((k, k))
    step_n = np.zeros((k, k))
    for t in range(1, length):
        both = forward[:, t - 1, :, None] + steps + (scores[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
        step_p += (np.exp(both) * mask[:, t, None, None]).sum(0)
        np.add.at(step_n, (tags[:, t - 1][mask[:, t]], tags[:, t][mask[:, t]]), 1)
    value = (scores * chosen).sum() + (steps * step_n).sum() + (begin * chosen[:, 0]).sum() - total.sum()
    return value, chosen - p, step_n - step_p, (chosen - p)[:, 0].sum(0)


def fit(lines: list[tuple[list[list[str]], list[int]]], rounds: int = 100, rate: float = 0.2, decay: float = 1e-3) -> Model:
    """Weights from (features per token, tag per token) of every line, by Adam on all lines at once.

    Features of one or two lines are chance and left out. An inside tag never follows an outside one or begins a line.
    """
    lines = [x for x in lines if x[0]]
    common = Counter(f for found, _ in lines for f in set().union(*found))
    number = {f: i for i, f in enumerate(sorted(f for f, c in common.items() if c > 2))}
    n, length = len(lines), max(len(tags) for _, tags in lines)
    tags, mask = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    feature, place = [], []
    for i, (found, own) in enumerate(lines):
        tags[i, : len(own)], mask[i, : len(own)] = own, True
        for t, names in enumerate(found):
            at = [number[f] for f in names if f in number]
            feature += at
            place += [i * length + t] * len(at)
    feature, place = np.array(feature), np.array(place)
    forbidden = np.zeros((3, 3))
    forbidden[OUTSIDE, INSIDE] = NEVER
    no_begin = np.array([0.0, 0.0, NEVER])
    sizes = [(len(number), 2), (3, 3), (3,)]
    values = [np.zeros(s) for s in sizes]
    mean, square = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    for step in range(1, rounds + 1):
        weights, steps, begin = values
        scores = np.zeros((n * length, 3))
        for k in (0, 1):
            scores[:, k + 1] = np.bincount(place, weights[feature, k], n * length)
        _, of_scores, of_steps, of_begin = likelihood(scores.reshape(n, length, 3), steps + forbidden, begin + no_begin, tags, mask)
        flat = of_scores.reshape(-1, 3)
        of_weights = np.stack([np.bincount(feature, flat[place, k + 1], len(number)) for k in (0, 1)], 1)
        for j, gradient in enumerate((of_weights, of_steps, of_begin)):
            gradient = gradient / n - decay * values[j]
            mean[j] = 0.9 * mean[j] + 0.1 * gradient
            square[j] = 0.999 * square[j] + 0.001 * gradient**2
            values[j] = values[j] + rate * (mean[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.999**step)) + 1e-8)
    weights, steps, begin = values[0], values[1] + forbidden, values[2] + no_begin
    return Model({f: tuple(weights[i].tolist()) for f, i in number.items()}, tuple(map(tuple, steps.tolist())), tuple(begin.tolist()))


def viterbi(model: Model, scores: list[tuple[float, float]]) -> list[int]:
    """Best tags of a stretch from the scores of begin and inside of its tokens."""
    if not scores:
        return []
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = model.steps
    o, (b, i) = model.begin[0], scores[0]
    b, i = b + model.begin[1], i + model.begin[2]
    back = []
    for to_b, to_i in scores[1:]:
        a0, a1, a2 = o + oo, b + bo, i + io
        b0, b1, b2 = o + ob, b + bb, i + ib
        c0, c1, c2 = o + oi, b + bi, i + ii
        from_o = 0 if a0 >= a1 and a0 >= a2 else 1 if a1 >= a2 else 2
        from_b = 0 if b0 >= b1 and b0 >= b2 else 1 if b1 >= b2 else 2
        from_i = 0 if c0 >= c1 and c0 >= c2 else 1 if c1 >= c2 else 2
        back.append((from_o, from_b, from_i))
        o, b, i = (a0, a1, a2)[from_o], (b0, b1, b2)[from_b] + to_b, (c0, c1, c2)[from_i] + to_i
    tag = 0 if o >= b and o >= i else 1 if b >= i else 2
    tags = [tag]
    for choice in reversed(back):
        tag = choice[tag]
        tags.append(tag)
    return tags[::-1]


def labelled(line: str, spans: list[tuple[int, int]], file: str) -> tuple[list[list[str]], list[int]]:
    """Features and tags of the tokens of a line whose secrets are known."""
    places = [(m.start(), m.end()) for m in TOKEN.finditer(line)]
    tokens = [line[a:b] for a, b in places]
    tags = []
    for a, b in places:
        inside = next((s for s in spans if a < s[1] and b > s[0]), None)
        tags.append(OUTSIDE if inside is None else BEGIN if a <= inside[0] else INSIDE)
    return [features(tokens, i, file) for i in range(len(tokens))], tags


@lru_cache(maxsize=1)
def trained(n: int = 2400, seed: int = 7) -> Model:
    """The model learned from ``n`` training lines; code has the traits of a text with many signs, prose of one with few."""
    traits = {"code": ("1", "2"), "prose": ("0", "0")}
    return fit([labelled(line, spans, traits[file][i % 2]) for i, (line, spans, file) in enumerate(training_lines(n, seed))])


# ---------------------------------------------------------------- texts


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind: leftmost matches of each kind that do not overlap, failing ones left out."""
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [Span("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Span("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that are decoded, each by itself: all of its lines."""
    out, at = [], 0
    while (end := text.find("\n", at)) >= 0:
        if end > at:
            out.append((at, end))
        at = end + 1
    if at < len(text):
        out.append((at, len(text)))
    return out


class Scorer:
    """Scores of tokens by sums of lookups; the weights of a kind of tokens in each place are added up once.

    Tokens with the same features of their own that are no neighbours of note share a row, so the table stays small however
    many words there are. Row 0 stands for what is beyond the ends of a line. Rows are forgotten when there are too many.
    """

    #: Columns: the token itself in a text of each trait, behind a telling word, and one, two, three before and one after.
    OWN, NEAR, BEFORE, AFTER, WIDTH = 0, 3, 3, 7, 8

    def __init__(self, model: Model):
        self.model = model
        #: Columns and weights of the neighbours that have any.
        self.beside: dict[str, list[tuple[int, tuple[float, float]]]] = {}
        for name, weight in model.weights.items():
            for step in (1, 2, 3):
                if name.startswith(f"{-step}="):
                    self.beside.setdefault(name[3:], []).append((self.BEFORE + step, weight))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.alike: dict[tuple[tuple[str, ...], str], int] = {}
        #: Features of long words of ASCII letters that are small but for the first; length, case and spread tell them.
        self.words: dict[tuple[int, bool, int], tuple[str, ...]] = {}
        self.rows = np.zeros((1024, self.WIDTH, 2))
        self.rows[0] = self._added([[], [], [], [], ["-1=^", "-1^"], ["-2=^"], ["-3=^"], ["+1=$"]])
        self.n = 1

    def _added(self, names: list[list[str]]) -> list[tuple[float, float]]:
        none, weights = (0.0, 0.0), self.model.weights
        found = [[weights.get(name, none) for name in place] for place in names]
        return [(sum(w[0] for w in place), sum(w[1] for w in place)) for place in found]

    def row(self, token: str) -> int:
        """Number of the row of a token that has none; ``features`` says what its weights are."""
        size = len(token)
        if size <= REMEMBERED_LENGTH and token.isascii() and token.isalpha() and (size < 8 or token[1:].islower()):
            if size < 8:
                own = _own_of_word(token.translate(_CLASS))
            else:
                told = (size, token.islower(), _spread(token))
                own = self.words.get(told) or self.words.setdefault(told, _own(token))
        else:
            own = _own(token)
        beside = token.lower() if size < 24 else "long"
        # a token by itself is told from all others
        kind = (own, token if size == 1 else beside if beside in self.beside else "")
        at = self.alike.get(kind)
        if at is None:
            at = self._add(token, own, self.beside.get(beside, ()))
            if len(self.alike) < ALIKE:
                self.alike[kind] = at
        if size <= REMEMBERED_LENGTH:
            self.number[token] = at
        return at

    def _add(self, token: str, own: tuple[str, ...], beside: Iterable[tuple[int, tuple[float, float]]]) -> int:
        names = [["bias", *own, f"file={file}&{own[1]}"] for file in "012"]
        names += [["near", f"near&{own[1]}", f"near&{own[0]}"], [f"-1{own[1]}"], [], [], [f"+1={own[1]}"]]
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = self._added(names)
        for column, weight in beside:
            self.rows[self.n, column] += weight
        if len(token) == 1:
            self.rows[self.n, self.AFTER] = self.model.weights.get(f"+1={token}", (0.0, 0.0))
        self.n += 1
        return self.n - 1

    def scores(self, lines: list[list[str]], files: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of begin and inside of the tokens of all lines, which are not empty, and the place of each line's first."""
        if self.n > REMEMBERED:
            self.forget()
        if len(self.number) > REMEMBERED:
            self.number.clear()
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        starts = 3 + np.cumsum(sizes + 3) - (sizes + 3)
        total = int((sizes + 3).sum()) + 3
        rows, own, near = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
        known = self.number
        for tokens, file, at in zip(lines, files, starts.tolist()):
            rows[at : at + len(tokens)] = [known.get(t) or self.row(t) for t in tokens]
            own[at : at + len(tokens)] = int(file)
            for first, last in _behind_telling(tokens):
                near[at + first : at + last + 1] = True
        table = self.rows
        scores = table[rows, self.OWN + own]
        for step in (1, 2, 3):
            scores[step:] += table[rows[:-step], self.BEFORE + step]
        scores[:-1] += table[rows[1:], self.AFTER]
        scores[near] += table[rows[near], self.NEAR]
        return scores, starts


def _behind_telling(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of tokens that have a telling word among the four before them."""
    joined = "".join(tokens)
    lower = joined.lower()
    if any(w in lower for w in TELLING) or not joined.isascii() and _ODD_CASE.search(joined):
        ends = np.cumsum([len(t) for t in tokens])
        for m in _TELLING_AT.finditer(joined):
            first, last = np.searchsorted(ends, (m.start(1), m.end(1) - 1), "right").tolist()
            if last < first + 4:
                yield last + 1, min(first + 4, len(tokens) - 1)


def best_tags(model: Model, scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best tags of all places by ``viterbi`` of each line, many lines at a time; places outside of lines have 0.

    A few lines that are longer than all others are decoded one by one. Both ways add and compare the same numbers.
    """
    tags = np.zeros(len(scores), np.int8)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alone = int(np.searchsorted(-sizes, -sizes[SIDE_BY_SIDE - 1])) if len(sizes) >= SIDE_BY_SIDE else len(sizes)
    for at, n in zip(starts[:alone].tolist(), sizes[:alone].tolist()):
        tags[at : at + n] = viterbi(model, list(map(tuple, scores[at : at + n].tolist())))
    starts, sizes = starts[alone:], sizes[alone:]
    if not len(sizes):
        return tags
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = model.steps
    own = scores[starts]
    o, b, i = np.full(len(starts), model.begin[0]), own[:, 0] + model.begin[1], own[:, 1] + model.begin[2]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # lines with a place t
    back = np.zeros((len(scores), 3), np.int8)
    best = lambda x, y, z: np.where((x >= y) & (x >= z), 0, np.where(y >= z, 1, 2))
    for t in range(1, int(sizes[0])):
        k = active[t]
        at = starts[:k] + t
        was_o, was_b, was_i, to = o[:k], b[:k], i[:k], scores[at]
        a, c, d = ((was_o + oo, was_b + bo, was_i + io), (was_o + ob, was_b + bb, was_i + ib), (was_o + oi, was_b + bi, was_i + ii))
        back[at, 0], back[at, 1], back[at, 2] = best(*a), best(*c), best(*d)
        o[:k], b[:k], i[:k] = (np.maximum(np.maximum(x, y), z) for x, y, z in (a, c, d))
        b[:k] += to[:, 0]
        i[:k] += to[:, 1]
    tag = best(o, b, i)
    for t in range(int(sizes[0]) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        tags[at] = tag[:k]
        tag[:k] = back[at, tag[:k]]
    return tags


def tagged_in(scorer: Scorer, texts: list[str]) -> list[list[Span]]:
    """Spans that the field tags as secrets in each text."""
    found: list[list[Span]] = [[] for _ in texts]
    lines: list[tuple[int, int, int]] = []
    tokens: list[list[str]] = []
    files: list[str] = []
    waiting = 0

    def decode() -> None:
        scores, starts = scorer.scores(tokens, files)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        tags = best_tags(scorer.model, scores, starts, sizes)
        some = np.add.reduceat(tags != OUTSIDE, starts) if len(starts) else []
        for k in np.flatnonzero(some).tolist():
            text, a, b = lines[k]
            for m, tag in zip(TOKEN.finditer(texts[text], a, b), tags[starts[k] : starts[k] + sizes[k]].tolist()):
                if tag == BEGIN:
                    found[text].append(Span(ADDED, m.start(), m.end()))
                elif tag == INSIDE:
                    found[text][-1] = Span(ADDED, found[text][-1].start, m.end())
        lines.clear(), tokens.clear(), files.clear()

    for k, text in enumerate(texts):
        file = file_traits(text)
        for a, b in stretches(text):
            own = TOKEN.findall(text, a, b)
            if own:
                lines.append((k, a, b))
                tokens.append(own)
                files.append(file)
                waiting += len(own)
            if waiting >= TOKENS_AT_ONCE:
                decode()
                waiting = 0
    if tokens:
        decode()
    return found


def tagged_spans(model: Model, text: str) -> list[Span]:
    """Spans that the field tags as secrets."""
    return tagged_in(Scorer(model), [text])[0]


def find_secrets(model: Model, text: str | None) -> list[Span]:
    """Base spans and the tagged spans that touch none of them, by start, then kind; null and empty texts have none."""
    return secrets_in(Scorer(model), [text])[0]


def secrets_in(scorer: Scorer, texts: list[str | None]) -> list[list[Span]]:
    """``find_secrets`` of each text."""
    plain = [text or "" for text in texts]
    return [with_tagged(base_spans(text), tagged) for text, tagged in zip(plain, tagged_in(scorer, plain))]


def with_tagged(base: list[Span], tagged: list[Span]) -> list[Span]:
    """Base spans and the tagged ones that touch none of them, both in order."""
    added, at, reach = [], 0, 0
    for span in tagged:
        while at < len(base) and base[at].start < span.end:
            reach, at = max(reach, base[at].end), at + 1
        if reach <= span.start:
            added.append(span)
    return sorted(base + added, key=lambda s: (s.start, (*KINDS, ADDED).index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at : span.start], f"<{span.kind}>"]
        at = max(at, span.end)
    return "".join(out) + text[at:]


def secrets(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """All rows with ``secrets``, an array of (kind, start, end, value), and ``redacted``.

    Offsets are code points, ends exclusive. Null texts have no spans and stay null in ``redacted``. Columns of these two
    names are replaced, all others kept; repeated rows are treated alike, an empty table stays empty.
    """
    kept = docs.select(*quoted([c for c in docs.columns if c not in ("secrets", "redacted")]))
    place = kept.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in rows_in(batches):
            texts = batch.column(place).to_pylist()
            found = secrets_in(scorer, texts)
            values = [[(s.kind, s.start, s.end, t[s.start : s.end]) for s in spans] for t, spans in zip(texts, found)]
            rows = [[dict(zip(("kind", "start", "end", "value"), v)) for v in own] for own in values]
            clean = [redact(t, spans) if spans else t for t, spans in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, kind), pa.array(clean, pa.string())], names=[*batch.schema.names, "secrets", "redacted"]
            )

    return mapped(kept, work, "secrets array<struct<kind: string, start: bigint, end: bigint, value: string>>, redacted string")


def digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans, from ``find_secrets``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in rows_in(batches):
            found = secrets_in(scorer, batch.column(1).to_pylist())
            own = [[s for s in spans if s.kind in KINDS] for spans in found]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in own], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(joined, found), pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    names = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id bigint, {names}, base_sha256 string, spans string")
