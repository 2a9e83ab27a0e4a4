"""Personal data: patterns propose spans, checksums confirm them, and words nearby adjust a score.

Every kind is found in time linear in the text: e-mail addresses are grown backwards from their ``@`` and dotted numbers
are cut from maximal runs, instead of trying a pattern at every character of a long run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import mapped, rows_in

# The kinds in the order that decides between spans with the same start, and what they look like.
KINDS = ("email", "ip", "card", "phone", "iban")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Words that speak for a kind or against personal data, within ``WINDOW`` characters of a span.
WINDOW = 48
FOR = {
    "email": ("mail", "contact", "kontakt", "contacto", "correo", "courriel", "write"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "example", "sample", "test", "isbn", "invoice", "order", "serial")
#: Score of a confirmed span without context, and what one word for or against it changes.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.95}
STEP = 0.15


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[Span]:
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            last = m.end()
            yield Span("email", start, last)


def _addresses(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in four)):
                yield Span("ip", at, end)
            at = end + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield Span("card", m.start(), m.end())


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield Span("phone", m.start(), m.end())


def _ibans(text: str) -> Iterator[Span]:
    """IBANs: the longest reading of a match that passes mod-97, shortened by whole groups after blanks."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end > m.start():
            account = text[m.start() : end].replace(" ", "")
            if len(account) < 15:
                break
            if len(account) <= 34 and mod97(account):
                yield Span("iban", m.start(), end)
                break
            end = text.rfind(" ", m.start(), end)


def find_spans(text: str | None) -> list[Span]:
    """All confirmed spans by start, then kind. Spans of different kinds may overlap; null and empty texts have none."""
    if not text:
        return []
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        found += _addresses(text)
        found += _cards(text)
        found += _ibans(text)
        if "+" in text:
            found += _phones(text)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def score(text: str, span: Span) -> float:
    """Confidence 0 to 1 of a confirmed span after looking at the words around it."""
    around = text[max(0, span.start - WINDOW) : span.start] + " " + text[span.end : span.end + WINDOW]
    words = set(re.findall(r"[^\W\d_]+", around.lower()))
    change = STEP * (bool(words & set(FOR[span.kind])) - bool(words & set(AGAINST)))
    return round(min(1.0, max(0.0, BASE_SCORE[span.kind] + change)), 2)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for span in spans:
        if span.start >= at:
            out += [text[at : span.start], f"<{span.kind}>"]
        at = max(at, span.end)
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``pii``, an array of (kind, start, end, value, score), and ``redacted``.

    Offsets are code points, ends exclusive. Null texts have no spans and stay null in ``redacted``. Columns of these two
    names are replaced, all others kept; repeated rows are treated alike.
    """
    kept = docs.drop("pii", "redacted")
    fields = "kind: string, start: bigint, end: bigint, value: string, score: double"
    place = kept.columns.index(text)
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            spans_of, clean = [], []
            for value in batch.column(place).to_pylist():
                spans = find_spans(value)
                spans_of.append(
                    [{"kind": s.kind, "start": s.start, "end": s.end, "value": value[s.start : s.end], "score": score(value, s)} for s in spans]
                )
                clean.append(redact(value, spans) if spans else value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(spans_of, kind), pa.array(clean, pa.string())],
                names=[*batch.schema.names, "pii", "redacted"],
            )

    return mapped(kept, work, f"pii array<struct<{fields}>>, redacted string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the four base kinds, digest of the base spans, all spans, and their scores in the same order.

    Spans come from ``find_spans``; ``scores`` has the confidence of each after looking at the words around it.
    """
    base = KINDS[:4]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            texts = batch.column(1).to_pylist()
            found = [find_spans(t) for t in texts]
            scores = [",".join(f"{score(t, s):.2f}" for s in spans) for t, spans in zip(texts, found)]
            own = [[s for s in spans if s.kind in base] for spans in found]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in own], pa.int64()) for k in base]
            digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(map(joined, found), pa.string()), pa.array(scores, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", "scores"],
            )

    names = ", ".join(f"n_{k} bigint" for k in base)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id bigint, {names}, base_sha256 string, spans string, scores string")
