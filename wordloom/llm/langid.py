"""Language identification by prediction by partial matching (PPM).

One byte context tree per language, of orders 0 to ``ORDER``, gives every byte of a text an exact code length: the symbol's
share in the longest known context, or an escape (method C) and the next shorter one. Statistics are frozen after
training, so a byte's code length depends only on the bytes before it. All languages share one tree of known contexts
whose nodes hold the code lengths of every language, and a whole batch of texts is scored by array lookups.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import flat, folded, mapped, rows_in

#: Bytes of context at most, and the bounds of training text: languages (those with most text), bytes of each, of all.
ORDER = 4
MOST_LANGUAGES, MOST_BYTES, MOST_TOTAL = 500, 1_000_000, 6_000_000
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes scored at once.
SPAN = 1 << 18


class Model(NamedTuple):
    """Frozen statistics of all languages.

    ``code`` maps bytes to the alphabet (0: never seen). ``nodes[k]`` maps (node of order k - 1, symbol) to a node of
    order k, as sorted keys; node 0 is "unknown". ``cost[k][node]`` is the code length in bits of the node's last symbol
    after its others, per language; ``escape[k][node]`` that of an escape after all of the node's symbols.
    """

    languages: list[str]
    code: np.ndarray
    nodes: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """A model from texts per language."""
    languages = sorted(samples)
    if not languages:
        return Model([], np.zeros(256, np.int64), [], [], [])
    texts = {l: folded(np.frombuffer("\n".join(samples[l]).encode(), np.uint8)) for l in languages}
    seen = np.zeros(256, bool)
    for raw in texts.values():
        seen[raw] = True
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 1
    symbols = {l: code[raw] for l, raw in texts.items()}
    n_lang = len(languages)
    # the tree of all n-grams of any language, and the node of each training place
    nodes: list[np.ndarray] = []
    places: list[dict[str, np.ndarray]] = []
    for k in range(order + 1):
        keys = {l: (_before(places[-1][l]).astype(np.int64) if k else 0) * width + s for l, s in symbols.items()}
        known = np.unique(np.concatenate([*map(np.unique, keys.values()), np.zeros(1, np.int64)]))
        known = known[known >= width] if k else known[known > 0]
        nodes.append(known)
        places.append({l: _lookup(known, x) for l, x in keys.items()})
    cost: list[np.ndarray] = []
    escape: list[np.ndarray] = []
    for k in range(order + 1):
        size = len(nodes[k]) + 1
        counts = np.zeros((n_lang, size))
        for j, l in enumerate(languages):
            counts[j] = np.bincount(places[k][l], minlength=size)
        counts[:, 0] = 0
        parent = np.concatenate([np.zeros(1, np.int64), nodes[k] // width])
        parents = len(nodes[k - 1]) + 1 if k else 1
        total = np.stack([np.bincount(parent, c, parents) for c in counts])
        kinds = np.stack([np.bincount(parent, c > 0, parents) for c in counts])
        # escape after a context the language never met costs nothing
        esc = np.where(total > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
        escape.append(esc.T.astype(np.float32))
        own = np.log2(np.maximum(total + kinds, 1))[:, parent] - np.log2(np.maximum(counts, 1))
        if k == 0:
            lower = np.full((n_lang, size), np.log2(256.0))
        else:
            suffix = _suffixes(nodes, k, width)
            lower = cost[k - 1][suffix].T
        table = np.where(counts > 0, own, esc[:, parent] + lower)
        if k == 0:
            table[:, 0] = esc[:, 0] + np.log2(256.0)
        cost.append(table.T.astype(np.float32))
    return Model(languages, code, nodes, cost, escape)


def _lookup(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1-based place of every key, 0 if it is not there."""
    if not len(known):
        return np.zeros(len(keys), np.int32)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, place + 1, 0).astype(np.int32)


def _suffixes(nodes: list[np.ndarray], k: int, width: int) -> np.ndarray:
    """For each node of order k, the node of order k - 1 without its first symbol."""
    last = np.concatenate([np.zeros(1, np.int64), nodes[k] % width])
    parent = np.concatenate([np.zeros(1, np.int64), nodes[k] // width])
    if k == 1:
        return _lookup(nodes[0], last)
    return _lookup(nodes[k - 1], _suffixes(nodes, k - 1, width)[parent].astype(np.int64) * width + last)


def _before(places: np.ndarray) -> np.ndarray:
    """The value one place earlier, 0 at the beginning."""
    return np.concatenate([np.zeros(1, places.dtype), places[:-1]])


class Scorer:
    """Dense lookup tables of a model, made once per worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.width = model, int(model.code.max()) + 1
        self.next = []
        for k, known in enumerate(model.nodes):
            table = np.zeros((len(model.nodes[k - 1]) + 1 if k else 1) * self.width, np.int32)
            table[known] = np.arange(1, len(known) + 1)
            self.next.append(table)

    def bits(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (bytes ``raw``, ``bounds``) under each language."""
        n_lang, order = len(self.model.languages), len(self.next) - 1
        out = np.zeros((len(bounds) - 1, n_lang))
        starts = np.zeros(len(raw) + 1, bool)
        starts[bounds] = True
        for begin in range(0, len(raw), SPAN):
            end, low = min(begin + SPAN, len(raw)), max(begin - order, 0)
            symbols = self.model.code[folded(raw[max(low - 1, 0) : end])][min(low, 1) :]
            costs = self._costs(symbols, starts[low:end])[begin - low :]
            sums = np.zeros((end - begin + 1, n_lang))
            np.cumsum(costs, axis=0, out=sums[1:])
            first = int(np.searchsorted(bounds, begin, "right")) - 1
            last = int(np.searchsorted(bounds, end, "left"))
            edges = np.clip(bounds[first : last + 1], begin, end) - begin
            out[first:last] += sums[edges[1:]] - sums[edges[:-1]]
        return out

    def _costs(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of every symbol per language: the longest known context's, plus escapes from longer ones."""
        places, contexts = [], []
        for k, table in enumerate(self.next):
            context = _before(places[-1]) if k else np.zeros(len(symbols), np.int32)
            context[starts] = 0
            contexts.append(context)
            places.append(table[context * np.int64(self.width) + symbols])
        cost = np.zeros((len(symbols), len(self.model.languages)), np.float32)
        rest = np.arange(len(symbols))
        for k in range(len(self.next) - 1, -1, -1):
            node = places[k][rest]
            known = node > 0 if k else np.ones(len(node), bool)
            cost[rest[known]] += self.model.cost[k][node[known]]
            rest = rest[~known]
            cost[rest] += self.model.escape[k][contexts[k][rest]]
        return cost


def training_sample(rows: DataFrame, most_bytes: int = MOST_BYTES) -> dict[str, list[str]]:
    """Texts per language: whole rows drawn by a hash of the text, about ``most_bytes`` a language, less if there are many.

    ``rows`` has text and lang. Bytes are summed over all rows, so each text of a language has the same chance; the one with
    the least hash is always drawn, so no language is without a text. Equal texts are drawn once, however many copies there
    are, and so what comes to the driver is bounded. Rows longer than a quarter of the bound are left to the others. The
    totals, one row for each of at most ``MOST_LANGUAGES`` languages, are sent to the texts; only drawn texts are shuffled.
    """
    size, place = F.octet_length("text"), F.xxhash64("text")
    usable = rows.where(F.col("lang").isNotNull() & (size > 0) & (size <= most_bytes // 4)).select("lang", "text")
    totals = usable.groupBy("lang").agg(F.sum(size).alias("_bytes"), F.min(place).alias("_least")).orderBy(F.desc("_bytes"), "lang").limit(MOST_LANGUAGES)
    each = float(min(most_bytes, MOST_TOTAL // max(totals.count(), 1)))
    drawn = (F.pmod(place, F.lit(1 << 30)) < F.lit(each) / F.col("_bytes") * (1 << 30)) | (place == F.col("_least"))
    samples: dict[str, list[str]] = {}
    for row in usable.join(F.broadcast(totals), "lang").where(drawn).select("lang", "text").distinct().toLocalIterator():
        samples.setdefault(row.lang, []).append(row.text)
    return {lang: sorted(texts) for lang, texts in samples.items()}


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows with ``lang_pred`` and ``score``, the posterior share of that language under equal priors.

    Null texts and texts without a letter get ``und`` and score 0, and so does everything if nothing was learned. Ties
    go to the language first in the alphabet. Only ``text`` is read for a prediction; columns of these two names are
    replaced, all others kept.
    """
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer, names = _scorers[key], np.array([*shared.value.languages, UNDETERMINED], dtype=object)
        for batch in rows_in(batches):
            column = batch.column(place)
            has_letter = np.array([bool(t and LETTER.search(t)) for t in column.to_pylist()])
            if len(names) == 1:
                best, share = np.zeros(len(column), np.int64), np.zeros(len(column))
            else:
                bits = scorer.bits(*flat(column))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
            best = np.where(has_letter, best, len(names) - 1)
            share = np.where(has_letter & (len(names) > 1), share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(share, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return mapped(kept, work, "lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from rows whose crc32(doc_id) modulo 4 is not 2."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = fit(training_sample(rows.where(~F.col("held_out"))))
    return identify(rows.select("doc_id", "held_out", "text"), model).drop("text")
