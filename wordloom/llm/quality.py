"""Quality classifier: attention-based multiple-instance learning (Ilse et al.).

A document is a bag of passages. Every passage is encoded, gated attention learned from document labels alone says how
much each passage counts, and the weighted passage representation is scored:

    h = tanh(E x),  a = softmax(w . (tanh(V h) * sigmoid(U h))),  score = sigmoid(c . sum(a h) + b)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import SPACES, flat, mapped, rows_in, splits, word_bounds, word_hashes

#: Words of a passage; units of the encoder and of the attention; bytes of text handled at once.
PASSAGE, UNITS, GATES, SPAN = 64, 24, 12, 1 << 19
#: Bound of labelled documents that a model is fitted on.
MOST_LABELLED = 5000
#: Bound of their text in bytes, each row with its overhead.
MOST_BYTES, ROW_BYTES = 64 << 20, 400
THRESHOLD = 0.3
#: Byte classes counted by themselves: printable ASCII one by one, then line ends, other control bytes, high bytes in three.
_CLASS = np.full(256, 96, np.int64)
_CLASS[32:127] = np.arange(95)
_CLASS[10] = 95
_CLASS[128:192], _CLASS[192:224], _CLASS[224:] = 97, 98, 99
_CLASSES = 100
N_FEATURES = _CLASSES + 8


class Model(NamedTuple):
    """Weights, and mean and spread of the features they were fitted on."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]


def passage_features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and each text's bounds in them; a text without words is one passage of zeros."""
    begins, ends = word_bounds(raw, bounds, SPACES)
    hashes, word_bounds_ = word_hashes(raw, bounds, fold=False)
    counts = np.diff(word_bounds_)
    passages = np.maximum(-(-counts // PASSAGE), 1)
    rows = np.concatenate([[0], np.cumsum(passages)])
    out = np.zeros((rows[-1], N_FEATURES), np.float32)
    if not len(begins):
        return out, rows
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(begins)) - word_bounds_[:-1][text]
    row = rows[text] + inside // PASSAGE
    words = np.bincount(row, minlength=len(out)).astype(np.float32)
    # bytes belong to the passage of the last word that began before them
    first = np.flatnonzero(np.diff(row, prepend=-1))
    edges = np.append(begins[first], len(raw))
    stops = np.minimum(edges[1:], bounds[1:][text[first]])
    sizes = stops - edges[:-1]
    where = np.repeat(row[first], sizes)
    at = np.arange(len(where)) + np.repeat(edges[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    histogram = np.bincount(where * _CLASSES + _CLASS[raw[at]], minlength=len(out) * _CLASSES).reshape(-1, _CLASSES)
    size = np.maximum(histogram.sum(axis=1, keepdims=True), 1)
    out[:, :_CLASSES] = np.sqrt(histogram / size)
    full = np.maximum(words, 1)
    same = np.zeros(len(begins), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    fresh = np.ones(len(begins), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    upper = histogram[:, 33:59].sum(axis=1)
    lower = histogram[:, 65:91].sum(axis=1)
    symbols = histogram[:, [c for c in range(1, 95) if not chr(c + 32).isalnum()]].sum(axis=1)
    extra = (
        np.bincount(row, same, len(out)) / full,
        np.bincount(row[order], fresh, len(out)) / full,
        np.bincount(row, ends - begins, len(out)) / full / 10,
        np.log1p(words) / 4,
        upper / np.maximum(upper + lower, 1),
        symbols / size[:, 0],
        np.bincount(row, ends - begins > 20, len(out)) / full,
        np.log1p(rows[1:] - rows[:-1])[np.repeat(np.arange(len(counts)), passages)] / 4,
    )
    for j, values in enumerate(extra):
        out[:, _CLASSES + j] = values
    return out, rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(weights: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    h = np.tanh(x @ weights["E"] + weights["e"])
    v, u = np.tanh(h @ weights["V"]), _sigmoid(h @ weights["U"])
    s = (v * u) @ weights["w"]
    share = np.exp(s - np.maximum.reduceat(s, rows[:-1])[owner])
    share /= np.add.reduceat(share, rows[:-1])[owner]
    z = np.add.reduceat(share[:, None] * h, rows[:-1])
    return {"owner": owner, "h": h, "v": v, "u": u, "share": share, "z": z, "score": _sigmoid(z @ weights["c"] + weights["b"])}


def _gradients(weights, x, rows, labels, decay) -> dict[str, np.ndarray]:
    f = _forward(weights, x, rows)
    owner, h, v, u, share = f["owner"], f["h"], f["v"], f["u"], f["share"]
    error = (f["score"] - labels) / len(labels)
    dz = error[:, None] * weights["c"]
    dh = share[:, None] * dz[owner]
    along = (h * dz[owner]).sum(axis=1)
    ds = share * (along - np.add.reduceat(share * along, rows[:-1])[owner])
    dv, du = (ds[:, None] * weights["w"] * o for o in (u, v))
    dv, du = dv * (1 - v * v), du * u * (1 - u)
    dh = (dh + dv @ weights["V"].T + du @ weights["U"].T) * (1 - h * h)
    out = {"c": f["z"].T @ error, "b": error.sum(), "w": (v * u).T @ ds, "V": h.T @ dv, "U": h.T @ du, "E": x.T @ dh, "e": dh.sum(axis=0)}
    return {k: g + decay * weights[k] for k, g in out.items()}


def fit(x: np.ndarray, rows: np.ndarray, labels: np.ndarray, steps: int = 200, rate: float = 0.02, decay: float = 3e-5) -> Model:
    """A model from the passages of labelled documents, by Adam over shuffled parts; the same data give the same model."""
    rng = np.random.default_rng(7)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 0.02
    x = np.clip((x - mean) / spread, -6, 6).astype(np.float32)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    prior = np.clip(labels.mean(), 0.02, 0.98)
    weights = {"E": draw(x.shape[1], UNITS), "e": np.zeros(UNITS, np.float32), "V": draw(UNITS, GATES), "U": draw(UNITS, GATES)}
    weights |= {"w": draw(GATES), "c": draw(UNITS) * 0.1, "b": np.float32(np.log(prior / (1 - prior)))}
    m, s = ({k: np.zeros_like(g) for k, g in weights.items()} for _ in range(2))
    n, part = len(labels), 512
    order, at = rng.permutation(n), 0
    for step in range(1, steps + 1):
        if at >= n:
            order, at = rng.permutation(n), 0
        own = order[at : at + part]
        at += part
        sizes = rows[own + 1] - rows[own]
        picked = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in own])
        gradients = _gradients(weights, x[picked], np.concatenate([[0], np.cumsum(sizes)]), labels[own], decay)
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in gradients.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            change = pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)
            weights[k] = (weights[k] - change).astype(np.float32)
    return Model(mean, spread, weights)


def scores(model: Model, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Score 0 to 1 of every text."""
    out = np.zeros(len(bounds) - 1)
    for at, to in splits(len(out), np.diff(bounds), SPAN):
        x, rows = passage_features(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        x = np.clip((x - model.mean) / model.spread, -6, 6)
        out[at:to] = _forward(model.weights, x, rows)["score"]
    return out


def training_bags(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage features, bounds and labels of at most about ``most`` labelled documents, drawn by a hash of the id.

    Of several labels of a document the highest counts; rows without id or label are left out. The drawn labels are
    bounded by ``most`` and so sent to the documents; features are made where the text is. Where the drawn documents, all
    rows of an id together, have more than ``MOST_BYTES`` of text, fewer of them are drawn, so that about as much comes to
    the driver; documents are never cut.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("bags")), F.lit(1 << 30)) < F.lit(min(1.0, most / max(n, 1)) * (1 << 30)))
    drawn = drawn.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    if size > MOST_BYTES:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fewer")), F.lit(1 << 30)) < F.lit(MOST_BYTES / size * (1 << 30)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            raw, bounds = flat(batch.column(2))
            x, own = passage_features(raw, bounds)
            packed = [x[own[i] : own[i + 1]].tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.float64()), pa.array(packed, pa.binary())], names=["doc_id", "quality", "x"])

    made = sorted((r.doc_id, r.quality, bytes(r.x)) for r in rows.mapInArrow(work, "doc_id bigint, quality double, x binary").toLocalIterator())
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for _, _, x in made]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
    return x, bounds, np.array([float(q > 0) for _, q, _ in made], np.float32)


_models: dict[str, Model] = {}


def score_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows with ``score`` and ``predicted`` (1 from a score of 0.3 on).

    Null and empty texts are one passage of zeros and get a score too. Without a model (no labels) every score is 0.5.
    Columns of these two names are replaced, all others kept.
    """
    kept = docs.drop("score", "predicted")
    place = kept.columns.index(text)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = shared.value
        for batch in rows_in(batches):
            if _models[key] is None:
                found = np.full(batch.num_rows, 0.5)
            else:
                found = scores(_models[key], *flat(batch.column(place)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return mapped(kept, work, "score double, predicted int")


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """The model learned from rows whose crc32(doc_id) modulo 5 is not 0; None if there are none."""
    x, rows, marks = training_bags(docs, labels.where(~_held_out()), most)
    return fit(x, rows, marks) if len(marks) else None


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fitted(docs, labels)
    rows = docs.select("doc_id", _held_out().alias("held_out"), "text")
    return score_documents(rows, model).drop("text")
