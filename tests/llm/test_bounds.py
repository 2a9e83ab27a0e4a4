"""What comes to the driver stays bounded, odd pages take linear time, repeated ids have one meaning."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, langid, neighbours, pages, quality
from wordloom.llm.training_pages import training_pages

from .conftest import ODD


def test_copies_of_a_text_are_learned_once(lab):
    """One text on most rows, and a language with a single row."""
    rows = [("en", "the same text again " * 20)] * 3000 + [("en", f"other words number {i} " * 5) for i in range(500)] + [("de", "ein Satz " * 30)]
    frame = lab.createDataFrame(rows, "lang string, text string").repartition(4)
    found = langid.training_sample(frame, 40_000)
    assert len(found["en"]) == len(set(found["en"])) and sum(map(len, found["en"])) < 80_000
    assert found["de"] == [rows[-1][1]]
    everything = langid.training_sample(frame, 1 << 22)
    assert set(everything["en"]) == {t for lang, t in rows if lang == "en"}


def test_labelled_texts_are_bounded_by_bytes(lab, monkeypatch):
    docs = lab.createDataFrame([(i % 200, "some words here " * 50) for i in range(2000)], "doc_id long, text string").repartition(4)
    labels = lab.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    whole, _, marks = quality.training_bags(docs, labels)
    assert len(marks) == 2000
    monkeypatch.setattr(quality, "MOST_BYTES", 200_000)
    part, bounds, marks = quality.training_bags(docs, labels)
    # documents are drawn whole: all ten rows of an id or none
    assert 0 < len(part) < len(whole) / 3 and len(marks) % 10 == 0 and bounds[-1] == len(part)


def test_forward_pass_is_the_formula():
    """Score of a text: codes of its passages, weighted by gated attention, through the last layer; in plain loops."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7, quality.N_FEATURES))
    rows = np.array([0, 3, 4, 7])
    w = {k: np.asarray(v, float) for k, v in quality.fit(x.astype(np.float32), rows, np.array([1, 0, 1], np.float32), steps=3).weights.items()}
    sigmoid = lambda t: 1 / (1 + math.exp(-t))
    wanted = []
    for d in range(3):
        codes = [[math.tanh(sum(x[i, f] * w["E"][f, j] for f in range(x.shape[1])) + w["e"][j]) for j in range(quality.UNITS)] for i in range(rows[d], rows[d + 1])]
        raw = []
        for h in codes:
            gate = [
                math.tanh(sum(h[j] * w["V"][j, g] for j in range(quality.UNITS))) * sigmoid(sum(h[j] * w["U"][j, g] for j in range(quality.UNITS)))
                for g in range(quality.GATES)
            ]
            raw.append(math.exp(sum(a * b for a, b in zip(gate, w["w"].ravel()))))
        z = [sum(r / sum(raw) * h[j] for r, h in zip(raw, codes)) for j in range(quality.UNITS)]
        wanted.append(sigmoid(sum(a * b for a, b in zip(z, w["c"].ravel())) + float(np.ravel(w["b"])[0])))
    assert np.allclose(quality._forward(w, x, rows)["score"], wanted, atol=1e-9)


def test_features_of_a_passage():
    """Shares of byte classes and the eight counts, by hand, of the second passage of a text."""
    first = " ".join(["w"] * quality.PASSAGE)
    second = "Two words, 2 more. Two"
    raw = np.frombuffer(f"{first} {second}".encode(), np.uint8)
    out, rows = quality.passage_features(raw, np.array([0, len(raw)]))
    assert rows.tolist() == [0, 2] and out.shape == (2, quality.N_FEATURES)
    alone, _ = quality.passage_features(np.frombuffer(second.encode(), np.uint8), np.array([0, len(second)]))
    # all but the number of passages of the text, the last count, is the passage's own
    differ = np.flatnonzero(~np.isclose(out[1], alone[0], atol=1e-6))
    assert set(differ) <= {32 - 32, quality.N_FEATURES - 1}


def test_text_of_formulas_and_embedded_things_stays():
    page = "<article><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is <object data='a'>fallback</object> <video>text</video> fine.</p></article>"
    assert [b.text for b in pages.leaf_blocks(page)] == ["The sum x+1 is fallback text fine."]


def test_unclosed_tags_take_linear_time():
    model = pages.trained(30)
    rng = random.Random(1)
    kinds = {
        "div": lambda n: "<div>a " * n,
        "names": lambda n: "".join(f"<div class='c{rng.random()}'>a " for _ in range(n)),
        "svg": lambda n: "<svg>a " * n,
        "declaration": lambda n: "<!a " * n,
        "ends": lambda n: "<div>" * n + "</section>a" * n,
        "headings": lambda n: "<h1>a <li>b " * n,
        "quotes": lambda n: '<a href="' * n,
        "paragraphs": lambda n: "<p>a <table><td>" * n,
    }
    for name, make in kinds.items():
        seconds = []
        for n in (10_000, 40_000):
            page = make(n)
            begun = time.process_time()
            pages.main_text(model, page)
            seconds.append(time.process_time() - begun)
        assert seconds[1] < 8 * seconds[0] + 0.5, (name, seconds)


def test_repeated_ids_are_one_query(lab):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(20, vectors[20].tolist())] * 5 + [(40, vectors[41].tolist())]
    frame = lab.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = neighbours.nearest(frame, frame.where(F.col("vec_id") % 20 == 0), 10).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(by_query) == set(range(0, 300, 20))
    assert all(sorted(k for k, _ in v) == list(range(1, 11)) for v in by_query.values())
    assert all(q not in [i for _, i in v] for q, v in by_query.items())


def test_a_large_benchmark_is_joined(lab, docs_of, monkeypatch):
    """The same leaks as with the benchmark in all tasks: moved parts, repeated items, common passages, odd texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = " ".join(word() for _ in range(9))
    items = [" ".join(word() for _ in range(rng.choice([8, 20, 60]))) for _ in range(40)]
    items += [f"{common} {' '.join(word() for _ in range(12))}" for _ in range(5)] + ["a b a b a b a b a b a b"]
    cutting = lambda t: " ".join(t.split()[rng.randint(0, 6) : rng.randint(7, 60)])
    texts = [f"{word()} {rng.choice(items)} {common} {cutting(rng.choice(items))}" for _ in range(60)] + [common, *ODD] + [items[3]] * 3
    table = lab.createDataFrame([*enumerate(items), (7, items[7]), (7, items[7]), (90, None), (None, items[3]), (91, "a b"), (92, "")], "item_id long, text string")
    docs = docs_of(texts, clashes=("leaks", "t1", "t2", "gram", "item_id"))
    shown = lambda frame: sorted((r.doc_id, [(l.item_id, round(l.coverage, 9), len(l.tiles)) for l in r.leaks]) for r in frame.collect())
    want = decontaminate.with_leaks(docs, table)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    found = decontaminate.with_leaks(docs, table)
    assert found.columns == want.columns and shown(found) == shown(want)
    assert sum(bool(leaks) for _, leaks in shown(want)) > 30


def test_pages_without_an_article_element():
    """F1 of the main blocks on fresh pages of the layouts that name their article in other ways or not at all."""
    model = pages.trained()
    right = wrong = missed = n = 0
    for page, kept in training_pages(300, 4321):
        if "<article" in page:
            continue
        n += 1
        blocks = pages.leaf_blocks(page, model.weights)
        for block, label in zip(blocks, pages.viterbi(model, pages.features(blocks))):
            main = block.text in kept
            right, wrong, missed = right + (label and main), wrong + (label and not main), missed + (main and not label)
    assert n > 100 and 2 * right / (2 * right + wrong + missed) > 0.97
