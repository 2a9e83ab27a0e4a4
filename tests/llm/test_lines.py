"""Line dedup against a plain version, and what has to hold of its results."""

import random
import re
import time
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from wordloom.llm import linededup

from .conftest import ODD

LEAST = 2 * linededup.WIDTH


def plain_chunks(text):
    """(first, lines) of every chunk."""
    h = lambda line: int(md5(line.encode()).hexdigest()[:8], 16)
    lines, out, chunk = text.split("\n"), [], []
    for i, line in enumerate(lines):
        chunk.append(line)
        rolled = (h(lines[max(i - 1, 0)]) * 31 + h(line)) % 2**32 % linededup.EVERY == 0
        if i + 1 == len(lines) or len(line) >= LEAST or len(lines[i + 1]) >= LEAST or rolled:
            out.append((i + 1 - len(chunk), chunk))
            chunk = []
    return out


def plain_passages(texts):
    """(text, removed lines) of texts that all differ in their ids, by dictionaries of chunks and pairs of chunks."""
    split = {d: plain_chunks(t) for d, t in enumerate(texts) if t is not None}
    chunk_at, pair_at = {}, {}
    for d, chunks in split.items():
        for k, (_, c) in enumerate(chunks):
            chunk_at.setdefault(tuple(c), (d, k))
            if k + 1 < len(chunks):
                pair_at.setdefault((tuple(c), tuple(chunks[k + 1][1])), (d, k))

    def alike(a, b):
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return n

    out = []
    for d, text in enumerate(texts):
        if text is None:
            out.append((None, 0))
            continue
        chunks, gone, k = split[d], set(), 0
        pair = lambda j: pair_at[tuple(chunks[j][1]), tuple(chunks[j + 1][1])] if j + 1 < len(chunks) else (d, j)
        while k < len(chunks):
            end = k
            while pair(end) < (d, end):
                end += 1
            begin_at, end_at = (pair(k), pair(end - 1)) if end > k else (chunk_at[tuple(chunks[k][1])],) * 2
            end_at = (end_at[0], end_at[1] + (end > k))
            if end > k or begin_at < (d, k):
                inside = lambda e, j: split[e][j][1] if 0 <= j < len(split[e]) else []
                beside = lambda e, j, step: inside(e, j + step)[::step] + inside(e, j + 2 * step)[::step]
                before, after = beside(d, k, -1), beside(d, end, 1)
                n, m = alike(before, beside(*begin_at, -1)), alike(after, beside(*end_at, 1))
                body = sum((c for _, c in chunks[k : end + 1]), before[:n] + after[:m])
                if len("\n".join(body)) >= LEAST:
                    first, last = chunks[k][0] - n, chunks[end][0] + len(chunks[end][1]) + m
                    gone |= set(range(first, last))
            k = end + 1
        out.append(("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)))
    return out


def line(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(n))


def mixed_texts(seed):
    rng = random.Random(seed)
    passages = ["\n".join(line(rng, n) for _ in range(64 // n)) for n in (1, 2, 4, 8, 16, 32) for _ in range(3)]
    texts = [t for t in ODD if (t or "").count("\n") < 100]
    texts += [f"{line(rng, 3)}\n{p}\n{line(rng, 4)}" for p in passages]
    texts += [f"{line(rng, 5)}\n{p}\n{line(rng, 2)}" for p in passages] + texts[-18:-12]
    texts += ["\n".join(rng.choice(passages).split("\n")[rng.randint(0, 3) :] + [line(rng, rng.randint(1, 40))]) for _ in range(20)]
    texts += ["\n".join(rng.choices(["a", "b", "menu", "home page", ""], k=rng.randint(5, 120))) for _ in range(25)]
    return texts + ["\n".join([line(rng, 30), "tail"])] * 2


@pytest.mark.parametrize("seed", range(2))
def test_passages_are_those_of_the_plain_version(docs_of, seed, monkeypatch):
    monkeypatch.setattr("wordloom.llm.skew.TOGETHER", 16)
    monkeypatch.setattr(linededup, "PART_BYTES", 2000)
    texts = mixed_texts(seed)
    docs = docs_of(texts)
    out = linededup.without_repeats(docs)
    assert out.columns == [c for c in docs.columns if c != "removed_lines"] + ["removed_lines"]
    assert not re.search("Python|Arrow|Pandas|MapPartitions", out._jdf.queryExecution().executedPlan().toString())
    found = {r.doc_id: (r.text, r.removed_lines) for r in out.collect()}
    assert [found[i] for i in range(len(texts))] == plain_passages(texts)
    # of equal lines the first one is always kept
    lines = lambda all_texts: {x for t in all_texts if t is not None for x in t.split("\n")}
    assert lines(texts) - {""} == lines(t for t, _ in found.values()) - {""}


def test_copies_of_whole_documents_leave_nothing(lab):
    """Every later exact copy in the given documents, whatever the length of its lines."""
    docs = lab.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    cleaned = {r.doc_id: r.text for r in linededup.digest(docs).collect()}
    first = {}
    for doc_id in sorted(texts):
        first.setdefault(texts[doc_id], doc_id)
    copies = [d for d, t in texts.items() if t and len(t) >= LEAST and first[t] != d]
    assert len(copies) > 30 and not any(cleaned[d] for d in copies)


def test_texts_of_one_id_are_documents_of_their_own(lab):
    rng = random.Random(3)
    p, a, b, c = line(rng, 40), line(rng, 40), line(rng, 40), line(rng, 40)
    rows = [(1, p), (2, f"{p}\n{a}"), (2, f"{b}\n{c}"), (3, None), (None, p), (None, p), (2, f"{p}\n{a}")]
    docs = lab.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(list)
    for r in linededup.without_repeats(docs).collect():
        found[r.doc_id].append((r.text, r.removed_lines))
    assert found[1] == [(p, 0)] and found[3] == [(None, 0)] and found[None] == [(p, 0)] * 2
    assert sorted(found[2]) == sorted([(a, 1), (a, 1), (f"{b}\n{c}", 0)])
    assert linededup.without_repeats(docs.limit(0)).count() == 0
    once = lab.createDataFrame([(1, p)] * 3, "doc_id long, text string")
    assert [r.removed_lines for r in linededup.without_repeats(once).collect()] == [0, 0, 0]


def test_time_is_linear_in_the_lines(lab):
    rng = random.Random(5)

    def seconds(n):
        text = "\n".join(line(rng, 3) for _ in range(n))
        docs = lab.createDataFrame([(1, text), (2, text), (3, text[1000:])], "doc_id long, text string").repartition(3)
        begun = time.time()
        removed = {r.doc_id: r.removed_lines for r in linededup.digest(docs).collect()}
        assert removed[1] == 0 and removed[2] == n and removed[3] > 0.99 * (n - 60)
        return time.time() - begun

    seconds(1000)
    small, large = seconds(10_000), seconds(100_000)
    assert large < 12 * small
