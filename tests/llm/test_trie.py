"""The conversation trie against a plain walk, and its splitting against plain sums."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in children[seq]) if children[seq] else 1
        own_bytes = len(seq[-1][1].encode()) if seq else 0
        saved[seq] = (len(members[seq]) - 1) * own_bytes + sum(saved[k] for k in children[seq])
    out = set()
    for seq, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == seq)
        parent = min(members[seq[:-1]]) if seq else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(convs), len(seq), parent, len(convs), len(children[seq]), leaves[seq], saved[seq], digest))
    return out


def made(rows, lab, **options):
    frame = lab.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("key", "d", "comp", "i", "at", "h")})
    found = [tuple(r) for r in trie.conversation_trie(frame, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def some_rows(seed, convs, words=3, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c * rng.choice([1, 1, 1, 7]), turn, rng.choice(["user", "assistant"]), "é" * rng.randint(0, words)))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("part,task", [(1 << 14, 1 << 16), (4, 8)])
def test_small_tries(lab, part, task):
    rows = some_rows(part, 60)
    assert made(rows, lab, part=part, task=task) == plain_trie(rows)


def test_odd_rows(lab):
    rows = [
        (5, None, "user", "a"), (5, 0, None, None), (6, 0, "user", "a"), (6, 1, "", ""), (6, 2, "x", "é"), (-7, 0, "u", "neg"),
        (-5, 3, "u", "neg"), (-5, 1, "v", "neg"), (None, 0, "user", "lost"), (10, 0, "u", "t" * 300_000), (2**62, 0, "u", "end"),
    ]
    assert made(rows, lab) == plain_trie(rows)
    assert made([], lab) == set() and made([(None, 0, "a", "b")], lab) == set()
    # equal turn numbers and repeated rows: all stay, in an order of their own
    tied = [(5, 1, "b", "x"), (5, 1, "a", "x"), (5, 1, "a", "x")]
    assert sorted(r[1] for r in made(tied, lab)) == sorted(r[1] for r in plain_trie(tied))


def test_long_chains_and_hot_nodes(lab, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    monkeypatch.setattr("wordloom.llm.skew.TOGETHER", 16)
    rows = [(0, i, "u", str(i)) for i in range(200)] + [(1000, i, "u", str(i)) for i in range(120)]
    rows += [(c * 5, i, "u", str(i)) for c in range(1, 40) for i in range(3)]
    assert made(rows, lab, part=16, task=32) == plain_trie(rows)


def test_ids_of_a_large_node_are_hashed_in_pieces(lab, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 64)
    rows = [(c * 5, 0, "u", "same") for c in range(300)]
    assert made(rows, lab) == plain_trie(rows)


@pytest.mark.parametrize("seed", range(4))
def test_sums_by_centroids(seed):
    rng = np.random.default_rng(seed)
    n = 3000
    parent = np.full(n, -1)
    depth = np.zeros(n, int)
    for i in range(1, n):
        p = i - 1 if seed == 0 or rng.random() < 0.6 else int(rng.integers(0, i)) if seed % 2 else -1
        parent[i], depth[i] = p, depth[p] + 1 if p >= 0 else 3
    values = rng.integers(0, 1 << 40, (n, 2))
    want = values.copy()
    for i in np.argsort(-depth, kind="stable"):
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    assert (trie.subtree_sums(parent, depth, values) == want).all()
