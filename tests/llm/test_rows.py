"""Sharding, near-duplicates, line chunks, packing and neighbours against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import linededup, neardup, neighbours, packing, sharding

from .conftest import ODD

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_jump(key, shards):
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (2**31 / ((key >> 33) + 1)))
    return at


def test_jump_is_the_published_function(lab):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 256, *random.Random(1).sample(range(2**60), 300)]
    rows = lab.createDataFrame([(k,) for k in keys], "k long").select("k", *(sharding.jump_shard(F.col("k"), n).alias(f"s{n}") for n in (1, 2, 24, 25)))
    for row in rows.collect():
        for n in (1, 2, 24, 25):
            assert row[f"s{n}"] == plain_jump(row.k % 2**64, n)
        assert row.s25 in (row.s24, 24)


def test_shards_of_odd_rows(lab, docs_of):
    docs = docs_of(ODD)
    rows = sharding.digest(docs, 24).collect()
    assert len(rows) == len(ODD)
    by_shard = defaultdict(list)
    for r in rows:
        text = (ODD[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.digest(docs.limit(0), 24).count() == 0
    twice = sharding.digest(docs.union(docs), 24).groupBy("shard", "slot").count().where("count > 1")
    assert twice.count() == 0
    moved = sharding.shard_rows(docs.withColumn("doc_id", F.lit(None).cast("long")), "doc_id", 24)
    assert {r.shard for r in moved.select("shard").collect()} == {plain_jump(0, 24)} and moved.columns == docs.columns


def test_native_plans(lab, docs_of):
    for frame in (sharding.digest(docs_of(ODD), 24), linededup.without_repeats(docs_of(ODD))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)


def plain_components(texts, percent, k=5):
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


def edited(rng, words, share):
    return [rng.choice("abcdefg") * rng.randint(2, 5) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("percent,cell", [(85, 2048), (80, 2048), (85, 16)])
def test_near_duplicates(lab, docs_of, monkeypatch, percent, cell):
    monkeypatch.setattr(neardup, "CELL_DOCS", cell)
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = ["One two", "one TWO", "one two three", "a b c d e", "A b C d e", *ODD]
    for size in (4, 6, 9, 30, 200, 600):
        base = [word() for _ in range(size)]
        texts += [" ".join(edited(rng, base, share)) for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(3)]
    cloud = [word() for _ in range(150)]
    texts += [" ".join(edited(rng, cloud, 0.018)) for _ in range(60)]
    rng.shuffle(texts)
    found = {r.doc_id: r for r in neardup.near_duplicates(docs_of(texts), percent).collect()}
    assert len(found) == len(texts)
    for i, (n, root) in enumerate(plain_components(texts, percent)):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (n, root, root == i)


def test_near_duplicates_of_odd_tables(lab, docs_of):
    docs = docs_of(["a b c d e f"] * 3)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    rows = neardup.near_duplicates(docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == {(0, 0, True): 2, (1, 0, False): 2, (2, 0, False): 2, (None, None, True): 3}


def test_chain_and_star_components(lab):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(9, 8), (8, 9), (5, 5)]
    rng.shuffle(pairs)
    found = {r.node: r.component for r in neardup.components(lab.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 240)}, 7: 7, 8: 8, 9: 8}
    assert neardup.components(lab.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64)
    one, two = np.unique(pool[:2000]), np.unique(pool[500:2500])
    found, used = neardup.estimates(neardup.registers(one), neardup.registers(two)[None], len(one), np.array([len(two)]))
    assert used[0] == neardup.BUCKETS and abs(found[0] - 1500 / 2500) < 0.2


@pytest.mark.parametrize("limit", [0.8, 0.85])
def test_registers_drop_no_probable_link(limit):
    for used in (3, 13, 20, 60, 128):
        tails = np.cumsum([math.comb(used, m) * limit**m * (1 - limit) ** (used - m) for m in range(used + 1)])
        for matches in range(1, used + 1):
            one, two = np.zeros(neardup.BUCKETS, np.uint16), np.zeros(neardup.BUCKETS, np.uint16)
            one[:used], two[:used] = 7, 9
            two[:matches] = 7
            near = neardup._candidates(0, np.array([one, two]), np.zeros((2, neardup.BANDS), np.uint64), np.array([200, 200]), 0, limit)
            assert near[1] == (tails[matches] > 1e-11)


def test_outer_cells_are_bounded_by_shingles(lab, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_SHINGLES", 1000)
    large = lab.createDataFrame([(1, 0, i, i, 200, 8) for i in range(40)], "key long, band int, doc_id long, f1 long, n long, _cells long")
    found = lab.createDataFrame([(i, 0) for i in range(10)], "node long, component long")
    cells = neardup._beyond_cells(large, found).where("left").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    assert len(cells) > 8 and max(r.n for r in cells) < 30 * 200


@pytest.mark.parametrize("group", [8192, 8])
def test_packing(lab, docs_of, group):
    rng = random.Random(8)
    texts = [*ODD, *(" ".join("".join(rng.choice("abcdeéßÜ'!9") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 400))) for _ in range(150))]
    plain = Tokenizer.from_file(VOCABULARY)
    wanted = {}
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            wanted[i, n] = (at, len(own), zlib.crc32(own.tobytes()))
    rows = packing.pack_documents(docs_of(texts), VOCABULARY, group=group).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == wanted and len(rows) == len(wanted)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(length for _, length, _ in wanted.values()) // 4096)
    assert len(sequences) <= least + (1 if group > 1000 else 3)


def test_packing_ends_where_nothing_fits_together(lab, monkeypatch):
    monkeypatch.setattr(packing, "MOST_GROUP", 40)
    columns = [c.split()[0] for c in packing.PIECES.split(", ")]
    rows = lab.range(300).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"),
        F.lit(2100).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("ids_crc32"), F.xxhash64("id").alias("deal"),
    )
    found = packing.pack(rows.select(*columns), 4096, 10).collect()
    assert len(found) == len({r.sequence_id for r in found}) == 300


def test_packing_of_odd_tables(lab, docs_of):
    docs = docs_of(["a b"])
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0
    rows = packing.pack_documents(docs.union(docs), VOCABULARY).collect()
    assert sorted(r.offset for r in rows) == [0, 3]


def test_sum_of_squares_takes_the_least_change():
    lengths = np.array([60, 60, 40, 50, 50, 30, 100])
    bins, offsets, made = packing.sum_of_squares(lengths, 100)
    fill = np.bincount(bins, lengths, made)
    assert fill.max() <= 100 and (offsets + lengths <= 100).all()
    rng = np.random.default_rng(1)
    counts, open_bins = Counter(), []
    lengths = rng.integers(1, 20, 200)
    bins, _, _ = packing.sum_of_squares(lengths, 20)
    free = {}
    for s, b in zip(lengths.tolist(), bins.tolist()):
        cost = lambda g: sum(v * v for v in (counts - Counter([g]) + Counter([g - s] if g > s else [])).values())  # noqa: B023, E731
        choices = {g: cost(g) for g in counts if counts[g] and g >= s}
        new = sum(v * v for v in (counts + Counter([20 - s] if s < 20 else [])).values())
        gap = free.get(b, 20)
        taken = choices[gap] if b in free else new
        assert taken == min([new, *choices.values()])
        if b in free:
            counts[gap] -= 1
        free[b] = gap - s
        counts[gap - s] += gap > s
        counts = +counts


def test_neighbours_against_all_pairs(lab):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 12)) * rng.uniform(0.5, 2, (900, 1))
    x[100:140] = x[3]
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, []), (1040, [0.0] * 12), (1060, [float("nan")] * 12), (1080, [1.0, None] * 6), (1100, [1.0] * 5), (None, [1.0] * 12)]
    rows += [(i, v, 0, 0.0) for i, v in bad]
    vectors = lab.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double").repartition(5)
    found = defaultdict(list)
    for r in neighbours.digest(vectors).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 900, 20):
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q]
        got = found.pop(q)
        assert len(got) == 20 and got == sorted(got, key=lambda p: (-p[1], p[0]))
        assert all(s == scores[i] for i, s in got)
        hit += len({i for i, _ in got} & set(order[:20]))
    assert not found and hit >= 0.9 * 45 * 20


def test_few_or_no_vectors(lab):
    schema = "vec_id long, embedding array<float>"
    few = neighbours.digest(lab.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1), (0, 2, 2)]
    none = neighbours.digest(lab.createDataFrame([(0, None)], schema))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, (500, 2), dtype=np.uint64)
    near = codes[0] ^ np.uint64(5)
    codes[1] = near
    index = neighbours.BlockIndex(codes)
    for radius in (0, 2, 4, 50, 60, 66, 128):
        true = np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(axis=1) <= radius)
        assert index.within(codes[0], radius).tolist() == true.tolist()
