"""Language, quality, personal data, pages and benchmark passages against plain versions and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, langid, pages, pii, quality
from wordloom.llm.common import flat, shingle_hashes, word_hashes
from wordloom.llm.training_pages import training_pages

from .conftest import ODD


def test_word_and_shingle_hashes():
    texts = [None, "a b c d e f", "A  b\tc\nd e F", "x", "", " x ", "é" * 3, "a b c d e f " * 3]
    words, edges = word_hashes(*flat(pa.array(texts)))
    lists = [words[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    assert lists[1] == lists[2] and lists[3] == lists[5] and lists[0] == lists[4] == [] and lists[7] == lists[1] * 3
    shingles, bounds = shingle_hashes(words, edges)
    assert np.diff(bounds).tolist() == [0, 2, 2, 1, 0, 1, 1, 14]
    # one word longer than a span, and texts that fall into several spans
    long = "q" * 1_200_000
    one, _ = word_hashes(*flat(pa.array(["b " * 300_000 + long + " z", long])))
    assert one[-1] == one[-3] and len(set(one.tolist())) == 3


def plain_bits(samples, text):
    out = []
    fold = lambda t: langid.folded(np.frombuffer(t.encode(), np.uint8)).tobytes()
    for name in sorted(samples):
        data, context = fold("\n".join(samples[name])), defaultdict(Counter)
        for i in range(len(data)):
            for k in range(min(langid.ORDER, i) + 1):
                context[data[i - k : i]][data[i]] += 1
        seen, total = fold(text), 0.0
        for i in range(len(seen)):
            for k in range(min(langid.ORDER, i), -1, -1):
                counts = context.get(seen[i - k : i])
                if not counts:
                    continue
                n, kinds = sum(counts.values()), len(counts)
                if seen[i] in counts:
                    total += math.log2((n + kinds) / counts[seen[i]])
                    break
                total += math.log2((n + kinds) / kinds)
            else:
                total += 8
        out.append(total)
    return out


def test_code_lengths_are_exact(monkeypatch):
    samples = {"en": ["the cat sat on the mat", "hello thé and"], "de": ["der hund und die katze", "ÜBER alles"], "xx": ["q"]}
    texts = ["the hund", "xyz q", "ü", "", "THE cat UND die katze zzz thé ALLES über " * 4]
    model = langid.fit(samples)
    for span in (1 << 18, 7):
        monkeypatch.setattr(langid, "SPAN", span)
        found = langid.Scorer(model).bits(*flat(pa.array(texts)))
        assert np.allclose(found, [plain_bits(samples, t) for t in texts], rtol=1e-5)


def test_languages_of_held_out_and_odd_rows(lab, docs_of):
    docs = lab.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert {r.doc_id for r in own} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in own) >= 0.98 * len(own) and all(0 <= r.score <= 1 for r in rows)
    odd = docs_of([*ODD, "the the", "12 + 3 !?"], langs=["en"] * 3 + [None] * (len(ODD) - 1))
    model = langid.fit({"en": ["the words of a text"], "de": ["die worte"]})
    out = langid.identify(odd, model)
    assert out.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    found = {r.doc_id: r.lang_pred for r in out.collect()}
    letters = [bool(t and re.search(r"[^\W\d_]", t)) for t in [*ODD, "the the", "12 + 3 !?"]]
    assert [found[i] != "und" for i in range(len(found))] == letters and found[len(ODD)] == "en"
    nothing = langid.digest(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.digest(odd.limit(0)).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    x, rows, labels = rng.standard_normal((9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    weights = {"E": rng.standard_normal((5, 4)), "e": rng.standard_normal(4), "V": rng.standard_normal((4, 3)), "U": rng.standard_normal((4, 3))}
    weights |= {"w": rng.standard_normal(3), "c": rng.standard_normal(4), "b": np.array(0.3)}

    def loss(w):
        p = quality._forward(w, x, rows)["score"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for name, g in quality._gradients(weights, x, rows, labels, 0.0).items():
        for at in np.ndindex(np.shape(weights[name])):
            moved = {k: np.array(v, float) for k, v in weights.items()}
            moved[name][at] += 1e-6
            assert abs((loss(moved) - loss(weights)) / 1e-6 - np.asarray(g)[at]) < 1e-4


def test_quality_of_held_out_and_odd_rows(lab, docs_of):
    docs, labels = (lab.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.digest(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    right = sum(r.predicted == r.quality for r in rows)
    assert right >= 0.97 * len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    odd = docs_of(ODD)
    marks = lab.createDataFrame([(0, 1, None), (4, 0, 1), (4, 1, 1), (None, 1, 1), (5, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(odd, quality.fitted(odd, marks))
    assert out.columns == [c for c in odd.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in quality.digest(odd, marks.limit(0)).collect()} == {0.5}
    assert quality.digest(odd.limit(0), marks).count() == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    parts = ["1", "22", "255", "256", ".", "@", "a", "b.c", "@x.y", " ", "-", "+", "(", ")", "4111111111111111", "é", "+1 (555) 123-4567", "0", "DE89370400440532013000"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        assert [tuple(s) for s in pii.find_spans(text) if s.kind in pii.KINDS[:4]] == plain_spans(text), text


def test_account_numbers_context_and_redaction():
    text = "My bank account: DE89 3704 0044 0532 0130 00, order DE89 3704 0044 0532 0130 01."
    (span,) = pii.find_spans(text)
    assert span.kind == "iban" and text[span.start : span.end] == "DE89 3704 0044 0532 0130 00"
    assert pii.score("iban DE", pii.Span("iban", 5, 7)) > pii.score("sample DE", pii.Span("iban", 7, 9))
    assert pii.redact(text, [span]).startswith("My bank account: <iban>, order")
    # long runs take linear time
    assert pii.find_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 100_000 + "+" * 100_000) == []


def test_personal_data_of_odd_rows(lab, docs_of):
    texts = [*ODD, "mail a.b@c.de, 10.0.0.1", "🙂 +1 (555) 123-4567"]
    docs = docs_of(texts)
    for r in pii.digest(docs).collect():
        spans = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS[:4]]
    out = pii.personal_data(docs)
    assert out.columns == [c for c in docs.columns if c not in ("pii", "redacted")] + ["pii", "redacted"]
    found = {r.doc_id: r for r in out.collect()}
    assert found[len(ODD)].redacted == "mail <email>, <ip>" and found[0].redacted is None
    assert found[len(ODD) + 1].pii[0].value == "+1 (555) 123-4567"
    assert pii.digest(docs.limit(0)).count() == 0


def test_leaf_blocks():
    page = """<!DOCTYPE html><title>T</title><body><script>var a="<p>no</p>";</script><div CLASS='Main-Box x1'>a &amp; <b>b</b>&nbsp;c<p>one<p>two<br>three
    <ul><li>x<li><a href="?a>b">link</a></ul><!-- <p>no</p> --><table><tr><td>1<td>2</table></div></p>tail &lt;<"""
    blocks = pages.leaf_blocks(page)
    assert [b.text for b in blocks] == ["T", "a & b c", "one", "two three", "x", "link", "1", "2", "tail <<"]
    assert blocks[1].path[-1] == ("div", ("main", "box", "x1")) and blocks[5].linked == 1.0
    assert [t for t, _ in blocks[6].path[-2:]] == ["tr", "td"]
    for odd in (None, "", "<", "<p", "<!--", "<script>", "</div></p>", "<p a='", "&#0;&bogus;", "<" * 1000, "<a b=\"" * 1000):
        pages.leaf_blocks(odd)


def test_viterbi_is_the_best_labelling_and_training_generalises():
    model = pages.trained(200, 5)
    right = total = 0
    for page, kept in training_pages(120, 77):
        blocks = pages.leaf_blocks(page)
        labels = pages.viterbi(model, pages.features(blocks))
        right += sum(a == (b.text in kept) for a, b in zip(labels, blocks))
        total += len(blocks)
    assert right >= 0.97 * total
    rng = random.Random(3)
    for _ in range(30):
        found = [rng.sample(sorted(model.weights), 3) for _ in range(rng.randint(1, 7))]

        def value(labels):
            s = model.begin if labels[0] else 0.0
            s += sum(sum(model.weights[f] for f in own) for own, l in zip(found, labels) if l)  # noqa: B023
            return s + sum(model.steps[a][b] for a, b in zip(labels, labels[1:]))

        every = [[(n >> i) & 1 for i in range(len(found))] for n in range(1 << len(found))]
        assert abs(value(pages.viterbi(model, found)) - max(map(value, every))) < 1e-9


def test_pages_of_the_tables_and_odd_pages(lab):
    table = lab.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.digest(table).join(table.select("page_id", "html"), "page_id").collect():
        inside = [b.text for b in pages.leaf_blocks(r.html) if any(t == "article" for t, _ in b.path)]
        assert r.text == "\n\n".join(inside) and r.n_chars == len(r.text)
    odd = lab.createDataFrame([(0, None, None, "x"), (1, "u", "", "x"), (2, "u", "<p>", "x"), (2, "u", "<p>", "x")], "page_id long, url string, html string, text string")
    out = pages.extract(odd)
    assert out.columns == ["page_id", "url", "text", "n_blocks", "n_chars"]
    assert [(r.text, r.n_blocks, r.n_chars) for r in out.collect()] == [("", 0, 0)] * 4
    assert pages.digest(odd.limit(0)).count() == 0


def plain_tiles(a, b, k):
    taken_a, taken_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and not taken_a[x + n] and not taken_b[y + n]:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (x, y, n)
        if best is None:
            return out
        out.append(best)
        for i in range(best[2]):
            taken_a[best[0] + i] = taken_b[best[1] + i] = True


def test_tiles_are_those_of_the_plain_search():
    rng = random.Random(4)
    for _ in range(400):
        k = rng.choice([2, 3, 5])
        a = [rng.choice("abc" if rng.random() < 0.8 else "xyz") for _ in range(rng.randint(0, 25))]
        b = [rng.choice("abc") for _ in range(rng.randint(k, 12))]
        if len(b) > 6:
            a = a[:5] + b[6:] + a[5:9] + b[:6] + a[9:]
        found = decontaminate.Items([(7, " ".join(b))], k).matches(*flat(pa.array([" ".join(a)])), 0.0)[0]
        assert [tuple(t) for t in (found[0][2] if found else [])] == plain_tiles(a, b, k)


def test_leaks(lab, docs_of, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [" ".join(word() for _ in range(40)) for _ in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    words = items[0].split()
    moved = " ".join(words[20:] + ["zz"] + words[:20])
    texts = [f"{noise(50)} {items[i].upper()}! {noise(9)}" for i in range(5)] + [moved, noise(400), " ".join(words[:15]), *ODD]
    table = lab.createDataFrame([*enumerate(items), (90, None), (None, items[3]), (91, "a b"), (92, "")], "item_id long, text string")
    docs = docs_of(texts)
    wanted = {(i, i) for i in range(5)} | {(5, 0)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.digest(docs, table).collect()} == wanted
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    blocks = list(decontaminate.item_blocks(table, 2000))
    assert len(blocks) > 2 and sum(map(len, blocks)) == len(items) + 2
    monkeypatch.setattr(decontaminate, "item_blocks", lambda items: iter(blocks))
    out = decontaminate.with_leaks(docs, table)
    assert out.columns == [c for c in docs.columns if c != "leaks"] + ["leaks"]
    assert {(r.doc_id, l.item_id) for r in out.collect() for l in r.leaks} == wanted
    monkeypatch.undo()
    assert decontaminate.digest(docs, table.limit(0)).count() == 0 and decontaminate.digest(docs.limit(0), table).count() == 0


def test_long_digit_groups_and_scores(lab, docs_of):
    """Parts of dotted numbers, cards and phones of any length; scores follow the words around a span."""
    zeros = "0" * 5000
    texts = [f"1.2.3.{zeros}9", f"{zeros}1.{zeros}2.3.4", f"1.2.3.{'9' * 6000}", f"+{zeros}", "1" * 6000, "server 10.0.0.1", "version 10.0.0.1", "10.0.0.1"]
    found = {r.doc_id: r for r in pii.digest(docs_of(texts)).collect()}
    assert [found[i].n_ip for i in range(8)] == [1, 1, 0, 0, 0, 1, 1, 1]
    assert found[0].spans == f"ip:0:{len(texts[0])}" and found[2].scores == ""
    assert [found[i].scores for i in (5, 6, 7)] == ["0.75", "0.45", "0.60"]
