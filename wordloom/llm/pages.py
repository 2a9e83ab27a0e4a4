"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is read once into leaf blocks (text between block-level tags) with their ancestors. Each block is main text or
not; features are its ancestors' tags and names and traits of its text; weights are learned on labelled pages
(``training_pages``) by maximum likelihood, and Viterbi finds the best labels of a page as a whole.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Container, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import mapped, quoted, rows_in
from wordloom.llm.training_pages import training_pages

# Fixed values of the markup language: elements without an end, within a line, without page text, and what an opening
# tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr"
    # formulas and embedded things with text of their own
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded menclose mfenced msub msup msubsup munder mover"
    " munderover mtable mtr mtd semantics object audio video canvas".split()
)
NO_TEXT = frozenset("script style template svg textarea select option noscript iframe annotation annotation-xml".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table tbody thead div section article body".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|['\"])*+)>",
    re.DOTALL,
)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")


class Path(Sequence):
    """Ancestors from the body down, as (tag, names), and the features they give together.

    A path shares all but its last element with the path above it, and its features too where it adds none.
    """

    def __init__(self, above: Path | None, tag: str, names: tuple[str, ...], known: Container[str] | None) -> None:
        self.above, self.own, self.depth = above, (tag, names), above.depth + 1 if above else 1
        found = {f"tag={tag}", *(f"name={n}" for n in names), *(f"begin={n[:5]}" for n in names if len(n) > 5)}
        if known is not None:
            found = {f for f in found if f in known}
        before = above.found if above else frozenset()
        self.found: frozenset[str] = before if found <= before else before | found

    def __len__(self) -> int:
        return self.depth

    def __getitem__(self, place):
        out, at = [], self
        while at is not None:
            out.append(at.own)
            at = at.above
        return tuple(out[::-1])[place]


class Block(NamedTuple):
    """Text of a leaf block, share of it in links, and its ancestors; an empty tuple if it has none."""

    text: str
    linked: float
    path: Path | tuple


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    if attributes:
        for m in _NAMES.finditer(attributes):
            value = references.unescape(m[2] or m[3] or m[4] or "")
            found += [p for p in _PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if len(p) > 1]
    return tuple(found)


def leaf_blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """All blocks with text in page order; script, style and the like have none. Broken nesting is closed as it comes.

    ``known`` limits the features of ancestors to these. Time is linear in the page: what is known to be absent (an open
    element, an end tag, the end of any further tag) is not looked for again.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Path] = []
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    last = page.rfind(">") + 1
    texts: list[str] = []
    links: list[str] = []
    in_link, at = False, 0

    def flush() -> None:
        if texts:
            text = " ".join(references.unescape("".join(texts)).split())
            if text:
                linked = len(" ".join(references.unescape("".join(links)).split()))
                out.append(Block(text, min(1.0, linked / len(text)), stack[-1] if stack else ()))
            texts.clear()
            links.clear()

    def close(names: tuple[str, ...] | frozenset, scope: frozenset = frozenset()) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            tag = stack[i].own[0]
            if tag in names:
                opened.subtract(x.own[0] for x in stack[i:])
                del stack[i:]
                return
            if tag in scope:
                return

    while True:
        m = _TAG.search(page, at, last) if at < last else None
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            texts.append(piece)
            if in_link:
                links.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in NO_TEXT:
            if not m[1] and not m[3].endswith("/"):
                end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                if not end:
                    endless.add(tag)
                at = end.end() if end else (len(page) if tag in ("script", "style", "template") else at)
            continue
        if tag in INLINE:
            if tag == "br":
                texts.append(" ")
            elif tag == "a":
                in_link = not m[1]
            continue
        flush()
        in_link = False
        if m[1]:
            close((tag,))
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPE)
        if tag in SAME:
            close(SAME[tag], SCOPE - {"div", "section"})
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(Path(stack[-1] if stack else None, tag, _names(m[3]), known))
            opened[tag] += 1
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of every block."""
    out = []
    for i, block in enumerate(blocks):
        text, words = block.text, block.text.split()
        found = {"bias", f"leaf={block.path.own[0]}", *block.path.found} if block.path else {"bias", "leaf="}
        found.add(f"words={min(int(math.log2(len(words) + 1)), 6)}")
        found.add(f"linked={int(block.linked * 3.99)}")
        if "©" in text or "copyright" in text.lower():
            found.add("rights")
        found.add("stop" if text[-1:] in ".!?:;\"'”»…" else "open")
        if i == 0:
            found.add("first")
        if i == len(blocks) - 1:
            found.add("last")
        out.append(sorted(found))
    return out


class Model(NamedTuple):
    """Weight of main text per feature, score of each step between labels, and of the first label being main text."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]
    begin: float


def _sum(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log1p(math.exp(min(a, b) - high))


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Weights from (features per block, label per block) of each page, by adaptive gradient steps page by page."""
    # features of one or two pages are chance
    common = Counter(f for found, _ in pages for f in set().union(*found))
    pages = [([[f for f in own if common[f] > 2] for own in found], labels) for found, labels in pages]
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    steps, begin = [[0.5, -0.5], [-0.5, 0.5]], 0.0
    steps_seen, begin_seen = [[1e-6] * 2, [1e-6] * 2], 1e-6
    for _ in range(rounds):
        for found, labels in pages:
            if not found:
                continue
            n = len(found)
            e = [sum(weights.get(f, 0.0) for f in own) for own in found]
            forward = [(0.0, e[0] + begin)]
            for t in range(1, n):
                a, b = forward[-1]
                forward.append((_sum(a + steps[0][0], b + steps[1][0]), e[t] + _sum(a + steps[0][1], b + steps[1][1])))
            backward = [(0.0, 0.0)] * n
            for t in range(n - 2, -1, -1):
                a, b = backward[t + 1]
                b += e[t + 1]
                backward[t] = (_sum(steps[0][0] + a, steps[0][1] + b), _sum(steps[1][0] + a, steps[1][1] + b))
            total = _sum(*forward[-1])
            step_change = [[0.0, 0.0], [0.0, 0.0]]
            for t in range(n):
                error = labels[t] - math.exp(forward[t][1] + backward[t][1] - total)
                for f in found[t]:
                    g = error - decay * weights.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-6) + g * g
                    weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(seen[f])
                if t:
                    step_change[labels[t - 1]][labels[t]] += 1
                    for i in (0, 1):
                        for j in (0, 1):
                            p = forward[t - 1][i] + steps[i][j] + (e[t] if j else 0.0) + backward[t][j] - total
                            step_change[i][j] -= math.exp(p)
                else:
                    begin_seen += error * error
                    begin += rate * error / math.sqrt(begin_seen)
            for i in (0, 1):
                for j in (0, 1):
                    steps_seen[i][j] += step_change[i][j] ** 2
                    steps[i][j] += rate * step_change[i][j] / math.sqrt(steps_seen[i][j])
    return Model(weights, (tuple(steps[0]), tuple(steps[1])), begin)


def viterbi(model: Model, found: list[list[str]]) -> list[int]:
    """Most probable labels of a page."""
    if not found:
        return []
    weights, steps = model.weights, model.steps
    a, b = 0.0, model.begin + sum(weights.get(f, 0.0) for f in found[0])
    back = []
    for own in found[1:]:
        from_a, from_b = a + steps[0][0], b + steps[1][0]
        to_a, to_b = a + steps[0][1], b + steps[1][1]
        back.append((int(from_b > from_a), int(to_b >= to_a)))
        a, b = max(from_a, from_b), max(to_a, to_b) + sum(weights.get(f, 0.0) for f in own)
    label = int(b >= a)
    labels = [label]
    for choice in reversed(back):
        label = choice[label]
        labels.append(label)
    return labels[::-1]


def main_text(model: Model, page: str | None) -> tuple[str, int]:
    """Main blocks joined by empty lines, and their number; a null or empty page has none."""
    blocks = leaf_blocks(page, model.weights)
    kept = [b.text for b, label in zip(blocks, viterbi(model, features(blocks))) if label]
    return "\n\n".join(kept), len(kept)


def trained(n: int = 300, seed: int = 5) -> Model:
    """The model learned from ``n`` labelled training pages."""
    labelled = []
    for page, kept in training_pages(n, seed):
        blocks = leaf_blocks(page)
        labelled.append((features(blocks), [int(b.text in kept) for b in blocks]))
    return fit(labelled)


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """All rows with ``text``, ``n_blocks`` and ``n_chars`` of the main text in place of the page.

    Pages that are null, empty or without main text get an empty text. Columns of these three names are replaced, all
    others but ``html`` kept.
    """
    kept = pages.drop(*({"text", "n_blocks", "n_chars"} - {html}))
    others = [c for c in kept.columns if c != html]
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches):
            found = [main_text(shared.value, page) for page in batch.column(len(others)).to_pylist()]
            made = (
                pa.array([t for t, _ in found], pa.string()),
                pa.array([n for _, n in found], pa.int64()),
                pa.array([len(t) for t, _ in found], pa.int64()),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "__main", "n_blocks", "n_chars"])

    found = mapped(kept.select(*quoted([*others, html])), work, "__main string, n_blocks bigint, n_chars bigint")
    return found.withColumnRenamed("__main", "text").select(*quoted([*others, "text", "n_blocks", "n_chars"]))


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(pages.select("page_id", "url", "html")).drop("n_blocks")
