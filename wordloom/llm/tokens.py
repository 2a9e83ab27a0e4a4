"""Token ids of texts by a public word-end BPE vocabulary, with a memory of words already met."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the vocabulary file's own word pattern, for the characters of PLAIN in lower case.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_¹²³¼½¾]+|[\d¹²³¼½¾]|(?:[^\s\w]|_)+")
#: The mark of a word's end in the vocabulary file, and the character that stands for it here; no plain text has it.
END, END_CHARACTER = "</w>", "\x01"
#: Only texts of these characters are cut into words here: on them normal form, lower case and blanks are beyond doubt.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ſ]*+")
#: Characters between blanks remembered per worker: half of them are forgotten at a time, those not met lately.
MEMORY = 2_400_000


def _alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _is_text(raw: bytes) -> bool:
    try:
        return bool(raw.decode())
    except UnicodeDecodeError:
        return False


class WordTokenizer:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)``; what stands between blanks is encoded once.

    Words are encoded by a byte-pair encoder over the same merges, in which the end mark is a byte of its own that joins the
    byte before it first. It gives the same ids if every token of the vocabulary is encoded as itself, which is tested.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        alphabet, mark = _alphabet(), END_CHARACTER.encode()
        raw = lambda token: bytes(alphabet[c] for c in token.removesuffix(END)) + mark * token.endswith(END)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        names = [*alphabet, *(c + END for c in alphabet)]
        names += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.encoder = tiktoken.Encoding(
            "words", pat_str=f"[^{END_CHARACTER}]+{END_CHARACTER}", mergeable_ranks={raw(t): i for i, t in enumerate(names)}, special_tokens={}
        )
        self.id_of = np.array([model["vocab"][t] for t in names], np.uint32)
        self.ends = np.array([t.endswith(END) for t in names])
        closed = [t for t in names if t.endswith(END)]
        parts = [raw(t) for t in closed if _is_text(raw(t)) and raw(t).count(mark) == 1]
        own = self.encoder.encode_ordinary(b"".join(parts).decode())
        self.same = len({raw(t) for t in names}) == len(names) and len(own) == len(parts)

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words."""
        made = self.encoder.encode_ordinary(END_CHARACTER.join([*words, ""]))
        packed, out, at = self.id_of[made].tobytes(), {}, 0
        for word, end in zip(words, (4 * np.flatnonzero(self.ends[made]) + 4).tolist()):
            out[word] = packed[at:end]
            at = end
        return out

    def _learn(self, parts: list[str]) -> None:
        wanted = set(parts).difference(self.young)
        for part in wanted & self.old.keys():
            self.young[part] = self.old[part]
        new = [(part, WORDS.findall(part)) for part in wanted.difference(self.young)]
        if new:
            of_word = self._encoded(list({w for _, words in new for w in words}))
            for part, words in new:
                self.young[part] = b"".join(map(of_word.__getitem__, words))
        self.held += sum(map(len, wanted))

    def ids(self, text: str) -> np.ndarray:
        if not self.same or not PLAIN.fullmatch(text) or "<|" in text:
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = text.lower().split()
        try:
            found = b"".join(map(self.young.__getitem__, parts))
        except KeyError:
            if self.held > MEMORY // 2:
                self.old, self.young, self.held = self.young, {}, 0
            self._learn(parts)
            found = b"".join(map(self.young.__getitem__, parts))
        return np.frombuffer(found, np.uint32)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    return WordTokenizer(path)
