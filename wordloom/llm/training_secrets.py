"""Labelled lines for the secret tagger, made from layouts: where secrets stand, and what only looks like one.

Words are invented from syllables, so that the tagger learns shapes and the words around secrets, not a vocabulary.
"""

from __future__ import annotations

import base64
import random
import string
import uuid

# Public beginnings of access tokens, and what such values are called.
PREFIXES = {"ghp_": 36, "gho_": 36, "glpat-": 20, "xoxb-": 48, "sk_live_": 24, "sk-": 48, "AIza": 35, "npm_": 36, "hf_": 34, "SG.": 66, "AKIA": 16}
CALLED = "password passwd pwd secret token api_key apikey api-key auth_token access_token client_secret private_key passphrase credential".split()
HARMLESS = "id name commit build version checksum digest color order invoice ref page size user request trace image file isbn serial date".split()
SYLLABLES = "la re ti on en der sch ver eau que ment tion ing th an os ci ado le pa vi ung keit ro ba mi ko".split()
HEX = "0123456789abcdef"


def _text(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choices(alphabet, k=n))


def _word(rng: random.Random) -> str:
    made = "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    return made.capitalize() if rng.random() < 0.15 else made


def _words(rng: random.Random, most: int) -> str:
    end = rng.choice(["", "", "", "", "", "", "!!", "###", "&&&", "..."])
    return " ".join(_word(rng) + ("," if rng.random() < 0.08 else end) for _ in range(rng.randint(0, most)))


def _secret(rng: random.Random) -> str:
    kind = rng.randrange(7)
    letters = string.ascii_letters + string.digits
    if kind == 0:
        prefix, n = rng.choice(list(PREFIXES.items()))
        return prefix + _text(rng, letters if prefix != "AKIA" else string.ascii_uppercase + string.digits, n)
    if kind == 1:
        return _text(rng, HEX, rng.choice([24, 32, 40, 64]))
    if kind == 2:
        return base64.b64encode(rng.randbytes(rng.choice([18, 24, 30, 32, 48]))).decode()
    if kind == 3:
        part = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
        return "eyJ" + part(18) + ".eyJ" + part(40) + "." + part(32)
    if kind == 4:
        return _text(rng, letters + "-_", rng.randint(16, 44))
    return _password(rng)


def _password(rng: random.Random) -> str:
    if rng.random() < 0.4:
        return _word(rng).capitalize() + _text(rng, string.digits, rng.randint(2, 5)) + rng.choice(["!", "", "#", "$", "_x"])
    return _text(rng, string.ascii_letters + string.digits + "!$%&#@*", rng.randint(8, 18))


def _harmless(rng: random.Random) -> str:
    kind = rng.randrange(18)
    digits = string.digits
    made = [
        lambda: _text(rng, digits, rng.randint(1, 19)),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"+{rng.randint(1, 99)} {_text(rng, digits, 3)} {_text(rng, digits, 4)} {_text(rng, digits, 3)}",
        lambda: f"{_word(rng)}.{_word(rng)}{rng.randint(1, 99)}@{_word(rng)}.com".lower(),
        lambda: f"https://www.{_word(rng)}.org/{_word(rng)}/{_word(rng)}-{rng.randint(1, 999)}.html".lower(),
        lambda: f"{rng.randint(1950, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T10:{rng.randint(10, 59)}:00",
        lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 200)}",
        lambda: _word(rng) + _word(rng).capitalize() + _word(rng).capitalize() + "()",
        lambda: f"{_word(rng)}_{_word(rng)}_{rng.randint(1, 64)}".lower(),
        lambda: "#" + _text(rng, HEX, 6),
        lambda: str(uuid.UUID(bytes=rng.randbytes(16))),
        lambda: f"{_word(rng)}/{_word(rng)}/{_word(rng)}{rng.randint(1, 9)}.py".lower(),
        lambda: f"{_text(rng, digits, 3)}-{rng.randint(1, 9)}-{_text(rng, digits, 4)}-{_text(rng, digits, 3)}-{rng.randint(0, 9)}",
        lambda: _word(rng).upper() + str(rng.randint(1, 999)),
        lambda: "".join(_word(rng) for _ in range(4)).lower(),
        lambda: " ".join(_text(rng, digits, 4) for _ in range(4)),
        lambda: f"{rng.randint(1, 999)}{rng.choice(['kg', 'km', 'px', 'th', 'ms'])}",
        lambda: rng.choice(["###", "$$$", "&&&", "%%%"]) + _word(rng) + rng.choice(["###", "$$$", "&&&"]),
    ]
    return made[kind]()


def _quoted(rng: random.Random, value: str) -> tuple[str, str, str]:
    quote = rng.choice(['"', "'", "", ""])
    return quote, value, quote


def training_lines(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]], str]]:
    """``n`` lines with the (start, end) of their secrets, and the kind of file they stand in: ``code`` or ``prose``."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        file = rng.choice(["code", "prose"])
        parts: list[tuple[str, bool]] = [(_words(rng, 2 if file == "code" else 9) + " ", False)]
        for _ in range(rng.choice([1, 1, 1, 2])):
            kind = rng.randrange(12)
            if kind <= 2:
                name = rng.choice(CALLED)
                name = rng.choice([name, name.upper(), f"{_word(rng)}_{name}", name.capitalize()])
                before, value, after = _quoted(rng, _secret(rng))
                parts += [(name + rng.choice(["=", " = ", ": ", '": ', " => "]) + before, False), (value, True), (after + rng.choice(["", ";", ",", "!!", ".", "###"]) * bool(after), False)]
            elif kind == 3:
                parts += [(f"{rng.choice(['postgres', 'mysql', 'https', 'redis'])}://{_word(rng)}:".lower(), False), (_password(rng).replace("@", "!"), True), (f"@{_word(rng)}.com/{_word(rng)}".lower(), False)]
            elif kind == 4:
                parts += [(rng.choice(["Authorization: Bearer ", "Bearer ", "authorization: token ", "--password ", "-p ", "the password is ", "my token is "]), False), (_secret(rng), True)]
            elif kind == 5:
                prefix, size = rng.choice(list(PREFIXES.items()))
                parts += [(prefix + _text(rng, string.ascii_letters + string.digits, size), True)]
            elif kind <= 8:
                before, value, after = _quoted(rng, _harmless(rng))
                parts.append((rng.choice(HARMLESS) + rng.choice(["=", ": ", " = ", " "]) + before + value + after, False))
            elif kind == 9:
                # names of secrets without one
                parts.append((rng.choice(CALLED) + rng.choice([" ", " = ", ": ", " is "]) + rng.choice(["", "None", "null", "true", "***", "<hidden>", "your", "os.environ", _word(rng), "reset", "required"]), False))
            else:
                parts.append((_harmless(rng), False))
            parts.append((" " + _words(rng, 5) + " ", False))
        line, spans = "", []
        for text, secret in parts:
            if secret:
                spans.append((len(line), len(line) + len(text)))
            line += text
        if rng.random() < 0.08:
            line = line.upper()
        out.append((line, spans, file))
    return out
