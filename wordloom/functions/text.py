"""Text helpers (section 2.10, KWI-5, KWI-7, KWI-11)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Attribute values that are not shown.
HIDDEN = ("__UNDEF__", "-", "_")


def truncated(text: Column | str, length: int) -> Column:
    """Text longer than ``length - 3`` is cut to ``length - 2`` characters and marked with three dots."""
    text = F.col(text) if isinstance(text, str) else text
    cut = F.concat(F.substring(text, 1, length - 2), F.lit("..."))
    return F.when(F.length(text) > length - 3, cut).otherwise(text)


def text_id_of(segment: Column | str) -> Column:
    """Text id of a segment id: everything from the first dot on (if something follows it) is taken off."""
    return F.regexp_replace(segment, r"\..+", "")


def one_word(token: Column) -> Column:
    """KWI-5. Spaces inside a token become ``_``; a fraction ``1 / 2`` is closed up to ``1/2``."""
    return F.replace(F.regexp_replace(token, r"(\d+) / (\d+)", "$1/$2"), F.lit(" "), F.lit("_"))


def rendered_token(values: list[Column]) -> Column:
    """KWI-4. ``word/attr/attr`` with a blank for a missing value."""
    blanked = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.concat_ws("/", one_word(blanked[0]), *blanked[1:])


def tooltip(attributes: list[Column], lemma: int | None = None) -> Column:
    """KWI-7. Shown attributes separated by a space, hidden values left out, the lemma in quotes."""
    shown = [F.when(~a.isin(*HIDDEN), F.concat(F.lit('"'), a, F.lit('"')) if k == lemma else a) for k, a in enumerate(attributes)]
    return F.concat_ws(" ", *shown)


def links(attribute: Column | str) -> Column:
    """KWI-11. Array of the addresses in a link attribute; NULL if the attribute holds none."""
    attribute = F.col(attribute) if isinstance(attribute, str) else attribute
    parts = F.split(F.replace(attribute, F.lit("!!"), F.lit("/")), r"\$")
    return F.when(attribute.rlike(r"\$https?:"), F.filter(parts, lambda p: F.trim(p) != ""))


def two_decimals(number: Column | str) -> Column:
    return F.format_string("%.2f", number)
