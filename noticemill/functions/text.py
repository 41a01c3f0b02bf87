"""Text functions as Columns: stripping, folding, normal forms, phrase matching."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What Unicode calls white space.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def pstrip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(c, F.lit(_SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(pstrip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@cache
def _fold_map(compat: bool) -> tuple[str, str]:
    """Latin letters that decompose to one base letter, then what is deleted; compat adds single-character variants."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    if compat:
        pairs |= {c: unicodedata.normalize("NFKD", c) for c in "ºª²³¹"}
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


def fold(c: Column, compat: bool = False) -> Column:
    """Without accents: canonical decomposition, or with compat also superscripts, ordinals and ligatures."""
    for ligature in ("ﬁ", "ﬂ") if compat else ():
        c = F.replace(c, F.lit(ligature), F.lit(unicodedata.normalize("NFKD", ligature)))
    return F.translate(c, *_fold_map(compat))


def search_form(c: Column) -> Column:
    """Lower case, folded, only a-z and 0-9 with single spaces."""
    return F.trim(F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit(""))), compat=True), "[^a-z0-9]+", " "))


def classify_form(c: Column) -> Column:
    """Lower case, folded, punctuation kept, white space collapsed."""
    return collapse(fold(F.lower(F.coalesce(c, F.lit("")))))


def clean_text(c: Column) -> Column:
    """Line ends as LF, runs of spaces and tabs as one space."""
    return pstrip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), "[ \t]+", " "))


def phrases(words: list[str]) -> Column:
    return F.array(*map(F.lit, dict.fromkeys(words)))


def bound(c: Column, f) -> Column:
    """f of c, in which c is computed once, however often f reads it or runs a lambda over it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def filled(c: Column) -> Column:
    """Null for an empty text; c is computed once, also within a lambda, where nullif() computes it twice."""
    return bound(c, lambda x: F.when(x != "", x))


def any_phrase(c: Column, words: list[str]) -> Column:
    return bound(c, lambda t: F.exists(phrases(words), lambda w: F.contains(t, w)))


def matches(c: Column, words: list[str]) -> Column:
    """The phrases that are in c, in the order of the list."""
    return bound(c, lambda t: F.filter(phrases(words), lambda w: F.contains(t, w)))


def dedup_bullets(c: Column) -> Column:
    """Parts between bullets, each once; blank text stays as it is."""
    parts = F.filter(F.transform(F.split(c, "•"), pstrip), lambda x: x != "")
    return F.when(pstrip(c) == "", c).otherwise(F.array_join(F.array_distinct(parts), " • "))


def split_trimmed(c: Column, separator: str = ",") -> Column:
    return F.transform(F.split(c, separator), pstrip)


def joined(values: Column, separator: str = ", ") -> Column:
    """Non-blank values joined; null if none."""
    return F.nullif(F.array_join(F.filter(F.transform(values, pstrip), lambda x: x.isNotNull() & (x != "")), separator), F.lit(""))


def text_or(c: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def as_list(c: Column) -> Column:
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def shortened(c: Column, size: int) -> Column:
    return F.substr(c, F.lit(1), F.lit(size))
