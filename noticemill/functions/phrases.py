"""Many phrases in one text: phrases under fragments that several of them share, looked for only where the fragments are.

A dictionary becomes groups: greedily the fragment that most phrases hold, and within its group those that tell them
apart. A text without a group's fragment is done with all its phrases at once. Groups are literals and the search is a few
higher-order functions over them, so that expressions stay as small as the list of phrases.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, phrases

SIZE = 5  # characters of a fragment
#: Letters of Portuguese, the rare ones first: a search compares a fragment only where its first letter is.
RARE_FIRST = "kwyxjzqhbfgvpltncmudriosea"


def _fragments(phrase: str, used: str) -> set[str]:
    """Fragments of one word of a phrase, as those across words are frequent in any text; the phrase itself if it has none."""
    found = {w[i : i + SIZE] for w in phrase.split() for i in range(len(w) - SIZE + 1)}
    return {f for f in found if f not in used} or {phrase}


@cache
def grouped(words: tuple[str, ...], used: str = "") -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(fragment, phrases that hold it), each phrase once: the fragment that covers most of what is left, of equals one with a rare first letter."""
    left, out = list(words), []
    while left:
        held: dict[str, int] = {}
        for w in left:
            for f in _fragments(w, used):
                held[f] = held.get(f, 0) + 1
        best = min(held, key=lambda f: (-held[f], RARE_FIRST.find(f[0]), f))
        own = tuple(w for w in left if best in _fragments(w, used))
        out.append((best, own))
        left = [w for w in left if w not in own]
    return tuple(out)


def _dictionary(words: list[str]) -> Column:
    """Array of (f, subs), subs an array of (f, words)."""
    subs = lambda used, own: F.array(*(F.struct(F.lit(f).alias("f"), phrases(list(w)).alias("words")) for f, w in grouped(own, used)))
    unique = tuple(dict.fromkeys(words))
    # a word that a group's phrases share tells nothing more within it
    shared = lambda f: " ".join({x for w in unique for x in w.split() if f in x})
    return F.array(*(F.struct(F.lit(f).alias("f"), subs(shared(f), own).alias("subs")) for f, own in grouped(unique)))


def indexed_lists(c: Column, lists: dict[str, list[str]]) -> Column:
    """Struct of the phrases of each list that are in c, in the order of the list; one search for all lists."""
    every = [w for words in lists.values() for w in words]

    def found(t: Column) -> Column:
        held = lambda x: F.contains(t, x["f"])
        within = lambda s: F.filter(s["words"], lambda w: F.contains(t, w))
        return F.flatten(F.transform(F.filter(_dictionary(every), held), lambda g: F.flatten(F.transform(F.filter(g["subs"], held), within))))

    def dealt(x: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.struct(*(F.when(F.size(x) > 0, F.array_intersect(phrases(words), x)).otherwise(none).alias(n) for n, words in lists.items()))

    return bound(c, lambda t: F.when(t.isNotNull(), bound(found(t), dealt)))


def indexed_matches(c: Column, words: list[str]) -> Column:
    """The phrases that are in c, in the order of the list, as text.matches() gives them."""
    return indexed_lists(c, {"found": words})["found"]


def any_indexed(c: Column, words: list[str]) -> Column:
    """Whether a phrase is in c, as text.any_phrase() says."""

    def found(t: Column) -> Column:
        within = lambda s: F.contains(t, s["f"]) & F.exists(s["words"], lambda w: F.contains(t, w))
        return F.exists(_dictionary(words), lambda g: F.contains(t, g["f"]) & F.exists(g["subs"], within))

    return bound(c, found)
