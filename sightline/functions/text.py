"""Text measures as native column expressions.

Regular expressions spell out their word characters (letters, decimal digits, underscore) instead of relying on what a
dialect means by \\w and \\b, so that every engine that knows Unicode classes gives the same counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word in word_count(): any letter or number, and the underscore.
NON_WORD = r"[^\p{L}\p{N}_]+"
#: Tokens of the content-quality scores (fixed).
TOKEN = r"[A-Za-z][A-Za-z'\-]*"
#: Names of two or more capitalised words, and numbers with an optional fraction and ordinal (fixed).
ENTITY = r"(?=[A-Z])\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
NUMBER = r"(?=\d)\b\d+(?:[.,]\d+)?(?:%|st|nd|rd|th)?\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it within a lambda."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Runs of letters, numbers or underscores; 0 for null."""
    words = F.split(text_or_empty(text), NON_WORD)
    return F.size(F.filter(words, lambda x: x != ""))


def spaced_words(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(text_or_empty(text), r"\s+"), "")


def tokens(text: Column) -> Column:
    """Lower-cased alphabetic tokens, with inner apostrophes and hyphens."""
    return F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), F.lit(0)), F.lower)


def matches(text: Column, pattern: str) -> Column:
    """Number of matches, none of which overlap."""
    return F.size(F.regexp_extract_all(text_or_empty(text), F.lit(pattern), F.lit(0)))


def any_phrase(phrases: list[str] | tuple[str, ...]) -> str:
    """A pattern of the texts that have one of the phrases, in one pass: it begins at the first space, comma or hyphen of each and
    the letter that follows, and then looks back. Phrases without these stand at their first letters."""
    starts: dict[str, dict[str, list[str]]] = {}
    for p in phrases:
        found = re.search("[ ,-]", p)
        at = found.start() if found else 0
        rest = re.escape(p[at + 2 :]) + (f"(?<={re.escape(p)})" if at else "")
        starts.setdefault(re.escape(p[at]), {}).setdefault(re.escape(p[at + 1 : at + 2]), []).append(rest)
    several = lambda parts: "(?:" + "|".join(parts) + ")"
    return f"(?=[{''.join(sorted(starts))}])" + several(c + several(x + several(rests) for x, rests in sorted(then.items())) for c, then in sorted(starts.items()))


def phrases_in(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    """The phrases that stand anywhere in the lower-cased text, each once, in the order given."""
    low, every = F.lower(text_or_empty(text)), F.array(*[F.lit(p) for p in phrases])
    found = lambda t: F.filter(every, lambda p: F.contains(t, p))
    return let(low, lambda t: F.when(t.rlike(any_phrase(phrases)), found(t)).otherwise(F.slice(every, 1, 0)))


def bigram_repetition(words: Column) -> Column:
    """Share of the different bigrams that stand twice or more; 0 for fewer than four words."""

    def share(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, i: (i > 0) & (F.get(pairs, i - 1) == x))
        return F.size(F.array_distinct(again)) / F.size(F.array_distinct(pairs))

    def pairs(w: Column) -> Column:
        rest = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
        both = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), rest, lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(w) < 4, F.lit(0.0)).otherwise(let(F.sort_array(both), share))

    return let(words, pairs)


def collapsed(text: Column) -> Column:
    """White space runs become one space; none at either end."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def truncated(text: Column, n: int) -> Column:
    """The first n characters, with three dots if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def escaped(text: Column) -> Column:
    """Text for use in XML: & < > and the double quote."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half away from zero after scaling: round(x 10^n) / 10^n."""
    return F.round(x * float(10**digits)) / float(10**digits) + F.lit(0.0)


def half_away(x: Column, digits: int = 0) -> Column:
    """half_up() as SQL has it: what is below zero and rounds to it stays below, as -0.0."""
    y = x * float(10**digits)
    return F.when(F.round(y) == 0, y * 0.0).otherwise(F.round(y) / float(10**digits))
