"""Column helpers that the native operators share.

Higher-order functions are interpreted, so what counts is work per word: texts are split at single spaces (which needs
no regular expression), runs of words are hashed by index, and whatever is used twice is bound once by ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: All ASCII but letters, digits and the space.
NOT_ALNUM = r"[\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row however often the body uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case and nothing else changed; lower() is used only where it does the same and is faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _at_spaces(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and any characters beyond ASCII; null has none."""

    def words(t: Column) -> Column:
        ascii_only = F.octet_length(t) == F.char_length(t)
        return F.when(ascii_only, _at_spaces(F.lower(t))).otherwise(F.transform(_at_spaces(t), lower_ascii))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_ALNUM, " "), words)


def spaced(text: Column) -> Column:
    """The text with all ASCII white space as spaces; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return _at_spaces(spaced(text))


def grams(words: Column, k: int, salt: int = 0) -> Column:
    """Hashes of all runs of k words, in order; empty where there are fewer words.

    Hashes of single words are paired into those of 2, 4, 8 ... words, and two of these that overlap make k.
    """
    shifted = lambda a, by: F.slice(a, F.lit(by + 1), F.size(a))

    def widen(part: Column, have: int) -> Column:
        if have == k:
            return part
        by = min(have, k - have)
        return let(part, lambda a: widen(F.zip_with(a, shifted(a, by), lambda x, y: F.xxhash64(x, y)), have + by))

    hashes = widen(F.transform(words, lambda w: F.xxhash64(F.lit(salt), w)), 1)
    return let(hashes, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0))))
