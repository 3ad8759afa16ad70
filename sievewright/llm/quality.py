"""Quality rules: repetition and length rules, then divergence from a reference of the document's language.

Two histograms of a document, its character classes and its common words, are held against the reference of its
language by Jensen-Shannon distance (the root of the divergence in base 2, so 0 to 1); both distances together, as the
root of the sum of their squares, make the verdict. Short documents are not judged by a histogram: a guard
for each asks for a least number of characters or words. All of it is column expressions over one row: no shuffle,
no Python, so it runs at the speed of the scan at any size.

Defined cases: null or empty text has no words, hence fails the base rules; a text of null or unknown language has no
reference, so it is judged by the base rules alone and its distances are 0; regions and scripts of a language code
("en-GB", "de_AT") play no part; repeated rows each get their row; texts of any length are judged whole, in n log n;
an empty table gives an empty result; other columns of the input are kept, whatever their names, but one of the
result's name (``quality``) gives way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from .columns import grams, let, spaced

# Shares of character classes in ordinary prose
# (lower-case and other letters, upper case, digits, white space, sentence marks, symbols, bytes beyond ASCII).
CLASSES = ("letters", "upper", "digits", "space", "marks", "symbols", "beyond")
CLASS_REFERENCE = {
    "en": (0.7952, 0.0138, 0.0006, 0.1667, 0.0237, 0.0005, 0.0000),
    "fr": (0.7077, 0.0104, 0.0008, 0.1667, 0.0238, 0.0005, 0.0906),
    "de": (0.7728, 0.0123, 0.0004, 0.1546, 0.0218, 0.0005, 0.0381),
    "es": (0.7243, 0.0120, 0.0008, 0.1616, 0.0230, 0.0005, 0.0782),
}
# Common words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with", "was", "on", "by", "be", "at", "are", "this", "from"),
    "fr": ("de", "la", "le", "les", "des", "et", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "avec", "pas"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
#: Share of running words that are common ones, for each language; the rest is one more bin.
COMMON_SHARE = {"en": 0.22, "fr": 0.22, "de": 0.21, "es": 0.21}

BANDS = 4
#: How common words share out over the bands.
BAND_PARTS = (0.58, 0.20, 0.125, 0.095)
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Root of the sum of both squared distances up to which a text passes: labelled good texts stay below 0.25, nearly all others lie above 0.32.
MAX_DISTANCE = 0.2828


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, in bits, of two arrays that each sum to 1."""

    def half(x: Column, y: Column) -> Column:
        mid = (x + y) / F.lit(2.0)
        return F.when(x > 0, F.lit(0.5) * x * F.log2(x / mid)).otherwise(F.lit(0.0))

    return F.aggregate(F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x)), F.lit(0.0), lambda a, x: a + x)


def repeated_words(hashes: Column, distinct: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text has twice or more; hashes are those of all windows.

    Windows are compared by 64-bit hashes within one text. Only texts with an equal pair go on: there (hash, place)
    pairs are sorted, places next to an equal hash are kept, and a fold over the sorted places adds up what they cover.
    That is n log n for any text.
    """

    def marks(s: Column) -> Column:
        twin = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twin, lambda x: x["p"]))

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + (p + WINDOW - F.greatest(a["end"], p))).alias("n"))
    covered = F.aggregate(let(ordered, marks), start, step)["n"]
    return F.when(F.size(distinct) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered)


def _remainder(text: Column) -> Column:
    """The text without lower-case ASCII letters and spaces: a twentieth of most texts, in which all other classes are counted."""
    return F.regexp_replace(text, r"[a-z\x20]+", "")


def _class_histogram(n_chars: Column, rest: Column, n_space: Column) -> Column:
    """Counts in the order of CLASSES."""
    upper, digits, marks = (F.regexp_count(rest, F.lit(x)) for x in (r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]"))
    odd = F.regexp_count(rest, F.lit(r"[\x00-\x08\x0E-\x1F#*$%&|<>+/=@\[\]\\^_`{}~\x7F]"))
    beyond = F.regexp_count(rest, F.lit(r"[^\x00-\x7F]"))
    others = (upper, digits, n_space, marks, odd, beyond)
    letters = n_chars - reduce(Column.__add__, others)
    return F.array(*(F.greatest(c.cast("double"), F.lit(0.0)) for c in (letters, *others)))


def _shares(counts: Column) -> Column:
    def scale(c: Column) -> Column:
        return let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    return let(counts, scale)


def _literal(values: tuple[float, ...] | list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _by_language(lang: Column, values: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for code, value in values.items():
        out = F.when(lang == code, value) if out is None else out.when(lang == code, value)
    return otherwise if out is None else out.otherwise(otherwise)


def class_references(table: dict[str, tuple[float, ...]] = CLASS_REFERENCE) -> dict[str, Column]:
    return {k: _literal([x / sum(v) for x in v]) for k, v in table.items()}


def _common_histogram(words: Column, lang: Column) -> Column:
    """Counts by rank in the list of common words, in bands of falling frequency, and of all other words."""

    def of(code: str) -> Column:
        known = COMMON_WORDS[code]
        width = len(known) // BANDS

        def count(common: Column) -> Column:
            within = lambda part: F.size(F.filter(common, lambda w: w.isin(*part)))
            bands = [within(known[i * width : (i + 1) * width]) for i in range(BANDS)]
            return F.array(*(c.cast("double") for c in (*bands, F.size(words) - F.size(common))))

        return let(F.filter(words, lambda w: w.isin(*known)), count)

    return _by_language(lang, {k: of(k) for k in COMMON_WORDS}, F.lit(None).cast("array<double>"))


def common_references() -> dict[str, Column]:
    """Zipf-like: each band of five words holds a falling part of COMMON_SHARE."""
    return {k: _literal([s * p for p in BAND_PARTS] + [1 - s]) for k, s in COMMON_SHARE.items()}


STEPS = ("n", "text", "rest", "lang", "words", "lines", "hashes", "classes", "common", "pieces", "space", "distinct", "repeat", "failed", "class_js", "common_js")


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_distance: float = MAX_DISTANCE,
    min_class_chars: int = 200,
    min_common_words: int = 50,
    name: str = "quality",
) -> DataFrame:
    """docs with a struct column, ``quality`` unless it is given another name, of counts, distances and the verdict (its fields are in the select below)."""
    own = dict(zip(STEPS, fresh(docs.columns, *(f"_quality_{x}" for x in STEPS))))  # names that docs has not
    n_words, text, rest, lang, words, lines, hashes, classes, common, pieces, space, distinct, repeat, failed, class_js, common_js = (F.col(own[x]) for x in STEPS)
    named = lambda **columns: {own[k]: v for k, v in columns.items()}
    # Columns in steps, not lambdas, wherever that will do: outside lambdas the functions are compiled.
    out = docs.withColumns(named(text=F.coalesce(F.col(text_col), F.lit("")), lang=F.lower(F.regexp_extract(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "^[^-_]*", 0))))
    out = out.withColumns(named(pieces=F.split(spaced(text), " "), lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), rest=_remainder(text)))
    # Each space parts two pieces, empty ones included, so their number gives the white space.
    out = out.withColumns(named(words=F.array_remove(pieces, ""), space=F.size(pieces) - 1))
    out = out.withColumns(named(hashes=grams(words, WINDOW), n=F.size(words), common=_shares(_common_histogram(words, lang))))
    n_chars, n_space = F.char_length(text), space
    out = out.withColumns(named(distinct=F.array_distinct(hashes), classes=_shares(_class_histogram(n_chars, rest, n_space))))
    out = out.withColumns(named(repeat=repeated_words(hashes, distinct)))
    against_class = _by_language(lang, {k: divergence(classes, v) for k, v in class_references().items()}, F.lit(0.0))
    against_common = _by_language(lang, {k: divergence(common, v) for k, v in common_references().items()}, F.lit(0.0))
    out = out.withColumns(
        named(
            failed=(n_words < min_words) | (F.lit(100) * repeat > F.lit(max_repeat_percent) * n_words),
            class_js=F.when(n_chars >= min_class_chars, against_class).otherwise(F.lit(0.0)),
            common_js=F.when(n_words >= min_common_words, against_common).otherwise(F.lit(0.0)),
        )
    )
    verdict = F.struct(
        n_words.cast("bigint").alias("n_words"),
        (n_chars - n_space).cast("bigint").alias("word_chars"),
        F.regexp_count(rest, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.sqrt(F.greatest(class_js, F.lit(0.0))).alias("class_distance"),
        F.sqrt(F.greatest(common_js, F.lit(0.0))).alias("common_distance"),
        (~failed & (class_js + common_js <= max_distance**2)).alias("kept"),
    )
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != name), verdict.alias(name))
