"""Benchmark decontamination by winnowing.

Every text gives a fingerprint: of the hashes of its k-word grams, the smallest in each window of w = window - k + 1
grams, leftmost on ties. Two texts that share ``window`` words in a row share such a window of grams, hence a kept
gram, so joining fingerprints finds every shared span; from a shared gram the match is extended word by word to both
sides, and counts where it reaches ``window`` words. Items shorter than that are one gram of their own length.

The benchmark's fingerprints are the only data that is broadcast. They are counted first; beyond ``block_rows`` they
are dealt by hash into as many blocks as keep under it, each joined to the documents in turn. On the documents' side
the order of the two tests is turned round, since looking up a hash is cheaper than comparing it to its neighbours:
every gram is looked up, and those found must then be the smallest of a window of their own text. Both tests hold for
the same rows either way. Documents are read and tokenised by one scan a block; only matching rows are shuffled.

Defined cases: null or empty text has no words and is clean; an item without words, without an id or with null text is
ignored; rows equal in document id and text count as one document; rows with one id and different texts each get
their row; no benchmark at all leaves every document clean, no documents give an empty result; texts of any number of
words are read whole, in time linear in it; other columns of either table play no part.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import alnum_words, let

WINDOW = 10
GRAM = 5
#: Most rows of benchmark fingerprints broadcast at once, some 300 bytes each.
BLOCK_ROWS = 200_000


def winnow(hashes: Column, width: int) -> Column:
    """Places (from 1) of the smallest hash in each window of width hashes, leftmost on ties, each once.

    A window's place never lies before its predecessor's, so repeats are dropped by looking one window back.
    """

    def place(h: Column, s: Column) -> Column:
        at = [h if j == 0 else F.get(hashes, s + j) for j in range(width)]
        least = F.least(*at)
        out = s + width
        for j in reversed(range(width - 1)):
            out = F.when(at[j] == least, s + (j + 1)).otherwise(out)
        return out

    def once(places: Column) -> Column:
        return F.filter(places, lambda p, i: (i == 0) | (p != F.get(places, i - 1)))

    places = F.slice(F.transform(hashes, place), F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    return let(places, once)


def runs(words: Column, k: int) -> Column:
    """Hashes of all runs of k words of a short text, made as ``find_spans`` makes them row by row."""
    each = F.transform(words, lambda w, i: F.xxhash64(F.lit(0), w, *(F.get(words, i + j) for j in range(1, k))))
    return F.slice(each, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def _entry(place: Column, length: int, fp: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), F.lit(length).alias("length"), fp.alias("fp"))


def long_prints(words: Column, window: int, gram: int) -> Column:
    """The fingerprint of a text of ``window`` words or more, as (place, length, fp)."""
    return let(runs(words, gram), lambda h: F.transform(winnow(h, window - gram + 1), lambda p: _entry(p, gram, F.get(h, p - 1))))


def _around(words: Column, place: Column, length: Column, reach: int) -> Column:
    """The gram, and up to reach words before (nearest first) and after it."""
    first = F.greatest(F.lit(1), place - reach)
    return F.struct(
        F.slice(words, place, length).alias("gram"),
        F.reverse(F.slice(words, first, place - first)).alias("before"),
        F.slice(words, place + length, F.lit(reach)).alias("after"),
    )


def _equal_from_start(a: Column, b: Column) -> Column:
    def count(same: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("bigint")) - 1, F.size(same).cast("bigint"))

    return let(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), count)


def benchmark_prints(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(fp, length, item_id, around) of all items."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("words")
    )
    one = lambda w: F.array(F.struct(F.lit(1).alias("place"), F.size(w).alias("length"), _salted(w, window).alias("fp")))
    prints = let(F.col("words"), lambda w: F.when(F.size(w) >= window, long_prints(w, window, gram)).otherwise(one(w)))
    rows = items.where(F.size("words") > 0).select("item_id", "words", F.explode(prints).alias("e"))
    return rows.select(
        F.col("e.fp").alias("fp"), F.col("e.length").alias("length"), (F.size("words") >= window).alias("long"), "item_id",
        _around(F.col("words"), F.col("e.place"), F.col("e.length"), window - gram).alias("item"),
    ).distinct()


def _salted(words: Column, window: int) -> Column:
    out = F.lit(None).cast("bigint")
    for n in range(1, window):
        out = F.when(F.size(words) == n, F.xxhash64(F.lit(n), F.slice(words, F.lit(1), F.lit(n)))).otherwise(out)
    return out


def find_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document: doc_id, text_key, n_words, spans (array of first and last word, from 1, none merged), items (sorted ids)."""
    prints = benchmark_prints(benchmark, window, gram)
    facts = prints.agg(F.count("*").alias("n"), F.collect_set(F.when(~F.col("long"), F.col("length"))).alias("short")).first()
    blocks = max(1, ceil(facts["n"] / block_rows))
    reach = window - gram
    words, at = F.col("words"), F.col("at")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), alnum_words(F.col("text")).alias("words"))
    rows = base.select("doc_id", "text_key", "words", F.posexplode_outer("words").alias("at", "word"))

    def seed(length: int, salt: int) -> Column:
        run = F.xxhash64(F.lit(salt), *(F.get(words, at + j) for j in range(length)))
        return F.struct(F.lit(length).alias("length"), F.when(at + length <= F.size(words), run).alias("fp"))

    seeds = [seed(gram, 0), *(seed(n, n) for n in sorted(facts["short"]))]
    rows = rows.withColumn("e", seeds[0] if len(seeds) == 1 else F.explode(F.array(*seeds)))
    rows = rows.select("doc_id", "text_key", "words", "at", F.col("e.length").alias("length"), F.col("e.fp").alias("fp"))

    def block(b: int) -> DataFrame:
        mine = prints if blocks == 1 else prints.where(F.pmod(F.col("fp"), F.lit(blocks)) == b)
        found = rows.join(F.broadcast(mine), ["fp", "length"], "left")
        found = found.where(F.col("at").isNull() | (at == 0) | F.col("item_id").isNotNull())
        place = F.coalesce(at, F.lit(0)) + 1
        return found.select(
            "doc_id", "text_key", place.alias("place"), "length", "long", "item_id", "item",
            F.greatest(F.size("words"), F.lit(0)).cast("bigint").alias("n_words"),
            F.when(F.col("item_id").isNotNull(), _around(words, place, F.col("length"), reach)).alias("doc"),
        )

    found = reduce(DataFrame.unionByName, (block(b) for b in range(blocks)))
    left = F.when(F.col("long"), _equal_from_start(F.col("doc.before"), F.col("item.before"))).otherwise(F.lit(0).cast("bigint"))
    right = F.when(F.col("long"), _equal_from_start(F.col("doc.after"), F.col("item.after"))).otherwise(F.lit(0).cast("bigint"))
    found = found.select(
        "doc_id", "text_key", "n_words", "place", "length", "item_id",
        (~F.col("long") | _is_print(F.col("doc"), window, gram)).alias("kept"),
        (F.col("doc.gram") == F.col("item.gram")).alias("same"), left.alias("left"), right.alias("right"), "long",
    )
    hit = F.col("kept") & F.col("same") & (~F.col("long") | (F.col("left") + F.col("right") + F.col("length") >= window))
    span = F.struct((F.col("place") - F.col("left")).alias("first"), (F.col("place") + F.col("length") - 1 + F.col("right")).alias("last"))
    return found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(hit, span))).alias("spans"),
        F.sort_array(F.collect_set(F.when(hit, F.col("item_id")))).alias("items"),
    )


def _is_print(doc: Column, window: int, gram: int) -> Column:
    """Whether the document's own fingerprint keeps the gram: all windows of grams that hold it lie in the words around it."""
    text = F.concat(F.reverse(doc["before"]), doc["gram"], doc["after"])
    kept = let(text, lambda w: let(runs(w, gram), lambda h: winnow(h, window - gram + 1)))
    return F.when(F.size(text) >= window, F.array_contains(kept, F.size(doc["before"]) + 1)).otherwise(F.lit(False))


def covered(spans: Column) -> Column:
    """Words that sorted spans cover together."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["last"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], s["first"] - 1)).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, spans, items and the verdict ``contaminated``."""
    spans = find_spans(docs, benchmark, **options)
    return spans.withColumn("n_hit", covered(F.col("spans"))).withColumn("contaminated", F.col("n_hit") > 0)
