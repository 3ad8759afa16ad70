"""Exact and near duplicates of labelled candidates.

A candidate has path, split, class_name and md5, and for near duplicates a 64-bit hash. Rows of one digest are never
brought together: a group's facts are aggregated (with partial sums in every task) and joined back, a join that
adaptive execution can split where one digest holds much of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NEAR_THRESHOLDS, SPLIT_PRIORITY, CurationError
from ..functions.arrays import hamming
from ..functions.names import fresh
from ..session import materialise

#: Most rows that one hash puts into a shuffle, on both sides together, where a limit can be kept within that.
MAX_ROWS = 64
#: How many comparisons of a joined pair a shuffled row is worth.
ROW_COST = 40
#: Comparisons from which a join is refused.
MAX_COMPARISONS = 10**15
#: About how many classes of one hash are paired with those of another in a row.
BLOCK = 64


def split_priority(split: Column) -> Column:
    out = None
    for name, rank in SPLIT_PRIORITY.items():
        out = F.when(split == name, rank) if out is None else out.when(split == name, rank)
    return out


def visit_order(split: Column, path: Column) -> Column:
    """Test before validation before train, then by path without case, then by path."""
    return F.struct(split_priority(split).alias("priority"), F.lower(path).alias("folded"), path.alias("path"))


def exact_decisions(candidates: DataFrame) -> DataFrame:
    """candidates with ``decision``: kept, cross_class (labels of equal files contradict: all go), same_split or cross_split."""
    order = visit_order(F.col("split"), F.col("path"))
    (group,) = fresh(candidates.columns, "_group")
    facts = F.struct(F.min("class_name").alias("low"), F.max("class_name").alias("high"), F.min(order).alias("first"), F.min_by("split", order).alias("split"))
    of = lambda name: F.col(f"{group}.{name}")
    decision = (
        F.when(of("low") != of("high"), "cross_class")
        .when(F.col("path") == of("first.path"), "kept")
        .when(F.col("split") == of("split"), "same_split")
        .otherwise("cross_split")
    )
    return candidates.join(candidates.groupBy("md5").agg(facts.alias(group)), "md5").select(*(f"`{c}`" for c in candidates.columns if c != "decision"), decision.alias("decision"))


def exact_survivors(candidates: DataFrame) -> DataFrame:
    return exact_decisions(candidates).where("decision = 'kept'").drop("decision")


def exact_stats(candidates: DataFrame) -> DataFrame:
    """One row of counters; unreadable rows (no digest) are counted but are no part of removed_total."""
    counted = lambda what: F.count_if(F.col("decision") == what)
    decided = exact_decisions(candidates.where(F.col("md5").isNotNull()))
    row = decided.agg(
        counted("same_split").alias("exact_same_class_same_split"),
        counted("cross_split").alias("exact_cross_split"),
        counted("cross_class").alias("exact_cross_class"),
    )
    lost = candidates.agg(F.count("*").alias("scanned"), F.count_if(F.col("md5").isNull()).alias("unreadable"))
    total = F.col("exact_same_class_same_split") + F.col("exact_cross_split") + F.col("exact_cross_class")
    return lost.crossJoin(row).select("scanned", "unreadable", "exact_same_class_same_split", "exact_cross_split", "exact_cross_class", total.alias("removed_total"))


def dedup_stats(candidates: DataFrame, survivors: DataFrame) -> DataFrame:
    """One row of counters for exact and near dedup together; survivors are those of both.

    Unreadable rows (no digest, or no hash once exact duplicates are out) are neither removed nor kept.
    """
    exact = exact_stats(candidates)
    unhashed = exact_survivors(candidates).agg(F.count_if(F.col("hash").isNull()).alias("unhashed"))
    kept = survivors.agg(F.count("*").alias("kept"))
    out = exact.crossJoin(unhashed).crossJoin(kept)
    unreadable = F.col("unreadable") + F.col("unhashed")
    near = F.col("scanned") - unreadable - F.col("removed_total") - F.col("kept")
    return out.select(
        "scanned", unreadable.alias("unreadable"), "exact_same_class_same_split", "exact_cross_split", "exact_cross_class", near.alias("near_removed"), (F.col("removed_total") + near).alias("removed_total")
    )


def simhash_table(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 60) -> DataFrame:
    """(key, hash): the sign of the sum, over distinct words, of each bit of their digests.

    One pass of sums instead of a row per word and bit. A sum counts two bits of the digests, one in each half of a
    long, so that there are half as many and what is compiled stays small.
    """
    half = (bits + 1) // 2
    plain = F.lower(F.col(text))
    for c in "\n\t\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    words = docs.select(key, F.explode(F.array_distinct(F.split(plain, " "))).alias("w")).where("w <> ''")
    words = words.select(key, F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, bits // 4), 16, 10).cast("bigint").alias("h"))
    pair = F.lit(1 | 1 << half)
    ones = [F.sum(F.shiftright("h", i).bitwiseAND(pair)).alias(f"b{i}") for i in range(half)]
    value = F.lit(0).cast("bigint")
    for bit in range(bits):
        sums = F.col(f"b{bit % half}")
        count = F.shiftright(sums, half) if bit >= half else sums.bitwiseAND(F.lit((1 << half) - 1))
        value = value + F.when(count * 2 > F.col("n"), F.lit(1 << bit)).otherwise(F.lit(0).cast("bigint"))
    return words.groupBy(key).agg(F.count("*").alias("n"), *ones).select(key, value.alias("hash"))


def check_threshold(threshold: int) -> None:
    if threshold not in NEAR_THRESHOLDS:
        raise CurationError(f"the distance limit must be one of {NEAR_THRESHOLDS}, so that 64 bits part into equal bands")


class Band(NamedTuple):
    """Bits of a hash, from ``shift`` on, and how many of them a probe may flip."""

    shift: int
    width: int
    flips: int

    @property
    def probes(self) -> int:
        return sum(comb(self.width, k) for k in range(self.flips + 1))


def probe_plan(threshold: int, bits: int, n: int) -> list[Band]:
    """Bands in which any two hashes within the limit meet, one of them probing with a few bits flipped.

    Of bands that allow f1, f2 ... flips, two hashes differ by no more than that in one of them if the (f + 1) sum up to
    the limit + 1. Few, wide bands with flips cost rows in the shuffle, many narrow ones cost comparisons of chance
    candidates; both together, for n random hashes, decide, with at most MAX_ROWS rows a hash. So at 60 bits a limit of
    3 takes up to 64 rows and less than 60 comparisons a hash at 10^9 hashes. A limit of 7 takes 49 rows but some
    6 * 10^6 comparisons there: wider bands would save these for a shuffle of thousands of rows a hash, which is worse.
    The result is the same whichever plan is taken.
    """

    def plans() -> Iterator[list[Band]]:
        for m in range(1, min(threshold + 1, bits) + 1):
            flips, more = divmod(threshold + 1, m)
            for extra in range(9 if more else 1):  # bits by which a band with one more flip is wider
                base, rest = divmod(bits - more * extra, m)
                widths = [base + (i < rest) + (extra if i < more else 0) for i in range(m)]
                if base > 0:
                    yield [Band(sum(widths[:i]), w, flips - 1 + (i < more)) for i, w in enumerate(widths)]

    def rows(plan: list[Band]) -> int:
        return sum(b.probes + 1 for b in plan)

    fit = [x for x in plans() if rows(x) <= MAX_ROWS] or [min(plans(), key=rows)]
    return min(fit, key=lambda x: rows(x) * ROW_COST + comparisons(x, n))


def comparisons(plan: list[Band], n: int) -> float:
    """Chance candidates of a hash among n random ones."""
    return n * sum(b.probes / 2**b.width for b in plan)


def _part(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def near_join(left: DataFrame, right: DataFrame, threshold: int, *, bits: int = 64, n: int | None = None) -> DataFrame:
    """Rows of left (h, ...) with rows of right (g, ...) whose hashes are within threshold bits, and the ``distance``.

    Hashes use their lowest ``bits`` bits. Right rows stand in every band by their own bits, left rows also by those
    with a few of them flipped (``probe_plan``). A pair that meets in several bands counts in the first, so nothing
    has to be made distinct afterwards. Both sides are shuffled by band, a join that adaptive execution may split.
    There is no way of this kind that stays far below all pairs for limits of a quarter of the bits (15 of 60): a join
    of more than MAX_COMPARISONS is refused.
    """
    if n is None:
        n = max(left.count(), right.count())
    plan = probe_plan(threshold, bits, n)
    if n * comparisons(plan, n) > MAX_COMPARISONS:
        raise CurationError(f"a limit of {threshold} of {bits} bits is too wide for {n} hashes: {n * comparisons(plan, n):.0e} comparisons")
    probes, stands = [], []
    for i, (shift, width, flips) in enumerate(plan):
        masks = [sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in combinations(range(width), k)]
        masks = F.expr("array(" + ",".join(f"{x if x < 1 << 63 else x - (1 << 64)}L" for x in masks) + ")")
        part = lambda c: _part(F.col(c), shift, width)  # noqa: B023, E731
        entry = lambda p: F.struct(F.lit(i).alias("band"), p.alias("part"))  # noqa: B023, E731
        probes.append(F.transform(masks, lambda x: entry(part("h").bitwiseXOR(x))))  # noqa: B023
        stands.append(entry(part("g")))
    probe, band, bits_there = fresh((*left.columns, *right.columns), "_probe", "_band", "_bits")
    dealt = lambda df, entries: df.withColumn(probe, F.explode(entries)).withColumns({band: F.col(f"{probe}.band"), bits_there: F.col(f"{probe}.part")}).drop(probe)
    differs = F.col("h").bitwiseXOR(F.col("g"))
    earlier = F.lit(True)
    for i, (shift, width, flips) in enumerate(plan[:-1]):
        earlier = earlier & ((F.col(band) <= i) | (F.bit_count(_part(differs, shift, width)) > flips))
    both = dealt(left, F.concat(*probes)).join(dealt(right, F.array(*stands)), [band, bits_there]).withColumn("distance", hamming(F.col("h"), F.col("g")))
    return both.where((F.col("distance") <= threshold) & earlier).drop(band, bits_there)


def banded_pairs(values: DataFrame, threshold: int, key: str = "key", value: str = "hash", *, bits: int = 64) -> DataFrame:
    """(a, b, distance) with a < b of all keys within threshold bits.

    Keys with equal values multiply: this is for values that are distinct or nearly so; else see ``collapsed_pairs``.
    """
    check_threshold(threshold)
    left = values.where(F.col(value).isNotNull()).select(F.col(key).alias("a"), F.col(value).alias("h"))
    right = values.where(F.col(value).isNotNull()).select(F.col(key).alias("b"), F.col(value).alias("g"))
    return near_join(left, right, threshold, bits=bits, n=left.count()).where(F.col("a") < F.col("b")).select("a", "b", "distance")


def collapsed_pairs(values: DataFrame, threshold: int, key: str = "key", value: str = "hash", *, bits: int = 64) -> DataFrame:
    """(a, b, distance) that link the same keys as ``banded_pairs``, in rows that grow with the keys, not their square.

    The least key of each value stands for it: it has a pair with every other key of the value, at distance 0, and the
    pairs with those that stand for near values.
    """
    check_threshold(threshold)
    rows = values.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("h"))
    nodes = materialise(rows.groupBy("h").agg(F.min("k").alias("k")), "near-values")
    near = banded_pairs(nodes, threshold, "k", "h", bits=bits)
    copies = rows.join(nodes.select("h", F.col("k").alias("first")), "h").where(F.col("k") != F.col("first"))
    return near.unionByName(copies.select(F.col("first").alias("a"), F.col("k").alias("b"), F.lit(0).alias("distance")))


def class_pairs(values: DataFrame, threshold: int, key: str = "key", value: str = "hash", same: str = "md5", *, bits: int = 64) -> DataFrame:
    """(a, b, distance, is_copy): every pair of ``banded_pairs`` between keys that differ in ``same``, told once for their copies.

    Keys that agree in value and in ``same`` are copies; the least one stands for their class and has a row with each
    other (is_copy). All classes within threshold bits of each other have a pair, those with equal values too. So
    ``banded_pairs`` follows from it: two keys are as far apart as the classes they are in.

    Each value is joined once, whatever it holds. Its classes are dealt into blocks of about BLOCK, and pairs of blocks
    are shuffled by both, so that a value that many classes share is no task of its own.
    """
    check_threshold(threshold)
    rows = values.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("h"), F.col(same).alias("t"))
    classes = materialise(rows.groupBy("h", "t").agg(F.min("k").alias("k")), "near-classes")
    nodes = materialise(classes.groupBy("h").agg(F.count("*").alias("n")).select("h", "n", F.ceil(F.col("n") / BLOCK).alias("m")), "near-values")
    blocks = classes.join(nodes, "h").groupBy("h", F.expr("pmod(xxhash64(k), m)").alias("i")).agg(F.collect_list("k").alias("x"))
    near = near_join(nodes.select("h", "m"), nodes.select(F.col("h").alias("g"), F.col("m").alias("w")), threshold, bits=bits, n=nodes.count())
    met = near.where("h < g").unionByName(nodes.where("n > 1").select("h", "m", F.col("h").alias("g"), F.col("m").alias("w"), F.lit(0).alias("distance")))
    each = lambda number, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(number) - 1)).alias(name)
    met = met.select("h", "g", "w", "distance", each("m", "i")).select("h", "i", "g", "distance", each("w", "j"))
    met = met.join(blocks, ["h", "i"]).join(blocks.toDF("g", "j", "y"), ["g", "j"])
    met = met.select("h", "g", "distance", "y", F.explode("x").alias("x")).select("h", "g", "distance", "x", F.explode("y").alias("y"))
    pairs = met.where((F.col("x") < F.col("y")) | (F.col("h") != F.col("g")) & (F.col("x") != F.col("y")))
    copies = rows.join(classes.toDF("g", "u", "first"), F.expr("h = g AND t <=> u AND k <> first")).select(F.col("first").alias("a"), F.col("k").alias("b"), F.lit(0).alias("distance"), F.lit(True).alias("is_copy"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance", F.lit(False).alias("is_copy")).unionByName(copies)


def greedy_survivors(pairs: DataFrame) -> DataFrame:
    """(key, kept) for every key in pairs (earlier, later): kept unless an earlier kept key is its neighbour.

    Not components: what is dropped drops nothing. Each round keeps the keys that are nobody's later one and drops
    their neighbours; pairs with a decided end leave. A round is one table in the shared folder, and they shrink: which
    keys it drops follows from the table alone.
    """

    def dropped(now: DataFrame) -> DataFrame:
        heads = now.select("earlier").distinct().join(now.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        return now.join(heads, "earlier", "left_semi").select("later").distinct()

    now = materialise(pairs.select("earlier", "later").distinct(), "greedy-pairs")
    keys = now.select(F.explode(F.array("earlier", "later")).alias("key")).distinct()
    rounds = []
    while not now.isEmpty():
        gone = dropped(now)
        rounds.append(gone)
        left = now.join(gone, "later", "left_anti").join(gone.withColumnRenamed("later", "earlier"), "earlier", "left_anti")
        now = materialise(left.select("earlier", "later"), "greedy-pairs")
    if not rounds:
        return keys.withColumn("kept", F.lit(True))
    gone = reduce(DataFrame.unionByName, rounds).select(F.col("later").alias("key"), F.lit(False).alias("kept"))
    return keys.join(gone, "key", "left").select("key", F.coalesce("kept", F.lit(True)).alias("kept"))


def near_survivors(candidates: DataFrame, threshold: int, value: str = "hash", *, bits: int = 64) -> DataFrame:
    """Candidates that no earlier survivor is within threshold bits of, whatever their class.

    Rows without a hash are unreadable and are no survivors (``dedup_stats`` counts them); otherwise a limit of 0
    changes nothing. Equal hashes are one node, placed where its first candidate is: only that one can survive.
    """
    candidates = candidates.where(F.col(value).isNotNull())
    if threshold <= 0:
        return candidates
    check_threshold(threshold)
    order = visit_order(F.col("split"), F.col("path"))
    nodes = materialise(candidates.groupBy(F.col(value).alias("h")).agg(F.min(order).alias("o")), "near-nodes")
    pairs = banded_pairs(nodes.withColumn("key", F.struct("o", "h")), threshold, value="h", bits=bits)
    verdict = greedy_survivors(pairs.select(F.col("a.h").alias("earlier"), F.col("b.h").alias("later")))
    gone = verdict.where(~F.col("kept")).select(F.col("key").alias("h"))
    kept = nodes.join(gone, "h", "left_anti").select(F.col("o.path").alias("path"))
    return candidates.join(kept, "path", "left_semi")
