"""Train, validation and test splits that keep groups whole."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RATIOS, SPLITS, check_ratios
from ..functions.names import fresh
from ..session import materialise
from .ordered import running_total
from .sampling import seeded_order

#: Groups that one task walks.
PIECE = 250_000


def split_targets(counts: DataFrame, by: list[str], ratios=RATIOS) -> DataFrame:
    """Rows wanted in each split: train and validation by rounding half to even, test what is left."""
    train = F.rint(F.col("total") * F.lit(float(ratios[0]))).cast("bigint")
    validation = F.rint(F.col("total") * F.lit(float(ratios[1]))).cast("bigint")
    return counts.select(*by, "total", train.alias("train"), validation.alias("validation"), (F.col("total") - train - validation).alias("test"))


def prefix_sum_split(groups: DataFrame, by: str, key: str, n: str, seed: int, ratios=RATIOS) -> DataFrame:
    """Groups (by, key, n) with their split: in seeded order, train until it has its target, then validation, then test.

    The sequential rule as prefix sums: where the running total of rows before a group has not reached the train
    target it goes to train; the sum train ended up with shifts the same test for validation. The seeded order is one
    of hashes, so their first digits deal a class's groups into parts of like size in that order; a part adds up for
    itself, and a small table of the parts' sums gives what lies before it.
    """
    check_ratios(*ratios)
    groups = groups.select(by, key, n)
    out = materialise(groups.withColumn("_o", seeded_order(seed, F.col(key))).withColumn("_p", F.substring("_o", 1, 3)), "split-order")
    sums = out.groupBy(by, "_p").agg(F.sum(n).alias("_sum"))
    earlier = W.partitionBy(by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(by, "_p", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.sum("_sum").over(W.partitionBy(by)).alias("_total"))
    inside = F.sum(n).over(W.partitionBy(by, "_p").orderBy("_o", key))
    out = out.withColumn("_inside", inside).join(sums, [by, "_p"]).withColumn("_cum", F.col("_base") + F.col("_inside")).withColumn("_before", F.col("_cum") - F.col(n))
    out = out.withColumn("_train", F.rint(F.col("_total") * F.lit(float(ratios[0])))).withColumn("_val", F.rint(F.col("_total") * F.lit(float(ratios[1]))))
    reached = out.groupBy(by).agg(F.min(F.when(F.col("_cum") >= F.col("_train"), F.col("_cum"))).alias("_reached"))
    out = out.join(reached, by).withColumn("_got", F.when(F.col("_train") <= 0, F.lit(0)).otherwise(F.coalesce("_reached", "_total")))
    split = F.when(F.col("_before") < F.col("_train"), "train").when(F.col("_before") - F.col("_got") < F.col("_val"), "validation").otherwise("test")
    return out.select(by, key, n, split.alias("split"))


def shared_groups(rows: DataFrame, key: str, label: str = "class_name") -> DataFrame:
    """(key, n_real, n_fake): both classes' groups merged on their key; a missing side counts 0."""
    count = lambda c: F.count_if(F.col(label) == c)
    return rows.groupBy(key).agg(count("real").alias("n_real"), count("fake").alias("n_fake"))


def grouped_greedy_split(groups: DataFrame, key: str, seed: int, ratios=RATIOS) -> DataFrame:
    """Shared groups (key, n_real, n_fake) with a split: each, in seeded order, to the split that would be least full.

    A group that is needed to give an empty split its first one goes to such a split. Each choice depends on all
    before it: groups are numbered in that order by ranges, and walked a piece of at most PIECE groups at a time, each
    in a task of its own that begins with the six counters the one before it ended with; members never meet there.
    """
    check_ratios(*ratios)
    totals = groups.agg(F.sum("n_real").alias("r"), F.sum("n_fake").alias("f"), F.count("*").alias("k")).first()
    wanted = []
    for total in (totals["r"] or 0, totals["f"] or 0):
        train, validation = round(total * ratios[0]), round(total * ratios[1])
        wanted.append([max(x, 1) for x in (train, validation, total - train - validation)])
    n_groups = int(totals["k"])
    kind = groups.schema[key].dataType.simpleString()
    names = [key, "n_real", "n_fake"]

    def walker(have: list[list[int]], seen: int):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, at = [list(x) for x in have], seen
            for b in batches:
                chosen = []
                for real, fake in zip(b.column("n_real").to_pylist(), b.column("n_fake").to_pylist()):
                    empty = [i for i in range(3) if not counts[0][i] and not counts[1][i]]
                    open_ = empty if empty and n_groups - at - 1 < len(empty) else range(3)
                    s = min(open_, key=lambda i: ((counts[0][i] + real) / wanted[0][i] + (counts[1][i] + fake) / wanted[1][i], i))  # noqa: B023
                    counts[0][s] += real
                    counts[1][s] += fake
                    at += 1
                    chosen.append(SPLITS[s])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(chosen, pa.string())], [*names, "split"])

        return walk

    (order,) = fresh(names, "_order")
    rows = groups.select(F.col(key), F.col("n_real").cast("bigint").alias("n_real"), F.col("n_fake").cast("bigint").alias("n_fake"))
    rows = rows.withColumn(order, F.struct(seeded_order(seed, F.col(key)), F.col(key).cast("string")))
    (place,) = fresh(rows.columns, "_place")
    rows = materialise(running_total(rows, [order], name=place), "split-order")
    have, parts, ddl = [[0, 0, 0], [0, 0, 0]], [], f"`{key}` {kind}, n_real bigint, n_fake bigint, split string"
    for first in range(0, max(1, n_groups), PIECE):
        piece = rows.where(F.col(place).between(first, first + PIECE - 1)).repartition(1).sortWithinPartitions(place).select(*names)
        done = materialise(piece.mapInArrow(walker(have, first), ddl), "split-piece")
        parts.append(done)
        if first + PIECE < n_groups:
            for r in done.groupBy("split").agg(F.sum("n_real").alias("r"), F.sum("n_fake").alias("f")).collect():
                i = SPLITS.index(r["split"])
                have[0][i] += r["r"]
                have[1][i] += r["f"]
    return reduce(DataFrame.unionByName, parts)
