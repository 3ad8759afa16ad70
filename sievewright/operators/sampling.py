"""Seeded, repeatable sampling: the order comes from a hash of seed and key, never from a row's place."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CurationError
from ..functions.names import fresh
from .ordered import running_total


def derived_seed(seed: Column | int, *parts: Column) -> Column:
    """A seed for each pool, so that changing one pool leaves the others' samples alone."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed.cast("string"), *parts), 256), 1, 12), 16, 10).cast("bigint")


def seeded_order(seed: Column | int, key: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), key).cast("binary"))


def seeded_cap(rows: DataFrame, key: str, cap: int | None, seed: int) -> DataFrame:
    """At most cap rows, by the seeded order; all of them where cap is none or 0. A top-k, so no full sort."""
    if not cap or cap <= 0:
        return rows
    return rows.orderBy(seeded_order(seed, F.col(key)), key).limit(cap)


def first_rows(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first rows in an order; all of them where most is none or not positive. A top-k, so no full sort."""
    return rows.orderBy(*order).limit(most) if most and most > 0 else rows


def in_batches(rows: DataFrame, key: str, batch_size: int, seed: int | None = None) -> DataFrame:
    """rows with ``batch`` and ``place`` in it, both from 0: in order of the key, or shuffled by seed and key.

    The last batch may be short. Places come from running totals over ranges, so no task numbers all rows.
    """
    order = F.col(key).cast("string") if seed is None else seeded_order(seed, F.col(key).cast("string"))
    first, at = fresh(rows.columns, "_order", "_at")
    placed = running_total(rows.withColumn(first, order), [first, key], name=at)
    return placed.select(*(f"`{c}`" for c in rows.columns), F.floor(F.col(at) / batch_size).cast("bigint").alias("batch"), (F.col(at) % batch_size).cast("int").alias("place"))


def ranked_in_pools(rows: DataFrame, pools: list[str], key: str, seed: int) -> DataFrame:
    """rows with ``rank`` from 1 in each pool's own seeded order."""
    order = [seeded_order(derived_seed(seed, *(F.col(p) for p in pools)), F.col(key)), F.col(key)]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*pools).orderBy(*order)))


def stratified_sample(rows: DataFrame, pools: list[str], key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """quota rows from every pool of quotas (pools, quota); a pool with fewer raises, it doesn't give fewer.

    Only the first quota rows of a pool are ever needed, which Spark's window group limit uses before the shuffle.
    """
    have = rows.groupBy(*pools).agg(F.count("*").alias("n"))
    short = quotas.join(have, pools, "left").where(F.coalesce("n", F.lit(0)) < F.col("quota")).limit(5).collect()
    if short:
        raise CurationError(f"pools with fewer rows than their quota: {[tuple(r) for r in short]}")
    most = int(quotas.agg(F.max("quota")).first()[0] or 0)
    ranked = ranked_in_pools(rows, pools, key, seed).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(quotas), pools).where(F.col("rank") <= F.col("quota")).drop("quota")


def compat_positions(n: int, count: int, seed: int) -> list[int]:
    """Places drawn by Python's generator from n sorted rows; depends on the three numbers only."""
    return list(range(n)) if count >= n else sorted(random.Random(seed).sample(range(n), count))


def even_positions(total: Column, most: Column) -> Column:
    """Places, from 0, spread evenly over total rows, at most ``most``; ends included, halves rounded to even."""
    spread = F.transform(
        F.sequence(F.lit(0), most - 1), lambda i: F.rint(i.cast("double") * ((total - 1).cast("double") / (most - 1).cast("double"))).cast("int")
    )
    return (
        F.when(total <= 0, F.array().cast("array<int>"))
        .when((most <= 0) | (most >= total), F.sequence(F.lit(0), total - 1))
        .when(most == 1, F.array(F.lit(0)))
        .otherwise(F.array_sort(F.array_distinct(spread)))
    )
