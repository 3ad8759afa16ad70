"""Audits of selections, splits and manifests; each gives rows (check_name, passed) or the offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSES, SPLITS
from ..functions.arrays import at_most
from ..functions.names import fresh
from ..functions.text import component_id, stem
from ..session import materialise
from .dedup import near_join

#: Most members of a group that is written as one row.
MEMBERS = 100_000
PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


def dense_counts(rows: DataFrame, split: str = "split", label: str = "class_name") -> DataFrame:
    """(split, class_name, n) with a row for every cell, 0 where nothing is."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(s, c) for s in SPLITS for c in CLASSES], "split string, class_name string")
    have = rows.groupBy(F.col(split).alias("split"), F.col(label).alias("class_name")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(have, ["split", "class_name"], "left").select("split", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


def class_counts(rows: DataFrame, split: str) -> DataFrame:
    """(class_name, n) of one split, 0 where a class has nothing."""
    return dense_counts(rows).where(F.col("split") == split).select("class_name", "n")


def group_members(rows: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, n, members): the paths of each group in order, as one text; a group of more than MEMBERS fails."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).where(at_most(F.col("n"), MEMBERS, "members of one group")).select(key)
    return rows.join(sizes, key).groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(path)), ",").alias("members"))


def rollup_counts(rows: DataFrame) -> DataFrame:
    """Counts by split and class, by split, and of all; '(all)' stands for what is summed over."""
    out = rows.rollup("split", "class_name").agg(F.count("*").alias("n"), F.grouping("split").alias("gs"), F.grouping("class_name").alias("gc"))
    name = lambda c, g: F.when(F.col(g) == 1, "(all)").otherwise(F.col(c)).alias(c)
    return out.select(name("split", "gs"), name("class_name", "gc"), "n")


def grouping_totals(rows: DataFrame) -> DataFrame:
    """The one-dimensional totals: by split, by class, and of all."""
    out = rows.cube("split", "class_name").agg(F.count("*").alias("n"), F.grouping("split").alias("gs"), F.grouping("class_name").alias("gc"))
    name = lambda c, g: F.when(F.col(g) == 1, "(all)").otherwise(F.col(c)).alias(c)
    return out.where((F.col("gs") == 1) | (F.col("gc") == 1)).select(name("split", "gs"), name("class_name", "gc"), "n")


def leaked_groups(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split, with those splits."""
    per = rows.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("found"))
    return per.where(F.size("found") > 1).select(key, F.array_join("found", ",").alias("splits"))


def leakage_summary(rows: DataFrame, key: str) -> DataFrame:
    per = rows.groupBy(key).agg(F.count_distinct("split").alias("k"))
    return per.agg(F.count("*").alias("group_count"), F.count_if(F.col("k") > 1).alias("leaked_count")).withColumn("ok", F.col("leaked_count") == 0)


def split_intersections(rows: DataFrame, key: str) -> DataFrame:
    """For each pair of splits, how many groups they share."""
    per = rows.groupBy(key).agg(F.collect_set("split").alias("found"))
    both = [F.count_if(F.array_contains("found", a) & F.array_contains("found", b)) for a, b in PAIRS]
    one = per.agg(*(c.alias(f"n{i}") for i, c in enumerate(both)))
    rows_ = F.array(*(F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"n{i}").alias("shared")) for i, (a, b) in enumerate(PAIRS)))
    return one.select(F.inline(rows_))


def _in_splits(rows: DataFrame, value: str, split: str) -> DataFrame:
    """(h, s): distinct hashes and the splits they occur in, as bits."""
    bit = F.lit(0)
    for i, name in enumerate(SPLITS):
        bit = F.when(F.col(split) == name, 1 << i).otherwise(bit)
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("h")).agg(F.bit_or(bit).cast("int").alias("s"))


def _across(pair: tuple[str, str], left: str, right: str) -> Column:
    a, b = (1 << SPLITS.index(x) for x in pair)
    has = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit)) > 0
    return (has(left, a) & has(right, b)) | (has(left, b) & has(right, a))


#: The limits at which least distances are sought.
RISING = (3, 7, 15, 19, 23, 31, 63)


def _pairs_across(values: DataFrame, threshold: int, bits: int, n: int | None = None) -> DataFrame:
    """(s, t, distance) of near hashes, equal ones included, that lie in different splits."""
    left, right = values, values.select(F.col("h").alias("g"), F.col("s").alias("t"))
    near = near_join(left, right, threshold, bits=bits, n=n).where(F.col("h") <= F.col("g"))
    return near.where(F.bit_count(F.col("s").bitwiseOR(F.col("t"))) > 1).select("s", "t", "distance")


def min_cross_distance(rows: DataFrame, value: str = "hash", split: str = "split", *, bits: int = 64) -> DataFrame:
    """(pair, distance): least Hamming distance between splits, -1 where one is empty.

    Limits rise and stop at the first that finds a pair: the least distance is then the least of those found. Where
    hashes lie close, as they do in large tables, that is a banded join at a small limit; a large table without any
    near pair across its splits is refused by the join instead of being run as all pairs.
    """
    values = materialise(_in_splits(rows, value, split), "cross-values")
    sides = values.agg(F.count("*").alias("n"), *(F.bool_or(F.col("s").bitwiseAND(1 << i) > 0).alias(x) for i, x in enumerate(SPLITS))).first()
    least: dict[tuple[str, str], int] = {p: -1 for p in PAIRS if not (sides[p[0]] and sides[p[1]])}
    for limit in RISING:
        wanted = [p for p in PAIRS if p not in least]
        if not wanted:
            break
        found = _pairs_across(values, limit, bits, sides["n"]).agg(*(F.min(F.when(_across(p, "s", "t"), F.col("distance"))).alias("|".join(p)) for p in wanted)).first()
        least |= {p: int(found["|".join(p)]) for p in wanted if found["|".join(p)] is not None}
    least = {p: bits for p in PAIRS} | least  # beyond the last limit all bits differ
    rows_ = [("|".join(p), least[p]) for p in PAIRS]
    return rows.sparkSession.createDataFrame(rows_, "pair string, distance bigint")


def near_across_splits(rows: DataFrame, threshold: int, value: str = "hash", split: str = "split", *, bits: int = 64) -> DataFrame:
    """One row (near): whether any two splits have hashes within threshold bits."""
    found = _pairs_across(materialise(_in_splits(rows, value, split), "cross-values"), threshold, bits)
    return found.agg((F.count("*") == 0).alias("near"))


def _named(one: DataFrame, checks: dict[str, Column]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(k).alias("check_name"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in checks.items()))
    return one.select(F.inline(entries))


def selection_checks(rows: DataFrame, quotas: dict[str, int], threshold: int, *, bits: int = 64) -> DataFrame:
    """Six checks of a selection with split, official_split, label, md5 and hash."""
    grid = dense_counts(rows, label="label")
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    exact = grid.agg(F.bool_and(F.col("n") == F.element_at(quota, F.col("split"))).alias("exact"))
    balance = grid.groupBy("split").agg((F.min("n") == F.max("n")).alias("b")).agg(F.bool_and("b").alias("balance"))
    digest = rows.groupBy("md5").agg((F.min("split") == F.max("split")).alias("s"), (F.min("label") == F.max("label")).alias("c"))
    digest = digest.agg(F.coalesce(F.bool_and("s"), F.lit(True)).alias("one_split"), F.coalesce(F.bool_and("c"), F.lit(True)).alias("one_class"))
    official = rows.groupBy("split").agg(F.bool_and(F.col("official_split").eqNullSafe(F.col("split"))).alias("o"))
    official = official.agg((F.bool_and("o") & (F.count("*") == len(SPLITS))).alias("official"))
    near = near_across_splits(rows, threshold, bits=bits)
    one = reduce(DataFrame.crossJoin, (exact, balance, digest, official, near))
    return _named(one, {
        "exact_counts_match_quota": F.col("exact"),
        "classes_balanced_in_every_split": F.col("balance"),
        "no_exact_duplicate_across_splits": F.col("one_split"),
        "no_item_under_both_labels": F.col("one_class"),
        "split_maps_to_one_official_split": F.col("official"),
        "no_near_duplicate_across_splits": F.col("near"),
    })


def missing_files(manifest: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    return manifest.join(disk, key, "left_anti").select(key)


def extra_files(manifest: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    return disk.join(manifest, key, "left_anti").select(key)


def corrupted_files(manifest: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    both = manifest.select(key, F.col("md5").alias("expected")).join(disk.select(key, F.col("md5").alias("found")), key)
    return both.where(F.col("expected") != F.col("found"))


def extras_like_manifest(manifest: DataFrame, disk: DataFrame, threshold: int, key: str = "path", *, bits: int = 64) -> DataFrame:
    """Extra files equal to a manifest row by digest, or within threshold bits of one: two semi joins, not an OR."""
    extra = disk.join(manifest, key, "left_anti")
    equal = extra.join(manifest.select("md5").distinct(), "md5", "left_semi").select(key)
    hashes = lambda df, name: df.where(F.col("hash").isNotNull()).select(F.col("hash").alias(name)).distinct()
    hits = near_join(hashes(extra, "h"), hashes(manifest, "g"), threshold, bits=bits).select(F.col("h").alias("hash")).distinct()
    near = extra.join(hits, "hash", "left_semi").select(key)
    return equal.unionByName(near).distinct()


def unreadable_files(manifest: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    """Files of the manifest that are there but have no hash (a left join: a file that is missing is not unreadable)."""
    (there,) = fresh((key, "hash"), "_there")
    both = manifest.select(key).join(disk.select(key, "hash", F.lit(True).alias(there)), key, "left")
    return both.where(F.col(there) & F.col("hash").isNull()).select(key)


def revalidation_checks(manifest: DataFrame, disk: DataFrame, quotas: dict[str, int], threshold: int, *, bits: int = 64) -> DataFrame:
    """The six selection checks, then five that hold the manifest against what is there."""
    none = lambda df: df.agg((F.count("*") == 0).alias("ok"))
    checks = {
        "all_files_present": none(missing_files(manifest, disk)),
        "all_digests_match": none(corrupted_files(manifest, disk)),
        "all_files_readable": none(unreadable_files(manifest, disk)),
        "no_unexpected_files": none(extra_files(manifest, disk)),
        "no_extra_duplicates_manifest": none(extras_like_manifest(manifest, disk, threshold, bits=bits)),
    }
    parts = [df.select(F.lit(name).alias("check_name"), F.col("ok").alias("passed")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, [selection_checks(manifest, quotas, threshold, bits=bits), *parts])


def verdict(checks: DataFrame) -> DataFrame:
    """One row: whether all checks (check_name, passed) passed, how many failed and their names, in order."""
    failed = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("check_name"))))
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.array_join(failed, ",").alias("failed"))


def leakage_from_names(files: DataFrame) -> DataFrame:
    """The leakage audit of a prepared tree: (component, splits, n_files, leaked) from (split, path) alone.

    Components come from the copied files' names, as the folders are flat.
    """
    name = stem(F.col("path"))
    per = files.select("split", component_id(name).alias("component")).groupBy("component")
    per = per.agg(F.sort_array(F.collect_set("split")).alias("found"), F.count("*").alias("n_files"))
    return per.select("component", F.array_join("found", ",").alias("splits"), "n_files", (F.size("found") > 1).alias("leaked"))


def any_rows(rows: DataFrame) -> DataFrame:
    """One row: whether there is any row; a limit lets the scan stop at the first."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def report_against_disk(reported: DataFrame, found: DataFrame) -> DataFrame:
    """Counts by split and class in a report and on disk, and whether they agree; missing counts are 0."""
    left, right = reported.withColumnRenamed("n", "reported"), found.withColumnRenamed("n", "found")
    both = left.join(right, ["split", "class_name"], "full_outer")
    both = both.select("split", "class_name", F.coalesce("reported", F.lit(0)).alias("reported"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.withColumn("agrees", F.col("reported") == F.col("found"))


def ready(counts: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """Whether every class has rows in every one of the splits (counts dense)."""
    return counts.where(F.col("split").isin(*splits)).agg(F.coalesce(F.bool_and(F.col("n") > 0), F.lit(False)).alias("ready"))
