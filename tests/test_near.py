import random

import pytest
from pyspark.sql import functions as F

from sievewright.config import CurationError
from sievewright.operators.audit import min_cross_distance, near_across_splits, revalidation_checks, verdict
from sievewright.operators import dedup, splits
from sievewright.operators.dedup import MAX_ROWS, banded_pairs, class_pairs, collapsed_pairs, comparisons, dedup_stats, exact_survivors, greedy_survivors, near_join, near_survivors, probe_plan
from sievewright.operators.frequent import most_frequent
from sievewright.operators.ordered import running_total
from sievewright.operators.sampling import first_rows, in_batches
from sievewright.operators.splits import grouped_greedy_split, prefix_sum_split
from sievewright.plans.queries import QUERIES


def close_hashes(bits, n=60, seed=1):
    rng, out = random.Random(seed), []
    while len(out) < n:
        h = rng.getrandbits(bits)
        out += [h] + [h ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, 9))) for _ in range(2)]
    return out[:n]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("bits,threshold,n", [(64, 0, 10), (64, 1, 10), (64, 3, 1_000_000), (60, 3, 10), (60, 7, 10), (63, 7, 10_000_000), (64, 15, 10), (60, 15, 1000)])
def test_near_join_equals_all_pairs(spark, bits, threshold, n):
    hashes = close_hashes(bits)
    left = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "a int, h bigint")
    right = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)], "b int, g bigint")
    got = sorted((r["a"], r["b"], r["distance"]) for r in near_join(left, right, threshold, bits=bits, n=n).collect())
    want = [(i, j, (x ^ y).bit_count()) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if (x ^ y).bit_count() <= threshold]
    assert got == sorted(want)


def test_plans_keep_to_their_rows_and_widen_as_tables_grow():
    assert [(b.width, b.flips) for b in probe_plan(3, 60, 10)] == [(15, 0)] * 4
    for threshold, bits in ((0, 64), (1, 64), (3, 60), (3, 63), (3, 64), (7, 60), (7, 63), (7, 64), (15, 60)):
        last = None
        for n in (10, 10_000, 10**6, 10**9):
            plan = probe_plan(threshold, bits, n)
            assert sum(b.probes + 1 for b in plan) <= MAX_ROWS
            assert sum(b.flips + 1 for b in plan) == threshold + 1 and sum(b.width for b in plan) == bits
            assert [b.shift for b in plan] == [sum(x.width for x in plan[:i]) for i in range(len(plan))]
            assert last is None or len(plan) <= last
            last = len(plan)
    assert comparisons(probe_plan(3, 60, 10**9), 10**9) < 100 and comparisons(probe_plan(7, 60, 10**9), 10**9) < 10**7


def test_joins_that_are_all_pairs_at_scale_are_refused(spark):
    one = spark.createDataFrame([(1, 1)], "a int, h bigint")
    with pytest.raises(CurationError, match="too wide"):
        near_join(one, one.toDF("b", "g"), 15, bits=60, n=10**9)


def test_collapsed_pairs_link_the_same_keys(spark):
    hashes = close_hashes(60, 30, 5)
    rows = [(i, h) for i, h in enumerate(hashes * 4)] + [(1000, None)]
    frame = spark.createDataFrame(rows, "key int, hash bigint")
    got = [(r["a"], r["b"], r["distance"]) for r in collapsed_pairs(frame, 7, bits=60).collect()]
    every = {(r["a"], r["b"], r["distance"]) for r in banded_pairs(frame, 7, bits=60).collect()}
    assert set(got) <= every and len(got) == len(set(got)) < len(every) / 4

    def parts(pairs):
        root = {i: i for i, _ in rows}
        for a, b, *_ in sorted(pairs) * 3:
            low = min(root[a], root[b])
            old = {root[a], root[b]}
            root = {k: low if v in old else v for k, v in root.items()}
        return root

    assert parts(got) == parts(every)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_class_pairs_lose_no_pair_of_different_texts(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    hashes = close_hashes(60, 12, 5)
    rows = [(i, h, f"text {i % 48}" if i % 5 else None) for i, h in enumerate(hashes * 8)] + [(1000, None, "text 1")]
    frame = spark.createDataFrame(rows, "key int, hash bigint, md5 string")
    got = [tuple(r) for r in class_pairs(frame, 7, bits=60).collect()]
    classes = {}
    for k, *kind in rows:
        classes.setdefault(tuple(kind), k)
    first = {k: classes[tuple(kind)] for k, *kind in rows}
    assert sorted((b, a) for a, b, _, copy in got if copy) == [(k, f) for k, f in sorted(first.items()) if k != f]
    every = {(r["a"], r["b"], r["distance"]) for r in banded_pairs(frame, 7, bits=60).collect()}
    between = [x[:3] for x in got if not x[3]]
    assert sorted(between) == sorted(x for x in every if first[x[0]] == x[0] and first[x[1]] == x[1])
    # With the copies put in again, it is every pair.
    far = {x[:2]: x[2] for x in between}
    told = {(a, b): 0 if first[a] == first[b] else far.get(tuple(sorted((first[a], first[b])))) for a in first for b in first if a < b}
    assert {(*k, d) for k, d in told.items() if d is not None} == every


def test_texts_of_the_same_words_are_paired(spark, tmp_path):
    """Different texts with one hash each have their pair; the copy of one has its row."""
    texts = ["red green blue", "blue green red", "green red blue", "red green blue", None, "other words of another text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["hamming_pairs_banded"](spark, str(tmp_path)).collect())
    assert got == [(0, 1, 0, False), (0, 2, 0, False), (0, 3, 0, True), (1, 2, 0, False)]


def test_nulls_and_equal_hashes(spark):
    rows = [("p1", "test", "real", "m1", 5), ("p2", "train", "real", "m2", 5), ("p3", "train", "fake", "m3", None), ("p4", "train", "fake", "m4", None), ("p5", "train", "fake", None, None), ("p6", "train", "real", "m1", 5), ("p7", "validation", "fake", "m7", 4096)]
    rows = spark.createDataFrame(rows, "path string, split string, class_name string, md5 string, hash bigint")
    kept = near_survivors(exact_survivors(rows), 3)
    assert sorted(r["path"] for r in kept.collect()) == ["p1"]
    got = dedup_stats(rows, kept).first().asDict()
    assert got == {"scanned": 7, "unreadable": 3, "exact_same_class_same_split": 0, "exact_cross_split": 1, "exact_cross_class": 0, "near_removed": 2, "removed_total": 3}
    assert banded_pairs(rows.select(F.col("path").alias("key"), "hash"), 3).count() == 6  # p1, p2, p6 and p7


def test_greedy_drops_nothing_by_dropped_ones(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 7), (9, 8)]
    got = {r["key"]: r["kept"] for r in greedy_survivors(spark.createDataFrame(pairs, "earlier int, later int")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 9: True, 8: False}
    assert greedy_survivors(spark.createDataFrame([], "earlier int, later int")).count() == 0


def test_distance_between_splits(spark):
    rng, splits = random.Random(2), ("train", "validation", "test")
    rows = [(rng.choice(splits), h) for h in close_hashes(60, 40, 3)]
    frame = spark.createDataFrame(rows + [("train", None)], "split string, hash bigint")
    got = {r["pair"]: r["distance"] for r in min_cross_distance(frame, bits=60).collect()}
    for pair, d in got.items():
        a, b = pair.split("|")
        assert d == min((x ^ y).bit_count() for s, x in rows for t, y in rows if (s, t) == (a, b))
    for limit in (0, 3, 7):
        assert near_across_splits(frame, limit, bits=60).first()[0] == (min(got.values()) > limit)
    far = [("train", 0), ("validation", -1), ("test", -1)]  # all 64 bits differ
    assert [r["distance"] for r in min_cross_distance(spark.createDataFrame(far, "split string, hash bigint")).collect()] == [64, 64, 0]
    alone = {r["pair"]: r["distance"] for r in min_cross_distance(spark.createDataFrame([("train", 1), ("test", 1), ("test", 6)], "split string, hash bigint")).collect()}
    assert alone == {"train|validation": -1, "train|test": 0, "validation|test": -1}


def test_unreadable_files_fail_their_check(spark):
    ddl = "path string, split string, class_name string, label string, official_split string, md5 string, hash bigint"
    rows = [(f"{s}{c}", s, c, c, s, f"{s}{c}", i << 20) for i, (s, c) in enumerate((s, c) for s in ("train", "validation", "test") for c in ("real", "fake"))]
    manifest = spark.createDataFrame(rows, ddl)
    quotas = {"train": 1, "validation": 1, "test": 1}
    checks = revalidation_checks(manifest, manifest, quotas, 0)
    assert verdict(checks).first().asDict() == {"passed": True, "n_failed": 0, "failed": ""}
    broken = manifest.withColumn("hash", F.when(F.col("path") != "testreal", F.col("hash")))
    assert verdict(revalidation_checks(manifest, broken, quotas, 0)).first()["failed"] == "all_files_readable"
    with_extra = manifest.unionByName(spark.createDataFrame([("x", "train", "real", "real", "train", "trainreal", 1 << 40)], ddl))
    assert verdict(revalidation_checks(manifest, with_extra, quotas, 0)).first()["failed"] == "no_extra_duplicates_manifest,no_unexpected_files"


def test_most_frequent_fills_up_from_a_step_too_large(spark):
    rows = spark.createDataFrame([(i, 3) for i in range(5000)] + [(-1, 50), (-2, 40)], "k int, n int")
    got = most_frequent(rows, "n", 1000).collect()
    assert 950 <= len(got) <= 1000 and {-1, -2} <= {r["k"] for r in got}
    assert most_frequent(rows, "n", 10_000).count() == 5002 and most_frequent(rows, "n", 0).count() == 0
    assert {r["k"] for r in most_frequent(rows, "n", 2).collect()} == {-1, -2}


def test_running_totals_and_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, rng.randint(0, 9)) for i in range(500)]
    got = {(r["k"], r["i"]): r["before"] for r in running_total(spark.createDataFrame(rows, "k string, i int, n int").repartition(7), ["k", "i"], "n").collect()}
    total = 0
    for k, i, n in sorted(rows):
        assert got[k, i] == total
        total += n
    frame = spark.createDataFrame([(f"p{i:03d}",) for i in range(50)], "path string")
    plain = sorted((r["batch"], r["place"], r["path"]) for r in in_batches(frame, "path", 8).collect())
    assert [p for *_, p in plain] == [f"p{i:03d}" for i in range(50)] and plain[-1][:2] == (6, 1)
    mixed = sorted((r["batch"], r["place"], r["path"]) for r in in_batches(frame.repartition(5), "path", 8, 42).collect())
    assert [x[:2] for x in mixed] == [x[:2] for x in plain] and [x[2] for x in mixed] != [x[2] for x in plain]
    assert mixed == sorted((r["batch"], r["place"], r["path"]) for r in in_batches(frame, "path", 8, 42).collect())
    assert first_rows(frame, ["path"], 3).count() == 3 and first_rows(frame, ["path"], None).count() == 50 and first_rows(frame, ["path"], 0).count() == 50


def test_splits_by_walking_the_groups(spark, monkeypatch):
    import hashlib

    rng = random.Random(6)
    groups = [(f"g{i}", rng.randint(0, 6), rng.randint(0, 6)) for i in range(300)]
    order = lambda g: (hashlib.md5(f"42|{g}".encode()).hexdigest(), g)
    frame = spark.createDataFrame(groups, "source string, n_real bigint, n_fake bigint").repartition(5)
    totals = [sum(g[1] for g in groups), sum(g[2] for g in groups)]
    wanted = [[round(t * 0.7), round(t * 0.15)] for t in totals]
    wanted = [[max(1, x) for x in (a, b, t - a - b)] for (a, b), t in zip(wanted, totals)]
    have, want = [[0] * 3, [0] * 3], {}
    for k, (g, r, f) in enumerate(sorted(groups, key=lambda g: order(g[0]))):
        empty = [i for i in range(3) if not have[0][i] + have[1][i]]
        allowed = empty if empty and len(groups) - k - 1 < len(empty) else [0, 1, 2]
        s = min(allowed, key=lambda i: (have[0][i] + r) / wanted[0][i] + (have[1][i] + f) / wanted[1][i])
        have[0][s] += r
        have[1][s] += f
        want[g] = ("train", "validation", "test")[s]
    assert {r["source"]: r["split"] for r in grouped_greedy_split(frame, "source", 42).collect()} == want
    monkeypatch.setattr(splits, "PIECE", 70)  # several tasks, each going on from the counters of the one before
    assert {r["source"]: r["split"] for r in grouped_greedy_split(frame, "source", 42).collect()} == want
    assert grouped_greedy_split(frame.limit(0), "source", 42).count() == 0
    rows = spark.createDataFrame([("real", g, r) for g, r, _ in groups] + [("fake", g, f) for g, _, f in groups], "class_name string, source string, n bigint")
    got = {(r["class_name"], r["source"]): r["split"] for r in prefix_sum_split(rows, "class_name", "source", "n", 42).collect()}
    for c, i in (("real", 1), ("fake", 2)):
        total, done, val = sum(g[i] for g in groups), 0, 0
        train = round(total * 0.7)
        for g in sorted(groups, key=lambda g: order(g[0])):
            if done < train:
                split, done = "train", done + g[i]
            elif val < round(total * 0.15):
                split, val = "validation", val + g[i]
            else:
                split = "test"
            assert got[c, g[0]] == split


def test_limits_that_are_refused(spark):
    with pytest.raises(CurationError):
        banded_pairs(spark.createDataFrame([(1, 1)], "key int, hash bigint"), 2)


def test_groups_of_one_row_are_bounded(spark, monkeypatch):
    from sievewright.operators import audit
    from sievewright.plans import build

    rows = spark.createDataFrame([("a", "p1"), ("a", "p0"), ("b", "p2")], "g string, path string")
    assert {r["g"]: (r["n"], r["members"]) for r in audit.group_members(rows, "g").collect()} == {"a": (2, "p0,p1"), "b": (1, "p2")}
    parts = rows.select(F.col("g").alias("component"), F.col("path").alias("node"))
    assert {r["members"] for r in build.component_members(parts).collect()} == {"p0_p1", "p2"}
    monkeypatch.setattr(audit, "MEMBERS", 1)
    monkeypatch.setattr(build, "MEMBERS", 1)
    for df in (audit.group_members(rows, "g"), build.component_members(parts)):
        with pytest.raises(Exception, match="more than 1"):
            df.collect()
