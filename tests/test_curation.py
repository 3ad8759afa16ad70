"""Properties of the curation operators, on tables made here and on the smallest input."""

import os
import random

import duckdb
import pytest
from picture_files import png
from pyspark.sql import functions as F

from sievewright.config import CurationError, check_ratios
from sievewright.functions import arrays as A
from sievewright.functions import text as X
from sievewright.operators import audit, dedup, metrics, sampling, splits
from sievewright.operators.graph import connected_components
from sievewright.plans import oracles, queries

HOME = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{HOME}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(HOME), reason="no tables")
@pytest.mark.parametrize("name", ["exact_dedup_stats", "split_class_rollup", "macro_metrics", "prefix_sum_split", "grouped_greedy_split", "history_early_stop", "softmax_argmax", "near_dedup_survivors", "validation_reject_reason", "dataset_fingerprint"])
def test_queries_equal_their_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, HOME)
    result = duck.execute(oracles.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(str(r) for r in result.fetchall())
    assert sorted(columns) == sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == want


def test_exact_dedup_rules(spark):
    rows = [("a", "train", "real", "1"), ("b", "test", "real", "1"), ("c", "train", "real", "1"), ("d", "test", "real", "2"), ("e", "test", "real", "2"), ("f", "train", "real", "3"), ("g", "test", "fake", "3"), ("h", "train", "fake", None)]
    pool = spark.createDataFrame(rows, "path string, split string, class_name string, md5 string")
    got = {r["path"]: r["decision"] for r in dedup.exact_decisions(pool.where("md5 is not null")).collect()}
    assert got == {"a": "cross_split", "b": "kept", "c": "cross_split", "d": "kept", "e": "same_split", "f": "cross_class", "g": "cross_class"}
    stats = dedup.exact_stats(pool).first().asDict()
    assert stats == {"scanned": 8, "unreadable": 1, "exact_same_class_same_split": 1, "exact_cross_split": 2, "exact_cross_class": 2, "removed_total": 5}


def test_near_survivors_follow_the_greedy_rule(spark):
    rng = random.Random(0)
    base = [rng.getrandbits(60) for _ in range(8)]
    rows = []
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(60)
        rows.append((f"p{i:03d}", rng.choice(["train", "validation", "test"]), "real", str(i), h))
    pool = spark.createDataFrame(rows, "path string, split string, class_name string, md5 string, hash bigint")
    for t in (1, 3, 7):
        kept = []
        for r in sorted(rows, key=lambda r: ({"test": 0, "validation": 1, "train": 2}[r[1]], r[0])):
            if all((r[4] ^ k[4]).bit_count() > t for k in kept):
                kept.append(r)
        assert {r["path"] for r in dedup.near_survivors(pool, t).collect()} == {r[0] for r in kept}
    assert dedup.near_survivors(pool, 0).count() == 120
    with pytest.raises(CurationError):
        dedup.near_survivors(pool, 5)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_samples_are_stable_and_exact(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("path"), (F.col("id") % 2).cast("string").alias("pool"))
    quotas = spark.createDataFrame([("0", 7), ("1", 3)], "pool string, quota bigint")
    draw = lambda df: {(r["pool"], r["path"]) for r in sampling.stratified_sample(df, ["pool"], "path", quotas, 42).collect()}
    first = draw(rows)
    assert len(first) == 10 and first == draw(rows.repartition(9))
    with pytest.raises(CurationError):
        sampling.stratified_sample(rows, ["pool"], "path", spark.createDataFrame([("0", 101)], "pool string, quota bigint"), 42)
    cap = lambda seed: {r["path"] for r in sampling.seeded_cap(rows, "path", 9, seed).collect()}
    assert cap(1) == cap(1) != cap(2) and sampling.seeded_cap(rows, "path", None, 1).count() == 200
    assert sampling.compat_positions(5, 9, 1) == [0, 1, 2, 3, 4] and len(sampling.compat_positions(50, 9, 1)) == 9


def test_most_frequent(spark):
    from sievewright.operators.frequent import most_frequent

    rows = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(300)] + [("none", 0)], "w string, n bigint")
    top = [r["n"] for r in most_frequent(rows, "n", 20).collect()]
    assert 10 <= len(top) <= 20 and min(top) > 1000 // 22
    assert most_frequent(rows, "n", 500).count() == 300 and most_frequent(rows.limit(0), "n", 5).count() == 0
    assert 1 <= most_frequent(rows.withColumn("n", F.lit(1)), "n", 5).count() <= 5  # one step, too large as a whole, gives parts


@pytest.mark.parametrize("total,most,want", [(10, 30, list(range(10))), (0, 5, []), (5, 1, [0]), (7, 0, list(range(7)))])
def test_even_positions(spark, total, most, want):
    assert one(spark, sampling.even_positions(F.lit(total), F.lit(most))) == want


def test_even_positions_spread(spark):
    got = one(spark, sampling.even_positions(F.lit(100), F.lit(30)))
    assert len(got) == 30 and got[0] == 0 and got[-1] == 99 and got == sorted({round(i * (99 / 29)) for i in range(30)})


def test_grouped_split_fills_every_split(spark):
    groups = spark.createDataFrame([("1_2", 10, 10), ("3_4", 10, 10), ("5_6", 10, 10)], "k string, n_real bigint, n_fake bigint")
    assert {r["split"] for r in splits.grouped_greedy_split(groups, "k", 42).collect()} == {"train", "validation", "test"}
    with pytest.raises(CurationError):
        check_ratios(0.7, 0.2, 0.2)


def test_prefix_split_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    groups = [("real", f"g{i}", rng.randint(1, 9)) for i in range(40)]
    frame = spark.createDataFrame(groups, "class_name string, k string, n bigint")
    for ratios in ((0.7, 0.15, 0.15), (0.0, 0.5, 0.5), (1.0, 0.0, 0.0)):
        got = {r["k"]: r["split"] for r in splits.prefix_sum_split(frame, "class_name", "k", "n", 3, ratios).collect()}
        order = [r["k"] for r in frame.orderBy(sampling.seeded_order(3, F.col("k")), "k").collect()]
        size, total, counts, want = {k: n for _, k, n in groups}, sum(n for *_, n in groups), [0, 0], {}
        for k in order:
            if counts[0] < round(total * ratios[0]):
                want[k] = "train"
                counts[0] += size[k]
            elif counts[1] < round(total * ratios[1]):
                want[k] = "validation"
                counts[1] += size[k]
            else:
                want[k] = "test"
        assert got == want


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "actual int, predicted int")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion(rows).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    fake = metrics.positive_class(rows).first()
    assert fake["precision"] == pytest.approx(2 / 3) and fake["recall"] == 1.0 and fake["support"] == 2
    assert metrics.overall(rows).first()["accuracy"] == 0.75
    report = metrics.metrics_report(rows).first()
    assert report["confusion_matrix"] == [[1, 1], [0, 2]] and report["positive"]["support"] == 2
    none = metrics.overall(rows.limit(0)).first()
    assert none["accuracy"] == 0.0 and none["macro_f1"] == 0.0
    odd = metrics.overall(spark.createDataFrame([(0, 0), (5, 5), (1, 7)], "actual int, predicted int")).first()
    assert odd["accuracy"] == pytest.approx(2 / 3)


def test_early_stop(spark):
    loss = [0.9, 0.8, 0.7, 0.6, 0.55, 0.49, 0.5, 0.49, 0.6, 0.1]
    rows = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(loss)] + [(2, 1, 0.5), (2, 2, 0.4)], "run_id int, epoch int, val_loss double")
    got = {r["run_id"]: (r["stop_epoch"], r["epochs_run"]) for r in metrics.early_stop(rows, 3).collect()}
    assert got == {1: (9, 9), 2: (None, 2)}


def test_audit_of_a_clean_and_a_leaky_selection(spark):
    rows = [(s, s, c, f"{s}{c}", (i * 2 + j) << 8) for i, s in enumerate(("train", "validation", "test")) for j, c in enumerate(("real", "fake"))]
    ddl = "split string, official_split string, label string, md5 string, hash bigint"
    quotas = {"train": 1, "validation": 1, "test": 1}
    assert all(r["passed"] for r in audit.selection_checks(spark.createDataFrame(rows, ddl), quotas, 0).collect())
    rows[0] = ("train", "test", "real", "testfake", rows[-1][4])
    failed = {r["check_name"] for r in audit.selection_checks(spark.createDataFrame(rows, ddl), quotas, 0).collect() if not r["passed"]}
    assert failed == {"no_exact_duplicate_across_splits", "no_item_under_both_labels", "split_maps_to_one_official_split", "no_near_duplicate_across_splits"}


def test_names(spark):
    assert one(spark, X.component_id(F.lit("000000_183_253__f__frame_000001"))) == "183_253"
    assert one(spark, X.frame_index(F.lit("183_253__f__frame_000007"))) == 7 and one(spark, X.frame_index(F.lit("x"))) == -1
    assert [one(spark, X.extension(F.lit(n))) for n in ("a.JPG", "a", ".jpg", "a.b.png")] == [".jpg", "", ".jpg", ".png"]
    assert one(spark, X.stem(F.lit("d/a.b.png"))) == "a.b" and one(spark, X.stem(F.lit("d/.png"))) == ".png"
    assert one(spark, X.group_key(F.lit("raw/real/v/f.png"), "raw/real")) == "v" and one(spark, X.group_key(F.lit("else/f.png"), "raw/real")) == "f"
    assert one(spark, X.video_name(F.lit("183_253"))).asDict() == {"kind": "manipulated", "sequence_id": "183", "source_id": "253"}
    assert one(spark, X.video_name(F.lit("x1")))["kind"] is None
    assert [one(spark, X.human_bytes(F.lit(n))) for n in (0, 1023, 1536, 5 * 1024**5)] == ["0.0 B", "1023.0 B", "1.5 KB", "5120.0 TB"]


def test_array_functions(spark):
    assert one(spark, A.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert sum(one(spark, A.softmax(F.array(F.lit(1000.0), F.lit(999.0))))) == pytest.approx(1)
    low = [float((i * 37) % 63) for i in range(63)]
    value = one(spark, A.hash_from_array(F.array(*(F.lit(x) for x in low))))
    assert value == int("".join("1" if x > 31 else "0" for x in low), 2) and value.bit_count() == 31
    assert one(spark, A.band_keys(F.lit(value), 3)) == [value >> s & 0xFFFF for s in (48, 32, 16, 0)]


def test_files_and_manifests(spark, tmp_path):
    from sievewright.sources import files, sinks

    for split in ("training", "val", "test"):
        for c in ("real", "fake"):
            folder = tmp_path / "pool" / split / c
            folder.mkdir(parents=True)
            (folder / "a.png").write_bytes(png(6, 6, len(split) * 16 + len(c)))
            (folder / "Real_b.JPG").write_bytes(b"broken")
            (folder / "notes.txt").write_text("x")
    pool = str(tmp_path / "pool")
    rows = files.scan_pool(spark, pool)
    assert rows.count() == 12 and files.misnamed(rows).first()["misnamed"] == 3
    scan = files.scan_classes(spark, {"real": f"{pool}/test/real", "fake": f"{pool}/test/fake"})
    assert {(r["class_name"], r["status"]) for r in scan.collect()} == {(c, s) for c in ("real", "fake") for s in ("valid", "invalid", "unsupported")}
    assert files.count_files(spark, pool) == 12 and files.count_files(spark, f"{pool}/none") == 0
    assert [r["label"] for r in files.labelled_split(spark, f"{pool}/test").collect()] == [0, 0, 1, 1]
    with pytest.raises(CurationError):
        files.scan_pool(spark, f"{pool}/test")
    assert files.find_pool_root(spark, str(tmp_path)).endswith("/pool") and files.split_folders(spark, f"{pool}/test") is None
    with pytest.raises(CurationError):
        files.find_pool_root(spark, f"{pool}/val")
    sinks.quarantine(scan, str(tmp_path / "aside"))
    assert spark.read.parquet(str(tmp_path / "aside")).count() == 2
    assert sinks.delete_invalid(scan) == 0 and (tmp_path / "pool/test/real/Real_b.JPG").exists()
    manifest = rows.select(
        F.concat_ws("_", "split", "class_name", "md5").alias("image_id"), F.col("class_name").alias("label"), "split", F.col("split").alias("official_split"),
        F.col("path").alias("source_file"), F.col("size_bytes").alias("bytes"), "md5", F.lit("00ff").alias("phash_hex"),
    )
    sinks.write_manifest(manifest, str(tmp_path / "manifest"))
    assert sorted(map(tuple, files.read_manifest(spark, str(tmp_path / "manifest")).collect())) == sorted(map(tuple, manifest.collect()))
    sinks.write_report(rows.groupBy().count(), str(tmp_path / "report"))
    assert files.read_json(spark, str(tmp_path / "report")).first()["count"] == 12 and files.read_json(spark, str(tmp_path / "none")) is None
    sinks.write_splits(rows, str(tmp_path / "splits"))
    back = spark.read.parquet(str(tmp_path / "splits"))
    assert sinks.delete_invalid(scan, allow_delete=True) == 2 and not (tmp_path / "pool/test/real/Real_b.JPG").exists()
    assert back.count() == 12 and set(back.columns) >= {"ord", "output_name", "split", "class_name"}


def test_streams(spark, tmp_path):
    from sievewright.streaming import counts

    rows = [("a", "train", "real", 5, "1", "2024-01-01 00:10:00"), ("b", "train", "real", 7, "1", "2024-01-01 00:20:00"), ("c", "test", "fake", 1, "2", "2024-01-01 02:00:00")]
    frame = spark.createDataFrame(rows, "path string, split string, class_name string, size_bytes bigint, md5 string, seen_at string").withColumn("seen_at", F.to_timestamp("seen_at"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = counts.candidate_stream(spark, str(tmp_path / "in"))
    for name, df, mode in (("running", counts.running_counts(stream), "complete"), ("firsts", counts.first_seen(stream), "append")):
        q = counts.to_memory(df, name, mode)
        q.processAllAvailable()
        q.stop()
    assert {(r["split"], r["n"], r["bytes"]) for r in spark.table("running").collect()} == {("train", 2, 12), ("test", 1, 1)}
    assert spark.table("firsts").count() == 2
