import hashlib
import math
import random

import pytest
from picture_files import jpeg, png
from pyspark.sql import functions as F

from sievewright.config import CurationError
from sievewright.functions.arrays import dct_hash
from sievewright.operators.graph import connected_components
from sievewright.plans import build
from sievewright.sources import files, sinks


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(900)]
    texts += [texts[0], texts[9], " "]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{out}/documents.parquet")
    return out


def test_the_whole_build_writes_after_its_audit(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "out")
    report = build.build(spark, sf_dir, folder).first()
    assert report["passed"] and report["selected"] == 2 * sum(build.QUOTAS.values())
    assert report["scanned"] == 903 and report["unreadable"] == 1
    assert report["removed_total"] == report["exact_same_class_same_split"] + report["exact_cross_split"] + report["exact_cross_class"] + report["near_removed"]
    written = files.read_manifest(spark, f"{folder}/manifest")
    assert written.count() == report["selected"]
    level = [f"{r['split']}/{r['label']}/{r['md5']}" for r in written.orderBy("image_id").collect()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level, first = [digest(x) for x in level], True
    while first or len(level) > 1:
        level, first = [digest("".join(level[i : i + 5])) for i in range(0, len(level), 5)], False
    got = build.manifest_fingerprint(written.repartition(3), run=5).first()
    assert (got["n_rows"], got["fingerprint"]) == (written.count(), level[0])
    assert build.manifest_fingerprint(written.limit(0)).first().asDict() == {"n_rows": 0, "fingerprint": digest("")}
    assert files.read_json(spark, f"{folder}/report").first()["scanned"] == 903
    with pytest.raises(Exception, match="already|exists"):
        build.build(spark, sf_dir, folder)
    with pytest.raises(CurationError):
        build.build(spark, sf_dir, folder, quotas={"train": 20, "validation": 4, "test": 400}, overwrite=True)


def test_paths_stay_inside():
    assert sinks.check_inside("/a/b/./c", "/a/b") == "/a/b/c" and sinks.check_inside("file:///a/b/c/../d", "file:///a/b") == "file:///a/b/d"
    for path in ("/a/c", "/a/b", "/a/b/../c", "/../x", "hdfs:///a/b/c"):
        with pytest.raises(CurationError):
            sinks.check_inside(path, "/a/b")


def test_copies_equal_their_sources_and_trees_their_manifest(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    for i in range(6):
        (source / f"f{i}.png").write_bytes(bytes([i]) * (i + 1))
    rows = spark.createDataFrame([(f"file:{source}/f{i}.png", ("train", "test")[i % 2], ("real", "fake")[i // 3]) for i in range(6)], "path string, split string, class_name string")
    named = sinks.with_output_names(rows)
    target = str(tmp_path / "tree")
    got = {r["output_path"].rsplit("/", 3)[1] + "/" + r["output_path"].rsplit("/", 1)[1]: r["md5"] for r in sinks.copy_files(named, target).collect()}
    assert len(got) == 6
    tree = files.scan_tree(spark, target)
    manifest = named.select("split", F.col("class_name").alias("label"), F.col("output_name").alias("image_id"), F.col("path"))
    sums = {f"file:{source}/f{i}.png": hashlib.md5(bytes([i]) * (i + 1)).hexdigest() for i in range(6)}
    manifest = spark.createDataFrame([(r["split"], r["label"], r["image_id"], sums[r["path"]]) for r in manifest.collect()], "split string, label string, image_id string, md5 string")
    assert files.tree_against_manifest(tree, manifest).count() == 0
    (tmp_path / "tree/train/real/extra.png").write_bytes(b"x")
    first = manifest.orderBy("image_id").first()
    (tmp_path / f"tree/{first['split']}/{first['label']}/{first['image_id']}").write_bytes(b"changed")
    assert sorted(r["state"] for r in files.tree_against_manifest(files.scan_tree(spark, target), manifest).collect()) == ["changed", "extra"]
    with pytest.raises(CurationError):
        sinks.copy_files(named, target)


def test_videos_and_their_components(spark, tmp_path):
    for folder, names in (("orig", ("183", "253", "585")), ("fake", ("183_253", "253_183", "585_599"))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.mp4").write_bytes(b"v")
    videos = files.discover_videos(spark, str(tmp_path / "orig"), str(tmp_path / "fake"))
    assert [(r["label"], r["kind"], r["method"]) for r in videos.collect()] == [("real", "original", None)] * 3 + [("fake", "manipulated", "Deepfakes")] * 3
    edges = videos.select("sequence_id", F.coalesce("source_id", "sequence_id").alias("source_id"))
    parts = connected_components(edges, "sequence_id", "source_id")
    got = {(r["sequence_id"], r["source_id"]): r["component_id"] for r in build.assign_components(videos, parts).collect()}
    assert got["183", "253"] == got["253", None] == "183" and got["585", "599"] == "585" and len(set(got.values())) == 2
    wrong = parts.withColumn("component", F.col("node"))
    with pytest.raises(CurationError):
        build.assign_components(videos, wrong)
    assert files.discover_videos(spark, str(tmp_path / "none"), str(tmp_path / "none")).count() == 0
    (tmp_path / "orig" / "x1.mp4").write_bytes(b"v")
    with pytest.raises(CurationError):
        files.discover_videos(spark, str(tmp_path / "orig"), str(tmp_path / "fake"))


def test_cut_off_files_are_invalid(spark, tmp_path):
    good = {"a.png": png(5, 4), "b.jpg": jpeg(5, 4)}
    for name, data in good.items():
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"cut-{name}").write_bytes(data[:-3])
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.scan_folder(spark, str(tmp_path), "real").collect()}
    assert got == {"a.png": "valid", "b.jpg": "valid", "cut-a.png": "invalid", "cut-b.jpg": "invalid"}


def test_dct_hash_equals_the_matrix_product(spark):
    rng = random.Random(3)
    side = 16
    pictures = [[rng.randint(0, 255) for _ in range(side * side)] for _ in range(4)]
    wave = [[math.cos(math.pi * (2 * x + 1) * u / (2 * side)) * math.sqrt((1 if u == 0 else 2) / side) for x in range(side)] for u in range(8)]
    rows = spark.createDataFrame(list(enumerate(pictures)), "i int, p array<int>")
    got = {r["i"]: r["h"] for r in rows.select("i", dct_hash(F.col("p"), side).alias("h")).collect()}
    for i, p in enumerate(pictures):
        low = [sum(p[y * side + x] * wave[u][y] * wave[v][x] for y in range(side) for x in range(side)) for u in range(8) for v in range(8)][1:]
        median = sorted(low)[31]
        assert got[i] == int("".join(str(int(c > median)) for c in low), 2)


def test_no_shared_folder_on_a_cluster(monkeypatch):
    from sievewright import session

    class Nothing:
        def isDefined(self):
            return False

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Fake.conf), "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(Nothing)}))})})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake)
