"""Files by their bytes, copies that skip what is there, new files of a folder, ledgers and the audit of a written tree."""

import os

import pytest
from picture_files import jpeg, png
from pyspark.sql import functions as F

from sievewright.config import MANIFEST_FIELDS, CurationError
from sievewright.plans import build
from sievewright.sources import files, sinks
from sievewright.sources.images import inspected
from sievewright.sources.ledger import Ledger, fingerprint_of
from sievewright.streaming import arrivals


def test_files_tell_their_sides_and_damage_anywhere(spark, tmp_path):
    whole = png(40, 50, pieces=5)
    scan = jpeg(64, 48)
    cases = {
        "a.png": (whole, ("PNG", 40, 50, True)), "one.png": (png(1, 1), ("PNG", 1, 1, True)), "b.jpg": (scan, ("JPEG", 64, 48, True)), "filled.jpg": (jpeg(3, 5, b"\xff\xff\xff"), ("JPEG", 3, 5, True)),
        "cut.png": (whole[:-3], False), "more.png": (whole + b"x", False), "cut.jpg": (scan[:-1], False), "no-frame.jpg": (scan.replace(b"\xff\xc0", b"\xff\xe1"), False), "long.jpg": (scan[:20], False),
        "empty.png": (b"", False), "text.png": (b"hello", False), "head.png": (whole[:8], False), "mark.jpg": (b"\xff\xd8", False),
    }
    for i in (20, len(whole) // 2, len(whole) - 20):  # one bit in the header, in the middle and in the last chunks
        cases[f"bit{i}.png"] = (whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :], False)
    rows = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in cases.items()], "name string, content binary")
    got = {r["name"]: r["i"] for r in rows.select("name", inspected(F.col("content")).alias("i")).collect()}
    for name, (_, want) in cases.items():
        assert (tuple(got[name]) == want) if want else not got[name]["whole"], (name, got[name])
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    found = {r["filename"]: (r["width"], r["height"], r["reason"]) for r in files.inspect_files(spark, str(tmp_path)).collect()}
    assert found["a.png"] == (40, 50, None) and found["b.jpg"] == (64, 48, None) and found["one.png"][2] == "too_small"
    assert "empty.png" not in found and found["cut.png"] == (None, None, "undecodable") and found["text.png"][2] == "undecodable"
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.scan_folder(spark, str(tmp_path), "real").collect()}
    assert {k for k, v in status.items() if v == "valid"} == {"a.png", "one.png", "b.jpg", "filled.jpg"}


@pytest.fixture
def named(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / "in" / f"f{i:02d}.png").write_bytes(png(4, 4, i))
    rows = [(f"file:{tmp_path}/in/f{i:02d}.png", ("train", "validation", "test")[i % 3], ("real", "fake")[i % 2]) for i in range(12)]
    return sinks.with_output_names(spark.createDataFrame(rows, "path string, split string, class_name string"))


def test_copies_open_wanted_files_only_and_skip_what_is_there(spark, tmp_path, named):
    (tmp_path / "in" / "decoy.png").write_bytes(b"x")
    os.chmod(tmp_path / "in" / "decoy.png", 0)
    os.mkfifo(tmp_path / "in" / "never.png")  # reading it would wait for ever
    out = str(tmp_path / "out")
    first = sinks.copy_missing(named, out).collect()
    assert {r["state"] for r in first} == {"copied"} and len(first) == 12
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.png")}
    assert sorted(p.read_bytes() for p in stamps) == sorted(png(4, 4, i) for i in range(12))
    again = sinks.copy_missing(named, out).collect()
    assert {r["state"] for r in again} == {"present"} and sorted(r[:2] for r in again) == sorted(r[:2] for r in first)
    assert stamps == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.png")}
    gone = next(iter(stamps))
    gone.unlink()
    third = {r["output_path"]: r["state"] for r in sinks.copy_missing(named, out).collect()}
    assert [k.rsplit("/", 1)[1] for k, v in third.items() if v == "copied"] == [gone.name] and len(third) == 12
    assert {r["state"] for r in sinks.copy_missing(named, out, overwrite=True).collect()} == {"copied"}
    assert not list((tmp_path / "out").rglob("*.tmp"))


def test_split_folders_are_cleared_and_nothing_else(spark, tmp_path, named):
    out = str(tmp_path / "table")
    sinks.write_splits(named.drop("ord", "output_name"), out)
    (tmp_path / "table" / "_notes").mkdir()
    (tmp_path / "table" / "_notes" / "x.txt").write_text("kept")
    with pytest.raises(CurationError):
        sinks.write_splits(named.drop("ord", "output_name"), out)
    sinks.write_splits(spark.read.parquet(f"{out}/split=train").withColumn("split", F.lit("train")).select("path", "split", "class_name"), out, overwrite=True)
    back = spark.read.option("pathGlobFilter", "*.parquet").parquet(out)
    assert {r["split"] for r in back.select("split").collect()} == {"train"} and back.count() == 4
    assert (tmp_path / "table" / "_notes" / "x.txt").read_text() == "kept"
    for s in ("train", "test"):
        (tmp_path / "tree" / s).mkdir(parents=True)
    assert sinks.clear_splits(spark, str(tmp_path / "tree")) == ["train", "test"] and (tmp_path / "tree").exists()


def test_new_files_are_taken_once(spark, tmp_path):
    folder, state = tmp_path / "grows", str(tmp_path / "state")
    folder.mkdir()
    for i in range(5):
        (folder / f"a{i}.png").write_bytes(b"x" * (i + 1))
    (folder / "a.txt").write_text("other")
    assert arrivals.taken(spark, state).count() == 0
    one = arrivals.take_new(spark, str(folder), state, glob="*.png", files_a_batch=2)
    assert one.count() == 5 and one.select("batch").distinct().count() == 3
    (folder / "b.png").write_bytes(b"new")
    two = arrivals.take_new(spark, str(folder), state, glob="*.png")
    assert two.count() == 6 == two.select("path").distinct().count() and {r["bytes"] for r in two.where("path like '%b.png'").collect()} == {3}
    assert arrivals.take_new(spark, str(folder), state, glob="*.png").count() == 6


def test_a_batch_that_stopped_half_way_is_taken_again(spark, tmp_path):
    import shutil

    folder, state = tmp_path / "grows", tmp_path / "state"
    folder.mkdir()
    for i in range(4):
        (folder / f"a{i}.png").write_bytes(b"x")
    arrivals.take_new(spark, str(folder), str(state), files_a_batch=2)
    commits = sorted((state / "checkpoint" / "commits").glob("1"))
    assert commits  # as if the run had stopped before its second batch was done
    for c in (*commits, state / "checkpoint" / "commits" / ".1.crc"):
        c.unlink(missing_ok=True)
    shutil.rmtree(state / "taken" / "batch=1")
    again = arrivals.take_new(spark, str(folder), str(state), files_a_batch=2)
    assert again.count() == 4 == again.select("path").distinct().count()


def test_next_of_a_listing(spark):
    listing = spark.createDataFrame([(f"v{i}", i) for i in range(6)], "path string, bytes int")
    had = listing.where("path in ('v1', 'v5')")
    left = lambda first: sorted(r["path"] for r in arrivals.next_files(listing, had, first).collect())
    assert left(3) == ["v0", "v2"] and left(None) == left(0) == ["v0", "v2", "v3", "v4"]


def test_ledger_goes_on_after_any_step(spark, tmp_path):
    docs = spark.range(100).withColumn("n", F.col("id") % 7)
    made = []

    def job(ledger, stop=9):
        def make(name, df):
            if len(ledger.again) - 1 >= stop:
                raise KeyboardInterrupt(name)
            made.append(name)
            return df

        a = ledger.step("a", lambda: make("a", docs.where("n > 2")), {"sum": F.sum("n")})
        b = ledger.step("b", lambda: make("b", a.where("n > 4")))
        return ledger.step("c", lambda: make("c", b.groupBy("n").count()), {"most": F.max("count")})

    folder = str(tmp_path / "job")
    for stop in (1, 2):
        with pytest.raises(KeyboardInterrupt):
            job(Ledger(spark, folder, {"docs": docs}), stop)
    (tmp_path / "job" / "0002-c").mkdir()  # as if it had stopped between the table and its entry
    ledger = Ledger(spark, folder, {"docs": docs.repartition(5)})
    assert sorted(map(tuple, job(ledger).collect())) == [(5, 14), (6, 14)] and made == ["a", "b", "c"]
    assert [(r["step"], r["rows"], r["counters"]) for r in ledger.log().orderBy("number").collect()] == [("a", 56, {"sum": 252}), ("b", 28, {}), ("c", 2, {"most": 14})]
    last = Ledger(spark, folder, {"docs": docs})
    job(last)
    assert made == ["a", "b", "c"] and last.log().count() == 3
    assert not list((tmp_path / "job" / "staged").glob("[!.]*"))
    with pytest.raises(CurationError, match="other inputs"):
        Ledger(spark, folder, {"docs": docs.where("id < 99")})
    with pytest.raises(CurationError, match="other inputs"):
        Ledger(spark, folder, {"docs": docs}, {"limit": 3})
    with pytest.raises(CurationError, match="was a, not b"):
        Ledger(spark, folder, {"docs": docs}).step("b", lambda: docs)


def test_fingerprints_see_rows_not_their_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, t string")
    assert fingerprint_of(rows) == fingerprint_of(rows.repartition(3).select("t", "k"))
    for other in (rows.distinct(), rows.unionByName(rows.limit(1)), rows.withColumnRenamed("t", "u"), rows.withColumn("k", F.col("k").cast("long")), rows.fillna("")):
        assert fingerprint_of(rows) != fingerprint_of(other)


def test_a_step_counts_in_the_pass_that_writes(spark, tmp_path):
    """One write and no other job over the rows."""
    ledger = Ledger(spark, str(tmp_path / "job"), {})
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ledger.step("a", lambda: spark.range(50).mapInArrow(watched, "id bigint"), {"sum": F.sum("id"), "even": F.count_if(F.col("id") % 2 == 0)})
    assert seen.value == 50 and ledger.entries[0]["counters"] == {"sum": 1225, "even": 25}


@pytest.fixture
def tree(spark, tmp_path):
    rows = []
    for k, (s, c) in enumerate((s, c) for s in ("train", "validation", "test") for c in ("real", "fake")):
        for i in range(2):
            (tmp_path / f"tree/{s}/{c}").mkdir(parents=True, exist_ok=True)
            (tmp_path / f"tree/{s}/{c}/{s}{c}{i}.png").write_bytes(png(8, 8, 16 * k + 8 * i))
    found = files.scan_tree(spark, str(tmp_path / "tree"))
    manifest = found.select("image_id", "label", "split", F.col("split").alias("official_split"), F.col("path").alias("source_file"), "bytes", "md5", F.lpad(F.lower(F.hex("hash")), 16, "0").alias("phash_hex"))
    assert tuple(manifest.columns) == MANIFEST_FIELDS
    sinks.write_manifest(manifest, str(tmp_path / "manifest"))
    return tmp_path


def test_reaudit_of_a_written_tree(spark, tree):
    audit = lambda: [x.collect() for x in build.reaudit(spark, str(tree / "tree"), str(tree / "manifest"), threshold=0, quotas={"train": 2, "validation": 2, "test": 2})]
    checks, differs = audit()
    assert len(checks) == 11 and all(r["passed"] for r in checks) and not differs
    (tree / "tree/train/real/trainreal0.png").write_bytes(png(8, 8, 200))  # changed, whole
    (tree / "tree/test/fake/testfake1.png").write_bytes(b"damaged")
    (tree / "tree/validation/real/validationreal1.png").unlink()
    (tree / "tree/test/real/extra.png").write_bytes((tree / "tree/train/fake/trainfake0.png").read_bytes())
    checks, differs = audit()
    assert {r["check_name"] for r in checks if not r["passed"]} == {"all_files_present", "all_digests_match", "all_files_readable", "no_unexpected_files", "no_extra_duplicates_manifest"}
    assert sorted((r["image_id"], r["state"]) for r in differs) == [("extra.png", "extra"), ("testfake1.png", "changed"), ("trainreal0.png", "changed"), ("validationreal1.png", "missing")]
