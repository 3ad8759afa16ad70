"""Composite plans: the dataset build, its manifest, fingerprint, summary and provenance."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CLASS_CAP, CLASSES, RATIOS, SEED, SPLITS, CurationError, check_ratios
from ..functions import arrays as A
from ..functions import text as X
from ..operators import audit, dedup, sampling, splits
from ..operators.graph import connected_components
from ..operators.ordered import running_total
from ..session import materialise, table
from ..sources.files import read_manifest, scan_tree, tree_against_manifest
from ..sources.ledger import Ledger
from ..sources.sinks import check_inside, write_manifest, write_report
from .views import HASH_BITS, hashed_pool

QUOTAS = {"train": 20, "validation": 4, "test": 4}
THRESHOLD = 3
#: Most members of a group that is written as one row.
MEMBERS = 100_000


def kept_candidates(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """What exact and then near dedup leave of candidates with hashes, as a table."""
    return materialise(dedup.near_survivors(dedup.exact_survivors(rows), threshold, bits=HASH_BITS), "build-kept")


def draw(kept: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """Quotas from every pool of split and class."""
    wanted = kept.sparkSession.createDataFrame([(s, c, q) for s, q in quotas.items() for c in CLASSES], "split string, class_name string, quota bigint")
    return sampling.stratified_sample(kept, ["split", "class_name"], "path", wanted, SEED)


def selection(spark: SparkSession, sf_dir: str, threshold: int = THRESHOLD) -> DataFrame:
    """Exact dedup, near dedup, then quotas from every pool of split and class."""
    rows = hashed_pool(spark, sf_dir).select("path", "split", "class_name", "size_bytes", "md5", "hash")
    return draw(kept_candidates(rows, threshold))


def as_manifest(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"label": F.col("class_name"), "official_split": F.col("split")})


def build(spark: SparkSession, sf_dir: str, folder: str, *, threshold: int = THRESHOLD, quotas: dict[str, int] = QUOTAS, overwrite: bool = False) -> DataFrame:
    """The whole build: dedup, draw, audit, and only if every check passes, manifest and report written to the folder.

    Returns the report, one row: the counters of both dedups, the audit's verdict and the selection's size.
    """
    rows = hashed_pool(spark, sf_dir).select("path", "split", "class_name", "size_bytes", "md5", "hash")
    kept = kept_candidates(rows, threshold)
    chosen = materialise(draw(kept, quotas), "build-selection")
    checks = audit.verdict(audit.selection_checks(as_manifest(chosen), quotas, threshold, bits=HASH_BITS))
    size = chosen.agg(F.count("*").alias("selected"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("selected_bytes"))
    report = materialise(dedup.dedup_stats(rows, kept).crossJoin(checks).crossJoin(size), "build-report")
    found = report.first()
    if not found["passed"]:
        raise CurationError(f"nothing is written: the selection fails {found['failed']}")
    write_manifest(manifest_rows(chosen), check_inside(f"{folder.rstrip('/')}/manifest", folder), overwrite)
    write_report(report, check_inside(f"{folder.rstrip('/')}/report", folder), overwrite)
    return report


def logged_build(spark: SparkSession, sf_dir: str, folder: str, *, threshold: int = THRESHOLD, quotas: dict[str, int] = QUOTAS) -> Ledger:
    """The steps of the build as tables of a folder, each counted in the pass that writes it; a rerun goes on where one stopped."""
    ledger = Ledger(spark, folder, {"documents": table(spark, sf_dir, "documents")}, {"threshold": threshold, "quotas": quotas})
    count = lambda what: F.count_if(F.col("decision") == what)
    names = ("path", "split", "class_name", "size_bytes", "md5", "hash")
    rows = ledger.step("candidates", lambda: hashed_pool(spark, sf_dir).select(*names), {"bytes": F.sum("size_bytes"), "unhashed": F.count_if(F.col("hash").isNull())})
    decided = ledger.step("decided", lambda: dedup.exact_decisions(rows), {k: count(k) for k in ("kept", "cross_class", "same_split", "cross_split")})
    kept = ledger.step("kept", lambda: dedup.near_survivors(decided.where("decision = 'kept'").drop("decision"), threshold, bits=HASH_BITS))
    ledger.step("selection", lambda: draw(kept, quotas), {"bytes": F.sum("size_bytes")})
    return ledger


def reaudit(spark: SparkSession, root: str, manifest: str, *, threshold: int = THRESHOLD, quotas: dict[str, int] = QUOTAS, hash_of: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """A written tree held against its written manifest: the eleven checks (check_name, passed), and what differs (split, label, image_id, state).

    The tree is read once. A decoder's hash_of finds extra files that resemble those of the manifest; without it only
    equal ones are found, and a file counts as readable if its bytes are whole.
    """
    rows = read_manifest(spark, manifest)
    place = F.concat_ws("/", "split", "label", "image_id").alias("path")
    wanted = materialise(rows.select(place, "image_id", "split", "label", "official_split", "md5", F.conv("phash_hex", 16, 10).cast("bigint").alias("hash")), "audit-manifest")
    found = materialise(scan_tree(spark, root, hash_of).select(place, "image_id", "split", "label", "md5", "hash"), "audit-tree")
    return audit.revalidation_checks(wanted, found, quotas, threshold, bits=64), tree_against_manifest(found, wanted)


def manifest_rows(rows: DataFrame) -> DataFrame:
    """Manifest columns of candidates with a hash."""
    image_id = F.concat_ws("_", "split", "class_name", F.concat(X.stem(F.col("path")), X.extension(X.basename(F.col("path")))))
    return rows.select(
        image_id.alias("image_id"), F.col("class_name").alias("label"), "split", F.col("split").alias("official_split"), F.col("path").alias("source_file"),
        F.col("size_bytes").alias("bytes"), "md5", A.hash_hex(F.col("hash")).alias("phash_hex"),
    )


def full_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the selection."""
    return manifest_rows(selection(spark, sf_dir))


def _in_levels(lines: DataFrame, order: list[str], run: int) -> DataFrame:
    """One row (n_rows, fingerprint) of lines in an order without ties: SHA-256 of every run of lines, of every run of these, and so on.

    Lines are numbered by ranges, so no task or group holds more than a run, and the levels grow with the logarithm.
    """
    now = running_total(lines, order, name="place").select("place", F.sha2(F.col("line"), 256).alias("digest"))
    now = materialise(now, "fingerprint")
    n = left = now.count()
    while True:
        each = now.groupBy(F.floor(F.col("place") / run).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("of"))
        now = each.select("place", F.sha2(F.array_join(F.transform("of", lambda x: x["digest"]), ""), 256).alias("digest"))
        left = -(-left // run)
        if left <= 1:
            return now.agg(F.lit(n).cast("bigint").alias("n_rows"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def fingerprint(rows: DataFrame, run: int = 1024) -> DataFrame:
    """A digest of 'split/class/md5' lines in order of path, in levels."""
    line = F.concat_ws("/", "split", "class_name", "md5")
    return _in_levels(rows.select("path", line.alias("line")), ["path", "line"], run)


def manifest_fingerprint(manifest: DataFrame, run: int = 1024) -> DataFrame:
    """A digest of the lines 'split/label/md5' in the manifest's order (by image_id), in levels: one row (n_rows, fingerprint)."""
    line = F.concat_ws("/", "split", "label", "md5")
    return _in_levels(manifest.select("image_id", line.alias("line")), ["image_id", "line"], run)


def summary(rows: DataFrame) -> DataFrame:
    """Counts, shares of the whole and sizes by split."""
    by = rows.groupBy("split").agg(
        F.count_if(F.col("class_name") == "real").alias("real"), F.count_if(F.col("class_name") == "fake").alias("fake"), F.count("*").alias("total"), F.sum("size_bytes").alias("bytes")
    )
    whole = by.agg(F.sum("total").alias("all"))
    return by.crossJoin(F.broadcast(whole)).select("split", "real", "fake", "total", "bytes", A.safe_divide(F.col("total"), F.col("all")).alias("share"))


def provenance(turns: DataFrame) -> DataFrame:
    """One row a frame (here: a turn of a conversation), numbered from 1 by video and frame, with its video's total."""
    totals = turns.groupBy("conv_id").agg(F.count("*").alias("video_frame_count"))
    starts = running_total(totals, ["conv_id"], "video_frame_count")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role"))
    rows = turns.select("conv_id", "turn", "role", place.alias("place")).join(starts, "conv_id")
    name = F.concat(F.lit("c"), "conv_id", F.lit("__frame_"), X.zero_padded(F.col("turn")), F.lit(".png"))
    index = (F.col("before") + F.col("place")).cast("bigint")
    return rows.select(index.alias("manifest_index"), "conv_id", F.col("turn").alias("frame_index"), "role", "video_frame_count", name.alias("frame_name"))


def provenance_frames(videos: DataFrame, frames: DataFrame, *, dataset: str = "videos", compression: str = "c23", method: str = "Deepfakes", root: str = "data/raw") -> DataFrame:
    """The manifest's frames with all their fields, numbered from 1 by video, frame and role.

    videos (sequence_id, source_id, component_id) are manipulated where they have a source; frames are (sequence_id,
    frame_index, role). Numbers come from running totals over videos, so no task numbers all frames.
    """
    ends = F.concat_ws("_", F.col("sequence_id").cast("string"), F.col("source_id").cast("string"))
    fake = F.col("source_id").isNotNull()
    facts = videos.select(
        "sequence_id", "source_id", "component_id", ends.alias("video_name"), F.when(fake, "fake").otherwise("real").alias("label"),
        F.when(fake, "manipulated").otherwise("original").alias("category"), F.when(fake, method).alias("method"),
    )
    totals = frames.groupBy("sequence_id").agg(F.count("*").alias("video_frame_count"))
    starts = running_total(totals, ["sequence_id"], "video_frame_count")
    place = F.row_number().over(W.partitionBy("sequence_id").orderBy("frame_index", "role"))
    rows = frames.select("sequence_id", "frame_index", place.alias("place")).join(starts, "sequence_id").join(facts, "sequence_id")
    name = X.frame_file_name(F.col("component_id").cast("string"), F.col("video_name"), F.col("frame_index"))
    return rows.select(
        (F.col("before") + F.col("place")).cast("bigint").alias("manifest_index"), F.concat_ws("/", F.lit(root), "label", name).alias("rel_path"), F.lit(dataset).alias("source_dataset"),
        F.lit(compression).alias("compression"), "label", "category", "method", F.concat("video_name", F.lit(".mp4")).alias("source_video"), "sequence_id", "source_id", "component_id", "frame_index",
        "video_frame_count", "video_name",
    )


def provenance_manifest(frames: DataFrame) -> DataFrame:
    """The nested manifest, a row a video: its number of frames and these as JSON, in their order.

    A video has as many frames as were sampled from it; one with more than MEMBERS fails instead of growing in one row.
    """
    entry = F.struct("manifest_index", "frame_index", F.col("role").alias("label"), F.col("frame_name").alias("rel_path"))
    frames = frames.where(A.at_most(F.col("video_frame_count"), MEMBERS, "frames of one video"))
    rows = frames.groupBy("conv_id").agg(F.max("video_frame_count").alias("total_frames"), F.sort_array(F.collect_list(entry)).alias("frames"))
    return rows.select(F.concat(F.lit("c"), "conv_id").alias("name"), "total_frames", F.to_json("frames", {"ignoreNullFields": "false"}).alias("frames"))


def extraction_by_label(turns: DataFrame) -> DataFrame:
    """Per label: videos it occurs in, frames, empty ones skipped; and the same of all, under '(all)'."""
    facts = (F.count_distinct("conv_id").alias("videos"), F.count("*").alias("frames"), F.count_if(F.length("text") == 0).alias("skipped"))
    return turns.groupBy(F.col("role").alias("label")).agg(*facts).unionByName(turns.agg(*facts).withColumn("label", F.lit("(all)")))


def identity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, source_id) of every manipulated video: here, every order and the customer it was made from."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("sequence_id"), (F.col("o_orderkey") + 10_000_000).cast("bigint").alias("source_id"))


def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of identities over all edges, with their sizes."""
    parts = connected_components(identity_edges(spark, sf_dir), "sequence_id", "source_id")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    return parts.join(sizes, "component").select("node", "component", "n")


def assign_components(videos: DataFrame, parts: DataFrame, *, strict: bool = True) -> DataFrame:
    """videos (sequence_id, source_id) with the component of their sequence, and whether the source lies in it too.

    A video without a source agrees. Strict: raises where any doesn't, which the components of these videos rule out.
    """
    of = lambda end, name: parts.select(F.col("node").alias(end), F.col("component").alias(name))
    out = videos.join(of("sequence_id", "component_id"), "sequence_id", "left").join(of("source_id", "_other"), "source_id", "left")
    out = out.withColumn("agrees", F.col("source_id").isNull() | F.col("_other").isNull() | F.col("component_id").eqNullSafe(F.col("_other"))).drop("_other")
    if strict and (bad := out.where(~F.col("agrees")).limit(1).collect()):
        raise CurationError(f"the ends of {bad[0]['sequence_id']}_{bad[0]['source_id']} lie in different components")
    return out


def create_splits(rows: DataFrame, *, cap: int | None = CLASS_CAP, seed: int = SEED, ratios=RATIOS, aligned: bool = False) -> DataFrame:
    """rows (path, class_name, source) with their split: each class capped (the second by seed + 1), then split by groups.

    Aligned groups lie in one split across both classes; otherwise each class is split by itself, again by its own seed.
    """
    check_ratios(*ratios)
    seeds = {c: seed + i for i, c in enumerate(CLASSES)}
    used = reduce(DataFrame.unionByName, (sampling.seeded_cap(rows.where(F.col("class_name") == c), "path", cap, s) for c, s in seeds.items()))
    used = materialise(used.select("path", "class_name", "source"), "split-rows")
    if aligned:
        placed = splits.grouped_greedy_split(splits.shared_groups(used, "source"), "source", seed, ratios).select("source", "split")
        return used.join(placed, "source").select("path", "class_name", "source", "split")
    groups = used.groupBy("class_name", "source").agg(F.count("*").alias("n"))
    placed = [splits.prefix_sum_split(groups.where(F.col("class_name") == c), "class_name", "source", "n", s, ratios) for c, s in seeds.items()]
    return used.join(reduce(DataFrame.unionByName, placed).drop("n"), ["class_name", "source"]).select("path", "class_name", "source", "split")


def component_members(parts: DataFrame) -> DataFrame:
    """The members of every component of (node, component), in order, as one name; one with more than MEMBERS fails."""
    sizes = parts.groupBy("component").agg(F.count_distinct("node").alias("size"))
    parts = parts.join(sizes.where(A.at_most(F.col("size"), MEMBERS, "members of one component")), "component")
    members = F.array_join(F.transform(F.sort_array(F.collect_set("node")), lambda x: x.cast("string")), "_")
    return parts.groupBy("component").agg(members.alias("members"), F.count("*").alias("n"))


def problem_lines(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The first problems (name, reason) as lines, in order of reason and name, and how many more there are."""
    bad = rows.where(F.col("reason").isNotNull())
    first = bad.orderBy("reason", "name").limit(limit)
    more = bad.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))
    return first.crossJoin(more).select(F.concat_ws(": ", "reason", "name").alias("problem"), "more")


def dataset_status(rows: DataFrame) -> DataFrame:
    """The dashboard's figures, (what, name, n, present): each class's raw rows, each split's, and all of them."""
    part = lambda what, c: rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    names = rows.sparkSession.createDataFrame([("raw", c) for c in CLASSES] + [("split", s) for s in SPLITS] + [("all", "all")], "what string, name string")
    have = part("raw", "class_name").unionByName(part("split", "split")).unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("all").alias("name"), "n", F.lit("all").alias("what")))
    return F.broadcast(names).join(have, ["what", "name"], "left").select("what", "name", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("present"))
