"""File scans, manifests and tolerant JSON, by Spark's own readers, which leave out files without a byte."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASSES, MANIFEST_DDL, MAX_BYTES, MAX_SIDE, MIN_SIDE, POOL_SUFFIXES, SPLIT_ALIASES, SPLITS, UPLOAD_SUFFIXES, CurationError
from ..functions.names import fresh
from ..functions.text import basename, extension, stem, video_name
from .images import inspected

_EMPTY = "path string, modificationTime timestamp, length bigint, content binary"


def _binary(spark: SparkSession, folder: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    try:
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], _EMPTY)
        raise


def suffix(path: Column) -> Column:
    """The suffix of a path's name: unlike ``extension``, a leading dot starts none."""
    name = basename(path)
    return F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0, extension(name)).otherwise("")


def decodable(content: Column) -> Column:
    """Whether the bytes are a whole file of a supported format, as far as they tell without decoding (see ``images``).

    A decoder can be passed to ``scan_folder`` in its place.
    """
    return F.coalesce(inspected(content)["whole"], F.lit(False))


def inspect_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, filename, size_bytes, format, width, height, reason): what each file's bytes say, and why it is refused (null: it isn't)."""
    files = _binary(spark, folder, recursive).select("path", basename(F.col("path")).alias("filename"), F.col("length").alias("size_bytes"), inspected(F.col("content")).alias("seen"))
    side = lambda c: F.when(F.col("seen.whole"), F.col(f"seen.{c}")).alias(c)
    rows = files.select("path", "filename", "size_bytes", F.col("seen.format").alias("format"), side("width"), side("height"))
    return rows.withColumn("reason", reject_reason(*(F.col(c) for c in ("filename", "size_bytes", "width", "height", "format"))))


def find_files(spark: SparkSession, folder: str, suffixes=UPLOAD_SUFFIXES, recursive: bool = True) -> DataFrame:
    """Paths and sizes of supported files, by path; a missing folder has none. Contents are never read."""
    files = _binary(spark, folder, recursive).select("path", F.col("length").alias("size_bytes"))
    return files.where(suffix(F.col("path")).isin(*suffixes)).orderBy("path")


def scan_folder(spark: SparkSession, folder: str, class_name: str, suffixes=UPLOAD_SUFFIXES, is_decodable=decodable) -> DataFrame:
    """(class_name, path, status): each file once, as valid, invalid (supported, not decodable) or unsupported."""
    files = _binary(spark, folder)
    status = F.when(~suffix(F.col("path")).isin(*suffixes), "unsupported").when(is_decodable(F.col("content")), "valid").otherwise("invalid")
    return files.select(F.lit(class_name).alias("class_name"), "path", status.alias("status"))


def scan_classes(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (scan_folder(spark, folder, name) for name, folder in folders.items()))


def count_files(spark: SparkSession, folder: str) -> int:
    return find_files(spark, folder).count()


def split_of_folder(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for split, names in SPLIT_ALIASES.items():
        out = F.when(F.lower(name).isin(*names), split).otherwise(out)
    return out


def scan_pool(spark: SparkSession, root: str) -> DataFrame:
    """Candidates (path, split, class_name, size_bytes, md5) in root/<split>/<class>, not below; all six folders must have files.

    Labels come from folders, never from names.
    """
    parts = F.split("path", "/")
    below = F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")) - len([x for x in root.rpartition(":")[2].split("/") if x])
    files = _binary(spark, root).where(below == 4).select("path", "length", "content", F.element_at(parts, -2).alias("class_name"), split_of_folder(F.element_at(parts, -3)).alias("split"))
    files = files.where(F.col("split").isNotNull() & F.lower("class_name").isin(*CLASSES) & suffix(F.col("path")).isin(*POOL_SUFFIXES))
    rows = files.select("path", "split", F.lower("class_name").alias("class_name"), F.col("length").alias("size_bytes"), F.md5("content").alias("md5"))
    found = rows.select("split", "class_name").distinct().count()
    if found < len(SPLITS) * len(CLASSES):
        raise CurationError(f"{root} has files for {found} of {len(SPLITS) * len(CLASSES)} pairs of split and class")
    return rows


def misnamed(candidates: DataFrame) -> DataFrame:
    """How many names begin with the other class; a warning only."""
    name = F.lower(stem(F.col("path")))
    wrong = (F.startswith(name, F.lit("real")) & (F.col("class_name") != "real")) | (F.startswith(name, F.lit("fake")) & (F.col("class_name") != "fake"))
    return candidates.agg(F.count_if(wrong).alias("misnamed"))


def labelled_split(spark: SparkSession, folder: str) -> DataFrame:
    """(path, label) of a split's class folders; labels by the fixed map, in order of class, then path."""
    rows = [find_files(spark, f"{folder}/{c}").select("path", F.lit(i).alias("label")) for i, c in enumerate(CLASSES)]
    return reduce(DataFrame.unionByName, rows).orderBy("label", "path")


def reject_reason(name: Column, size: Column, width: Column, height: Column, fmt: Column) -> Column:
    """Why an upload is refused, by the first check it fails; null where it passes. Null sides are undecodable."""
    ext = extension(name)
    return (
        F.when(ext == "", "no_extension")
        .when(~ext.isin(*UPLOAD_SUFFIXES), "unsupported_extension")
        .when(size <= 0, "empty")
        .when(size > MAX_BYTES, "too_large")
        .when(width.isNull() | height.isNull(), "undecodable")
        .when((width < MIN_SIDE) | (height < MIN_SIDE), "too_small")
        .when((width > MAX_SIDE) | (height > MAX_SIDE), "too_many_pixels")
        .when(~F.coalesce(fmt, F.lit("")).isin("JPEG", "PNG"), "unsupported_format")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest by its fixed schema; digests are never taken for numbers."""
    return spark.read.schema(MANIFEST_DDL).csv(path, header=True)


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON document, or None where it is missing or no JSON."""
    try:
        out = spark.read.option("multiLine", "true").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return None if not out.columns or out.columns == ["_corrupt_record"] else out


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or () if x.isDirectory())


def split_folders(spark: SparkSession, root: str) -> dict[tuple[str, str], str] | None:
    """Folder of every (split, class) below root, by any of the splits' names; None unless all six are there."""
    names = {alias: split for split, aliases in SPLIT_ALIASES.items() for alias in aliases}
    found = {}
    for folder in _folders(spark, f"{root.rstrip('/')}/*/*"):
        *_, split, label = folder.rsplit("/", 2)
        if split.lower() in names and label.lower() in CLASSES:
            found.setdefault((names[split.lower()], label.lower()), folder)
    return found if len(found) == len(SPLITS) * len(CLASSES) else None


def find_pool_root(spark: SparkSession, folder: str) -> str:
    """The first folder that holds a whole pool: the folder itself, else one up to three levels below, by level and name."""
    for depth in range(4):
        for root in _folders(spark, folder.rstrip("/") + "/*" * depth):
            if split_folders(spark, root):
                return root
    raise CurationError(f"no folder in {folder} holds all splits and classes")


def scan_tree(spark: SparkSession, root: str, hash_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, split, label, image_id, bytes, md5, hash) of the files of a written tree, root/<split>/<class>/<name>; missing folders have none.

    Without a decoder's hash_of (of the contents), hash is a digest of whole files, which is near no other; null where
    a file is damaged.
    """
    files = _binary(spark, root)
    parts = F.split("path", "/")
    content = F.col("content")
    value = hash_of(content) if hash_of else F.when(decodable(content), F.xxhash64(content).bitwiseAND(F.lit((1 << 63) - 1)))
    rows = files.select(
        "path", F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("image_id"),
        F.col("length").alias("bytes"), F.md5(content).alias("md5"), value.alias("hash"),
    )
    return rows.where(F.col("split").isin(*SPLITS) & F.col("label").isin(*CLASSES) & suffix(F.col("path")).isin(*POOL_SUFFIXES))


def tree_against_manifest(tree: DataFrame, manifest: DataFrame) -> DataFrame:
    """(split, label, image_id, state) of what differs: missing, extra or changed."""
    key = ["split", "label", "image_id"]
    wanted, found = fresh(key, "_wanted", "_found")
    both = manifest.select(*key, F.col("md5").alias(wanted)).join(tree.select(*key, F.col("md5").alias(found)), key, "full_outer")
    state = F.when(F.col(found).isNull(), "missing").when(F.col(wanted).isNull(), "extra").when(F.col(wanted) != F.col(found), "changed")
    return both.select(*key, state.alias("state")).where("state IS NOT NULL")


def discover_videos(spark: SparkSession, originals: str, manipulated: str, method: str = "Deepfakes", glob: str = "*.mp4") -> DataFrame:
    """(path, kind, method, sequence_id, source_id, label) of the videos of two folders, by path; labels come from the folder.

    A missing folder has none. A name that is no '123' or '123_456' raises.
    """
    found = []
    for folder, label, way in ((originals, "real", None), (manipulated, "fake", method)):
        files = _binary(spark, folder, recursive=False, glob=glob).select("path", video_name(stem(F.col("path"))).alias("v"))
        found.append(files.select("path", "v.kind", F.lit(way).cast("string").alias("method"), "v.sequence_id", F.when(F.lit(way is not None), F.col("v.source_id")).alias("source_id"), F.lit(label).alias("label")))
    rows = found[0].unionByName(found[1])
    if bad := rows.where("kind IS NULL").orderBy("path").limit(1).collect():
        raise CurationError(f"no video name: {bad[0]['path']}")
    return rows.orderBy(F.desc("label"), "path")
