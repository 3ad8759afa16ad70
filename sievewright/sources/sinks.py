"""Manifests, reports and split tables written out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MANIFEST_FIELDS, SPLITS, CurationError
from ..functions.names import fresh
from ..functions.text import basename, zero_padded
from ..operators.ordered import running_total
from ..session import hadoop_path, materialise

#: Bytes that are copied at once.
PIECE = 1 << 20


def write_manifest(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV with a header and the manifest's columns, in its order."""
    mode = "overwrite" if overwrite else "errorifexists"
    rows.select(*MANIFEST_FIELDS).orderBy("image_id").coalesce(1).write.mode(mode).csv(path, header=True)


def write_report(row: DataFrame, path: str, overwrite: bool = True) -> None:
    """A one-row report as indented JSON."""
    text = F.to_json(F.struct(*row.columns), {"pretty": "true", "ignoreNullFields": "false"})
    row.select(text.alias("value")).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def with_output_names(rows: DataFrame) -> DataFrame:
    """rows (split, class_name, path) with their place in their folder, from 0, and the name they get there."""
    at, first = fresh(rows.columns, "_at", "_first")
    placed = running_total(rows, ["split", "class_name", "path"], name=at)
    starts = placed.groupBy("split", "class_name").agg(F.min(at).alias(first))
    placed = placed.join(F.broadcast(starts), ["split", "class_name"]).withColumn("ord", (F.col(at) - F.col(first)).cast("int"))
    name = F.concat(zero_padded(F.col("ord")), F.lit("_"), basename(F.col("path")))
    return placed.select(*(f"`{c}`" for c in rows.columns if c not in ("ord", "output_name")), "ord", name.alias("output_name"))


def clear_splits(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders of the three splits below path, plain (train) or of a partitioned table (split=train), and nothing else."""
    gone = []
    for split in SPLITS:
        for name in (split, f"split={split}"):
            target, store = hadoop_path(spark, check_inside(f"{path.rstrip('/')}/{name}", path))
            if store.exists(target) and store.delete(target, True):
                gone.append(name)
    return gone


def write_splits(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """A table partitioned by split and class. Overwriting clears the folders of all three splits first, and only these.

    Rows are named and checked as a table of their own before anything is cleared, so rows may come from that very path.
    """
    named = materialise(with_output_names(rows), "splits")
    twice = named.groupBy("split", "class_name", F.lower("output_name").alias("name")).count().where("count > 1")
    if not twice.isEmpty():
        raise CurationError("two rows would get one name")
    target, store = hadoop_path(rows.sparkSession, path)
    if store.exists(target):
        if not overwrite:
            raise CurationError(f"{path} is there already")
        clear_splits(rows.sparkSession, path)
    named.write.partitionBy("split", "class_name").mode("append").parquet(path)


def quarantine(rows: DataFrame, path: str) -> None:
    """Invalid files' rows kept aside in a table, instead of deleting what they name."""
    rows.where("status = 'invalid'").write.mode("append").parquet(path)


def delete_invalid(rows: DataFrame, allow_delete: bool = False) -> int:
    """Delete invalid (not unsupported) files, only if allowed; returns how many went. Tasks delete what their rows name."""
    if not allow_delete:
        return 0

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        gone = 0
        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(_uri(path))
                if store.get_file_info(name).is_file:  # a task that runs again finds its files gone
                    store.delete_file(name)
                    gone += 1
        yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], ["gone"])

    wanted = rows.where("status = 'invalid'").select("path")
    return int(wanted.mapInArrow(delete, "gone bigint").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0])


def check_inside(path: str, folder: str) -> str:
    """The path made plain, if it lies below the folder; raises where dots or another root lead out of it."""
    scheme, mark, rest = path.rpartition("://")
    root_scheme, _, root = folder.rpartition("://")
    plain: list[str] = []
    for x in rest.split("/"):
        if x == "..":
            if not plain:
                raise CurationError(f"{path} lies outside {folder}")
            plain.pop()
        elif x not in ("", "."):
            plain.append(x)
    inside = [x for x in root.split("/") if x not in ("", ".")]
    if scheme != root_scheme or plain[: len(inside)] != inside or len(plain) == len(inside):
        raise CurationError(f"{path} lies outside {folder}")
    return scheme + mark + ("/" if rest.startswith("/") else "") + "/".join(plain)


def _uri(path: str) -> str:
    """The path with a scheme, as file systems take it; Spark writes local ones with one slash."""
    if ":" not in path.split("/")[0]:
        return f"file://{path}"
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _outputs(rows: DataFrame, folder: str) -> DataFrame:
    return rows.select("path", F.concat_ws("/", F.lit(folder.rstrip("/")), "split", "class_name", "output_name").alias("output_path"))


def _copied(wanted: DataFrame) -> DataFrame:
    """Copies files (path, output_path); gives (output_path, bytes, md5). Tasks open what they copy by its path, and nothing else.

    A task writes to a name of its own attempt that is then renamed, so one that runs again replaces its files. Files
    go through in pieces; contents are never rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        attempt, made = TaskContext.get().taskAttemptId(), set()
        for b in batches:
            out, sizes, sums = [], [], []
            for source, target in zip(b.column("path").to_pylist(), b.column("output_path").to_pylist()):
                here, name = fs.FileSystem.from_uri(_uri(source))
                there, path = fs.FileSystem.from_uri(_uri(target))
                if (parent := path.rpartition("/")[0]) not in made:
                    there.create_dir(parent, recursive=True)
                    made.add(parent)
                size, digest = 0, hashlib.md5()
                with here.open_input_stream(name, compression=None) as stream, there.open_output_stream(f"{path}.{attempt}.tmp", compression=None) as to:
                    while piece := stream.read(PIECE):
                        to.write(piece)
                        digest.update(piece)
                        size += len(piece)
                there.move(f"{path}.{attempt}.tmp", path)
                out.append(target)
                sizes.append(size)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["output_path", "bytes", "md5"])

    return wanted.repartition("output_path").mapInArrow(write, "output_path string, bytes bigint, md5 string")


def copy_files(rows: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Copy files (path, split, class_name, output_name) byte for byte to folder/split/class; gives (output_path, bytes, md5).

    An existing folder is refused unless overwriting, which empties it first.
    """
    target, store = hadoop_path(rows.sparkSession, folder)
    if store.exists(target):
        if not overwrite:
            raise CurationError(f"{folder} is there already")
        store.delete(target, True)
    return materialise(_copied(_outputs(rows, folder)), "copied")


def copy_missing(rows: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Copy only files that the folder has not got (all of them, if overwriting); gives (output_path, bytes, state) of every row.

    What is there is found by listing the folder once, in the cluster and without contents; its rows are ``present``,
    with the size found, the others ``copied``. So a second run copies nothing and counts the same.
    """
    spark = rows.sparkSession
    wanted = _outputs(rows, folder).withColumn("key", _plain(F.col("output_path")))
    target, store = hadoop_path(spark, folder)
    if overwrite or not store.exists(target):
        there = spark.createDataFrame([], "key string, bytes bigint")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        there = materialise(found.select(_plain(F.col("path")).alias("key"), F.col("length").alias("bytes")), "there")
    new = _copied(wanted.join(there, "key", "left_anti")).select("output_path", "bytes", F.lit("copied").alias("state"))
    old = wanted.join(there, "key").select("output_path", "bytes", F.lit("present").alias("state"))
    return materialise(new.unionByName(old), "copied")


def _plain(path: Column) -> Column:
    """A path without scheme and authority, by which names of one folder can be compared."""
    return F.regexp_replace(path, r"^[a-z0-9]+:(?://[^/]*)?(?=/)", "")
