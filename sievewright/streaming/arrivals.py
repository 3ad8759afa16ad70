"""New files of a growing folder, each taken once; the stream's checkpoint is the ledger of what was taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def take_new(spark: SparkSession, folder: str, state: str, *, glob: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Take what came to the folder since the last run with this state; gives all that was taken so far: (path, bytes, batch).

    A run takes all there is and ends. A batch is planned in the checkpoint before it is written, under its number; one
    that was stopped half way is written again in its place, so no file is lost or listed twice. Contents are not read.
    """
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true")
    for name, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", files_a_batch)):
        reader = reader.option(name, str(value)) if value else reader
    rows = reader.load(folder).select("path", F.col("length").alias("bytes"))

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{state}/taken/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return taken(spark, state)


def taken(spark: SparkSession, state: str) -> DataFrame:
    """What runs with this state have taken."""
    path, store = hadoop_path(spark, f"{state}/taken")
    empty = spark.createDataFrame([], "path string, bytes bigint, batch bigint")
    return spark.read.schema(empty.schema).parquet(f"{state}/taken") if store.exists(path) else empty


def next_files(listing: DataFrame, had: DataFrame, first: int | None = None) -> DataFrame:
    """Of a listing (path, ...), in order of path and cut to its first rows, those that were not had before."""
    head = listing.orderBy("path").limit(first) if first and first > 0 else listing
    return head.join(had.select("path"), "path", "left_anti")
