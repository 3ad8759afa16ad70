"""Counts and exact duplicates of candidates that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CANDIDATE_DDL = "path string, split string, class_name string, size_bytes bigint, md5 string, seen_at timestamp"


def candidate_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Candidates from Parquet files dropped into a folder."""
    return spark.readStream.schema(CANDIDATE_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_counts(candidates: DataFrame) -> DataFrame:
    """Counts and bytes by split and class; the state is one row a cell."""
    return candidates.groupBy("split", "class_name").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def hourly_arrivals(candidates: DataFrame, late: str = "1 hour") -> DataFrame:
    """Arrivals by hour and class; hours close once the watermark has passed them."""
    return candidates.withWatermark("seen_at", late).groupBy(F.window("seen_at", "1 hour"), "class_name").agg(F.count("*").alias("n"))


def first_seen(candidates: DataFrame, late: str = "1 day") -> DataFrame:
    """Candidates whose digest did not occur within the watermark before them; the state holds that long only."""
    return candidates.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["md5"])


def to_memory(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()
