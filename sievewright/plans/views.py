"""The relations of the curation library, stood in for by the tables at hand (no image bytes are needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import hash_from_array
from ..operators.dedup import simhash_table
from ..session import materialise, table

SPLIT_SQL = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"
CLASS_SQL = "CASE WHEN doc_id % 3 = 0 THEN 'fake' ELSE 'real' END"
HASH_BITS = 60
PATH_SQL = "concat('pool/', lpad(CAST(doc_id AS string), 9, '0'), '.txt')"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: path, split, class_name, size_bytes, md5, source."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{PATH_SQL} AS path", f"{SPLIT_SQL} AS split", f"{CLASS_SQL} AS class_name", "CAST(octet_length(text) AS bigint) AS size_bytes", "md5(CAST(text AS binary)) AS md5", "source"
    )


def hashed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the 60-bit hash of their words, null where they have none; a table, so that it is worked out once."""
    return materialise(pool(spark, sf_dir).join(simhash_table(table(spark, sf_dir, "documents")), "doc_id", "left"), "hashed-pool")


def coefficient_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 63 coefficients (the first is dropped) and their median hash."""
    low = F.slice("embedding", 2, 63)
    split = F.expr("CASE vec_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), split.alias("split"), hash_from_array(low).alias("hash"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").cast("int").alias("actual"), F.col("toxic").cast("int").alias("predicted"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs: a user's events in order of time, their value as the validation loss; epochs without a value are no points of the curve."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(order).alias("epoch"), F.col("value").alias("val_loss"))
    return rows.where(F.col("val_loss").isNotNull())


def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes by class: (class_name, source, n)."""
    return pool(spark, sf_dir).groupBy("class_name", "source").agg(F.count("*").alias("n"))
