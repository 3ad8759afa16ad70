"""A corpus from documents, stage by stage: quality rules, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with the columns of documents; the last
adds the slot and the shard. Between stages the rows are written as Parquet and read again, so a lost executor costs
one stage's part at most.

Defined cases: rows with null ids are documents of their own by their text; of rows with one id, or equal rows, the
near-duplicate stage leaves one; empty and null texts fail the quality rules; an empty table leaves an empty table with
the same columns; columns that the stages don't know pass through, but for ``slot`` and ``shard``, which the last stage
sets; tables that lack a column a stage reads fail by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.names import fresh
from sievewright.llm.decontaminate import decontaminate
from sievewright.llm.mixing import mix_sources
from sievewright.llm.quality import quality_rules
from sievewright.llm.sharding import assign_shards
from sievewright.llm.similarity import near_duplicate_groups
from sievewright.session import materialise, table

#: Ids from here on stand for rows without one.
NO_ID = 1 << 62


def _as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    # A filter would be pushed below the columns it is made of and have them worked out twice; a row number, which
    # no filter may pass, keeps it above them.
    row, verdict = fresh(docs.columns, "_row", "quality")
    judged = quality_rules(docs, name=verdict).withColumn(row, F.monotonically_increasing_id())
    return _as_before(judged.where(F.col(f"{verdict}.kept") & (F.col(row) >= 0)), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles, the one with the smallest id; of rows of one id, one text, once."""
    ident, key, n_rows = fresh(docs.columns, "_id", "_key", "_rows")
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID) + F.pmod(hashed, F.lit(1 << 61)))
    keyed = docs.withColumns({ident: number, key: hashed})
    groups = near_duplicate_groups(keyed.select(F.col(ident).alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias(ident)).agg(F.count("*").alias(n_rows))
    # Most ids have one row; only where there are more is it asked which text and which of equal rows stays.
    first = materialise(first, "near-first")
    # The same join at every size: the ids kept grow with the documents, so they are never broadcast.
    left = keyed.join(first.hint("merge"), ident)
    if first.where(F.col(n_rows) > 1).isEmpty():
        return _as_before(left, docs)
    many = left.where(F.col(n_rows) > 1)
    chosen = many.groupBy(ident).agg(F.min(key).alias(key))
    one = many.join(chosen, [ident, key], "left_semi").dropDuplicates([ident, key])
    return _as_before(left.where(F.col(n_rows) == 1).unionByName(one), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    ident, key = fresh(docs.columns, "_id", "_key")
    found = found.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key))
    same = docs["doc_id"].eqNullSafe(found[ident]) & (F.xxhash64(docs["text"]) == found[key])
    return _as_before(docs.join(found, same, "left_anti"), docs)


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their shares."""
    (mix,) = fresh(docs.columns, "mix")
    return _as_before(mix_sources(docs, name=mix).where(f"{mix}.sampled"), docs)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and shard."""
    return assign_shards(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", draw_mixture),
    ("sharding", place_on_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
