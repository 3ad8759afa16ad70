"""The thin queries over whole tables: each applies its operator and derives the columns agreed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .ballkmeans import ball_k_means
from .bpe import decode_ids, encode_texts
from .columns import LOWER, UPPER
from .decontaminate import decontaminate
from .htmltree import extract_pages
from .licenses import scan_licenses
from .linededup import dedup_lines
from .merkle import FIELDS, digest_of, fold, merkle_manifest, siblings
from .mixing import mix_sources
from .oracles import ORACLES
from .ppm import score_documents
from .quality import quality_rules
from .sharding import assign_shards
from .similarity import near_duplicate_groups
from .warc import round_trip


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    fields = ("source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")
    return mixed.select("doc_id", *(F.col(f"mix.{f}").alias(f) for f in fields))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return found.select("doc_id", *(F.col(f"licenses.{f}").alias(f) for f in fields))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"quality.{f}").alias(f) for f in fields))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), digest=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), offsets=False)
    back = decode_ids(encoded.select("doc_id", "tokens.ids"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_k_means(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    shown = digest_of([tampered if f == "text" else F.col(f) for f in FIELDS])
    found = merkle_manifest(docs, carry={"shown": shown})
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("shown"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_licenses": op3_licenses,
    "op4_html_extraction": op4_html_extraction,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_bpe": op11_bpe,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_merkle_manifest": op13_merkle_manifest,
}

__all__ = ["ORACLES", "QUERIES"]
