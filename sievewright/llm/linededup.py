"""Line dedup over levelled sorted runs of line hashes.

A store keeps, for every line key seen, the smallest document id that holds it, as runs: tables bucketed and sorted by
hash in the shared folder. Documents come in batches of rising ids. A batch's keys are grouped once, into a table with
the runs' buckets and order; merging it with the runs, bucket by bucket, then needs neither an exchange nor a sort.
Keys found there keep their earlier holder, the others (the anti-join) make the batch's own run. When a level has
``fanout`` runs and another batch is to come, they are merged into one of the next level, so a batch meets few runs
however many came before it. The store writes down its levels after every batch, under a new number, so that a later
session can open it and go on, and a session that dies leaves it as it was before.

Keys are 128-bit hashes (two 64-bit hashes with different salts). Counts per key are reduced before the shuffle, so a
line that a third of all documents hold costs one row a task; a document's dropped lines come back as numbers of
lines, and texts are put together again from the whole text.

Defined cases: null or empty text is one empty line, which is kept; rows with a null id count as one document with the
largest id; rows of one id, repeated rows among them, are one document, each rebuilt by itself; texts of any number of
lines are read whole, in linear time; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path, materialise, new_path
from .columns import lower_ascii

MIN_CHARS = 10
#: Batches of a table that is given whole, and runs of a level that are merged; fewer than the batches, so that merged runs are met.
BATCHES = 4
FANOUT = 2
KEY = ["h1", "h2"]
LAST = 2**63 - 1
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_DDL = "h1 bigint, h2 bigint, holder bigint, latest bigint"


class LineStore:
    """Keys seen so far and their first holders, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int | None = None, fanout: int = FANOUT):
        """Opens the store in the folder, or begins one there with so many buckets (the session's shuffle partitions by default)."""
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.tables: list[str] = []
        found = self._states()
        state = json.loads("".join(r[0] for r in spark.read.text(f"{self.folder}/state-{found[-1]:06d}").collect())) if found else {}
        self.number = found[-1] if found else 0
        self.buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = state.get("levels", [[]])

    def _states(self) -> list[int]:
        path, store = hadoop_path(self.spark, self.folder)
        names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
        marked = [n for n in names if n.startswith("state-") and store.exists(hadoop_path(self.spark, f"{self.folder}/{n}/_SUCCESS")[0])]
        return sorted(int(n.removeprefix("state-")) for n in marked)

    def _save(self) -> None:
        self.number += 1
        state = json.dumps({"buckets": self.buckets, "levels": self.levels})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.folder}/state-{self.number:06d}")

    @contextmanager
    def _planned(self) -> Iterator[None]:
        """Within it, runs are tables of the catalogue whose order Spark takes as given; afterwards nothing of that is left.

        A bucket of a run is one sorted file, and only with a setting of the session is it read as such.
        """
        before = self.spark.conf.get(ORDERED, None)
        self.spark.conf.set(ORDERED, "true")
        try:
            yield
        finally:
            for name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay
            self.tables.clear()
            if before is None:
                self.spark.conf.unset(ORDERED)
            else:
                self.spark.conf.set(ORDERED, before)

    def write(self, rows: DataFrame, label: str) -> str:
        """Rows by key, as a table in the store's buckets and order; returns its name in the folder."""
        name = f"{label}-{uuid.uuid4().hex}"
        table = f"sievewright_lines_{uuid.uuid4().hex}"
        bucketed = rows.select("h1", "h2", "holder", "latest").write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        bucketed.option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return name

    def read(self, name: str) -> DataFrame:
        """A table of the store, with its buckets and order known to the planner; for use within ``_planned``."""
        table = f"sievewright_lines_{uuid.uuid4().hex}"
        clause = f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS"
        self.tables.append(table)
        self.spark.sql(f"CREATE TABLE {table} ({_DDL}) USING parquet {clause} LOCATION '{self.folder}/{name}'")
        return self.spark.table(table)

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch: keys (h1, h2, holder, latest), a row a key, latest its largest id there.

        Returns those of them that some document of the batch loses, with the holder that counts, as a table. Full
        levels are merged before a batch, not after it, so no run is merged that nothing reads.
        """
        with self._planned():
            return materialise(self._add(keys), "losing")

    def _add(self, keys: DataFrame) -> DataFrame:
        while any(len(level) >= self.fanout for level in self.levels):
            self._compact()
        batch = self.read(self.write(keys, "batch"))
        merged = batch.withColumn("earlier", F.lit(None).cast("bigint"))
        for name in (n for level in self.levels for n in level):
            run = self.read(name).select("h1", "h2", F.col("holder").alias("_held"))
            merged = merged.join(run.hint("merge"), KEY, "left").withColumn("earlier", F.coalesce("earlier", "_held")).drop("_held")
        fresh = merged.where(F.col("earlier").isNull())
        self.levels[0].append(self.write(fresh, "run"))
        self._save()
        return merged.withColumn("holder", F.coalesce("earlier", "holder")).where(F.col("latest") > F.col("holder")).select(*KEY, "holder")

    def _compact(self) -> None:
        """Merges the first level that is full into one run of the next, two runs at a time: they share no key, so a full join of sorted buckets is the merge."""
        i = next(i for i, level in enumerate(self.levels) if len(level) >= self.fanout)
        if i + 1 == len(self.levels):
            self.levels.append([])
        one, *others = self.levels[i]
        for name in others:
            other = self.read(name).withColumnsRenamed({"holder": "_holder", "latest": "_latest"})
            both = self.read(one).join(other.hint("merge"), KEY, "full").select(*KEY, F.coalesce("holder", "_holder").alias("holder"), F.coalesce("latest", "_latest").alias("latest"))
            one = self.write(both, f"level{i + 1}")
        self.levels[i + 1].append(one)
        self.levels[i] = []


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_key, line, h1, h2) of all lines long enough to count."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("line", "raw")
    )
    key = lower_ascii(F.regexp_replace("raw", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    lines = lines.withColumn("key", key).where(F.char_length("key") >= min_chars)
    return lines.select("id", "text_key", "line", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def _bounds(lines: DataFrame, batches: int) -> list[int]:
    if batches < 2:
        return []
    cuts = lines.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, *, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS, store: LineStore | None = None) -> DataFrame:
    """(id, text_key, lines): the numbers of the lines that each document loses; only documents that lose any.

    With a store, its keys count as held by earlier documents, and those of docs (of larger ids) are added to it.
    """
    spark = docs.sparkSession
    lines = materialise(keyed_lines(docs, min_chars), "lines")
    store = store or LineStore(spark, new_path(spark, "line-store"), fanout=fanout)
    edges, parts = _bounds(lines, batches), []
    for low, high in zip([None, *edges], [*edges, None]):
        batch = lines
        batch = batch if low is None else batch.where(F.col("id") > low)
        batch = batch if high is None else batch.where(F.col("id") <= high)
        keys = batch.groupBy(*KEY).agg(F.min("id").alias("holder"), F.max("id").alias("latest"))
        # Only keys that some document of the batch loses go on to meet its lines.
        losing = store.add(keys)
        parts.append(batch.join(losing, KEY).where(F.col("id") != F.col("holder")).select("id", "text_key", "line"))
    return reduce(DataFrame.unionByName, parts).groupBy("id", "text_key").agg(F.collect_set("line").alias("lines"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, drops = b.column("text").to_pylist(), b.column("lines").to_pylist()
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts, drops):
            lines = text.split("\n")
            n_lines.append(len(lines))
            n_dropped.append(len(drop or ()))
            if drop:
                gone = set(drop)
                text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"]
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _rebuild(batches):
        sums = [hashlib.sha256(t.encode()).hexdigest() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def dedup_lines(docs: DataFrame, *, digest: bool = False, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and its text without repeated lines (or, with digest, that text's SHA-256)."""
    drops = dropped_lines(docs, **options).hint("shuffle_hash")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("text_key"))
    rows = rows.join(drops, ["id", "text_key"], "left").select("doc_id", "text", "lines")
    last = "kept_sha256 string" if digest else "text string"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_digest if digest else _rebuild, f"doc_id {kind}, n_lines bigint, n_dropped bigint, {last}")
