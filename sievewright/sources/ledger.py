"""Steps of a job as tables that are swapped in whole, with a log that a rerun goes on from.

A step is written to a place of its own and then renamed to its name; only after that its entry goes into the log, by a
rename too. So whatever stops a job, a step is there whole with its entry, or it is done again. What a step counts is
observed in the pass that writes it. An entry names the inputs of the job by fingerprint: other inputs are refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import CurationError
from ..session import hadoop_path

LOG_DDL = "number int, step string, rows bigint, counters map<string, bigint>, fingerprint string"


def fingerprint_of(rows: DataFrame) -> str:
    """A digest of a table's rows and columns that depends on neither order nor partitions: their number, and two sums over their hashes."""
    names = sorted(rows.columns)
    each = F.xxhash64(*(F.col(f"`{c}`") for c in names))
    # Sums of both halves: equal rows add up, where they would cancel out in an exclusive or.
    low, high = each.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(each, 32)
    r = rows.agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high")).first()
    kinds = [rows.schema[c].dataType.simpleString() for c in names]
    return hashlib.sha256(json.dumps([names, kinds, *map(str, r)]).encode()).hexdigest()


class Ledger:
    """The steps of a job in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, inputs: Mapping[str, DataFrame], settings: Mapping[str, object] | None = None):
        """Opens the ledger of a folder or begins one; raises where it was begun with other inputs or settings."""
        self.spark, self.folder = spark, folder.rstrip("/")
        facts = {"inputs": {k: fingerprint_of(v) for k, v in sorted(inputs.items())}, "settings": {k: str(v) for k, v in sorted((settings or {}).items())}}
        self.fingerprint = hashlib.sha256(json.dumps(facts).encode()).hexdigest()
        self.entries = self._read()
        for e in self.entries:
            if e["fingerprint"] != self.fingerprint:
                raise CurationError(f"{folder} was begun with other inputs or settings (step {e['step']}); clear it or take another folder")
        self.again: list[str] = []

    def _read(self) -> list[dict]:
        path, store = hadoop_path(self.spark, f"{self.folder}/log")
        if not store.exists(path):
            return []
        names = sorted(x.getPath().toString() for x in store.listStatus(path) if x.getPath().getName().endswith(".json"))
        return [json.loads("".join(r[0] for r in self.spark.read.text(n).collect())) for n in names]

    def _rename(self, source: str, target: str) -> None:
        here, store = hadoop_path(self.spark, source)
        there, _ = hadoop_path(self.spark, target)
        if not store.rename(here, there):
            raise CurationError(f"{source} could not be moved to {target}")

    def _enter(self, entry: dict) -> None:
        target = f"{self.folder}/log/{entry['number']:04d}-{entry['step']}.json"
        staged, store = hadoop_path(self.spark, f"{self.folder}/staged/{uuid.uuid4().hex}")
        stream = store.create(staged, True)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        store.mkdirs(hadoop_path(self.spark, f"{self.folder}/log")[0])
        self._rename(staged.toString(), target)
        self.entries.append(entry)

    def step(self, name: str, make: Callable[[], DataFrame], counters: Mapping[str, Column] | None = None) -> DataFrame:
        """The table of a step: read where its entry is there, else made, counted as it is written, and swapped in.

        Steps come in one order; a rerun that asks for another one is refused. Counters are sums or counts over rows.
        """
        number = len(self.again)
        self.again.append(name)
        table = f"{self.folder}/{number:04d}-{name}"
        if number < len(self.entries):
            if self.entries[number]["step"] != name:
                raise CurationError(f"step {number} was {self.entries[number]['step']}, not {name}")
            return self.spark.read.parquet(table)
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        seen = Observation()
        counts = [c.cast("bigint").alias(f"n_{k}") for k, c in (counters or {}).items()]
        rows = make()
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.option("compression", "zstd").parquet(staged)
        target, store = hadoop_path(self.spark, table)
        store.delete(target, True)  # a table without an entry is of a run that stopped between the two
        self._rename(staged, table)
        found = seen.get
        self._enter({"number": number, "step": name, "rows": found["rows"], "counters": {k: found[f"n_{k}"] for k in counters or {}}, "fingerprint": self.fingerprint})
        return self.spark.read.parquet(table)

    def log(self) -> DataFrame:
        """A row for every step that is done, in order, however often the job was run."""
        rows = [(e["number"], e["step"], e["rows"], e["counters"], e["fingerprint"]) for e in self.entries]
        return self.spark.createDataFrame(rows, LOG_DDL)
