"""Linear scoring with a guarded checkpoint: weights as a table, read and checked once, multiplied by whole batches.

A checkpoint is a table of its own in the shared folder: a row of facts (format, name, sizes, a digest of the weights)
and a row for every class. It is at most as large as classes times inputs, which loading checks before anything is sent
to the tasks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import CurationError

FORMAT = 1
_DDL = "kind string, index int, format int, name string, classes int, inputs int, digest string, bias double, weights array<double>"
#: Most numbers of a model that is sent to the tasks (8 bytes each).
MAX_NUMBERS = 32_000_000


class Linear(NamedTuple):
    name: str
    bias: np.ndarray
    weights: np.ndarray


def nearest_mean(rows: DataFrame, label: str, vector: str, inputs: int, name: str = "nearest-mean") -> Linear:
    """The linear model whose largest logit is that of the class with the nearest mean vector; labels are 0, 1, 2 ...

    Sums by class are the only thing that leaves the tasks; rows without a label or with another length don't count.
    """
    sound = rows.where((F.size(vector) == inputs) & F.col(label).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    sums = sound.groupBy(F.col(label).cast("int").alias("c")).agg(F.array(*(F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(inputs))).alias("m")).orderBy("c").collect()
    if [r["c"] for r in sums] != list(range(len(sums))) or not sums:
        raise CurationError(f"labels are not 0 to {len(sums) - 1}, each with a vector")
    means = np.array([r["m"] for r in sums])
    return Linear(name, -(means**2).sum(1) / 2, means)


def _digest(bias: np.ndarray, weights: np.ndarray) -> str:
    numbers = [*bias.tolist(), *weights.ravel().tolist()]
    return hashlib.sha256(struct.pack(f"<{len(numbers)}d", *numbers)).hexdigest()


def save_checkpoint(spark: SparkSession, model: Linear, path: str, overwrite: bool = False) -> None:
    classes, inputs = model.weights.shape
    rows = [("facts", None, FORMAT, model.name, classes, inputs, _digest(model.bias, model.weights), None, None)]
    rows += [("class", i, None, None, None, None, None, float(b), [float(x) for x in w]) for i, (b, w) in enumerate(zip(model.bias, model.weights))]
    spark.createDataFrame(rows, _DDL).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> Linear:
    """The model of a checkpoint; one that is missing, of another format, incomplete or damaged is refused with the reason."""

    def refuse(reason: str):
        return CurationError(f"the checkpoint {path} can't be used: {reason}")

    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        raise refuse("there is none" if "PATH_NOT_FOUND" in str(e) else "it is no table") from e
    if missing := {c.split()[0] for c in _DDL.split(", ")} - set(table.columns):
        raise refuse(f"it lacks {', '.join(sorted(missing))}")
    facts = table.where("kind = 'facts'").limit(2).collect()
    if len(facts) != 1:
        raise refuse("it has no row of facts" if not facts else "it has several rows of facts")
    f = facts[0]
    if f["format"] != FORMAT:
        raise refuse(f"its format is {f['format']}, not {FORMAT}")
    if not f["classes"] or not f["inputs"] or f["classes"] * f["inputs"] > MAX_NUMBERS:
        raise refuse(f"{f['classes']} classes of {f['inputs']} inputs are none or too many")
    rows = table.where("kind = 'class'").orderBy("index").limit(f["classes"] + 1).collect()
    if [r["index"] for r in rows] != list(range(f["classes"])):
        raise refuse("its classes are not all there, once each")
    if any(r["bias"] is None or r["weights"] is None or len(r["weights"]) != f["inputs"] or None in r["weights"] for r in rows):
        raise refuse(f"a class has not {f['inputs']} weights and a bias")
    bias, weights = np.array([r["bias"] for r in rows]), np.array([r["weights"] for r in rows])
    if _digest(bias, weights) != f["digest"]:
        raise refuse("its weights are not those that were saved")
    if not (np.isfinite(bias).all() and np.isfinite(weights).all()):
        raise refuse("a weight is no number")
    return Linear(f["name"], bias, weights)


def score(rows: DataFrame, model: Linear, vector: str, *, name: str = "logits") -> DataFrame:
    """rows with the logits of every class; null where the vector is null, of another length or has nulls.

    The model is broadcast, so a worker has it once however many batches it goes through; a batch is one product.
    """
    rows = rows.drop(name)
    at, inputs, classes = rows.columns.index(vector), model.weights.shape[1], len(model.bias)
    sent = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        turned = weights.T.copy()
        for b in batches:
            column = b.column(at)
            sound = [x is not None and len(x) == inputs and None not in x for x in column.to_pylist()] if column.null_count or column.flatten().null_count or len(column.flatten()) != inputs * len(column) else None
            whole = column if sound is None else column.filter(pa.array(sound))
            logits = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, inputs) @ turned + bias
            sizes = np.full(b.num_rows, classes) if sound is None else np.array(sound) * classes
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            nulls = None if sound is None else pa.array([not s for s in sound])
            out = pa.ListArray.from_arrays(pa.array(ends), pa.array(logits.ravel()), mask=nulls)
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} array<double>").fields]))
