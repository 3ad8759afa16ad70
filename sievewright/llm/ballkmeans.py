"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and a radius that covers its members. Only clusters whose centroids lie within twice
the radius can take members from it; these are its neighbours, nearest first. A member nearer to its centroid than half
the way to the nearest neighbour is in the stable core and stays. The others lie in annuli, between half the ways to
one neighbour and the next, and are compared exactly with the neighbours up to their annulus. All of this holds in
squared integers (``4 d(x, c)^2 < d(c, c')^2``), so the result is that of comparing every vector with every centroid.

A round is one pass over the vectors, which writes their new clusters, and one aggregate over what it wrote: sums,
counts, and the largest distance, which with the way that the centroid moves bounds the next radius. Centroids (as many
as asked for) are all that passes through the driver. A round's table replaces the one before it.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; null ids
are kept and hashed as the empty text; repeated rows are vectors of their own; where hashes are equal the smaller
vector comes first; ties in distance go to the smaller number; empty clusters keep their centroids; fewer vectors than
centroids give as many centroids as vectors; an empty table gives an empty result; components beyond ``LIMIT`` after
scaling fail by name; other columns don't pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hadoop_path, new_path

CLUSTERS, ROUNDS, DIM, SCALE, SALT = 40, 5, 64, 256, "2"
#: Scaled components lie below this, so that distances and their sums over a ball fit 64 bits.
LIMIT = 1 << 22

RESULT = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid": "array<bigint>", "centroid_sha256": "string"}


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: as a product of doubles where all terms stay below 2^53, else term by term."""
    if 4 * vectors.shape[1] * LIMIT * LIMIT < 1 << 53:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)
    x, c = vectors.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def _up(square: int) -> int:
    """The root, rounded up."""
    root = isqrt(square)
    return root + (root * root < square)


def neighbours(centroids: np.ndarray, radii: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each ball, the centroids within twice its radius, nearest first, and their squared distances."""
    apart = squared(centroids, centroids)
    out = {}
    for i, radius in radii.items():
        near = [j for j in np.argsort(apart[i], kind="stable").tolist() if j != i and int(apart[i, j]) <= 4 * radius * radius]
        out[i] = np.array(near, np.int64), apart[i, near]
    return out


def reassign(vectors: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its squared distance, from the cluster that each is in."""
    cluster, distance = own.copy(), np.zeros(len(own), np.int64)
    order = np.argsort(own, kind="stable")
    bounds = np.flatnonzero(np.diff(own[order])) + 1
    for members in np.split(order, bounds) if len(order) else ():
        i = int(own[members[0]])
        ids, apart = near[i]
        distance[members] = mine = squared(vectors[members], centroids[i : i + 1])[:, 0]
        annulus = np.searchsorted(apart, 4 * mine, side="right")  # 0 is the stable core
        for a in np.unique(annulus[annulus > 0]).tolist():
            there = members[annulus == a]
            those = np.sort(np.append(ids[:a], i))
            d = squared(vectors[there], centroids[those])
            best = d.argmin(1)
            cluster[there], distance[there] = those[best], d[np.arange(len(there)), best]
    return cluster, distance


def _pass(rows: DataFrame, centroids: np.ndarray, near: dict | None) -> DataFrame:
    """id, vector, cluster, distance: by all centroids without near, else from the cluster of each row."""
    dim = centroids.shape[1]
    vector = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column("vector").flatten().to_numpy().reshape(-1, dim)
            if near is None:
                d = squared(vectors, centroids)
                cluster = d.argmin(1)
                distance = d[np.arange(len(d)), cluster]
            else:
                cluster, distance = reassign(vectors, b.column("cluster").to_numpy().astype(np.int64), centroids, near)
            columns = [b.column("id"), b.column("vector").cast(vector), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<int>, cluster int, distance bigint")


def scaled_vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id and vector (integers) of the rows whose vectors are whole."""
    whole = (F.size(vector_col) == dim) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))

    def integer(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) >= LIMIT - 1, F.raise_error(F.concat(F.lit(f"component beyond {LIMIT} after scaling: "), x.cast("string"))).cast("int")).otherwise(F.floor(y).cast("int"))

    return rows.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(vector_col, integer).alias("vector"))


def first_centroids(rows: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors of smallest hash, in its order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "vector").orderBy("key", "vector").limit(clusters).collect()
    return np.array([r["vector"] for r in found], np.int64)


def ball_k_means(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """Per whole vector: id_col, vector, cluster, distance, cluster_inertia, inertia, centroid (final), centroid_sha256."""
    spark = rows.sparkSession
    vectors = scaled_vectors(rows, id_col, vector_col, dim, scale)
    centroids = first_centroids(vectors, clusters, salt)
    if not len(centroids):
        return vectors.limit(0).selectExpr(f"id AS `{id_col}`", "vector", *(f"CAST(NULL AS {kind}) AS {c}" for c, kind in RESULT.items()))
    state, last, near = vectors, None, None
    for turn in range(rounds + 1):
        path = new_path(spark, f"balls-{turn}")
        done = _pass(state, centroids, near)
        done.write.option("compression", "zstd").parquet(path)
        if last:
            target, store = hadoop_path(spark, last)
            store.delete(target, True)
        state, last = spark.read.schema(done.schema).parquet(path), path
        if turn == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.array(*(F.sum(F.get("vector", F.lit(i)).cast("bigint")) for i in range(dim))).alias("sums"))
        moved, radii = centroids.copy(), {}
        for r in sums.collect():  # at most one row a cluster
            i, middle = r["cluster"], [s // r["n"] for s in r["sums"]]
            shift = sum((int(a) - b) ** 2 for a, b in zip(centroids[i], middle))
            moved[i], radii[i] = middle, _up(r["far"]) + _up(shift)
        centroids, near = moved, neighbours(moved, radii)
    per = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    whole = sum(per.values())
    ends = [(i, per.get(i, 0), whole, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    balls = spark.createDataFrame(ends, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>, centroid_sha256 string")
    return state.join(F.broadcast(balls), "cluster").select(F.col("id").alias(id_col), "vector", *RESULT)
