import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import ballkmeans as bk


def lloyd(rows, clusters, rounds, dim, scale, salt):
    """Every vector against every centroid, in Python's integers."""
    import math

    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in hashed[:clusters]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for k in range(len(centroids)):
                members = [v for (_, v), (_, c) in zip(kept, found) if c == k]
                if members:
                    centroids[k] = [sum(x) // len(members) for x in zip(*members)]
    inertia = [sum(d for d, c in found if c == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i), c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, found))


def spread(rng, n, dim, kind):
    if kind == "apart":  # far groups, so that most are in stable cores
        middles = [[rng.uniform(-4, 4) for _ in range(dim)] for _ in range(6)]
        return [[x + rng.gauss(0, 0.1) for x in rng.choice(middles)] for _ in range(n)]
    if kind == "grid":  # few distinct values: ties in distance, equal centroids, empty clusters
        return [[rng.randint(0, 1) / 4 for _ in range(dim)] for _ in range(n)]
    return [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("kind", ["apart", "grid", "noise"])
def test_equals_every_vector_against_every_centroid(spark, kind):
    rng = random.Random(kind)
    rows = [(i, v) for i, v in enumerate(spread(rng, 240, 5, kind))]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (7, rows[7][1]), (7, rows[8][1]), (900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("-inf")] + [0.0] * 4), (905, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "vector", "cluster", "distance", "key", "n")}).repartition(3)
    got = bk.ball_k_means(frame, clusters=12, rounds=4, dim=5, scale=16).collect()
    got = sorted(((r["vec_id"] is None, r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got)
    assert got == lloyd(rows, 12, 4, 5, 16, bk.SALT)


def test_reassignment_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    for dim, most in ((2, 6), (3, 200), (64, 200)):
        vectors, centroids = rng.integers(-most, most, (400, dim)), rng.integers(-most, most, (20, dim))
        every = bk.squared(vectors, centroids)
        for own in (every.argmin(1), rng.integers(0, 20, 400)):
            radii = {int(i): bk._up(int(every[own == i, i].max())) for i in np.unique(own)}
            near = bk.neighbours(centroids, radii)
            cluster, distance = bk.reassign(vectors.astype(np.int32), own, centroids, near)
            assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    groups = rng.integers(-500, 500, (8, 3)) * 100
    vectors = groups[rng.integers(0, 8, 300)] + rng.integers(-9, 9, (300, 3))
    every = bk.squared(vectors, groups)
    near = bk.neighbours(groups, {int(i): bk._up(int(every[every.argmin(1) == i, i].max())) for i in np.unique(every.argmin(1))})
    assert sum(len(x) for x, _ in near.values()) < 8  # groups far apart are hardly neighbours


def test_large_components_are_exact_and_larger_ones_fail(spark):
    wide = np.array([[bk.LIMIT - 2] * 200, [2 - bk.LIMIT] * 200])
    assert bk.squared(wide, wide)[0, 1] == 200 * (2 * bk.LIMIT - 4) ** 2
    frame = spark.createDataFrame([(1, [20_000.0, 0.0])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="after scaling"):
        bk.ball_k_means(frame, dim=2, clusters=2).collect()


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 1.0])], "vec_id int, embedding array<float>")
    got = bk.ball_k_means(frame, dim=2).collect()
    assert {r["cluster"] for r in got} == {0, 1} and {r["inertia"] for r in got} == {0}
    none = bk.ball_k_means(frame, dim=3)
    assert none.count() == 0 and none.columns == bk.ball_k_means(frame, dim=2).columns
    assert bk.ball_k_means(frame.limit(0), dim=2).count() == 0
