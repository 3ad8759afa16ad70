"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node of its part.

    Every round links neighbours to the smallest node each of them knows, first among larger then among smaller ones,
    until the edges form stars; that takes a number of rounds that grows with the logarithm of the longest path.
    Rounds are tables in the shared folder, so a lost executor costs no more than its part of one round. Self edges
    name their node; null ends are ignored.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = materialise(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "cc-nodes")
    now = both.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialise(now, "cc-edges"), None
    state = _state(now)
    rounds = 0
    while state != before and state[0]:
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        before, state = state, _state(now)
        rounds += 1
    labels = now.groupBy("u").agg(F.min("v").alias("component"))
    found = nodes.join(labels, nodes["node"] == labels["u"], "left")
    return found.select("node", F.coalesce("component", "node").alias("component"))
