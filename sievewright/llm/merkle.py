"""Merkle manifest of a dataset: a digest per row, one tree per group of rows, one root, and a proof for every row.

Rows of a group ascend by key. Every run of ``fanout`` neighbours becomes the digest of their digests, the last run
with what is left, level by level until one is left; the groups' ends, ordered by group, are joined to the root alike.

The trees are cut into aligned blocks of ``fanout ** LEVELS`` nodes. A block's root is folded with a stack of open runs,
one a level. The roots of blocks are nodes of the tree above, which is cut into blocks in turn, so a few rounds reach
the top at any size. Proofs then come down again: each block, given the proof of its own root, is traversed from its
first leaf to its last. At every level the traversal keeps the run that the path goes through (existing) and builds the
next one (desired) from one leaf a step, so that the next path is there when it is needed; beside the block's leaves it
holds two runs a level, however large the tree. No path is ever shuffled but those of block roots.

Defined cases: null fields are written as ``-``, null keys and groups come first; rows equal in key are ordered by
digest and are leaves of their own, equal rows too; empty and long texts are digested whole; a group of one row is its
own subroot; an empty table gives an empty result; columns not named among the fields are neither digested nor kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_total
from ..session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Levels of a block: 4,096 leaves of 64 bytes at a fan-out of 16.
LEVELS = 3
PATH = "array<struct<left: string, right: string>>"


def digest_of(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of the fields, each its byte count, a colon and its value, or - where it is null."""

    def written(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(written, fields)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _hash(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


class Subtree:
    """Open runs, one a level, filled from below; the run of the top level is what is wanted."""

    def __init__(self, top: int, fanout: int):
        self.runs, self.fanout = [[] for _ in range(top + 1)], fanout

    def add(self, node: str) -> None:
        for run in self.runs[:-1]:
            run.append(node)
            if len(run) < self.fanout:
                return
            node = _hash(run)
            run.clear()
        self.runs[-1].append(node)

    def close(self) -> list[str]:
        """The top run, with what the levels below still hold."""
        for low, high in zip(self.runs, self.runs[1:]):
            if low:
                high.append(_hash(low))
                low.clear()
        return self.runs[-1]


def block_root(leaves: list[str], levels: int, fanout: int) -> str:
    tree = Subtree(levels, fanout)
    for leaf in leaves:
        tree.add(leaf)
    return tree.close()[0]


def traverse(leaves: list[str], levels: int, fanout: int) -> Iterator[list[tuple[str, int]]]:
    """For each leaf in turn, per level the run that its path goes through (joined) and its place there."""
    spans = [fanout ** (k + 1) for k in range(levels)]

    def run(k: int, start: int) -> str:
        tree = Subtree(k, fanout)
        for leaf in leaves[start : start + spans[k]]:
            tree.add(leaf)
        return "".join(tree.close())

    existing = [run(k, 0) for k in range(levels)]
    desired = [Subtree(k, fanout) for k in range(levels)]
    for at in range(len(leaves)):
        for k, span in enumerate(spans):
            if at and at % span == 0:
                existing[k], desired[k] = "".join(desired[k].close()), Subtree(k, fanout)
            if at + span < len(leaves):  # the leaf that the next run of this level takes now
                ahead = at - at % span + span + at % span
                desired[k].add(leaves[ahead])
        yield [(run_, at // (span // fanout) % fanout) for run_, span in zip(existing, spans)]


def levels_of(n: int, fanout: int, most: int) -> int:
    """How often n nodes are joined until one is left; ``most`` where the block is not all of the tree."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _block_roots(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, place, n, node) of the blocks' roots, as nodes of the tree above; n is how many the tree has there."""
    size = fanout**LEVELS

    def roots(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = table.column("n")[0].as_py()
        root = block_root(table.column("node").to_pylist(), levels_of(n, fanout, LEVELS), fanout)
        return pa.table({"tree": [table.column("tree")[0].as_py()], "place": [table.column("place")[0].as_py() // size], "n": [-(-n // size)], "node": [root]})

    keyed = nodes.select("tree", "place", "n", "node", F.floor(F.col("place") / size).alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(roots, "tree string, place bigint, n bigint, node string")


def _descend(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """nodes with path and root, from the paths and roots of their blocks (tree, place, path, root)."""
    size = fanout**LEVELS
    kept = nodes.columns
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def paths(table: pa.Table, block: pa.Table) -> pa.Table:
        if not table.num_rows or not block.num_rows:
            raise ValueError("a block has no root, or a root no block")
        table = table.sort_by("place")
        upper = block.column("path")[0].as_py()
        over_left, over_right = [s["left"] for s in upper], [s["right"] for s in upper]
        left, right, ends = [], [], [0]
        levels = levels_of(table.column("n")[0].as_py(), fanout, LEVELS)
        for path in traverse(table.column("node").to_pylist(), levels, fanout):
            left += [run[: 64 * at] for run, at in path]
            right += [run[64 * at + 64 :] for run, at in path]
            left += over_left
            right += over_right
            ends.append(len(left))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(kind.value_type))
        out = table.select(kept).append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))
        return out.append_column("root", pa.array([block.column("root")[0].as_py()] * table.num_rows, pa.string()))

    keyed = nodes.withColumn("block", F.floor(F.col("place") / size)).groupBy("tree", "block")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields) + f", path {PATH}, root string"
    return keyed.cogroup(above.withColumn("block", F.col("place")).groupBy("tree", "block")).applyInArrow(paths, schema)


def _climb(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, place, path, root) of nodes that are a table, by as many rounds as their trees are high."""
    alone = blocks.where("n = 1").select("tree", "place", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    many = blocks.where("n > 1")
    if many.isEmpty():
        return alone
    upper = materialise(_block_roots(many, fanout), "merkle-blocks")
    found = materialise(_descend(many, _climb(upper, fanout), fanout).select("tree", "place", "path", "root"), "merkle-paths")
    return alone.unionByName(found)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place (in their tree, from 0) and n (rows of the tree); order begins with the tree's column."""
    placed = materialise(running_total(rows, order, name="number"), "merkle-order")
    trees = placed.groupBy(F.col(order[0]).alias("its")).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    joined = placed.join(trees, placed[order[0]] == trees["its"])
    return joined.select(*(placed[c] for c in rows.columns), (F.col("number") - F.col("first")).alias("place"), "n")


def merkle_manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, carry: Mapping[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Per row: key, group, leaf, place (in its group), path, subroot, root, and the carried columns (worked out from docs)."""
    carried = {f"carry{i}": c for i, c in enumerate((carry or {}).values())}
    # A null group's tree is named by the empty text, others by their name after a mark: both sort as they should.
    rows = docs.select(
        F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"),
        F.col(key).alias("key"), digest_of([F.col(f) for f in fields]).alias("node"), *(c.alias(n) for n, c in carried.items()),
    )
    leaves = materialise(_numbered(materialise(rows, "merkle-leaves"), ["tree", "key", "node"]), "merkle-places")
    blocks = materialise(_block_roots(leaves, fanout), "merkle-blocks")
    within = materialise(_climb(blocks, fanout), "merkle-within")
    ends = within.where("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("its"), F.col("root").alias("node"))
    ends = materialise(_numbered(ends, ["tree", "its"]), "merkle-ends")
    top = materialise(_descend(ends, _climb(materialise(_block_roots(ends, fanout), "merkle-blocks"), fanout), fanout), "merkle-top")
    top = top.select(F.col("its").alias("tree"), F.col("node").alias("subroot"), F.col("path").alias("over"), F.col("root").alias("whole"))
    # The path of a block's root goes on with that of its group's end; the subroot travels in front of the root.
    above = within.join(top, "tree").select("tree", "place", F.concat("path", "over").alias("path"), F.concat("subroot", "whole").alias("root"))
    found = _descend(leaves, above, fanout)
    return found.select(
        F.col("key").alias(key), F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).cast(docs.schema[group].dataType).alias(group), F.col("node").alias("leaf"), "place", "path",
        F.left("root", F.lit(64)).alias("subroot"), F.right("root", F.lit(64)).alias("root"), *(F.col(n).alias(c) for n, c in zip(carried, carry or {})),
    )


def verify_rows(docs: DataFrame, manifest: DataFrame, root: str, *, key: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(key, status) of rows of docs against a manifest whose keys are distinct, and a root known from elsewhere.

    ``verified``: the row's digest and the path in the manifest lead to the root; ``changed``: they don't; ``added``: the
    manifest has no such key; ``missing``: docs has none.
    """
    shown = docs.select(F.col(key).alias("k"), digest_of([F.col(f) for f in fields]).alias("shown"))
    kept = manifest.select(F.col(key).alias("key"), "path")
    both = shown.join(kept, F.col("k").eqNullSafe(F.col("key")), "full")
    status = (
        F.when(F.col("path").isNull(), "added").when(F.col("shown").isNull(), "missing")
        .when(fold(F.col("shown"), F.col("path")) == root, "verified").otherwise("changed")
    )
    return both.select(F.coalesce("k", "key").alias(key), status.alias("status"))
