import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sievewright.llm import merkle
from sievewright.llm.columns import LOWER, UPPER

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def tree(nodes, fanout):
    """The root and every node's path, with whole levels in hand."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, above_owners = [], []
        for a in range(0, len(level), fanout):
            run = level[a : a + fanout]
            for k in range(len(run)):
                for i in owners[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(run))
            above_owners.append([i for x in owners[a : a + fanout] for i in x])
        level, owners = above, above_owners
    return level[0], paths


def whole(rows, fanout):
    """(doc_id, leaf, place, path, subroot, root) of all rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0, leaf_of(r)), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([k[2] for k, _ in sorted(groups[s])], fanout) for s in names}
    root, upper = tree([inner[s][0] for s in names], fanout)
    out = []
    for s, over in zip(names, upper):
        for place, ((k, key), path) in enumerate(zip(sorted(groups[s]), inner[s][1])):
            out.append((repr(key), repr(s), k[2], place, tuple(path + over), inner[s][0], root))
    return sorted(out)


def rows_of(rng, n):
    words = ["A", "bé", "", "漢 字", "Z" * 300]
    rows = [(rng.randint(0, 3 * n), rng.choice(["s", "s", "s", "t", "", None, "é", "z"]), rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, *words]) if rng.random() < 0.3 else f"Text {i}") for i in range(n)]
    return [*rows, (None, "s", None, None, None), (None, "s", "en", 1, "x"), rows[0], rows[0], (n * 9, "alone", "en", 1, "y" * 100_000)]


@pytest.mark.parametrize("fanout,n", [(2, 150), (3, 300)])  # blocks of 8 and 27 leaves, so that trees are several blocks high
def test_manifest_equals_whole_levels_in_hand(spark, fanout, n):
    rows = rows_of(random.Random(n), n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("tree", "node", "place", "n", "key", "path", "root", "number", "_part", "block", "carry0", "its")}).repartition(4)
    got = merkle.merkle_manifest(docs, fanout=fanout, carry={"lang": F.col("lang")}).collect()
    found = sorted((repr(r["doc_id"]), repr(r["source"]), r["leaf"], r["place"], tuple(map(tuple, r["path"])), r["subroot"], r["root"]) for r in got)
    assert found == whole(rows, fanout)


def test_traversal_keeps_two_runs_a_level_and_gives_every_path():
    for fanout, levels in ((2, 3), (3, 2), (16, 3)):
        for n in sorted({1, 2, fanout, fanout + 1, fanout**levels - 1, fanout**levels, fanout ** (levels - 1) + 1}):
            leaves = [digest([str(i)]) for i in range(n)]
            high = merkle.levels_of(n, fanout, levels)
            root, paths = tree(leaves, fanout)
            assert merkle.block_root(leaves, high, fanout) == root
            got = [[(run[: 64 * at], run[64 * at + 64 :]) for run, at in path] for path in merkle.traverse(leaves, high, fanout)]
            assert got == paths
    one = [digest(["x"])]
    assert merkle.block_root(one, 2, 4) == digest([digest(one)])  # a last block of a higher tree
    assert list(merkle.traverse(one, 2, 4)) == [[(one[0], 0), (digest(one), 0)]]


def test_rows_are_verified_against_a_root(spark):
    rows = [(i, f"s{i % 3}", "en", 5, f"Text {i}") for i in range(60)]
    manifest = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA), fanout=4)
    root = manifest.first()["root"]
    shown = [r for r in rows if r[0] != 9]
    shown[3] = (3, "s0", "en", 5, "text 3")
    shown.append((100, "s0", "en", 5, "new"))
    got = {r["doc_id"]: r["status"] for r in merkle.verify_rows(spark.createDataFrame(shown, SCHEMA), manifest, root).collect()}
    assert {k: v for k, v in got.items() if v != "verified"} == {3: "changed", 9: "missing", 100: "added"} and len(got) == 61


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, 3, "Aé"), (2, "s", "en", None, None)], SCHEMA)
    for r in docs.select("*", merkle.digest_of([F.col(c) for c in merkle.FIELDS]).alias("leaf")).collect():
        assert r["leaf"] == leaf_of(tuple(r)[:5])
    assert docs.where("doc_id = 2").select(F.translate("source", UPPER, LOWER)).first()[0] == "s"
    none = merkle.merkle_manifest(docs.limit(0))
    assert none.count() == 0 and none.columns == merkle.merkle_manifest(docs).columns
    one = merkle.merkle_manifest(docs.limit(1)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []
