import random
from itertools import islice

import numpy as np

from sievewright.llm.similarity import Blocks, RTree, Shingler, _pieces, join_local, linked, near_duplicate_groups, pack, vectors


def make(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.choice((6, 30, 80, 200)))] for _ in range(12)]
    out = [None, "", " \n", "one", "one", "One two three", "a b c d e", "a b c d e f"]
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, len(w) // 40 + 1))):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + passage
        out.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    return out


def brute(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").translate(low).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_groups_equal_brute_force(spark):
    texts = make()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    for leaf in (512, 4):  # the second deals every group into leaves
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_groups(docs, leaf_nodes=leaf).collect()}
        assert got == brute(texts)


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "x y z"), (9, "X y z")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in near_duplicate_groups(docs).collect())
    assert got == [(-1, 2, 4), (4, 1, 4), (4, 2, 4), (9, 1, 4)]
    assert near_duplicate_groups(docs.limit(0)).count() == 0


def test_tree_search_loses_no_link():
    sets = [x for x in Shingler().many(make(8, 150)) if len(x)]
    points, sizes = vectors(sets), np.array([len(x) for x in sets])
    tree = RTree(points, sizes)
    for i, x in enumerate(sets):
        found = set(tree.search(points[i], len(x)).tolist())
        assert {j for j, y in enumerate(sets) if linked(x, y)} <= found


def test_blocks_connect_all_links():
    sets = [x for x in Shingler().many(make(9, 90)) if len(x)]
    blocks = Blocks()
    blocks.edges(list(range(len(sets))), [len(x) for x in sets], [pack(p) for p in vectors(sets)])
    for i, x in enumerate(sets):
        for j in range(i):
            if linked(x, sets[j]):
                assert blocks.find(i) == blocks.find(j)


def test_local_join_and_long_texts():
    shingle = Shingler()
    text = "word another " * 120_000  # longer than a piece
    assert len(shingle(text)) == 2
    words = " ".join(str(i) for i in range(300_000))
    assert len(shingle(words)) == 299_996
    assert join_local([shingle(words), shingle(words + " more"), shingle("a b c d e f g")]) == [0, 0, 2]


def test_large_sets_link_in_one_partition(spark):
    rng, texts = random.Random(5), []
    for i in range(24):  # a long text and the same one shortened, at 0.80 to 0.82
        n = (1_000, 1_500, 3_000, 5_000, 10_000, 20_000)[i % 6]
        words = [f"{i}.{rng.getrandbits(40)}" for _ in range(n + 4)]
        texts += [" ".join(words), " ".join(words[: 4 + -(-n * (80 + i // 6 % 3) // 100)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: part for i, (_, part) in brute(texts).items()}


def test_words_longer_than_a_piece():
    for text in ("a " + "x" * 3_000_000, "a " + "x" * 3_000_000 + "\n b", " " * 2_500_000 + "x" * 2_500_000 + " b", "x" * 3_000_000 + " " + "y" * 3_000_000):
        pieces = list(islice(_pieces(text.encode()), 50))
        assert b"".join(pieces) == text.encode() and [w for p in pieces for w in p.split()] == text.encode().split()
    assert len(Shingler()("a b c " + "x" * 3_000_000 + " d e")) == 2
