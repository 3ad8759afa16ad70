"""The pipeline against a restatement of all its stages, on small tables with awkward rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from sievewright.llm.sharding import SHARDS, TABLE_SIZE, fill_table

#: Columns of a caller with names that stages might use themselves; they come out as they went in.
CLASHES = ("_x", "_row", "_id", "_key", "_rows", "_quality_n", "_mix_tokens", "_mix_p", "quality", "mix", "words")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    common = "the of and to in a is that for it".split()
    word = lambda: rng.choice(common) if rng.random() < 0.25 else "".join(rng.choice("aeioulnrst") for _ in range(5))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(10)).capitalize() for _ in range(n)) + "."
    item = prose(3)
    texts = [prose(12) for _ in range(30)]
    texts += [texts[0], texts[1].upper().lower() + " more", texts[2] + "\n" + item, "bad", "### $$$ " * 60, None, "", prose(3000)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (6, prose(11), "en", "s0"), (None, texts[7], "en", None), (None, prose(9), None, "s1"), (None, prose(9), "xx", "s1")]
    rows += [rows[-1], (900, texts[30] + " x", "en", "s2"), (-4, texts[9] + " y", "en", "s2")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"extra": F.lit(1), "slot": F.lit("s"), **{c: F.lit(c) for c in CLASHES}}).repartition(3).write.parquet(f"{out}/documents.parquet")
    items = [(1, item), (2, None), (3, ""), (1, item)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, [t for _, t in items]


def restated(rows, items):
    """The rows (doc_id, text, lang, source) left after each stage, in a list a stage."""
    left = [[r for r in rows if brute.quality(r[1], r[2])[3]]]
    plain = {}
    for r in left[0]:  # one row for each id, the one whose text hashes lowest
        ident = r[0] if r[0] is not None else (1 << 62) + brute.spark_hash(r[1]) % (1 << 61)
        key = (brute.spark_hash(r[1]), r)
        plain.setdefault(ident, []).append(key)
    ids, texts, home = [], [], []
    for ident, keyed in plain.items():
        for _, r in keyed:
            ids.append(ident)
            texts.append(r[1])
            home.append(min(keyed, key=lambda k: k[0])[1])
    # Rows of one id are one document: their links are joined by linking the rows themselves.
    first = {}
    for i in brute.one_of_each_group(ids, texts):
        first[ids[i]] = home[i]
    left.append(list(first.values()))
    left.append([r for r in left[-1] if not brute.contaminated(r[1], items)])
    mixed = brute.mixture([(r[0], r[1], r[3], r[2]) for r in left[-1]])
    left.append([r for k, r in enumerate(left[-1]) if mixed[k][5]])
    return left


def as_set(rows):
    return sorted((r[0] if r[0] is not None else -10**9, brute.spark_hash(r[1] or "")) for r in rows)


@pytest.mark.filterwarnings("ignore:targets")
def test_every_stage_equals_its_restatement(spark, tables):
    import corpus_pipeline as p

    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, want = docs.columns, restated([r[:4] for r in rows], items)
    for i, (_, stage) in enumerate(p.STAGES):
        docs = p.materialise(stage(spark, docs, folder), "test")
        got = docs.collect()
        assert set(columns) <= set(docs.columns) and (i == len(p.STAGES) - 1 or docs.columns == columns)
        assert as_set((r["doc_id"], r["text"]) for r in got) == as_set(want[min(i, 3)]), p.STAGES[i][0]
    owners = fill_table(SHARDS, TABLE_SIZE)
    for r in got:
        slot = brute.slot(r["doc_id"], r["text"], TABLE_SIZE)
        assert (r["slot"], r["shard"], r["extra"]) == (slot, SHARDS[owners[slot]], 1)
        assert all(r[c] == c for c in CLASHES)
    assert as_set((r["doc_id"], r["text"]) for r in p.run(spark, folder).collect()) == as_set(want[3])
    assert {len(x) for x in want} and len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 5


def test_empty_tables(spark, tables, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.count() == 0 and set(docs.columns) | {"shard"} == set(out.columns)


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    for n in range(1, 14):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names and set(e.oracle_sql()) <= names
