import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm.mixing import mix_report, mix_sources
from sievewright.llm.sharding import assign_shards

import brute


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [rng.choice((" ", "\n", " | ")).join(word() for _ in range(rng.choice((3, 20, 70, 300)))) for _ in range(150)]
    texts += [None, "", " \t\n", "w " * 200_000, texts[0], texts[0]]
    return [(i if i != 7 else None, t, rng.choice(("a", "a", "a", "b", "c", None)), rng.choice(("en", "en", "fr", None))) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id bigint, text string, source string, lang string")
    return frame.withColumns({"tokens": F.lit("clash"), "p": F.lit("clash"), "mix": F.lit("clash"), "shard": F.lit("clash")}).repartition(4)


@pytest.mark.parametrize("max_cells,share", [(100_000, 0.6), (0, 0.02)])  # by joins with targets that can be met, as each round takes seconds here
@pytest.mark.filterwarnings("ignore:targets")
def test_mixture_equals_brute_force(docs, rows, max_cells, share):
    docs = docs if max_cells else docs.where("k % 150 > 100")
    rows = {k: r for k, r in enumerate(rows) if max_cells or k % 150 > 100}
    want = dict(zip(rows, brute.mixture([r[:4] for r in rows.values()], share).values()))
    got = mix_sources(docs, max_cells=max_cells, share=share).select("k", "mix.*").collect()
    assert len(got) == len(rows)
    for r in got:
        source, lang, topic, n, p, sampled = want[r["k"]]
        assert (r["source"], r["lang"], r["topic"], r["n_tokens"], r["sampled"]) == (source, lang, topic, n, sampled), r
        assert brute.close(r["probability"], p) and brute.close(r["weight"], p / share)


def test_report_tells_what_cannot_be_met(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "rare" if i == 0 else "usual", "en") for i in range(50)], "doc_id bigint, text string, source string, lang string")
    goal = {"source": {"rare": 0.5, "usual": 0.5}}
    report = {(r["dimension"], r["value"]): r for r in mix_report(docs, share=0.4, targets=goal).collect()}
    assert report["source", "rare"]["tokens"] == 10 and report["source", "rare"]["expected"] == pytest.approx(10) and report["source", "rare"]["target"] == pytest.approx(100)
    assert report["source", "rare"]["off"] == pytest.approx(0.9)
    with pytest.warns(UserWarning, match="source rare by 90.0 %"):
        mix_sources(docs, share=0.4, targets=goal).count()
    fair = {r["off"] for r in mix_report(docs, share=0.4, targets={"source": {"rare": 0.02, "usual": 0.98}}).collect()}
    assert max(fair) < 1e-6


def test_shards_equal_brute_force(docs, rows):
    names, size = tuple(f"s{i}" for i in range(5)), 211
    table = brute.shards(names, size)
    got = assign_shards(docs, names, size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        _, text, *_ = rows[r["k"]]
        slot = brute.slot(r["doc_id"], text, size)
        assert (r["slot"], r["shard"]) == (slot, table[slot])


def test_null_keys_are_placed_by_their_text(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (None, None), (None, "")], "doc_id bigint, text string")
    got = {(r["text"] or ""): set() for r in docs.collect()}
    for r in assign_shards(docs).collect():
        got[r["text"] or ""].add(r["slot"])
    assert all(len(x) == 1 for x in got.values()) and len({next(iter(x)) for x in got.values()}) == 3
    assert assign_shards(docs.limit(0)).count() == 0
