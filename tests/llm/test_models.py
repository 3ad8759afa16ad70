import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm.htmltree import BOX, MAIN, OFF, labelled_pages, parse, train
from sievewright.llm.mixing import mix_sources, rake, rake_frame
from sievewright.llm.ppm import END, ORDER, Shorter, blend, code_length, count_corpus, grams_of, score_documents, segments, slices, train_trie
from sievewright.llm.sharding import assign_shards, fill_table


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40))).capitalize(), rng.choice(["en", "fr", None]), rng.choice("xyyy"), 1) for i in range(80)]
    rows += [(80, None, "en", None, 0), (81, "", "en", "x", 0), (82, "a\x00b \t\nÉ", "en", "x", 5), rows[3]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def low(t):
    return (t or "").encode().lower()


def training(docs):
    rows = [(r["doc_id"], low(r["text"])) for r in docs.collect()]
    return rows, [t for d, t in rows if zlib.crc32(str(d).encode()) % 10]


@pytest.mark.parametrize("head", [400_000, 30, 0])
def test_lm_scores_equal_the_walked_trie(docs, head):
    rows, texts = training(docs)
    trie, counts = train_trie(texts), Counter(w for t in texts for w in [*t.split(), END])
    n, v = sum(counts.values()), len(counts)
    got = score_documents(docs, head_grams=head, head_words=head // 2).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        tokens = [*t.split(), END]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = by[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
        assert r["score"] == pytest.approx(code_length(t, trie), rel=1e-6, abs=1e-5)


def grams(texts):
    out = Counter()
    for t in texts:
        data = b"\0" * ORDER + t + b"\0"
        out.update(int.from_bytes(data[i : i + ORDER + 1], "big") for i in range(len(data) - ORDER))
    return out


@pytest.mark.parametrize("texts", [[], [b""], [b"abracadabra", b"abba", b"caba"], [bytes(range(1, 256)) * 3, b"ab", b"b" * 50]])
def test_lm_blend_equals_the_walked_trie_by_gram(texts):
    trie, seen = train_trie(texts), grams(texts)
    asked = [b"abracad", b"zz top", b"abba\xff", b"bbbbbbbbx", bytes(range(250, 256))]
    every = sorted(set(seen) | set(grams(asked)))
    pairs = Counter()
    for g, n in seen.items():
        pairs[g & 0xFFFF] += n
    shorter = Shorter(np.array(sorted(pairs), np.int64), np.array([pairs[p] for p in sorted(pairs)], float))
    logs = dict(zip(every, blend(np.array(every, np.int64), np.array([seen[g] for g in every]), shorter)))
    for t in texts + asked:
        assert sum(logs[g] * n for g, n in grams([t]).items()) == pytest.approx(code_length(t, trie), rel=1e-9, abs=1e-9)


def test_lm_predictions_are_distributions():
    texts = [b"abracadabra", b"abba", bytes(range(256))]
    trie, seen = train_trie(texts), grams(texts)
    pairs = Counter()
    for g, n in seen.items():
        pairs[g & 0xFFFF] += n
    shorter = Shorter(np.array(sorted(pairs), np.int64), np.array([pairs[p] for p in sorted(pairs)], float))
    for context in (b"\0\0\0\0\0", b"racad", b"zzzab", b"\x01\x02\x03\x04\x05"):
        base = int.from_bytes(context, "big") << 8
        asked = {base | s for s in range(256)}
        every = sorted(asked | set(seen))
        logs = blend(np.array(every, np.int64), np.array([seen[g] for g in every]), shorter)
        assert sum(10.0**x for g, x in zip(every, logs) if g in asked) == pytest.approx(1, abs=1e-9)
    assert code_length(b"ab", trie) < 0
    assert code_length(b"") == pytest.approx(-math.log10(256)) and code_length(b"abababababab") > 13 * -math.log10(256)  # an adaptive model learns


def test_batches_are_sliced_whole():
    texts = ["Aa " * 5, None, "", "x" * 50, "yY", None]
    got = list(slices(pa.array(texts), 10))
    assert [t for _, part in got for t in part] == [(t or "").lower().encode() for t in texts]
    assert [at for at, _ in got] == [0, 1, 4] and not list(slices(pa.array([], pa.string())))


def test_memory_does_not_follow_the_batch():
    """Counting 16 MB of texts in one batch."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(20_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 1_150)) for _ in range(2_000)]
    batch = pa.record_batch({"held_out": pa.array([i % 10 == 0 for i in range(len(texts))]), "text": pa.array(texts)})

    class Taken:  # a table that hands over what is run on its batches
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    tracemalloc.start()
    grams = 0
    for rows in count_corpus(Taken())(iter([batch])):
        grams += rows.column("n").to_numpy().sum() if rows.column("word").null_count else 0
    counting = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert grams == sum(len(t) + 1 for i, t in enumerate(texts) if i % 10)
    assert counting < 250, counting


@pytest.mark.parametrize("chunk", [9, 40, 1000])
def test_lm_segments_hold_every_gram_once(chunk, monkeypatch):
    from sievewright.llm import ppm

    monkeypatch.setattr(ppm, "CELLS", 1 << 9)  # so that some grams are numbered by sorting
    texts, found = [b"", b"hello world", b"x" * 57, b"ab" * 30, "größe".encode()], Counter()
    for data, starts, owners in segments(texts, chunk=chunk):
        ids, codes = grams_of(data)
        inside = ppm._inside(len(ids), starts, ORDER)
        assert (np.diff(np.r_[starts, len(data)]) > ORDER).all() and len(owners) == len(starts)
        found.update(codes[ids[inside]].tolist())
    assert found == grams(texts)


def test_lm_beats_the_unigram_base_on_held_out_texts(spark):
    rng = random.Random(3)
    parts = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 2))) for _ in range(60)]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    sentences = [" ".join(word() for _ in range(8)) + "." for _ in range(60)]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(10))) for i in range(300)]
    got = score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert got["s"] > got["b"]


def test_lm_long_text_of_many_words(spark):
    words = [f"w{i * i % 9973}" for i in range(700_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:1000])), (3, None)]
    got = {r["doc_id"]: r for r in score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["n_tokens"] == 700_001 and got[2]["n_known"] == 1001 and got[1]["score"] < got[2]["score"] < got[3]["score"]


def test_lm_without_rows(docs):
    assert score_documents(docs.limit(0)).count() == 0


def test_html_model_on_held_out_pages():
    model, right, n = train(), 0, 0
    for page in labelled_pages(150, seed=77):
        nodes, blocks = parse(page)
        state = []
        for x in nodes:
            state.append(x.mark if x.mark is not None else state[x.parent] if x.parent >= 0 else BOX)
        belief = model.marginals(nodes)
        right += sum((belief[i][MAIN] > belief[i][OFF]) == (state[i] == MAIN) for i, _ in blocks)
        n += len(blocks)
    assert right / n > 0.98


def test_html_extracts_articles():
    model = train()
    page = (
        '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<div class="ad">Buy this.</div><article><h1>Title &amp; more</h1><p><b>First <i>para</i>\n graph<br><p>Second&nbsp;one.<aside>See also</aside><ul><li>x</ul></article>'
        '<section class="comments"><h2>Comments</h2><p>Great text, thanks a lot.</p></section><footer>&copy; me</footer>'
    )
    assert model.extract(page) == "Title & more\nFirst para graph\nSecond one.\nx"
    assert model.extract(None) == "" and model.extract("") == "" and model.extract("<article>a < b") == "a < b"


def test_html_keeps_what_follows_unclosed_elements():
    model, article = train(), "<article><h1>Title</h1><p>First paragraph of the text.</p><p>Second one.</p></article>"
    whole = "Title\nFirst paragraph of the text.\nSecond one."
    for before in ("<datalist><option value=a><option value=b></datalist>", "<div><video src=v></div>", "<div><canvas></div>", "<div><object data=o></div>", "<div><button></div>", "<select><option><option></select>"):
        assert model.extract(before + article) == whole
    for tag in ("object", "audio", "video", "canvas", "noscript"):
        assert "Fallback words." in model.extract(article.replace("<p>Second", f"<{tag}>Fallback words.</{tag}><p>Second"))
    assert "Let x + 1 be odd." in model.extract(article.replace("Second one.", "Let <math><mi>x</mi> <mo>+</mo> <mn>1</mn></math> be odd."))
    assert model.extract("<article>a</article><script>x = 1 <p>b") == "a"


def test_raking_meets_targets(spark):
    cells = [(s, lang, t, float(n)) for s, lang, t, n in (("a", "en", "x", 900), ("a", "fr", "y", 50), ("b", "en", "y", 100), ("b", "fr", "x", 80), ("c", "en", "x", 0))]
    goal = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.7, "fr": 0.3}, "topic": {"x": 0.65, "y": 0.35}}
    p = rake(cells, 0.2, goal)
    total = sum(c[3] for c in cells) * 0.2
    for i, d in enumerate(("source", "lang", "topic")):
        for value, share in goal[d].items():
            assert sum(c[3] * x for c, x in zip(cells, p) if c[i] == value) == pytest.approx(share * total, rel=1e-6)
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    got = {(r["source"], r["lang"], r["topic"]): r["p"] for r in rake_frame(frame, 0.2, goal, rounds=8).collect()}
    assert [got[c[:3]] for c in cells] == pytest.approx(p, rel=1e-2)


def test_raking_by_joins_stops_as_on_the_driver(spark, monkeypatch):
    from sievewright.llm import mixing

    cells = [("a", "en", "x", 400.0), ("a", "fr", "x", 200.0), ("b", "en", "x", 100.0), ("b", "fr", "x", 50.0)]
    rounds, real = [], mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, label: (label == "mix-cells" and rounds.append(1), real(df, label))[1])
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double").coalesce(1)
    got = {(r["source"], r["lang"], r["topic"]): r["p"] for r in rake_frame(frame, 0.2).collect()}
    assert [got[c[:3]] for c in cells] == pytest.approx(rake(cells, 0.2), rel=0, abs=1e-6)
    assert len(rounds) < 5 and rake_frame.__defaults__[-1] == mixing.ROUNDS


def test_mixing_draws_by_probability(docs):
    rows = mix_sources(docs, share=0.5).select("doc_id", "mix.*").collect()
    assert len(rows) == docs.count() and all(0 <= r["probability"] <= 1 for r in rows)
    assert {r["source"] for r in rows} == {"x", "y", "(none)"}
    again = {(r["doc_id"], r["sampled"]) for r in mix_sources(docs.repartition(7), share=0.5).select("doc_id", "mix.*").collect()}
    assert again == {(r["doc_id"], r["sampled"]) for r in rows}
    assert mix_sources(docs.limit(0)).count() == 0


def test_shards_share_the_table_and_move_little():
    names = [f"s{i}" for i in range(10)]
    table = fill_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 9) < 0.25 * 1009
    with pytest.raises(ValueError):
        fill_table(["a", "a"], 7)
    with pytest.raises(ValueError):
        fill_table(["a"], 8)


def test_sharding_places_every_row(docs):
    rows = assign_shards(docs, ("a", "b", "c"), size=101).collect()
    table = fill_table(("a", "b", "c"), 101)
    assert len(rows) == docs.count() and all(r["shard"] == "abc"[table[r["slot"]]] for r in rows)
    assert len({(r["doc_id"], r["slot"]) for r in rows}) == 83
