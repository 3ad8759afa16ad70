import hashlib
import os
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from sievewright.llm import bpe
from sievewright.llm.queries import op11_bpe

MIXED = [" ", " ", "\n", "\t", "　", "'", "'", "s", "t", "re", "ve", "r", "v", "l", "ll", "e", "d", "m", "S", "a", "é", "漢", "٣", "½", "!", "-", "😀", "́", "Ᲊ", "\x00"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary_file(), bpe.class_table())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_scan_equals_a_walk_through_the_states():
    single, fresh, _, ends = bpe.moves()
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 5000):
        kind, first = rng.integers(0, 10, n), rng.random(n) < 0.1
        state, want = bpe.BEGIN, []
        for k, f in zip(kind.tolist(), first.tolist()):
            state = bpe._move(bpe.BEGIN if f else state, k)
            want.append(state)
        assert ends[bpe.scan(np.where(first, fresh[kind], single[kind]), width=8)].tolist() == want


def test_ids_equal_the_library_on_mixed_characters(codec, library):
    rng = random.Random(5)
    for _ in range(600):
        texts = ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        sizes = [len(t.encode()) for t in texts]
        ids, begins, per = codec.encode("".join(texts).encode(), np.cumsum([0, *sizes])[:-1])
        assert [ids[a:b].tolist() for a, b in zip(per, per[1:])] == [library.encode_ordinary(t) for t in texts], texts
        back, bounds = codec.decode(ids)
        assert back.tobytes() == "".join(texts).encode() and bounds[:-1].tolist() == begins.tolist()


def test_every_code_point_is_of_the_class_that_the_pattern_sees(codec, library):
    """Between two letters each code point goes with the letters, or apart, as in the library."""
    every = [f"b{chr(c)}b\n" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 3 == 1]
    text = "".join(every)
    ids, _, _ = codec.encode(text.encode(), np.array([0]))
    assert ids.tolist() == library.encode_ordinary(text)


def test_long_pieces_merge_as_in_the_library(codec, library):
    rng = random.Random(6)
    for n in (bpe.LONG_PIECE - 1, bpe.LONG_PIECE, 500, 20_000):
        for letters in ("a", "ab", "theandofing"):
            piece = "".join(rng.choice(letters) for _ in range(n))
            assert bpe.merge(piece.encode(), codec.ranks) == library.encode_ordinary(piece)


def test_the_cache_is_emptied_and_results_stay(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    for text in ("one two three four five six", "six five four three two one", "one two"):
        assert codec.encode(text.encode(), np.array([0]))[0].tolist() == library.encode_ordinary(text)


def test_frames_with_nulls_long_texts_ties_and_clashes(spark, library):
    texts = [None, "", "a b", "a b", "x" * 300_000, " y'll see " * 40_000, "ü　ö", "<|endoftext|>"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("tokens", "ids", "starts", "_row", "decoded")})
    got = bpe.encode_texts(docs)
    rows = got.collect()
    assert sorted(got.columns) == sorted(docs.columns) and all(r["ids"] == r["_row"] == "clash" for r in rows)
    for r in rows:
        text = texts[r["doc_id"] or 0] or ""
        assert r["tokens"]["ids"] == library.encode_ordinary(text)
        assert r["tokens"]["starts"] == np.cumsum([0, *map(len, library.decode_tokens_bytes(r["tokens"]["ids"]))])[:-1].tolist()
    back = bpe.decode_ids(got.select("doc_id", "text", F.col("tokens.ids").alias("ids"), "decoded"))
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())
    second = got.where("doc_id = 6").select(bpe.token_text(F.col("text"), F.col("tokens.starts"), 1).alias("t")).first()["t"]
    assert bytes(second) == library.decode_single_token_bytes(library.encode_ordinary("ü　ö")[1])
    assert bpe.encode_texts(docs.limit(0)).count() == 0


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [5, 6])], "k int, ids array<int>")
    got = {r["k"]: bytes(r["decoded"]) for r in bpe.decode_ids(rows).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 2
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_ids(spark.createDataFrame([([10**6],)], "ids array<int>")).collect()


def test_the_query_equals_the_library_on_a_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    digest = lambda x: hashlib.sha256(x).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {}
    for k, t in texts.items():
        ids = library.encode_ordinary(t)
        want[k] = (len(ids), digest(",".join(map(str, ids)).encode()), digest(t.encode()))
    assert {r[0]: tuple(r)[1:] for r in op11_bpe(spark, folder).collect()} == want
