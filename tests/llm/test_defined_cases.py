"""Columns with clashing names, long texts, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from sievewright.llm.decontaminate import decontaminate
from sievewright.llm.htmltree import extract_pages
from sievewright.llm.licenses import scan_licenses
from sievewright.llm.linededup import dedup_lines
from sievewright.llm.mixing import mix_sources
from sievewright.llm.ppm import score_documents
from sievewright.llm.quality import quality_rules
from sievewright.llm.sharding import assign_shards
from sievewright.llm.similarity import near_duplicate_groups
from sievewright.llm.warc import round_trip

CLASHES = ["lines", "words", "n", "node", "token", "part", "id", "line", "row", "word", "mix", "quality", "slot", "shard", "score", "fp", "length", "item_id", "place", "html_", "tokens", "p", "h1", "holder", "text_key", "licenses", "_row", "_id", "_key", "_rows", "_quality_n", "_QUALITY_TEXT", "_mix_tokens", "_mix_p", "_held", "_part"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the of and " * 30 + "MIT License", "en", "a"), (2, "line one of two here\nline one of two here", "en", "a"), (3, "LINE one of two here", None, None), (4, None, "en", "b"), (5, "x" * 200_000 + " end", "en", "b")]
    out = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for c in CLASHES:
        out = out.withColumn(c, F.lit("clash"))
    return out


OPERATORS = {
    "decontaminate": lambda d: decontaminate(d, d.sparkSession.createDataFrame([(1, "line one of two here", "x")], "item_id int, text string, words string")),
    "licenses": scan_licenses,
    "lines": dedup_lines,
    "lm": score_documents,
    "mixing": mix_sources,
    "near": near_duplicate_groups,
    "quality": quality_rules,
    "shards": assign_shards,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_long_texts(docs, name):
    rows = OPERATORS[name](docs).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 5]
    if name == "decontaminate":
        assert {r["doc_id"]: r["n_hit"] for r in rows} == {1: 0, 2: 10, 3: 5, 4: 0, 5: 0}
    if name == "lines":
        assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in rows} == {1: (1, 0), 2: (2, 0), 3: (1, 1), 4: (1, 0), 5: (1, 0)}
    if name == "licenses":
        assert {r["doc_id"]: r["licenses"]["labels"] for r in rows} == {1: "mit", 2: "", 3: "", 4: "", 5: ""}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.filterwarnings("ignore:targets")
def test_texts_of_many_words_and_lines(spark, name):
    """A text of 120,000 words and 12,000 lines, a third of it again, and twice a row of its own."""
    words = [f"w{i * 7919 % 50_021}" for i in range(120_000)]
    text = "\n".join(" ".join(words[i : i + 10]) for i in range(0, len(words), 10))
    rows = [(1, text, "en", "a"), (2, text[: len(text) // 3], "en", "a"), (3, "line one of two here", "en", "b"), (3, "line one of two here", "en", "b")]
    got = OPERATORS[name](spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert sorted(r["doc_id"] for r in got if name != "decontaminate" or r["doc_id"] != 3) == ([1, 2] if name == "decontaminate" else [1, 2, 3, 3])
    by = {r["doc_id"]: r for r in got}
    if name == "decontaminate":
        assert by[1]["n_words"] == 120_000 and by[3]["n_hit"] == 5
    if name == "lines":
        assert by[1]["n_lines"] == 12_000 and by[2]["n_dropped"] >= by[2]["n_lines"] - 1
    if name == "licenses":
        assert by[1]["licenses"]["n_words"] == 120_000
    if name == "near":
        assert by[1]["n_shingles"] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and by[2]["component_id"] == 2
    if name == "mixing":
        assert by[1]["mix"]["n_tokens"] == 120_000


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>"), (1, "u", "<article><p>a</p></article>"), (None, None, None)], "page_id bigint, url string, html string")
    pages = pages.withColumn("text", F.lit("clash")).withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted(r["text"] for r in extract_pages(pages).collect()) == ["", "a", "a"]
    assert round_trip(pages).count() == 3
    assert extract_pages(pages.limit(0)).count() == 0
