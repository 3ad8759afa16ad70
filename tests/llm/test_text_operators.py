"""The operators on texts against plain restatements, on small awkward inputs."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievewright.llm.decontaminate import decontaminate
from sievewright.llm.licenses import Scanner, scan_licenses
from sievewright.llm.linededup import dedup_lines
from sievewright.llm.quality import quality_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(t):
    return ALNUM.findall((t or "").translate(LOW))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "the", "Éa", "x1", "of", "zz", "Ab", "q"])
    out = [None, "", "   \n\t ", "!!! ...", "One", "a b\x0bc\rd", "İSTANBUL ÀB x", "a" * 3000, "the of " * 400, "q\n" * 300]
    out += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    line = "This is a line of text"
    out += [f"{line}\nnext {i}\n{line.upper()}  \nshort" for i in range(5)]
    out += ["MIT  License, and the apache-license; GENERAL public\nlicense mit license", "Releesed under the MIT Licence.", "mit license" * 2]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None, "xx"][i % 4], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[10])  # a repeated row
    rows.append((None, "the of zz the of zz", "en", None, None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def hits(words, items, window=10):
    hit, named = set(), set()
    for key, item in items:
        n = min(window, len(item))
        for j in range(len(item) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == item[j : j + n]:
                    hit.update(range(i, i + n))
                    named.add(str(key))
    return len(hit), sorted(named)


@pytest.mark.parametrize("block_rows", [200_000, 20])
def test_decontamination_equals_brute_force(spark, docs, texts, block_rows):
    items = [(1, texts[12]), (2, texts[15]), (3, "a"), (4, "the of " * 9), (5, None), (6, "!!"), (7, "zz q the"), (8, texts[20]), (9, texts[20])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    words = [(k, alnum(t)) for k, t in items]
    for r in decontaminate(docs, bench, block_rows=block_rows).collect():
        text = "the of zz the of zz" if r["doc_id"] is None else texts[r["doc_id"]]
        n_hit, named = hits(alnum(text), words)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(alnum(text)), n_hit, named), r["doc_id"]


def test_decontamination_without_rows(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate(docs.limit(0), none).count() == 0


def test_quality_base_columns(docs, texts):
    for r in quality_rules(docs).where("doc_id is not null").collect():
        text = texts[r["doc_id"]] or ""
        words, q = SPACE.findall(text), r["quality"]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        assert q["n_words"] == len(words) and q["word_chars"] == sum(map(len, words))
        assert q["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert q["n_dup_lines"] == len(lines) - len(set(lines))
        assert q["n_repeat_words"] == len(repeated)
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        assert q["base_failed"] == failed and not (failed and q["kept"])


def test_quality_verdict_tells_prose_from_noise(spark):
    rng = random.Random(1)
    common = "the of and to in a is that for it as with was on by be at are this from".split()
    prose = " ".join(rng.choice(common) if rng.random() < 0.25 else "".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(300))
    prose = ". ".join(s.capitalize() for s in re.findall(r"(?:\S+ ?){1,12}", prose))
    noise = " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in prose.split())
    rows = spark.createDataFrame([(1, prose, "en", 7), (2, noise, "en", 7), (3, prose.upper().replace(" ", "!! "), "en", 7)], "doc_id bigint, text string, lang string, quality int")
    got = {r["doc_id"]: r["quality"]["kept"] for r in quality_rules(rows).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_licenses_base(docs, texts):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for r in scan_licenses(docs).where("doc_id is not null").collect():
        words, x = alnum(texts[r["doc_id"]]), r["licenses"]
        places = [(i, k) for k, p in phrases.items() for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        assert (x["n_words"], x["n_base"]) == (len(words), len(places))
        assert (x["first_word"], x["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert x["base_labels"] == ",".join(sorted({k for _, k in places}))
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1


def test_licenses_with_edits():
    scanner = Scanner()
    assert [s[0] for s in scanner.spans("it is releesed undr the mit licence today")] == ["mit"]
    (label, first, last, edits), = scanner.spans("licensed under cc by nc 4 0")
    assert (label, first, edits) == ("cc-by-nc", 0, 0)
    assert scanner.spans("nothing of the kind is said in here") == []


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2), (7, 3)])
def test_line_dedup_equals_brute_force(docs, texts, batches, fanout):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = rows.unionByName(rows.where("doc_id in (12, 51)"))  # repeated rows
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in dedup_lines(rows, digest=True, batches=batches, fanout=fanout).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_line_runs_are_merged_without_exchange_or_sort(spark, docs):
    from sievewright.llm.linededup import KEY, LineStore, keyed_lines
    from sievewright.session import new_path

    store, lines = LineStore(spark, new_path(spark, "store")), keyed_lines(docs)
    for low in range(0, 60, 15):
        keys = lines.where(f"id >= {low} and id < {low + 15}").groupBy(*KEY).agg(F.min("id").alias("holder"), F.max("id").alias("latest"))
        if low < 45:
            store.add(keys)
    with store._planned():
        plan = store._add(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort [" not in plan
    assert [len(x) for x in store.levels] == [2, 1]  # two batches merged into one run, and two more


def test_line_store_goes_on_in_a_later_session(spark, texts):
    from sievewright.llm.linededup import LineStore
    from sievewright.session import new_path

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder, got = new_path(spark, "store"), {}
    for part in ("doc_id < 20", "doc_id >= 20 and doc_id < 45", "doc_id >= 45"):
        store = LineStore(spark.newSession(), folder, buckets=3)
        assert store.buckets == 3
        found = dedup_lines(rows.where(part), digest=True, batches=2, store=LineStore(spark, folder, buckets=3)).collect()
        got |= {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found}
    assert got == brute_lines(list(enumerate(texts)))
    assert LineStore(spark, folder).buckets == 3 and LineStore(spark, folder).number == 6


def test_line_store_leaves_no_tables_and_no_setting(spark, docs):
    setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before, tables = spark.conf.get(setting, None), {t.name for t in spark.catalog.listTables()}
    assert dedup_lines(docs, batches=5, fanout=2).count() == docs.count()
    assert spark.conf.get(setting, None) == before and {t.name for t in spark.catalog.listTables()} == tables


def test_line_dedup_of_nothing(docs):
    assert dedup_lines(docs.limit(0)).count() == 0


def test_quality_gives_no_verdict_by_histogram_without_a_reference(spark):
    text = " ".join(f"слово{i} и ещё" for i in range(40)) + "."
    rows = spark.createDataFrame([(1, text, "ru"), (2, text, None), (3, "слово " * 60, "ru")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["quality"] for r in quality_rules(rows).collect()}
    assert got[1]["kept"] and got[2]["kept"] and got[1]["class_distance"] == 0
    assert got[3]["base_failed"] and not got[3]["kept"]
