import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from sievewright.llm.warc import BrokenRecord, members, parse_record, read_archives, record_bytes, revisit_faults, round_trip, with_revisits, write_archives


def test_round_trip(spark):
    big, other = "ä<p>" * 400, "z" * 2000
    rows = [(1, "http://a", big), (2, "http://b\nx", big), (3, None, big), (4, "c", "small"), (5, "d", "small"), (6, "e", None), (7, "f", other), (None, "g", other), (8, "h", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in round_trip(pages, payloads=True).collect()}
    assert len(got) == len(rows)
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 4, 5, 6)] == [("revisit", 3), ("revisit", 3), ("response", None), *[("response", None)] * 3]
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        if got[i]["record_type"] == "response":
            assert got[i]["payload"].decode() == (html or "")
    assert round_trip(pages.limit(0)).count() == 0


def test_archives_roll_over_and_revisits_are_held_against_their_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 1200 if i % 3 else f"{i}" * 900) for i in range(60)], "page_id bigint, url string, html string").coalesce(2)
    files = write_archives(with_revisits(pages), f"file://{tmp_path}", archive_bytes=2000).cache()
    assert files.count() > 4 and files.agg(F.sum("records")).first()[0] == 60
    records = read_archives(files).cache()
    assert records.count() == 60 and records.where("error is not null").count() == 0 and revisit_faults(records).count() == 0
    lost = records.where("record_id not like '%:59'").withColumn("payload_digest", F.when(F.col("record_id").endswith(":58"), "00").otherwise(F.col("payload_digest")))
    assert {r["fault"] for r in revisit_faults(lost).collect()} <= {"missing", "digest"} and revisit_faults(lost).count() > 0


def foreign(kind, ident, block, *more, ending=b"\r\n\r\n"):
    head = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Record-ID:  <{ident}>", *more, f"CONTENT-LENGTH: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + ending)


def test_archives_of_others(spark, tmp_path):
    body = "<p>größe</p>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        foreign("warcinfo", "urn:uuid:1", b"software: x"),
        foreign("response", "urn:uuid:2", http, "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {sha1}"),
        foreign("response", "urn:uuid:3", http, "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "A" * 32),
        foreign("revisit", "urn:uuid:4", b"", "WARC-Refers-To: <urn:uuid:2>", f"WARC-Payload-Digest: {sha1}"),
        gzip.compress(b"no record at all"),
        foreign("resource", "urn:uuid:5", body, "WARC-Block-Digest: sha-256:" + hashlib.sha256(body).hexdigest(), "X-Folded: a", "\tb"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"),
        foreign("resource", "urn:uuid:6", b"y" * 300_000),
        foreign("resource", "urn:uuid:7", b"end"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(records[0] + records[8][:-9])
    files = spark.createDataFrame([(f"file://{tmp_path}/{x}.warc.gz",) for x in "ab"], "path string")
    got = read_archives(files, max_record=100_000).orderBy("path", "number").collect()
    a = [r for r in got if "a.warc" in r["path"]]
    assert [r["record_id"] for r in a] == ["urn:uuid:1", "urn:uuid:2", None, "urn:uuid:4", None, "urn:uuid:5", None, None, "urn:uuid:7"]
    assert a[1]["payload"] == body and a[1]["payload_digest"] == hashlib.sha1(body).hexdigest() and a[1]["url"] == "http://a/"
    assert a[3]["refers_to_id"] == "urn:uuid:2" and a[3]["payload_bytes"] is None and a[3]["payload_digest"] == a[1]["payload_digest"]
    assert [(r["error"] or "").split(" in ")[0] for r in a] == ["", "", "wrong payload digest", "", "not a WARC record", "", "no warc-record-id", "a record of more than 100000 bytes", ""]
    assert [bool(r["error"]) for r in got if "b.warc" in r["path"]] == [False, True]
    assert revisit_faults(read_archives(files.where("path like '%a.warc%'"), payloads=False)).count() == 0


def test_reader_checks_digests():
    good = record_bytes(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    raws = list(members(io.BytesIO(good * 3)))
    assert len(raws) == 3 and parse_record(raws[2])["payload"] == b"payload"
    with pytest.raises(BrokenRecord):
        parse_record(raws[0].replace(b"payload\r\n", b"paYload\r\n"))
    assert isinstance(list(members(io.BytesIO(good[:-9])))[-1], BrokenRecord)
    assert list(members(io.BytesIO(b""))) == []
