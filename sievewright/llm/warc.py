"""WARC archives: one gzip member a record, written and read in sequence.

Writing: a payload of at least ``min_revisit`` bytes that several records share is stored once, by the record with the
largest id; the others become revisit records that name it. Which record that is comes from a group-by on digests, so
payloads are shuffled once, by id. Each task writes one archive, under a name of its own and then renamed, into the
shared folder; a task that runs twice replaces its own file by an equal one.

Archives roll over at ``archive_bytes``.

Reading: archives are read front to back in blocks, one gzip member after another, and decompressed no further than
``max_record`` bytes a record, so a member that would blow up costs no more than that. Records are framed by their
content length; block and payload digests are verified where they are given. Only type, id and content length are asked
for; header names count in any case, ids may be of any kind, and the payload of a record with an HTTP message is its
body. A record that fails is a row with its ``error``, and reading goes on with the next member; where the compressed
stream itself is broken, one row says so and the rest of that archive is lost.

Defined cases: a null payload is empty; null urls are written as empty; rows with a null id are archived with an empty
id, read back as null and never named by a revisit; repeated rows are one record each, and those of the largest id all
keep their payload; very long payloads are written and read whole up to ``max_record``; other columns play no part; an
empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, new_path

MIN_REVISIT = 1000
BLOCK = 1 << 16
#: Largest record that is read, and size at which the next archive begins.
MAX_RECORD, ARCHIVE_BYTES = 1 << 30, 1 << 30
_PREFIX = "urn:sievewright:page:"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One record, compressed as one gzip member; a revisit carries no payload but its digest and length."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    spell = lambda digest: "sha1:" + base64.b32encode(digest).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_PREFIX}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: {spell(bytes.fromhex(sha1_hex))}",
        f"WARC-Block-Digest: {spell(bytes.fromhex(sha1_hex) if not revisit else hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PREFIX}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gzip.compress(raw) + gzip.flush()


class BrokenRecord(ValueError):
    """What is wrong with a record, once its headers, as far as they could be read, are known."""


def members(stream, max_record: int = MAX_RECORD) -> Iterator[bytes | BrokenRecord]:
    """The decompressed gzip members of a stream, one at a time; in place of one too large or broken, what is wrong."""
    data = stream.read(BLOCK)
    while data:
        unzip, parts, size = zlib.decompressobj(31), [], 0
        try:
            while not unzip.eof:
                if not data:
                    raise BrokenRecord("the archive ends inside a record")
                part = unzip.decompress(data, BLOCK)
                size += len(part)
                if size <= max_record:
                    parts.append(part)
                else:
                    parts.clear()  # the rest of the member is still read, to get to the next one
                data = unzip.unconsumed_tail or (b"" if unzip.eof else stream.read(BLOCK))
        except (zlib.error, BrokenRecord) as e:
            yield e if isinstance(e, BrokenRecord) else BrokenRecord(f"the stream is broken: {e}")
            return
        yield b"".join(parts) if size <= max_record else BrokenRecord(f"a record of more than {max_record} bytes")
        data = unzip.unused_data or stream.read(BLOCK)


def _digest_of(spelled: str) -> tuple[str, bytes]:
    """Algorithm and bytes of a digest in base 32 or 16."""
    name, _, value = spelled.strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in hashlib.algorithms_available:
        return name, b""
    width = hashlib.new(name).digest_size
    if len(value) == 2 * width:
        return name, bytes.fromhex(value)
    return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))


def _verify(what: str, data: bytes, spelled: str | None) -> None:
    if spelled:
        name, wanted = _digest_of(spelled)
        if wanted and hashlib.new(name, data).digest() != wanted:
            raise BrokenRecord(f"wrong {what} digest")


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record; raises BrokenRecord where framing or a digest is wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not first.startswith("WARC/"):
        raise BrokenRecord("not a WARC record")
    fields: dict[str, str] = {}
    name = ""
    for x in lines:
        if x[:1] in (" ", "\t") and name:  # a folded header
            fields[name] += " " + x.strip()
        else:
            name, _, value = x.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    missing = [x for x in ("warc-type", "warc-record-id", "content-length") if x not in fields]
    if missing or not fields["content-length"].isdigit():
        raise BrokenRecord(f"no {missing[0]}" if missing else "content-length is no number")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:].strip(b"\r\n"):
        raise BrokenRecord(f"wrong content length in {fields['warc-record-id']}")
    try:
        _verify("block", block, fields.get("warc-block-digest"))
        kind = fields["warc-type"].lower()
        http = fields.get("content-type", "").lower().startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        if kind != "revisit":  # a revisit's digest is that of the payload it leaves out
            _verify("payload", payload, fields.get("warc-payload-digest"))
        name, digest = _digest_of(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else ("", b"")
    except (ValueError, KeyError) as e:
        raise BrokenRecord(f"{e} in {fields['warc-record-id']}") from e
    if name != "sha1" and kind != "revisit":
        digest = hashlib.sha1(payload).digest()
    length = fields.get("x-payload-length", "")
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "url": fields.get("warc-target-uri", "").strip("<>"),
        "record_type": kind,
        "payload_bytes": len(payload) if kind != "revisit" else int(length) if length.isdigit() else None,
        "payload_digest": digest.hex() or None,
        "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload": payload if kind != "revisit" else None,
        "error": None,
    }


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to (null where the record keeps its payload)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "digest", F.sha2(F.col("html"), 256).alias("exact"))
    groups = large.groupBy("digest", "exact").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") > 1)
    revisits = large.join(groups, ["digest", "exact"]).where(F.col("page_id") != F.col("keeper"))
    revisits = revisits.select("page_id", "digest", F.col("keeper").alias("refers_to")).distinct()
    return rows.join(revisits.hint("shuffle_hash"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(rows: DataFrame, path: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of ``with_revisits`` as .warc.gz files; returns (path, records) of the files written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        records = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        row, number, names, counts = next(records, None), 0, [], []
        while row is not None or not names:
            name = f"part-{task.partitionId():05d}-{number:04d}.warc.gz"
            temporary, n, size = f"{root}/{name}.{task.taskAttemptId()}.tmp", 0, 0
            with store.open_output_stream(temporary, compression=None) as out:
                while row is not None and size < archive_bytes:
                    data = record_bytes(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3], row[4])
                    out.write(data)
                    n, size, row = n + 1, size + len(data), next(records, None)
            store.move(temporary, f"{root}/{name}")
            names.append(f"{path}/{name}")
            counts.append(n)
            number += 1
        yield pa.RecordBatch.from_pydict({"path": pa.array(names), "records": pa.array(counts, pa.int64())})

    return rows.mapInArrow(write, "path string, records bigint")


_FIELDS = (("record_id", "string"), ("url", "string"), ("record_type", "string"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("refers_to_id", "string"), ("error", "string"), ("payload", "binary"))


def read_archives(files: DataFrame, *, payloads: bool = True, max_record: int = MAX_RECORD) -> DataFrame:
    """Records of the archives whose paths are in files, in (path, number) and the columns of ``parse_record``.

    Without payloads only what else is known of them; digests are verified either way. Broken records have an error.
    """
    fields = _FIELDS if payloads else _FIELDS[:-1]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([("path", pa.string()), ("number", pa.int64()), *((n, kinds[k]) for n, k in fields)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = _store(path)
                with store.open_input_stream(name, compression=None) as stream:
                    for i, raw in enumerate(members(stream, max_record)):
                        try:
                            if isinstance(raw, BrokenRecord):
                                raise raw
                            row = parse_record(raw)
                        except BrokenRecord as e:
                            row = {"error": str(e)}
                        rows.append({"path": path, "number": i} | {k: row.get(k) for k, _ in fields})
                        held += len(row.get("payload") or b"") + 200 if payloads else 200
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").mapInArrow(read, "path string, number bigint, " + ", ".join(f"{n} {k}" for n, k in fields))


def page_of(record_id: Column) -> Column:
    """The page a record id of ours stands for; null for others and for the empty one."""
    return F.when(F.startswith(record_id, F.lit(_PREFIX)), F.substring(record_id, len(_PREFIX) + 1, 40).try_cast("bigint"))


def revisit_faults(records: DataFrame) -> DataFrame:
    """(record_id, refers_to_id, fault) of revisits whose record is missing, or has another digest or length."""
    asked = records.where("record_type = 'revisit'").select("record_id", "refers_to_id", F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n"))
    there = records.where("record_type <> 'revisit' AND error IS NULL").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("payload_digest").alias("_digest"), F.max("payload_bytes").alias("_bytes"))
    both = asked.join(there, "refers_to_id", "left")
    fault = F.when(F.col("_digest").isNull(), "missing").when(F.col("_digest") != F.col("_d"), "digest").when(F.col("_bytes") != F.col("_n"), "length")
    return both.select("record_id", "refers_to_id", fault.alias("fault")).where("fault IS NOT NULL")


def round_trip(pages: DataFrame, *, min_revisit: int = MIN_REVISIT, payloads: bool = False) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; raises if a record does not come back whole.

    Of the records, page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload).
    """
    spark = pages.sparkSession
    files = materialise(write_archives(with_revisits(pages, min_revisit), new_path(spark, "warc")), "warc-files")
    n = int(files.agg(F.count("*")).first()[0])
    read = read_archives(files.repartition(max(1, n), "path"), payloads=payloads)
    sound = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(", ", "path", F.concat(F.lit("record "), "number"), "error")).cast("boolean"))
    kept = ["payload"] if payloads else []
    return read.where(sound).select(page_of(F.col("record_id")).alias("page_id"), "url", "record_type", "payload_bytes", "payload_digest", page_of(F.col("refers_to_id")).alias("refers_to"), *kept)
