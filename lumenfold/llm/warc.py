"""Dictionary-compressed WARC archives.

Each task collects records up to ROLL bytes, builds a Zstandard dictionary from these records, and writes an
archive: the dictionary in a leading skippable frame (magic 0x184D2A5D), then every record as a frame of its
own. Archives go to the shared folder under names of their own attempt; the list of archives is a written
table, so a lost executor's half-written files are never read. Reading takes the dictionary from the archive.

Of payloads of at least LEAST bytes that are equal, the record with the largest page_id is a response, others
are revisits that refer to it. Null html is an empty payload. Rows that repeat the largest page_id and its
payload are all responses. A null page_id is written as an absent one and never referred to unless it is
alone. An empty table writes no archive. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch
from .text import column

MAGIC = 0x184D2A5D
ROLL, DICTIONARY, LEVEL, LEAST = 8 << 20, 64 << 10, 3, 1000
PER_TASK = 4  # archives that one task reads
PIECE = 1 << 10  # bytes of an archive taken at once
DATE = "2020-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, which tells the payload's length, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = http + (payload if refers_to is None else b"")
    clean = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Target-URI: {clean}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, type, refers_to, payload (None for a revisit), payload_bytes, digest as bare hex. Raises if damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].split(":")[1]).hex()
    response = fields["warc-type"] == "response"
    if response and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload and digest differ")
    number = lambda v: int(x) if v and (x := v.strip("<>").rpartition(":")[2]) else None
    return {"page_id": number(fields["warc-record-id"]), "type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "payload": payload if response else None, "payload_bytes": n, "digest": digest}


def train(records: list[bytes]) -> bytes:
    """A dictionary from the records; a few or tiny records give none that can be trained, then the longest's start serves as a raw one."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, records)) // 20)), records).as_bytes()
    except zstandard.ZstdError:
        return max(records, key=len)[:4096]


def compress(records: list[bytes]) -> bytes:
    dictionary = train(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return b"".join([MAGIC.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed, *(writer.compress(r) for r in records)])


def decompress(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    dictionary, at = None, 0
    if int.from_bytes(archive[:4], "little") == MAGIC:
        at = 8 + int.from_bytes(archive[4:8], "little")
        body = archive[8:at]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == b"\x28\xb5\x2f\xfd" else body)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        # small pieces, so that what is left of the last one, which is copied, stays small whatever the archive's size
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the archive ends inside a record")
            part = view[at : at + PIECE]
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(out)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


def decide(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, refers_to (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    sha = F.sha2(F.col("html").cast("binary"), 256)  # payloads that share a SHA-1 can be made
    keys = rows.where(F.octet_length("html") >= LEAST).select(sha.alias("digest"), "page_id")
    last = keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    # a table of its own, as a join can split a large group of equal payloads only between two plain inputs
    last = scratch.keep(last, "last")
    # short payloads meet nothing; a key of their own deals them evenly
    mine = F.when(F.octet_length("html") >= LEAST, sha).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("digest", mine).join(last, "digest", "left")
    return rows.select("page_id", "url", "html", F.when(F.col("last") != F.coalesce("page_id", F.lit(-(2**63))), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page; gives archive, records. Must be materialised once before it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(compress(records))
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64())], ["archive", "records"])

        held, size = [], 0
        for batch in batches:
            for i, url, html, ref in zip(*(column(batch, c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                record = build_record(i.as_py(), url.as_py(), html.as_py().encode(), ref.as_py())
                if held and size + len(record) > ROLL:
                    yield flush(held)
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield flush(held)

    return pages.mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to, archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in column(batch, "archive").to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_stream(name) as f:
                    rows = [parse_record(r) for r in decompress(f.read())]
                names = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()))
                yield pa.record_batch([*(pa.array([r[n] for r in rows], t) for n, t in names), pa.array([path] * len(rows))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"])

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    s = Scratch(pages.sparkSession)
    listed = s.keep(write_archives(decide(pages, s), folder or s.path("warc")), "archives")
    # a given number, else tasks would be merged by the size of this list of names
    rows = read_archives(listed.repartition(max(1, -(-listed.count() // PER_TASK)), "archive"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM d LEFT JOIN m USING (digest)
"""
