"""Zstandard WARC archives: a writer and a reader that validates what it reads.

An archive is a leading skippable frame that holds the dictionary, then one Zstandard frame per
record, compressed with that dictionary; so a record can be decoded alone. The reader loads
the dictionary from the skippable frame, decodes frame by frame, parses the WARC headers and
checks version, the length of the block against Content-Length, and the digest of
response payloads against WARC-Payload-Digest.

Archives travel as rows (``archive`` name, ``content`` binary), one row per file, so they can lie
in any store that Spark reads; ``read_archives`` also takes files loaded with Spark's ``binaryFile``
source, and ``export`` writes rows as files to a folder. A task closes an archive at about
``archive_bytes`` of records, so one row stays small.

Equal payloads of at least ``MIN_REVISIT`` bytes: the smallest page_id is the response, others are
revisits. The smallest id per digest is aggregated map-side without payloads, so a payload that a
third of all pages share is one small row per task; payloads themselves meet only their own
page's verdict.

Defined cases: null html is an empty payload; a null url gives an empty target; pages with a null
id are always responses and read back with a null id; rows that repeat the smallest id are
all responses; an empty table gives no archive and no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.shared import materialize

# Fixed values of the archive format.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 16 << 10
DICT_SAMPLES = 200
DICT_SAMPLE_BYTES = 4096
RECORD_DATE = "2000-01-01T00:00:00Z"

ARCHIVES = "archive string, content binary"
RECORDS = ("archive string, page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, "
           "payload_digest string, payload binary")


def verdicts(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, refers_to of the pages that revisit an earlier one."""
    facts = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("_b"))
    facts = materialize(facts.where(F.length("_b") >= min_bytes)
                        .select("page_id", F.sha2("_b", 256).alias("digest")).where("page_id IS NOT NULL"), "payload-digests")
    first = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (facts.join(first, "digest").where("page_id <> refers_to")
            .select("page_id", "refers_to").distinct())


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit has no block."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
            ("WARC-Date", RECORD_DATE), ("WARC-Target-URI", " ".join((url or "").split())),
            ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
            ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(refers_to)),
                 ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises ValueError if it is not well formed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"malformed header {line!r}")
        headers[name.strip().lower()] = value.strip()
    if "content-length" not in headers or not headers["content-length"].isdigit():
        raise ValueError("no Content-Length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {n}")
    if headers.get("warc-type") not in ("response", "revisit"):
        raise ValueError("unexpected WARC-Type")
    block = rest[:n]
    if headers["warc-type"] == "response":
        if "sha256:" + hashlib.sha256(block).hexdigest() != headers.get("warc-payload-digest"):
            raise ValueError("payload digest differs")
    return headers, block


def pack(records: list[bytes]) -> bytes:
    """An archive of the records. The dictionary is trained on a bounded sample of them spread over
    the archive; where there is too little to train on, the first records' start serves as one."""
    import zstandard as zstd

    step = max(1, len(records) // DICT_SAMPLES)
    samples = [r[:DICT_SAMPLE_BYTES] for r in records[::step]]
    try:
        raw = zstd.train_dictionary(DICT_BYTES, samples, k=512, d=8).as_bytes()
    except zstd.ZstdError:
        raw = b"".join(samples)[:DICT_BYTES].ljust(8, b" ")
    coder = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw))
    return struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw + b"".join(coder.compress(r) for r in records)


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    import zstandard as zstd

    if len(content) < 8:
        raise ValueError("archive too short")
    magic, n = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC or 8 + n > len(content):
        raise ValueError("no dictionary in a leading skippable frame")
    coder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content[8:8 + n]))
    at = 8 + n
    view = memoryview(content)
    while at < len(content):
        frame = coder.decompressobj()
        out = [frame.decompress(view[at:at + (1 << 16)])]
        end = at + (1 << 16)
        while not frame.eof:
            if end >= len(content):
                raise ValueError("truncated frame")
            out.append(frame.decompress(view[end:end + (1 << 16)]))
            end += 1 << 16
        at = min(end, len(content)) - len(frame.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive rows of all pages, written to the shared folder."""
    sent = verdicts(pages, min_bytes).withColumnRenamed("page_id", "_id")
    rows = (pages.join(sent, F.col("page_id") == F.col("_id"), "left")
            .select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"), "refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, total = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{task:06d}-{made:06d}.warc.zst"], "content": [pack(held)]},
                                              pa.schema([("archive", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            ids, urls, bodies, refs = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                held.append(record(ids[i].as_py(), urls[i].as_py(), bodies[i].as_py(), refs[i].as_py()))
                total += len(held[-1])
                if total >= archive_bytes:
                    yield close()
                    made, held, total = made + 1, [], 0
        if held:
            yield close()

    return materialize(rows.mapInArrow(write, ARCHIVES), "archives", "none")


def read_archives(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per record of archive rows, or of files loaded with the ``binaryFile`` source."""
    if "archive" not in archives.columns:
        archives = archives.select(F.col("path").alias("archive"), "content")
    schema = RECORDS.format(id=id_type)
    kinds = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                       ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, total = [], 0
                for data in unpack(content.as_py()):
                    h, block = parse(data)
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append({"archive": name.as_py(), "page_id": number("x-page-id"), "url": h.get("warc-target-uri"),
                                 "record_type": h["warc-type"], "refers_to": number("x-refers-to-page-id"),
                                 "payload_bytes": number("x-payload-length"),
                                 "payload_digest": h["warc-payload-digest"].removeprefix("sha256:"),
                                 "payload": block if h["warc-type"] == "response" else None})
                    total += len(block)
                    if total > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, total = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return archives.select("archive", "content").mapInArrow(read, schema)


def export(archives: DataFrame, folder: str) -> int:
    """Write archive rows as files to a folder that all executors share; returns their number."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                part = os.path.join(folder, f".{name.as_py()}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content.as_py())
                os.replace(part, os.path.join(folder, name.as_py()))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    return archives.select("archive", "content").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def warc(pages: DataFrame) -> DataFrame:
    """Write all pages to archives and read them back: one digest row per page."""
    return (read_archives(write_archives(pages))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
