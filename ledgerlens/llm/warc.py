"""WARC archives: a deterministic sharded writer, and a reader.

Pages are sorted by range of ``page_id`` and payload digest. Each task writes its range to gzip files (one member
per record) and starts another file when the compressed size of the current one has reached
``FILE_BYTES``. Headers and digests are made from the payload, record ids from page id and
digest, so a file's bytes depend on its pages alone and a retried task writes the same files
again. A file is written under a temporary name and renamed; the manifest, a table written by
Spark after all tasks ended, says which files count. The reader takes files in the manifest only.

Of the pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest
page_id is a ``response`` record; the others are ``revisit`` records that refer to it and do not
repeat the payload. Only ids and digests are joined to find them: the html is shuffled once, by
the sort, in which each page meets the row that says what it refers to.

Defined results: null html is the empty payload; null or odd urls are written without, or with
percent-encoded control characters; of repeated rows (same id and payload) one is the response
and the others refer to that id; a null page_id comes first, is never referred to, and is a
response if no page with an id has its payload; other columns are ignored; an empty table
writes no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import commit_file, new_folder

FILE_BYTES = 16 << 20  # compressed size after which a task starts another file
MIN_REVISIT = 0
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_MANIFEST = "file string, part int, seq int, records bigint, bytes bigint, sha1 string"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str, copy: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{payload_digest}{f':{copy}' if copy else ''}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int) -> bytes:
    """One uncompressed record; ``refers_to`` makes it a revisit of that page's response."""
    own = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, own, copy)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, own, 0)}"]
    head += [
        f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzip file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not at the start of a record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or "sha1:" + digest(block) != head["warc-block-digest"]:
            raise ValueError(f"damaged record {head.get('warc-record-id')}")
        yield head, block


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def parse_record(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload bytes, payload digest, record type, page referred to."""
    own = head["warc-payload-digest"].removeprefix("sha1:")
    size, kind = int(head["x-payload-length"]), head["warc-type"]
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if len(payload) != size or digest(payload) != own:
            raise ValueError(f"payload does not fit its digest: {head['warc-record-id']}")
    refers = _page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
    return _page_of(head["warc-record-id"]), size, own, kind, refers


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    )


def _references(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload other rows have as well."""
    keys = pages.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("sha1"))
    # partial counts per task: a payload that very many pages share is one row per task here
    groups = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return keys.distinct().join(groups.select("sha1", "refers_to"), "sha1").select("page_id", "sha1", "refers_to")


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` to WARC files in ``folder``; returns the committed manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, records = TaskContext.get().partitionId(), 0, 0
        held = io.BytesIO()
        now: tuple[int | None, str] | None = None
        refers: int | None = None
        copy = -1

        def flush() -> pa.RecordBatch:
            nonlocal seq, records, held
            name, content = f"part-{part:06d}-{seq:06d}.warc.gz", held.getvalue()
            commit_file(folder, name, content)
            row = [name, part, seq, records, len(content), hashlib.sha1(content).hexdigest()]
            seq, records, held = seq + 1, 0, io.BytesIO()
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["file", "part", "seq", "records", "bytes", "sha1"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, own, refers_to, payload = (b.column(k)[i].as_py() for k in (0, 2, 3, 4))
                if (page_id, own) != now:
                    now, refers, copy = (page_id, own), None, -1
                if payload is None:  # sorts before the records of its payload
                    refers = refers_to
                    continue
                copy += 1
                target = None if refers == page_id and copy == 0 else refers
                held.write(gzip.compress(make_record(page_id, b.column(1)[i].as_py(), payload, target, copy), 6, mtime=0))
                records += 1
                if held.tell() >= file_bytes:
                    yield flush()
        if records:
            yield flush()

    whole = _pages(pages)
    none = F.lit(None)
    rows = _references(whole, least).select("page_id", none.cast("string").alias("url"), "sha1", "refers_to", none.cast("binary").alias("payload"))
    both = rows.unionByName(whole.select("page_id", "url", F.sha1("payload").alias("sha1"), none.cast("bigint").alias("refers_to"), "payload"))
    # a page_id that repeats spreads by its payloads; a task holds one reference and one count
    ordered = both.repartitionByRange("page_id", "sha1").sortWithinPartitions("page_id", "sha1", F.col("refers_to").asc_nulls_last(), "url")
    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the
    committed files; damaged files and records raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = [parse_record(*r) for r in read_records(content.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(rows)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    ["file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, " + _RESULT)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    return found.join(manifest.select("file"), "file", "left_semi").drop("file")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read all of them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    if write_warc(pages, folder).isEmpty():
        return spark.createDataFrame([], _RESULT)
    return read_warc(spark, folder)
