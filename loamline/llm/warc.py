"""WARC archives: written from pages, read back, and assembled to one nested row per capture.

Writing: of pages with equal payloads the one with the smallest page_id is
written as a response, the others as revisits that refer to it. Every capture is
three records, each a gzip member of its own: the request and the metadata name
the response (or revisit) as the record they are concurrent to. Digests shared by
several pages are found by an aggregation of (digest, page_id) alone, so payloads
aren't shuffled unless that list is too long to broadcast.

Reading: archives are parsed as streams, one record at a time, and every stored
payload is checked against its digest. Assembly: records that name the same
transaction are aggregated to one row with request, response and metadata.

Archives go to the session's shared folder under names that depend on the
partition alone; each is written under a name of the attempt and then moved, so
a repeated task replaces its own archive.

Defined cases: a null html is an empty payload, a null url an empty target; rows
without a page_id are always responses, and nothing refers to them; repeated rows
give one capture each, all of the same type, and rows that differ in their url are
captures of their own; an empty table gives no archive and no capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.session import fresh_path, materialize, ship

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20
#: Shared digests (about 120 bytes each) are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
LEVEL = 1
COPIES = 10_000

_HEAD = "WARC-Type: {}\r\nWARC-Record-ID: {}\r\nWARC-Date: " + DATE + "\r\n"
_RECORDS = (
    "archive string, record_id string, transaction string, type string, target string, page_id long, "
    "payload_digest string, payload_bytes long, refers_to string, refers_page long, content binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target_of(url: str | None) -> str:
    return " ".join((url or "").split())


def record_id(kind: str, page_id: int | None, digest: str, target: str) -> str:
    h = hashlib.md5(f"{kind} {page_id} {digest} {target}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def member(head: str, block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    data = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def capture(page_id: int | None, url: str | None, html: str | None, first: int | None, first_url: str | None = None) -> bytes:
    """Request, response or revisit, and metadata of one page; ``first`` is the page that holds an equal payload.

    The metadata of a revisit tell that page, so that no reader has to look for it.
    """
    payload, target = (html or "").encode(), target_of(url)
    digest = base32_sha1(payload)
    revisit = first is not None and first != page_id
    me = record_id("response", page_id, digest, target)
    about = f"WARC-Target-URI: {target}\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = _HEAD.format("revisit" if revisit else "response", me) + about + f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http;msgtype=response\r\n"
    if revisit:
        head += f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {record_id('response', first, digest, target_of(first_url))}\r\n"
    joined = f"WARC-Concurrent-To: {me}\r\n"
    request = _HEAD.format("request", record_id("request", page_id, digest, target)) + about + joined + "Content-Type: application/http;msgtype=request\r\n"
    metadata = _HEAD.format("metadata", record_id("metadata", page_id, digest, target)) + about + joined + "Content-Type: application/warc-fields\r\n"
    fields = (f"page-id: {page_id}\r\n" if page_id is not None else "") + (f"refers-to-page-id: {first}\r\n" if revisit else "")
    return (
        member(request, f"GET {target} HTTP/1.1\r\n\r\n".encode()) + member(head, http if revisit else http + payload) + member(metadata, fields.encode())
    )


def write_archives(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html); returns their manifest (archive, captures, bytes)."""
    spark = pages.sparkSession
    ship(spark)
    path = path or fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    eligible = rows.filter(F.octet_length("html") >= min_revisit_bytes)
    shared = materialize(eligible.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "shared")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    is_shared = F.col("page_id").isNotNull() & (F.octet_length("html") >= min_revisit_bytes)
    typed = rows.join(shared, "digest", "left").select("page_id", "url", "html", F.when(is_shared, F.col("first")).alias("first"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        made, out, captures, size = 0, None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal made, out, captures, size
            out.close()
            name = f"{path}/part-{part:06d}-{made:04d}.warc.gz"
            files.move(waiting(), f"{root}/part-{part:06d}-{made:04d}.warc.gz")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([captures], pa.int64()), pa.array([size], pa.int64())], ["archive", "captures", "bytes"])
            made, out, captures, size = made + 1, None, 0, 0
            return row

        def waiting() -> str:
            return f"{root}/.part-{part:06d}-{made:04d}.{attempt}"

        for batch in batches:
            for i in range(batch.num_rows):
                data = capture(*(batch.column(c)[i].as_py() for c in range(5)))
                if out is None:
                    out = files.open_output_stream(waiting(), compression=None)
                    info = member(_HEAD.format("warcinfo", record_id("warcinfo", part, str(made), "")) + "Content-Type: application/warc-fields\r\n", b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size += len(info)
                out.write(data)
                captures, size = captures + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return materialize(typed.mapInArrow(run, "archive string, captures long, bytes long"), "manifest")


def inflate(stream, chunk: int = 1 << 15) -> Iterator[bytes]:
    """Bytes of a file of gzip members, one after another."""
    unpack, data = zlib.decompressobj(31), stream.read(chunk)
    while data:
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        yield unpack.decompress(data)
        data = unpack.unused_data if unpack.eof and unpack.unused_data else stream.read(chunk)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    held, at = bytearray(), 0
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            lines = held[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:40]!r}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head["content-length"])
            if len(held) < end + 8 + size:
                break
            yield head, bytes(held[end + 4 : end + 4 + size])
            at = end + 8 + size
        if at > 1 << 20 or at == len(held):
            del held[:at]
            at = 0
    if len(held) > at:
        raise ValueError("the archive ends inside a record")


def read_records(manifest: DataFrame, with_content: bool = True) -> DataFrame:
    """Every record of the archives but warcinfo; a payload that doesn't fit its digest raises an error.

    payload_bytes is that of the full payload, which a revisit's HTTP header tells.
    """

    def one(archive: str, head: dict[str, str], block: bytes) -> tuple:
        kind, me = head["warc-type"], head["warc-record-id"]
        page_id = digest = size = refers = page = None
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            told = next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest, size, refers = head["warc-payload-digest"].removeprefix("sha1:"), int(told.split(b":")[1]), head.get("warc-refers-to")
            if kind == "response" and (base32_sha1(body) != digest or len(body) != size):
                raise ValueError(f"{archive}: {me} doesn't hold the payload of its digest")
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
            page_id, page = (int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page-id"))
        return archive, me, head.get("warc-concurrent-to", me), kind, head.get("warc-target-uri"), page_id, digest, size, refers, page, block if with_content else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in names[:5]] + [("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("refers_page", pa.int64()), ("content", pa.binary())]
        )

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                files, name = fs.FileSystem.from_uri(archive)
                rows, held = [], 0
                with files.open_input_stream(name, compression=None) as stream:
                    for head, block in parse(inflate(stream)):
                        if head["warc-type"] != "warcinfo":
                            rows.append(one(archive, head, block))
                            held += len(block) if with_content else 0
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    spark = manifest.sparkSession
    ship(spark)
    names = [c.split()[0] for c in _RECORDS.split(", ")]
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive").repartition(n).mapInArrow(run, _RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: transaction, page_id, and the nested request, response and metadata records."""
    nested = F.struct("record_id", "type", "target", "page_id", "payload_digest", "payload_bytes", "refers_to", "refers_page", "content")
    is_response = F.col("type").isin("response", "revisit")

    def of(condition: Column) -> Column:
        return F.max(F.when(condition, nested))

    grouped = records.groupBy("transaction").agg(
        of(F.col("type") == "request").alias("request"), of(is_response).alias("response"), of(F.col("type") == "metadata").alias("metadata"), F.count_if(is_response).alias("n")
    )
    # Repeated pages have the same identifiers; each of their captures gets its row.
    # In two steps, so that no array is longer than COPIES or the number of pages over it.
    blocks = grouped.filter("n > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    one_each = blocks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES))))
    return one_each.select("transaction", F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")


def captures(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages``, read the archives back and tell of every page how it was stored."""
    records = read_records(write_archives(pages, min_revisit_bytes=min_revisit_bytes), with_content=False)
    columns = ["page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("metadata.refers_page").alias("refers_to")]
    return transactions(records).select(*columns)
