"""WARC archives: writing, and reading back with segment reassembly.

A page becomes a ``response`` record whose HTTP body has chunked framing, or a
``revisit`` of the page with the largest id that has the same payload.  Blocks
over ``segment_bytes`` are written as a first record and continuations.

Reading parses every archive by content lengths.  Whole records are decoded
where they are read.  Only segments are moved: they are grouped by the id of
their first record, ordered by number, checked against the total length that
the last one states, joined and decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import new_folder, written

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16 << 10, 4 << 10, 20_000
#: Bytes after which parsed records are handed on.
BATCH_BYTES = 8 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = b"\r\n"
END_OF_RECORD = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = (
    "record_type string, page_id bigint, url string, payload_digest string, record_id string,"
    " refers_to_record string, payload binary, payload_bytes bigint, problem string"
)
SEGMENT = (
    "record_type string, page_id bigint, url string, payload_digest string, origin string, number int,"
    " total bigint, length bigint, block binary"
)
ARROW_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def arrow_schema(columns: str) -> pa.Schema:
    pairs = (column.split() for column in columns.split(","))
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in pairs])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, url: str | None, digest: str) -> str:
    """Id of a page's record: equal pages have equal ids."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _parts(block: bytes, size: int) -> list[bytes]:
    """Parts of up to ``size`` bytes that do not cut a UTF-8 sequence."""
    parts, start = [], 0
    while start < len(block):
        end = min(start + max(size, 4), len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(block[start:end])
        start = end
    return parts


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = []
    for part in _parts(payload, size):
        out += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(CRLF + CRLF)
    if not found:
        raise ValueError("no end of the HTTP head")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _header(kind: str, own_id: str, length: int, fields: dict[str, object]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    lines += [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return ("\r\n".join(lines) + f"\r\nContent-Length: {length}\r\n\r\n").encode()


def page_records(
    page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None, segment_bytes: int
) -> list[bytes]:
    """Records of one page, without the blank lines that end each."""
    digest = base32_sha1(payload)
    own = record_uri(page_id, url, digest)
    uri = None if url is None else "".join(url.split())
    fields: dict[str, object] = {"WARC-Target-URI": uri, "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_uri(*refers_to, digest)}
        return [_header("revisit", own, len(HTTP_HEAD), fields) + HTTP_HEAD]
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        return [_header("response", own, len(block), fields) + block]
    out, parts = [], _parts(block, segment_bytes)
    for number, part in enumerate(parts, 1):
        more: dict[str, object] = {"WARC-Segment-Number": number}
        kind, part_id = "response", own
        if number > 1:
            kind, part_id = "continuation", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own} {number}')}>"
            more["WARC-Segment-Origin-ID"] = own
        if number == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        out.append(_header(kind, part_id, len(part), (fields if number == 1 else {}) | more) + part)
    return out


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    segment_bytes: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Gzipped archives of ``pages`` (page_id, url, html) below ``path``.

    Among equal payloads of ``min_bytes`` or more, the row with the largest
    ``page_id`` is the response and the others revisit it; equal rows of that
    id are responses all.  A null payload is empty; a row without an id is a
    response if no row with one has its payload.  Other columns are ignored.
    Only digests are grouped; the pages are joined to groups of two rows or more.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"sha1": F.unhex(F.sha1(F.col("html").cast("binary"))), "bytes": F.octet_length("html")})
    first = (
        rows.where(F.col("bytes") >= min_bytes)
        .groupBy("sha1", "bytes")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
    )
    # the address belongs to the id of the referred record
    named = (
        rows.join(first, ["sha1", "bytes"])
        .where("page_id = first_id")
        .groupBy("sha1", "bytes", "first_id")
        .agg(F.min(F.struct("url")).alias("first_url"))
        .select("sha1", "bytes", "first_id", F.col("first_url.url").alias("first_url"))
    )
    linked = rows.join(named, ["sha1", "bytes"], "left").select(
        "page_id", "url", "html", "first_id", "first_url", F.expr("not (page_id <=> first_id) and first_id is not null").alias("again")
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out: list[bytes] = []
                for row in batch.slice(start, 256).to_pylist():
                    refers_to = (row["first_id"], row["first_url"]) if row["again"] else None
                    out += page_records(row["page_id"], row["url"], row["html"].encode(), refers_to, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    (
        linked.mapInArrow(records, "value string")
        .write.option("lineSep", END_OF_RECORD)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{fields.get('warc-record-id')} is cut off")
        yield fields, block


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _decoded(fields: dict[str, object], block: bytes) -> dict[str, object]:
    """A record's row: its payload, or what is wrong with it."""
    payload, problem = None, None
    if fields["record_type"] == "response":
        try:
            payload = http_payload(block)
            if fields["payload_digest"] != base32_sha1(payload):
                payload, problem = None, "the payload has another digest"
        except ValueError as error:
            problem = str(error)
    return fields | {"payload": payload, "payload_bytes": None if payload is None else len(payload), "problem": problem}


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row, n in rows:
        kept.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    yield pa.RecordBatch.from_pylist(kept, schema)


def _read(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Whole records decoded, or the segments of the others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for content in batch.column(0):
                data = pa.BufferReader(content.as_buffer())
                for fields, block in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=data))):
                    number = _number(fields.get("warc-segment-number"))
                    if (number is not None) != segmented:
                        continue
                    shared = {
                        "record_type": fields["warc-type"],
                        "page_id": _number(fields.get("x-page-id")),
                        "url": fields.get("warc-target-uri"),
                        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    }
                    if segmented:
                        origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
                        total = _number(fields.get("warc-segment-total-length"))
                        place = {"origin": origin, "number": number, "total": total, "length": len(block)}
                        yield shared | place | {"block": block}, len(block)
                    else:
                        own = {
                            "record_id": fields["warc-record-id"],
                            "refers_to_record": fields.get("warc-refers-to"),
                        }
                        yield _decoded(shared | own, block), len(block)

    columns = SEGMENT if segmented else RECORD
    arrow = arrow_schema(columns)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _batches(rows(batches), arrow), columns)


def _reassemble(segments: DataFrame) -> DataFrame:
    """Records of the segments that share an origin.

    A record that was written several times, with equal ids, has each number as
    often and is returned as often.  Missing numbers and wrong totals are named
    in ``problem``.
    """
    grouped = segments.groupBy("origin").agg(
        F.array_sort(
            F.collect_list(F.struct("number", "total", "record_type", "page_id", "url", "payload_digest", "block"))
        ).alias("parts")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for batch in batches:
            for i in range(batch.num_rows):
                origin, parts = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                unique = {part["number"]: part for part in parts}
                copies = len(parts) // len(unique)
                first, last = unique.get(1, parts[0]), unique[max(unique)]
                block = b"".join(unique[n]["block"] for n in sorted(unique))
                row = {k: first[k] for k in ("record_type", "page_id", "url", "payload_digest")}
                row |= {"record_id": origin, "refers_to_record": None}
                if sorted(unique) != list(range(1, len(unique) + 1)) or len(parts) != copies * len(unique):
                    done = row | {"payload": None, "payload_bytes": None, "problem": "segments are missing"}
                elif last["total"] != len(block):
                    problem = f"{len(block)} bytes, not {last['total']}"
                    done = row | {"payload": None, "payload_bytes": None, "problem": problem}
                else:
                    done = _decoded(row, block)
                for _ in range(max(1, copies)):
                    yield done, len(block)

    arrow = arrow_schema(RECORD)
    return grouped.mapInArrow(lambda batches: _batches(rows(batches), arrow), RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit in the archives below ``path``.

    ``payload`` is decoded; it is null for a revisit, and for a record with a
    ``problem`` (a missing segment, a wrong total length, bad framing, another
    digest than stated).
    """
    return _read(spark, path, False).unionByName(_reassemble(_read(spark, path, True)))


def resolved(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``, the page id of the response that a revisit names, and its size."""
    target = (
        records.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("refers_to_record"))
        .agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("target_bytes"))
    )
    return (
        records.join(target, "refers_to_record", "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "target_bytes"))
        .drop("target_bytes")
    )


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "archives")
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    records = written(read_archives(spark, path).drop("payload"), "archive-records")
    return resolved(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "problem"
    )
