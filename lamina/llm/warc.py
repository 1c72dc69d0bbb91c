"""WARC archives: a writer that marks revisits, and a splittable reader.

Writing. Each record is a gzip member of its own. Of records with equal payloads of ``MIN_REVISIT`` bytes or more the one with
the least id is the response; the others are revisits that name it and carry no payload. Spark's text writer stores the
members byte for byte through its commit protocol, so lost or repeated tasks leave no partial file: the last byte of a member
(the top byte of its size) is zero, so it can serve as the line separator; a member of 16 MB or more is followed by one zero
byte of padding, which gzip readers pass over.

Reading. Files are listed with their lengths and cut into byte ranges, one task each. A task looks for the gzip magic in its
range, validates a candidate by inflating its first bytes and parsing a WARC version line and header block, and then inflates
the member to its end (checksum included), reading past the range where needed. It owns exactly the records that start inside
its range. A candidate that does not validate is compressed data that happens to look like the magic; the search goes on behind it.

Defined cases: a null payload is empty; rows that share the least id of equal payloads are all responses, and rows without an
id revisit the least id; a truncated or damaged member yields no record; an empty archive yields no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.session import ship_package

MIN_REVISIT, RANGE_BYTES, READ_BYTES = 100, 4 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.BinaryType()),
])


def marked(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """page, url, payload, digest, bytes and ``original``: the response's id for revisits, else null."""
    payload = F.coalesce(pages[payload_column].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_column].alias("page"), pages[url_column].alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page").alias("original"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(first.where("n > 1").drop("n"), "digest", "left")
    return joined.withColumn("original", F.when(~F.col("page").eqNullSafe(F.col("original")), F.col("original")))


def record_urn(page: object) -> str:
    """The record id of a page: a name-based identifier, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def encode_record(page: object, url: str | None, payload: bytes, digest: str, size: int, original: object) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", record_urn(page)),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "".join((url or "").split())),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Bytes", str(size))]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if original is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(original)), ("X-Refers-To-Page", str(original))]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    record = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record.encode() + block + b"\r\n\r\n") + deflate.flush()


def write_archives(records: DataFrame, path: str) -> None:
    """Store the records of ``marked`` under a new folder."""
    ship_package(records.sparkSession)
    records = records.select("page", "url", "payload", "digest", "bytes", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[(x.as_py() for x in batch.column(c)) for c in range(6)], strict=True)
            members = (encode_record(*row) for row in rows)
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] if m.endswith(b"\0") else m for m in members], pa.binary())], ["member"])

    members = records.mapInArrow(run, "member binary")
    # the cast keeps the bytes as they are
    members.select(F.col("member").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and payload of an inflated record; the HTTP head inside the block is taken off."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    try:
        block = rest[: int(headers["Content-Length"])]
    except (KeyError, ValueError):
        return None
    if headers.get("Content-Type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return headers, block


def _member(read, at: int, buffer: memoryview) -> tuple[bytes, int] | None:
    """The inflated record that starts at ``at`` and its compressed length, or None if there is none. ``buffer``: bytes from there on."""
    inflate = zlib.decompressobj(31)
    try:
        start = inflate.decompress(buffer[:4096], 1 << 14)
        if not start.startswith(b"WARC/1.") or b"\r\n" not in start:
            return None
        inflate, parts, used = zlib.decompressobj(31), [], 0
        piece = bytes(buffer)
        while piece and not inflate.eof:
            parts.append(inflate.decompress(piece))
            used += len(piece)
            piece = b"" if inflate.eof else read(at + used, READ_BYTES)
        return (b"".join(parts), used - len(inflate.unused_data)) if inflate.eof else None
    except zlib.error:
        return None


def records_in(read, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and payload of the records that start in [start, end); ``read(at, n)`` gives up to n bytes."""
    base, data = start, read(start, min(READ_BYTES, end - start + 2))
    at = start
    while at < end:
        found = data.find(MAGIC, at - base)
        if found < 0:
            # the last two bytes may begin a magic; nothing that starts at or behind the end matters
            at = max(at, base + len(data) - 2)
            fresh = read(at, min(READ_BYTES, end - at + 2)) if at < end else b""
            if len(fresh) <= 2:
                return
            base, data = at, fresh
            continue
        at = base + found
        if at >= end:
            return
        if len(data) - found < 8192:
            base, data = at, read(at, READ_BYTES)
            found = 0
        got = _member(read, at, memoryview(data)[found:])
        record = got and _parse(got[0])
        if record:
            yield at, *record
            at += got[1]
            if at > base + len(data):
                base, data = at, read(at, max(0, min(READ_BYTES, end - at + 2)))
        else:
            at += 1


def _open(path: str):
    """A reader of byte ranges, by a path as Spark lists it."""
    system, inner = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    handle = system.open_input_file(inner)
    size = handle.size()
    return handle, lambda at, n: handle.read_at(min(n, size - at), at) if at < size and n > 0 else b""


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records under ``path``; the number of tasks follows the bytes, not the files."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    dealt = ranges.repartition(max(1, ranges.count()))  # a given number: tiny rows would else be put together into one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                handle, read = _open(file)
                with handle:
                    rows, held = [], 0
                    for at, headers, payload in records_in(read, start, start + range_bytes):
                        rows.append({"path": file, "offset": at, "record_type": headers.get("WARC-Type"), "record_id": headers.get("WARC-Record-ID"),
                                     "uri": headers.get("WARC-Target-URI"), "headers": list(headers.items()), "payload": payload})
                        held += len(payload)
                        if held > READ_BYTES * 8:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    return dealt.mapInArrow(run, RECORD)


ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                   ("uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
