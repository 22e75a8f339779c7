"""WARC archives with revisit resolution.

Headers (id, digest, length, place of the page) are shuffled by payload digest, without payloads; of the rows of a digest
that with the smallest id becomes the original, the others revisit it. What is found is joined to the pages by their
places, of which each has its own, so no page or payload that many rows repeat makes a file large. Each record is a gzip
member of its own, as readers that seek by record need it. Spark has no sink for bytes, but its text sink writes strings
as they are, with a separator behind each: members are written without their last byte, which is 0 (the top byte of a
length under 16 MB), and the separator is that byte. So archives land on any file system that Spark writes to, and a
lost task's file is written again. A file holds about FILE_MB of payload. Reading goes through the archives record by
record, by Content-Length, and revisits are joined with their originals to get back the payload's length and digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keymoment.llm.common import Scratch, located

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
FILE_MB = 16
#: A gzip member holds at most so many bytes; a longer record goes on in further members.
MEMBER_BYTES = 8 << 20
#: One date for all records, so that reruns write the same archives.
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HEADERS, _SLICE = 1 << 16, 1 << 14
PARSED = "page_id bigint, record_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, url string"


def _digest(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def urn(*parts: Column) -> Column:
    """A URN that depends on the parts (null as 'null') alone."""
    h = F.md5(F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("null")) for x in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve(rows: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, int]:
    """(repeats, bytes): repeats(file, row, original, revisit) of each row of a located() table of pages whose payload has
    come before, by page_id (null last) and place: original is the page_id of the first. bytes: of all payloads."""
    html = F.coalesce(F.col("whole.html"), F.lit(""))
    headers = rows.select(F.col("whole.page_id").alias("page_id"), _digest(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), "file", "row")
    headers = scratch.keep(headers, "headers")
    total = headers.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "row")
    firsts = headers.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    firsts = scratch.keep(firsts, "firsts")
    repeats = headers.join(firsts, "digest").where((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row")))
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return scratch.keep(repeats.select("file", "row", F.col("first.page_id").alias("original"), revisit.alias("revisit")), "repeats"), total


def records(rows: DataFrame, repeats: DataFrame, files: int) -> DataFrame:
    """A column `value` with the WARC record of each row of a located() table of pages, in `files` partitions of like size."""
    own = rows.select(F.col("whole.page_id").alias("page_id"), F.col("whole.url").alias("url"), F.coalesce(F.col("whole.html"), F.lit("")).alias("html"), "file", "row")
    t = own.repartition(files, "file", "row").join(repeats.repartition(files, "file", "row"), ["file", "row"], "left").withColumn("digest", _digest(F.col("html")))
    again = F.coalesce("revisit", F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.coalesce(F.regexp_replace("url", "[\\r\\n]+", "%0D%0A"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    first = urn(F.lit("first"), F.col("page_id"), F.col("digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(F.col("revisit").isNull(), first).otherwise(urn(F.lit("again"), F.col("page_id"), F.col("digest"), F.col("file"), F.col("row")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.lit("first"), F.col("original"), F.col("digest"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.coalesce(line("Page-ID", F.col("page_id").cast("string")), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return t.select(F.concat(head, block, F.lit(_END)).alias("value"))


def members(record: bytes) -> bytes:
    """A record as gzip: one member, or several if it is long, without the last byte, which is 0."""
    out = b""
    for k in range(0, len(record), MEMBER_BYTES):
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        out += z.compress(record[k : k + MEMBER_BYTES]) + z.flush()
    return out[:-1]


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.column(0).slice(k, 64)
            yield pa.RecordBatch.from_arrays([pa.array([members(x.as_buffer().to_pybytes()) for x in part], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = LEAST_BYTES, file_mb: int = FILE_MB) -> None:
    """Write a record for each row of pages(page_id, url, html, ...) as WARC files under path, a gzip member a record."""
    rows = located(pages, scratch)
    repeats, total = resolve(rows, scratch, least_bytes)
    files = max(1, -(-total // (file_mb << 20)))
    packed = records(rows, repeats, files).mapInArrow(_compress, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\u0000").text(path)
    scratch.drop("located", "headers", "firsts", "repeats")


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive that comes in pieces; names of headers in lower case. What has been
    read is let go of, so memory holds a record and a piece."""
    data, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        part = next(chunks, None)
        if part is not None:
            if at > _HEADERS:
                del data[:at]
                at = 0
            data.extend(part)
        return part is not None

    while True:
        looked = at
        while (end := data.find(b"\r\n\r\n", looked)) < 0:
            gone = at
            looked = max(at, len(data) - 3)
            if not more():
                if data[at:].strip():
                    raise ValueError("the archive ends within a record")
                return
            looked -= gone - at
        lines = bytes(data[at:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        size, at = int(head["content-length"]), end + 4
        while len(data) - at < size + 4 and more():
            pass
        if len(data) - at < size:
            raise ValueError("the archive ends within a record")
        yield head, bytes(memoryview(data)[at : at + size])
        at += size + 4


def inflated(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of gzip data of one or more members, in pieces; other data as it is. What follows a member is handed on
    in small slices, as a copy of all the rest for each member would cost the square of the archive."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at, left, z = memoryview(data), 0, b"", None
    while left or at < len(view):
        if not left:
            left, at = view[at : at + _SLICE], at + _SLICE
        z = z or zlib.decompressobj(31)
        while True:
            if out := z.decompress(left, piece):
                yield out
            left = z.unconsumed_tail
            if z.eof or not left:
                break
        if z.eof:
            left, z = z.unused_data, None
    if z and (out := z.flush()):
        yield out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for cell in batch.column(0):
            out: list[tuple] = []
            for head, block in parse(inflated(cell.as_py() or b"")):
                full = head.get("warc-type") == "response"
                payload = block[block.find(b"\r\n\r\n") + 4 :] if full else b""
                page = head.get("page-id")
                out.append((int(page) if page else None, head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), len(payload) if full else None, hashlib.sha256(payload).hexdigest() if full else None, head.get("warc-target-uri")))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """A row for each record of the archives under path: page_id, payload_bytes, payload_digest, record_type, refers_to
    (the page_id of a revisit's original) and url; length and digest of a revisit are those of its original's payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = scratch.keep(files.mapInArrow(_read, PARSED), "parsed")
    asked = parsed.where("record_type = 'revisit'").select("refers_to").distinct()
    originals = parsed.where("record_type = 'response'").select("record_id", F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest"))
    originals = scratch.keep(originals.join(asked, originals["record_id"] == asked["refers_to"], "left_semi"), "originals")
    revisits = parsed.where("record_type = 'revisit'").join(originals.withColumnRenamed("record_id", "o_id"), F.col("refers_to") == F.col("o_id"), "left")
    revisits = revisits.select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to"), "url")
    first = parsed.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"), "url")
    return first.unionAll(revisits)


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, file_mb: int = FILE_MB) -> DataFrame:
    """Write pages as deduplicated archives in the shared folder, read them back: one row for each row of pages.

    A null html is an empty payload; payloads under least_bytes are all responses. Rows that repeat both page_id and
    payload of a response are responses too, as they are that page; each record has an id of its own. A null page_id is kept as null and comes after all
    ids as original. A url may be null or hold line breaks (written as %0D%0A). Columns other than page_id, url and html
    are ignored. An empty table gives an empty one. Any text may stand in a payload, WARC headers too: records are found
    by their length.
    """
    scratch = Scratch(pages.sparkSession)
    write_archives(pages, f"{scratch.path}/warc", scratch, least_bytes, file_mb)
    return read_archives(pages.sparkSession, f"{scratch.path}/warc", scratch)
