"""Content-addressed WARC archive: payload bytes once, exact record headers beside them.

``archive`` writes two tables.  ``payloads`` holds every different payload once under its SHA-256;
``headers`` holds the exact bytes of every record's WARC header and of the head of its block (for a
page: the HTTP head), with the digest of the payload that belongs to it.  ``records`` joins them back to
whole records, and ``write_files`` and ``read_files`` turn records to and from WARC files.

A payload that many records share meets them in parts: the record's part is a hash below a number
that the payload's row fixes, so the join deals a third of all records evenly.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlattice.llm.common import in_arrow, join_totals, named, stored

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of one payload that meet it in one part of the join.
PART = 1024
#: Records in one file at most, as ``write_files`` makes them.
FILE_RECORDS = 10_000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32, as WARC digests are written: 160 bits are eight groups of four letters."""
    digest = F.sha1(payload)

    def letters(group: int) -> list[Column]:
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        return [F.substr(F.lit(BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[x for group in range(8) for x in letters(group)])


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``record_id, uri, block_head, payload`` of a page table; a null text is an empty payload."""
    payload = F.coalesce(named(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    # a line break in an address would end its header line
    uri = F.regexp_replace(F.coalesce(named(url_col), F.lit("")), r"[\r\n]", " ")
    return pages.select(named(id_col).cast("long").alias("record_id"), uri.alias("uri"), head.cast("binary").alias("block_head"), payload.alias("payload"))


def warc_header(record_id: Column, uri: Column, record_type: Column, refers_to: Column, payload_digest: Column, n_bytes: Column, date: str) -> Column:
    """A record's header up to and with its empty line; a revisit's block holds no payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        F.when(record_type == "revisit", F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.coalesce(refers_to.cast("string"), F.lit("none")), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), payload_digest)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", n_bytes.cast("string")),
        F.lit(CRLF),
    )
    return text.cast("binary")


def header_field(header: Column, name: str) -> Column:
    """A field's text in header bytes, null where there is none."""
    found = F.regexp_extract(header.cast("string"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive(records: DataFrame, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """``(headers, payloads)`` of ``record_id, uri, block_head, payload[, header]``, both written in the shared folder.

    Of records whose payloads of ``least`` bytes or more are equal, the one with the largest ``record_id`` (null
    ids last, then by address) is a response and the others revisit it; a revisit's block ends with its
    head.  Smaller payloads are stored once too, but all of their records are responses.  Where the
    records bring a ``header`` of their own, it is kept to the byte and states their type.

    Payloads count as equal by SHA-256, and a digest whose payloads differ in length stops the job.  Rows
    that are equal in all columns are one response and revisits of it.  A null payload or head is empty.
    An empty table gives empty tables.

    ``payloads``: digest (SHA-256), payload_digest (base32 SHA-1), n_bytes, held (records), parts, first_id, payload.
    ``headers``: record_id, copy (0 and up for equal rows), digest, part, header, block_head.
    """
    brought = "header" in records.columns
    none = F.lit(b"")
    own = records.select("record_id", F.coalesce("uri", F.lit("")).alias("uri"), F.coalesce("block_head", none).alias("block_head"), (F.coalesce("header", none) if brought else none).alias("header"), F.coalesce("payload", none).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    kept = own.groupBy("digest").agg(F.count("*").alias("held"), F.min(F.octet_length("payload")).alias("shortest"), F.max(F.octet_length("payload")).alias("n_bytes"), F.max(F.struct("record_id", "uri", "block_head", "header", "payload")).alias("best"))
    payloads = stored(
        kept.select(
            F.when(F.col("shortest") == F.col("n_bytes"), F.col("digest")).otherwise(F.raise_error(F.lit("payloads of one digest differ"))).alias("digest"),
            base32_sha1(F.col("best.payload")).alias("payload_digest"),
            F.col("n_bytes").cast("long").alias("n_bytes"),
            "held",
            F.ceil(F.col("held") / F.lit(PART)).cast("int").alias("parts"),
            F.struct("best.record_id", "best.uri", "best.block_head", "best.header").alias("first"),
            F.col("best.payload").alias("payload"),
        ),
        "payloads",
    )
    # equal rows are counted, so that one of them is the first
    counted = own.groupBy("digest", "record_id", "uri", "block_head", "header").agg(F.count("*").alias("copies"))
    block = F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 4096"))
    copies = counted.withColumn("block", F.explode(block)).withColumn("copy", F.explode(F.sequence(F.col("block") * 4096, F.least(F.col("block") * 4096 + 4095, F.col("copies") - 1))))
    met = join_totals(copies, payloads.select("digest", "held", "payload_digest", "n_bytes", "parts", "first"), "digest", "held")
    is_first = (F.col("copy") == 0) & F.struct("record_id", "uri", "block_head", "header").eqNullSafe(F.col("first"))
    kind = F.when(is_first | (F.col("n_bytes") < least), "response").otherwise("revisit")
    length = F.octet_length("block_head") + F.when(kind == "response", F.col("n_bytes")).otherwise(0)
    header = F.col("header") if brought else warc_header(F.col("record_id"), F.col("uri"), kind, F.col("first.record_id"), F.col("payload_digest"), length, date)
    headers = met.select("record_id", "copy", "digest", F.pmod(F.xxhash64("record_id", "uri", "copy"), F.col("parts")).cast("int").alias("part"), header.alias("header"), "block_head")
    return stored(headers, "headers"), payloads


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """``record_id, copy, record_type, refers_to, payload_bytes, payload_digest, payload, record`` of every header row.

    All is read from the stored bytes: type and reference from the header, length and digest from the
    payload, whose SHA-256 must be its address.  ``payload`` is a revisit's too; ``record`` is the record to
    the byte, with the two empty lines that end it.
    """
    address = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its address says: "), "digest")))
    read = payloads.select(address.alias("digest"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "payload")
    kind = header_field(F.col("header"), "WARC-Type")
    block = F.concat("block_head", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload")))
    return (
        headers.select("*", kind.alias("record_type"), F.regexp_extract(header_field(F.col("header"), "WARC-Refers-To"), r"<urn:record:(-?\d+)>", 1).alias("to"))
        .join(read, ["digest", "part"])
        .select("record_id", "copy", "record_type", F.when(F.col("to") != "", F.col("to").cast("long")).alias("refers_to"), "payload_bytes", "payload_digest", "payload", F.concat("header", block, F.lit((CRLF * 2).encode())).alias("record"))
    )


def write_files(records: DataFrame, path: str) -> None:
    """WARC files (gzip) of ``record`` bytes as ``reconstruct`` gives them, ``FILE_RECORDS`` each at most."""
    bare = F.substring("record", F.lit(1), F.octet_length("record") - 4).cast("string")
    records.select(bare.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header, with its empty line, and block of each record of a WARC file, plain or gzip."""
    held = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := held.readline():
        if not line.strip():
            continue
        lines, length = [line], None
        while (line := held.readline()).strip():
            lines.append(line)
            name, _, value = line.partition(b":")
            length = int(value) if name.strip().lower() == b"content-length" else length
        if not lines[0].startswith(b"WARC/") or length is None or not line:
            raise ValueError("no WARC record header")
        block = held.read(length)
        if len(block) < length:
            raise ValueError("a WARC record is cut short")
        yield b"".join([*lines, line]), block


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, place, header, block`` of every record in the WARC files under ``path``, a file a task's unit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, begin = [], 0, 0
                for header, block in parse_records(data):
                    rows.append((header, block))
                    size += len(header) + len(block)
                    if size > 4_000_000:
                        yield _batch(file, begin, rows)
                        rows, size, begin = [], 0, begin + len(rows)
                if rows:
                    yield _batch(file, begin, rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").transform(in_arrow, work, "file string, place long, header binary, block binary")


def _batch(file: str, begin: int, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(range(begin, begin + len(rows)), pa.int64()), pa.array([h for h, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["file", "place", "header", "block"])


def file_records(read: DataFrame) -> DataFrame:
    """Records for ``archive`` of what ``read_files`` gives; an HTTP block's head ends with its first empty line.

    Their ids are the numbers in ``<urn:record:N>`` addresses, null for others; a revisit's own payload is empty.
    """
    is_http = F.coalesce(header_field(F.col("header"), "Content-Type").startswith("application/http"), F.lit(False))
    cut = F.when(is_http, F.locate(CRLF + CRLF, F.decode("block", "ISO-8859-1")))
    head = F.when(cut > 0, cut + 3).otherwise(0)
    own_id = F.regexp_extract(header_field(F.col("header"), "WARC-Record-ID"), r"<urn:record:(-?\d+)>", 1)
    return read.select(
        F.when(own_id != "", own_id.cast("long")).alias("record_id"),
        header_field(F.col("header"), "WARC-Target-URI").alias("uri"),
        F.substring("block", F.lit(1), head).alias("block_head"),
        F.substring("block", head + 1, F.octet_length("block")).alias("payload"),
        "header",
    )
