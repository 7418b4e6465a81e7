"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, both written and read by Spark.

An ARC file opens with a ``filedesc`` record whose body names the version and with it the fields of every
header line; a record is its header line and as many bytes as the line declares. Files are read as a
stream of lines, put together again by the declared lengths, so a task holds one record and never a file.
A WARC record gets its identifier from its place in the ARC file, so a repeated task makes the same one.

Spark's text source writes the files: what ends an ARC record (a line feed) or a WARC record (two line
ends) is its line separator. Plain files are read whole, a row each; compressed ones line by line.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import picked
from plumbline.session import cut_lineage, remove, scratch_path

# fixed values: the fields of a header line by ARC version, and the revisit profile of WARC 1.1
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = "\r\n"

#: Bytes of records a task hands on at a time.
BATCH_BYTES = 4 << 20
#: Identical payloads of at least so many bytes become one response and revisits.
REVISIT_BYTES = 0


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(stamp: str) -> str | None:
    """An ARC date (fourteen digits; a shorter one begins the period it names) as a WARC date; None if it is no date."""
    if not re.fullmatch(r"[0-9]{4,14}", stamp) or len(stamp) % 2:
        return None
    s = stamp + "00000101000000"[len(stamp):]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


class Stream:
    """Lines and runs of bytes from the pieces of a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at:] + piece, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its line feed, None at the end."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.held)
                if self.at == end:
                    return None
                break
        out, self.at = self.held[self.at:end], min(end + 1, len(self.held))
        return out

    def read(self, n: int) -> bytes:
        """The next n bytes, or what is left."""
        parts, need = [], n
        while need > 0:
            part = self.held[self.at:self.at + need]
            if part:
                parts.append(part)
                self.at += len(part)
                need -= len(part)
            else:
                piece = next(self.pieces, None)
                if piece is None:
                    break
                self.held, self.at = piece, 0
        return b"".join(parts)


def split_http(block: bytes) -> int:
    """Where the payload of an HTTP response begins, 0 if the block is none."""
    if not block.startswith(b"HTTP/"):
        return 0
    m = re.search(rb"\r?\n\r?\n", block)
    return m.end() if m else 0


def arc_records(stream: Stream, file: str) -> Iterator[dict]:
    """The records of one ARC file. Lines that are no header, as blank ones between records, are passed over."""
    fields, archive, number = len(ARC_FIELDS[1].split()), file, 0
    while (line := stream.line()) is not None:
        parts = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
        n = fields
        if line.startswith(b"filedesc:"):  # its version comes with its body, so the line has to tell by itself
            n = len(ARC_FIELDS[2 if len(parts) >= 10 else 1].split())
        if len(parts) < n or not parts[-1].isdecimal() or iso_date(parts[2 - n]) is None:
            continue
        size = int(parts[-1])
        block = stream.read(size)
        url, ip, stamp, mime = " ".join(parts[:1 - n]), parts[1 - n], parts[2 - n], parts[3 - n]
        opening = line.startswith(b"filedesc:") and re.match(rb"([12]) [^\n]*\nURL IP-address", block)
        about = bool(opening)
        if opening:
            archive, fields = url.removeprefix("filedesc://"), len(ARC_FIELDS[int(opening[1])].split())
        body = 0 if about else split_http(block)
        payload = block[body:]
        yield {
            "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}/{archive}/{number}')}>",
            "type": "warcinfo" if about else "response" if body else "resource",
            "url": None if url == "-" else url, "date": iso_date(stamp), "ip": None if ip in ("-", "0.0.0.0") else ip,
            "mime": mime, "cut": len(block) < size, "http": block[:body], "payload": payload, "payload_bytes": len(payload),
            "payload_digest": digest(payload), "block_digest": digest(block) if body else None, "http_digest": digest(block[:body]) if body else None}
        number += 1


def warc_records(stream: Stream, file: str) -> Iterator[dict]:
    """The records of one WARC file, payloads digested anew."""
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        named: dict[str, str] = {}
        while (line := stream.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            named.setdefault(name.strip().lower(), value.strip())
        block = stream.read(int(named.get("content-length") or 0))
        kind = named.get("warc-type")
        body = split_http(block) if named.get("content-type", "").startswith("application/http") else 0
        payload = None if kind == "revisit" else block[body:]
        told = (named.get("warc-payload-digest") or "").rpartition(":")[2] or None
        yield {
            "record_id": named.get("warc-record-id"), "type": kind, "url": named.get("warc-target-uri"), "date": named.get("warc-date"),
            "refers_to": named.get("warc-refers-to"), "http": block[:body], "payload": payload, "payload_bytes": None if payload is None else len(payload),
            "payload_digest": told if payload is None else digest(payload), "intact": payload is None or told is None or told == digest(payload)}


_ARC = pa.schema([
    *[(k, pa.string()) for k in ("record_id", "type", "url", "date", "ip", "mime")], ("cut", pa.bool_()), ("http", pa.binary()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), *[(k, pa.string()) for k in ("payload_digest", "block_digest", "http_digest")]])
_ARC_DDL = "record_id string, type string, url string, date string, ip string, mime string, cut boolean, http binary, payload binary, payload_bytes bigint, payload_digest string, block_digest string, http_digest string"
_WARC = pa.schema([
    *[(k, pa.string()) for k in ("record_id", "type", "url", "date", "refers_to")], ("http", pa.binary()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])
_WARC_DDL = "record_id string, type string, url string, date string, refers_to string, http binary, payload binary, payload_bytes bigint, payload_digest string, intact boolean"


def _read(spark: SparkSession, path: str, parse, schema: pa.Schema, ddl: str, bodies: bool) -> DataFrame:
    """The records of all files below ``path``; without ``bodies`` payloads are digested but not handed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, v) for batch in batches for f, v in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()))
        ahead = next(pieces, None)
        held, size = [], 0
        while ahead is not None:
            file = ahead[0]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == file:
                    value = ahead[1]
                    ahead = next(pieces, None)
                    yield value

            stream = Stream(own())
            for record in parse(stream, file):
                if not bodies:
                    record["payload"] = None
                held.append(record)
                size += len(record["payload"] or b"") + len(record["http"]) + 500
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            for _ in stream.pieces:  # what a parser left
                pass
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    name = F.col("_metadata.file_name").alias("file")
    value = F.col("value").cast("binary")
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(name, F.concat(value, F.lit(b"\n")).alias("value"))
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,warc,txt}").load(path).select(name, F.col("content").alias("value"))
    return lines.unionByName(whole).mapInArrow(run, ddl)


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """ARC records of both versions: identifier, type and dates as WARC has them, HTTP header and payload apart, digests."""
    return _read(spark, path, arc_records, _ARC, _ARC_DDL, bodies)


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """WARC records; a revisit has no payload, and the digest its header names. ``intact``: the payload has the digest its header names."""
    return _read(spark, path, warc_records, _WARC, _WARC_DDL, bodies)


def write_arc(records: DataFrame, path: str, url: str, http: str, payload: str, date: str, ip: str = "0.0.0.0", origin: str = "plumbline") -> None:
    """One ARC file a task, gzip; files of even number are of version 1, the others of version 2.

    ``url``, ``http`` and ``payload`` name columns: text, and the two parts of a response in bytes. White space and control
    characters of a URL are percent-encoded, a null or empty one is ``-``; a null part is empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name, at = 1 + part % 2, f"{origin}-{part:06d}.arc", 0

        def head(where: str, mime: str, status: int, block: bytes) -> bytes:
            more = f"{status} {digest(block)} - {at} {name} " if version == 2 else ""
            return f"{where} {ip} {date} {mime} {more}{len(block)}\n".encode() + block

        def written(rows: list[bytes]) -> pa.RecordBatch:
            nonlocal at
            at += sum(len(r) + 1 for r in rows)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

        about = f"{version} 0 {origin}\n{ARC_FIELDS[version]}\n".encode()
        first = True
        for batch in batches:
            rows = []
            if first:
                first = False
                yield written([head(f"filedesc://{name}", "text/plain", 200, about)])
            for u, h, p in zip(*(batch.column(k).to_pylist() for k in ("url", "http", "payload"))):
                where = re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u or "") or "-"
                rows.append(head(where, "text/html", 200, (h or b"") + (p or b"")))
                if sum(map(len, rows[-64:])) > BATCH_BYTES:
                    yield written(rows)
                    rows = []
            yield written(rows)

    made = picked(records, url=url, http=http, payload=payload).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_BREAK))).otherwise("")


def convert(spark: SparkSession, arc_path: str, warc_path: str, prefer: Column | None = None, min_bytes: int = REVISIT_BYTES) -> None:
    """Write the ARC files below ``arc_path`` as WARC 1.1, gzip.

    Responses with the same payload of ``min_bytes`` or more: the one with the greatest ``prefer`` (an expression over
    the columns of ``read_arc``; by default the date) stays a response, the others become revisits of it, without
    their payload. Equal and null ones are settled by the identifier. Repeated digests are counted before they are
    joined; the rows of a frequent one can be split by adaptive execution. Records cut short are marked as such.
    """
    prefer = F.col("date") if prefer is None else prefer
    responses = read_arc(spark, arc_path, bodies=False).filter((F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes))
    order = F.struct(prefer.isNotNull().alias("known"), prefer.alias("prefer"), "record_id", "url", "date")
    repeated = responses.groupBy(F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("long")).agg(
        F.count(F.lit(1)).alias("n"), F.max(order).alias("kept")).filter("n > 1").select("of", "long", "kept")
    repeated = cut_lineage(repeated, "repeated")
    records = read_arc(spark, arc_path)
    same = (F.col("payload_digest") == F.col("of")) & (F.col("payload_bytes") == F.col("long")) & (F.col("type") == "response")
    joined = records.join(repeated, same, "left")
    revisit = F.col("kept").isNotNull() & (F.col("kept.record_id") != F.col("record_id"))
    is_http = F.col("type") == "response"
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(f"WARC/1.1{_BREAK}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("type"))), _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("url"))),
        _line("WARC-Filename", F.when(F.col("type") == "warcinfo", F.regexp_replace("url", "^filedesc://", ""))), _line("WARC-IP-Address", F.col("ip")),
        _line("WARC-Profile", F.when(revisit, PROFILE)), _line("WARC-Refers-To", F.when(revisit, F.col("kept.record_id"))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("kept.url"))), _line("WARC-Refers-To-Date", F.when(revisit, F.col("kept.date"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("http_digest")).otherwise(F.coalesce("block_digest", "payload_digest")))),
        _line("WARC-Payload-Digest", F.when(F.col("type") != "warcinfo", F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        _line("WARC-Truncated", F.when(F.col("cut"), "unspecified")),
        _line("Content-Type", F.when(is_http, "application/http; msgtype=response").otherwise(F.col("mime"))),
        _line("Content-Length", (F.octet_length("http") + F.octet_length(body)).cast("string")), F.lit(_BREAK))
    value = F.concat(head.cast("binary"), F.col("http"), body).cast("string").alias("value")
    joined.select(value).write.option("lineSep", _BREAK * 2).option("compression", "gzip").text(warc_path)


_PAGE = "X-Page-Id"


def _page_id(http: Column) -> Column:
    return F.regexp_extract(http.cast("string"), rf"\r\n{_PAGE}: (-?[0-9]+)\r\n", 1).try_cast("bigint")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20200101000000", min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the WARC files.

    The pages go into ARC files, these are converted to WARC, and the WARC files are read again. A null html is an
    empty payload; a null id is never the greatest, and of equal greatest ids one row is the response; a page whose
    response has a null id refers to null. An empty table gives no rows; other columns don't matter.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    own = picked(pages, page_id=page_id, url=url, html=html)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    named = F.when(F.col("page_id").isNotNull(), F.concat(F.lit(f"{_PAGE}: "), F.col("page_id").cast("string"), F.lit(_BREAK))).otherwise("")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "), F.octet_length(body).cast("string"), F.lit(_BREAK),
        named, F.lit(_BREAK)).cast("binary")
    write_arc(own.select("url", http.alias("http"), body.alias("payload")), arc, "url", "http", "payload", date)
    convert(spark, arc, warc, _page_id(F.col("http")), min_bytes)
    remove(spark, arc)
    found = read_warc(spark, warc, bodies=False).filter(F.col("type").isin("response", "revisit"))
    found = cut_lineage(found.select("record_id", "type", "refers_to", _page_id(F.col("http")).alias("page_id"), "payload_bytes", "payload_digest"), "records")
    remove(spark, warc)
    kept = found.filter("type = 'response'").select(
        F.col("record_id").alias("kept_id"), F.col("page_id").alias("kept_page"), F.col("payload_bytes").alias("kept_bytes"))
    joined = found.join(kept, F.col("refers_to") == F.col("kept_id"), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "kept_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("kept_page").alias("refers_to"))
