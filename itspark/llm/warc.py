"""Legacy archives (ARC) converted to WARC.

An ARC file begins with a version block that names the fields of its records' header lines; a record is a
header line, a body of the declared length, and a newline. Version 1 has five fields (URL, IP
address, 14-digit date, type, length), version 2 ten, with a status code, checksum, location, offset and
file name. The converter reads the header by its version, takes as many bytes as declared, and makes the
WARC record that says the same: a record id from the URL, the date, the payload's digest and the place in the
archive (so that a task run again writes the same, and no two captures share one), the date in ISO form, the
type, and SHA-256 digests of block and payload. What is an HTTP message becomes a response; anything else, such
as a ``dns:`` record, a resource of its own content type. Of responses with equal payloads of at least
``MIN_PAYLOAD`` bytes the first one (by page id where there is one, else by date and URL) stays, the others
become revisits, which keep the HTTP header and refer to it.

Files are read and written through Spark's own readers and writers, plain or gzipped, with one member for all
records or one each. A task unzips a file as it goes on and hands records on by ``HELD_BYTES``; it holds the
file as it is stored, which Spark's reader bounds at 2 GB. Records are put on the text writer as one value each,
their bytes as they are, ended by the two line breaks that end a WARC record; a file has at most ``RECORDS``.

Cases: a null payload is empty; a null URL becomes ``urn:none`` and comes back as null; white space in a URL
is percent-coded in the ARC line, and read as part of the URL where an archive has it; payloads may be any
bytes; heads may end their lines with or without a carriage return and need not name a length; rows with equal
ids and equal payloads are all responses if the id is the smallest; a null id sorts last; a revisit of a
record that is in none of the given files has no ``refers_to``; empty tables give empty archives and no rows.
An archive that ends inside a record or a member, or is none, is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.llm.common import staged

MIN_PAYLOAD = 100
RECORDS = 2000
#: Bytes of records that a task holds before it hands them on, and that it unzips at once.
HELD_BYTES, STEP = 32 << 20, 1 << 20
EPOCH = "20240101000000"
#: The header fields that versions 1 and 2 of the format declare.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {size}\r\nX-Page-Id: {page}\r\n\r\n"
RECORD_END = "\r\n\r\n"
PAGES = (
    "page_id long, url string, date string, ip string, kind string, http boolean, head_bytes int, block binary, "
    "payload_digest string, payload_bytes long, record_id string"
)


def to_arc(pages: DataFrame, path: str, version: int) -> None:
    """Write pages (page_id, url, html) as ARC files of a version, one version block per file and record group.

    Each file's records follow their own version block, as in archives that were put together from several.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                values.append(arc_record(version, page, url, html or ""))
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(work, "value string")
    rows.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", RECORDS).text(path)


def version_block(version: int) -> str:
    body = f"{version} 0 itspark\n{FIELDS[version]}\n"
    line = f"filedesc://pages.arc 0.0.0.0 {EPOCH} text/plain"
    return f"{line} {len(body)}\n{body}" if version == 1 else f"{line} 200 - - 0 pages.arc {len(body)}\n{body}"


def arc_record(version: int, page: int | None, url: str | None, html: str) -> str:
    """A record with its version block before it, so that a file may be cut anywhere between records."""
    body = HTTP.format(kind="text/html", size=len(html.encode()), page="" if page is None else page) + html
    place = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "urn:none"
    size = len(body.encode())
    fields = [place, "0.0.0.0", EPOCH, "text/html"]
    if version == 2:
        fields += ["200", "-", "-", "0", "pages.arc"]
    return f"{version_block(version)}\n{' '.join([*fields, str(size)])}\n{body}"


class _Stream:
    """Lines and stretches of bytes that come in chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = iter(chunks), b"", 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held, self.at = self.held[self.at :] + chunk, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its break; None at the end."""
        seen = self.at
        while (end := self.held.find(b"\n", seen)) < 0:
            waiting = len(self.held) - self.at
            if not self._more():
                if not waiting:
                    return None
                end = len(self.held)
                break
            seen = self.at + waiting
        out, self.at = self.held[self.at : end], end + 1
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts, missing = [], n
        while missing:
            part = self.held[self.at : self.at + missing]
            self.at += len(part)
            missing -= len(part)
            parts.append(part)
            if missing and not self._more():
                raise ValueError("archive ends inside a record")
        return b"".join(parts)


def _chunks(content: bytes) -> Iterator[bytes]:
    """All gzip members of a file, of which archives have one a record; a file that is not zipped as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest:
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            chunk = member.decompress(rest, STEP)
            rest = member.unconsumed_tail
            if not chunk and not member.eof and not rest:
                raise ValueError("archive ends inside a gzip member")
            yield chunk
        # Members may be padded with zeros.
        rest = member.unused_data.lstrip(b"\0")


def _unzipped(content: bytes) -> bytes:
    return b"".join(_chunks(content))


def parse_arc(chunks: Iterator[bytes] | bytes) -> Iterator[dict[str, bytes]]:
    """Records of an ARC file: header fields by name, and the body. A version block changes the fields.

    Fields are counted from the end of the line, since old archives have spaces in URLs.
    """
    stream = _Stream([chunks] if isinstance(chunks, bytes) else chunks)
    names: list[str] | None = None
    while (line := stream.line()) is not None:
        if not line:
            continue
        try:
            size = int(line.rpartition(b" ")[2])
        except ValueError:
            raise ValueError("record does not have the fields that its version block names") from None
        body = stream.take(size)
        if line.startswith(b"filedesc:"):
            names = body.split(b"\n")[1].decode().rstrip("\r").split(" ")
            continue
        values = line.rsplit(b" ", len(names) - 1) if names else []
        date = values[names.index("Archive-date")] if names and len(values) == len(names) else b""
        if not date.isdigit() or not 8 <= len(date) <= 14:
            raise ValueError("record does not have the fields that its version block names")
        yield dict(zip(names, values)) | {"body": body}


def head_size(block: bytes) -> int:
    """Bytes of an HTTP message before its payload, with lines that end in either way; all of one without payload."""
    ends = [at + len(end) for end in (b"\r\n\r\n", b"\n\n") if (at := block.find(end)) >= 0]
    return min(ends, default=len(block))


def http_fields(head: bytes) -> dict[bytes, bytes]:
    """Header fields, names in lower case."""
    lines = (line.rstrip(b"\r").partition(b":") for line in head.split(b"\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in lines if colon}


def _whole(value: bytes | None) -> int | None:
    """A whole number that fits a long, or None."""
    try:
        number = int(value) if value else None
    except ValueError:
        return None
    return number if number is not None and -(2**63) <= number < 2**63 else None


def _iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, place: str) -> str:
    """A version-8 UUID of the capture and its place in the archives."""
    h = hashlib.sha256("\n".join((url, date, digest, place)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-{8 + int(h[16], 16) % 4:x}{h[17:20]}-{h[20:32]}>"


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > HELD_BYTES or len(held) >= RECORDS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def read_arc(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Records of ARC files, with the digest and size of each payload."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for number, record in enumerate(parse_arc(_chunks(content.as_py()))):
                    block = record["body"]
                    url, date = record["URL"].decode("utf-8", "replace"), _iso(record["Archive-date"].decode())
                    http = block.startswith(b"HTTP/")
                    head = head_size(block) if http else 0
                    digest = hashlib.sha256(memoryview(block)[head:]).hexdigest()
                    page = _whole(http_fields(block[:head]).get(b"x-page-id")) if http else None
                    kind = record["Content-type"].decode("utf-8", "replace")
                    name = record_id(url, date, digest, f"{path.as_py()} {number}")
                    yield (page, url, date, record["IP-address"].decode("utf-8", "replace"), kind, http, head, block, digest, len(block) - head, name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(records(batches), PAGES)

    return _files(spark, [paths] if isinstance(paths, str) else list(paths)).mapInArrow(work, PAGES)


def warc_record(row: dict) -> bytes:
    """A response, a resource, or a revisit without payload where there is a ``first_id``."""
    revisit = row["first_id"] is not None
    block = row["block"][: row["head_bytes"]] if revisit else row["block"]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response" if row["http"] else "resource"),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["url"]),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", "sha256:" + row["payload_digest"]),
        ("Content-Type", "application/http; msgtype=response" if row["http"] else row["kind"]),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[2:2] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", row["first_id"]),
        ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def convert(spark: SparkSession, arc_paths: list[str], path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """ARC files to WARC files."""
    pages = read_arc(spark, arc_paths)
    # The first of each payload that several records have; of a hot payload one row a task is shuffled.
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "date", "url", "record_id")
    groups = pages.filter(F.col("http") & (F.col("payload_bytes") >= min_payload)).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = staged(groups.filter("n > 1").select(F.col("payload_digest").alias("shared"), "first"), "payloads")
    joined = pages.join(shared, F.col("http") & (F.col("payload_digest") == F.col("shared")), "left")
    # Where the first has a page id, records with the same one are responses too, and those without come later.
    later = F.coalesce(F.col("page_id") > F.col("first.page_id"), F.lit(True))
    later = F.when(F.col("first.none"), F.struct("date", "url") > F.struct("first.date", "first.url")).otherwise(later)
    joined = joined.withColumn("first_id", F.when(F.col("first").isNotNull() & later, F.col("first.record_id"))).drop("first", "shared")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(((warc_record({c: batch.column(c)[k].as_py() for c in batch.schema.names}),) for k in range(batch.num_rows)), "value binary")

    # A string that is made from bytes has these bytes, and the text writer writes them.
    values = joined.mapInArrow(work, "value binary").select(F.col("value").cast("string"))
    values.write.option("compression", "gzip").option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS).text(path)


def parse_warc(chunks: Iterator[bytes] | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record; blocks are as long as declared."""
    stream = _Stream([chunks] if isinstance(chunks, bytes) else chunks)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if "content-length" not in fields:
            raise ValueError("archive ends inside a record")
        yield fields, stream.take(int(fields["content-length"]))


PARSED = "page_id long, url string, date string, record_type string, payload_digest string, payload_bytes long, payload binary, record_id string, refers_to_id string"


def read_warc(spark: SparkSession, path: str, body: bool = True) -> DataFrame:
    """page_id, url, date, record_type, refers_to, payload_digest, payload_bytes, payload of the responses, revisits
    and resources in WARC files; SHA-256 digests are checked. A revisit has no payload; its size and the page it
    refers to are those of the record that has it, or else what its own header says."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column("content"):
                for fields, block in parse_warc(_chunks(content.as_py())):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    http = kind != "resource" and block.startswith(b"HTTP/")
                    head = head_size(block) if http else 0
                    said = http_fields(block[:head]) if http else {}
                    named, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
                    size = _whole(said.get(b"content-length"))
                    if kind != "revisit":
                        found, size = hashlib.sha256(memoryview(block)[head:]).hexdigest(), len(block) - head
                        if named == "sha256" and found != digest:
                            raise ValueError("payload does not fit its digest")
                        digest = found
                    url = fields.get("warc-target-uri", "urn:none")
                    payload = block[head:] if body and kind != "revisit" else None
                    yield (
                        _whole(said.get(b"x-page-id")), None if url == "urn:none" else unquote(url), fields.get("warc-date"), kind, digest, size, payload,
                        fields.get("warc-record-id"), fields.get("warc-refers-to"),
                    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(records(batches), PARSED)

    parsed = staged(_files(spark, [path]).mapInArrow(work, PARSED), "parsed")
    revisits, others = parsed.filter("record_type = 'revisit'"), parsed.filter("record_type != 'revisit'")
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    known = others.select("record_id", "page_id", "payload_bytes").join(wanted, "record_id", "left_semi")
    known = known.groupBy(F.col("record_id").alias("known_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("known_bytes"))
    found = revisits.join(staged(known, "known"), F.col("refers_to_id") == F.col("known_id"), "left")
    columns = ("page_id", "url", "date", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    found = found.withColumn("payload_bytes", F.coalesce("known_bytes", "payload_bytes")).select(*columns)
    return others.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionAll(found)
