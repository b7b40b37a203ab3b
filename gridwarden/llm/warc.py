"""WARC archives: writing captures, reading records, and assembling them into transactions.

`write_archives` writes three records a page: the response, a request and a metadata record, both
naming the response as concurrent. Pages with equal payloads of at least `least_bytes` are told
apart first: the page with the smallest id becomes the response, the others revisits that refer
to it and hold the HTTP header alone. The files are gzip-compressed WARC/1.1, written by Spark's
text writer with the blank line that ends a record as its separator, so they lie in whatever
store Spark writes to. `read_records` reads such files, or archives made elsewhere: gzip files are
not split, so a task sees the bytes of a file in order and cuts records by their lengths, holding
one record at a time. `assemble` joins the records of a capture through their concurrent-to
identifiers, in either direction, into one nested row; `resolve` follows revisits to the capture
that holds their payload.

Hot keys: payloads, or captures referred to, that make up a thousandth of all rows are at most a
thousand and are joined by broadcast; all others meet in a shuffle. Requests and metadata are
reduced by capture before they are shuffled, so a capture named by very many records has one row.

Defined results: null html counts as empty. A null page id comes after all others. Of equal
payloads every row with the smallest id is a response. Rows that repeat id, url and payload have
equal identifiers; each stays a capture of its own. Line breaks in urls are written as %0D and
%0A; a null url has no field. Of several requests or metadata records of a capture the one with
the smallest identifier is nested and `n` tells how many there are; records whose capture is
missing are left to `read_records`. A damaged record, or an uncompressed file that Spark splits,
raises an error. An empty table gives archives without records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm.common import join_split_hot
from gridwarden.session import written

END = b"\r\n\r\n"
BATCH_BYTES = 8 << 20
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, "
    "target_uri string, warc_date string, fields map<string,string>, "
    "payload binary, payload_bytes long, payload_digest string"
)
ARROW_SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "warc_date")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
       ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _urn(kind: str, *parts: Column) -> Column:
    """A record identifier that is the same whenever the same row is written."""
    known = [F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts]
    h = F.md5(F.concat_ws("\x00", F.lit(kind), *known))
    groups = [F.substring(h, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _record(header: list[tuple[str, Column]], block: Column) -> Column:
    """The bytes of one record up to the blank line that ends it; null fields are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")) for name, value in header]
    lines = [F.coalesce(line, F.lit("")) for line in lines]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n").cast("binary"), *[x.cast("binary") for x in (*lines, length)], block)


def _with_first(pages: DataFrame, least_bytes: int) -> DataFrame:
    """id, url, html, size, digest, and `first` (struct id, url) of the page that equal payloads refer to."""
    rows = pages.withColumns(
        {"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)}
    )
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.coalesce("url", F.lit("")).alias("u"), "url")
    repeats = written(
        rows.where(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.count("*").alias("weight"), F.min(order).alias("first"))
        .where("weight > 1")
        .select("digest", "weight", F.struct("first.id", "first.url").alias("first")),
        "warc-repeats",
    )
    return join_split_hot(rows, repeats, "digest", "weight")


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Three records a page, next to each other, into gzip-compressed files below `path`."""
    rows = _with_first(
        pages.select(
            F.col(f"`{id_col}`").alias("id"),
            F.regexp_replace(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
            F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("html"),
        ),
        least_bytes,
    )
    me = [F.col("id"), F.col("url"), F.col("digest")]
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), F.lit("\r\n\r\n"),
    ).cast("binary")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    capture = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", _urn("capture", *me)),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(revisit, _urn("capture", F.col("first.id"), F.col("first.url"), F.col("digest")))),
            ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first.url"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, "html")),
    )
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    beside = [("WARC-Concurrent-To", _urn("capture", *me)), *common]
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn("request", *me)), *beside,
         ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")).cast("binary"),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn("metadata", *me)), *beside,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")).cast("binary"),
    )
    (
        rows.select(F.explode(F.array(capture, request, metadata)).alias("record"))
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END.decode()).option("compression", "gzip").text(path)
    )


def _fields(block: bytes) -> dict[str, str]:
    """Names in lower case; a name that repeats keeps its first value."""
    found = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return found


class _Stream:
    """Cuts the bytes of one archive into records, as they arrive."""

    def __init__(self, path: str | None):
        self.path, self.buffer, self.need, self.begun = path, bytearray(), 0, False

    def feed(self, pieces: list[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
        if self.begun:
            self.buffer += END
        self.begun = True
        self.buffer += END.join(pieces)
        at = 0
        while len(self.buffer) - at >= self.need:
            while self.buffer[at : at + 2] == b"\r\n":
                at += 2
            stop = self.buffer.find(END, at)
            if stop < 0:
                self.need = 0
                break
            first, _, rest = bytes(self.buffer[at:stop]).partition(b"\r\n")
            header = _fields(rest)
            size = header.get("content-length", "")
            if not first.startswith(b"WARC/1.") or not (size.isascii() and size.isdigit()):
                raise ValueError(f"no WARC record where one must begin, in {self.path}")
            start = stop + len(END)
            if len(self.buffer) < start + int(size):
                self.need = start + int(size) - at
                break
            yield header, bytes(self.buffer[start : start + int(size)])
            at, self.need = start + int(size), 0
        del self.buffer[:at]

    def close(self) -> None:
        if bytes(self.buffer).strip(b"\r\n"):
            raise ValueError(f"the last record is cut off in {self.path}")


def _row(header: dict[str, str], block: bytes) -> dict:
    kind = header.get("warc-type")
    payload = block
    if header.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        payload = block.partition(END)[2]
    fields = _fields(block) if header.get("content-type", "").lower().startswith("application/warc-fields") else {}
    return {
        "record_id": header.get("warc-record-id"),
        "record_type": kind,
        "concurrent_to": header.get("warc-concurrent-to"),
        "refers_to": header.get("warc-refers-to"),
        "target_uri": header.get("warc-target-uri"),
        "warc_date": header.get("warc-date"),
        "fields": list(fields.items()),
        "payload": payload,
        "payload_bytes": len(payload),
        "payload_digest": hashlib.sha256(payload).hexdigest(),
    }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream, rows, held = _Stream(None), [], 0
    for batch in batches:
        paths, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if any(batch.column(2).to_pylist()):
            raise ValueError("an uncompressed archive is larger than a split; compress it with gzip")
        start = 0
        while start < len(paths):
            stop = start + 1
            while stop < len(paths) and paths[stop] == paths[start]:
                stop += 1
            if paths[start] != stream.path:
                stream.close()
                stream = _Stream(paths[start])
            for header, block in stream.feed(values[start:stop]):
                rows.append(_row(header, block))
                held += len(block)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                    rows, held = [], 0
            start = stop
    stream.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record. Payload: the HTTP body of HTTP records, else the block."""
    pieces = spark.read.option("lineSep", END.decode()).text(path)
    return pieces.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ).mapInArrow(_parse, RECORD_SCHEMA)


def _beside(records: DataFrame, kind: str, links: DataFrame) -> DataFrame:
    """capture_id, and one struct for all records of a kind that belong to it."""
    rows = records.where(F.col("record_type") == kind).select("record_id", "concurrent_to", "fields")
    found = rows.join(links, rows.record_id == links.other_id, "left").select(
        F.coalesce("concurrent_to", "linked").alias("capture_id"), "record_id", "fields"
    )
    return (
        found.where("capture_id IS NOT NULL")
        .groupBy("capture_id")
        .agg(F.min("record_id").alias("record_id"), F.min_by("fields", "record_id").alias("fields"), F.count("*").alias("n"))
        .select("capture_id", F.struct("record_id", "fields", "n").alias(kind))
    )


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: record_id, record_type, refers_to, target_uri, warc_date, payload,
    payload_bytes, payload_digest, and the structs request and metadata (null if missing)."""
    captures = records.where("record_type IN ('response', 'revisit', 'resource', 'conversion')")
    links = (
        captures.where("concurrent_to IS NOT NULL")
        .groupBy(F.col("concurrent_to").alias("other_id"))
        .agg(F.min("record_id").alias("linked"))
    )
    nested = captures.drop("concurrent_to", "fields").withColumn("capture_id", F.col("record_id"))
    for kind in ("request", "metadata"):
        nested = nested.join(_beside(records, kind, links), "capture_id", "left")
    return nested.drop("capture_id")


def resolve(captures: DataFrame, *about: str) -> DataFrame:
    """Every capture with `original`: a struct of payload_bytes, payload_digest and the columns
    `about` of the capture that a revisit refers to; null for others or if that is missing."""
    named = (
        captures.where("record_type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("weight"))
    )
    found = captures.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to"),
        F.struct("payload_bytes", "payload_digest", *about).alias("original"),
    )
    targets = written(named.join(found, "refers_to").dropDuplicates(["refers_to"]), "warc-originals")
    rest = captures.where("record_type <> 'revisit'").withColumn(
        "original", F.lit(None).cast(targets.schema["original"].dataType)
    )
    revisits = captures.where("record_type = 'revisit'")
    return join_split_hot(revisits, targets, "refers_to", "weight").unionByName(rest)
