"""WARC archives: writing, reading and segment reassembly.

Writing: a page becomes a ``response`` record whose HTTP body uses chunked framing;
bodies over ``SEGMENT_BYTES`` go on in ``continuation`` records.  Of pages with equal
payloads the one with the largest id is written in full, the others are ``revisit``
records that refer to it.  Records are written by Spark's own text writer (a record
ends in a newline, which is the writer's line end), gzip-compressed, to any store.

Reading: the text reader splits archives at the record mark; headers are parsed,
segments grouped by origin id and ordered by number, the total length verified, the
chunked framing decoded and the payload digest compared.  The chunk encoder cuts any
record mark inside a payload in two, so a payload cannot fake a record.

Payloads stay where they are: digests are grouped by themselves, and those that occur
more than once are looked up.  Rows are numbered when they are staged, and record ids are
made from that number, so that repeated rows have records of their own.

Defined cases: null html is an empty payload; equal rows of one id are all responses
(revisits refer to one of them); a null id counts as smaller than any other; texts have
no length limit; other columns are ignored; an empty table gives empty archives; missing,
repeated or short segments and digests that differ raise ``WarcError``.
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

from .common import Scratch, looked_up, prepare, text_or_empty

VERSION = b"WARC/1.1\r\n"
#: Record mark of the line reader.  It must not repeat its own beginning: the reader looks back no further than its buffer.
MARK = b"\n" + VERSION
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_SPACE = uuid.UUID("2f1b8d8e-6f0a-4f2e-9f43-5a7d4bb2c0de")


class WarcError(ValueError):
    """A record or a set of segments that does not hold together."""


def record_id(row: int, digest: str) -> str:
    """The id of the record of a staged row."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{row}/{digest}')}>"


def digest_column(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, from built-in functions."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _char_cut(payload: bytes, at: int) -> int:
    """The last cut at or before ``at`` that does not part a UTF-8 character."""
    low = at
    while low > 0 and low < len(payload) and payload[low] & 0xC0 == 0x80:
        low -= 1
    return low or at


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing; no chunk holds the whole record mark."""
    cuts = {0, len(payload)}
    for at in range(CHUNK_BYTES, len(payload), CHUNK_BYTES):
        cuts.add(_char_cut(payload, at))
    if b"WARC/1.1\r\n" in payload:
        cuts.update(m.start() + 4 for m in re.finditer(rb"WARC/1\.1\r\n", payload))
    marks = sorted(cuts)
    parts = []
    for a, b in zip(marks, marks[1:]):
        parts.append(b"%x\r\n%b\r\n" % (b - a, payload[a:b]))
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked framing (extensions and trailers are skipped)."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size missing")
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError as e:
            raise WarcError(f"chunk size {body[at:end]!r}") from e
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("chunk cut short")
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block)


def page_records(row: int, page: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, revisit: bool) -> Iterator[bytes]:
    """The records of a page; a revisit refers to the row ``revisits``."""
    own = record_id(row, digest)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    fields = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "" if page is None else page)]
    if revisit:
        extra = [
            ("WARC-Type", "revisit"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(revisits, digest)),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        yield _record(extra + fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = HTTP_HEAD + chunked(payload)
    kind = [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= SEGMENT_BYTES:
        yield _record(kind + fields, block)
        return
    cuts = [0]
    while cuts[-1] < len(block):
        at = cuts[-1] + SEGMENT_BYTES
        cuts.append(len(block) if at >= len(block) else max(cuts[-1] + 1, _char_cut(block, at)))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        if k == 1:
            yield _record([*kind, *fields, ("WARC-Segment-Number", 1)], block[a:b])
            continue
        last = [("WARC-Segment-Total-Length", len(block))] if b == len(block) else []
        part = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(row, f"{digest}/{k}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k)]
        yield _record(part + last, block[a:b])


def write_archives(pages: DataFrame, path: str, scratch: Scratch, page: str = "page_id", url: str = "url", source: str = "html") -> None:
    """Write the records of ``pages`` (page, url, html) to gzip archives under ``path``."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.encode(text_or_empty(source), "UTF-8").alias("payload"))
    rows = scratch.table(rows.withColumns({"digest": digest_column(F.col("payload")), "row": F.monotonically_increasing_id()}), "staged")
    lead = F.max(F.struct("page", "row")).alias("lead")  # nulls sort first
    copies = scratch.table(rows.groupBy("digest").agg(lead, F.count("*").alias("n")).where("n > 1"), "copies")
    joined = looked_up(rows, copies, ["digest"]).select(
        "row", "page", "url", "payload", "digest", F.col("lead.row").alias("revisits"), (F.col("lead").isNotNull() & ~F.col("page").eqNullSafe(F.col("lead.page"))).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r[:-1] for row in zip(*(c.to_pylist() for c in batch.columns)) for r in page_records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    joined.mapInArrow(run, "value string").write.option("compression", "gzip").text(path)
    scratch.drop("staged", "copies")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields (lower case) and the block of one record."""
    if data.startswith(VERSION):
        data = data[len(VERSION) :]
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("record without a block")
    fields = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("record without a length") from e
    if len(rest) < size:
        raise WarcError(f"block of {len(rest)} bytes, {size} announced")
    return fields, rest[:size]


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP block, its chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if re.search(rb"(?i)transfer-encoding:\s*chunked", head) else body


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its segments (number, total length or None, bytes)."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise WarcError(f"segments {[s[0] for s in segments]}")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] != len(block):
        raise WarcError(f"{len(block)} bytes in segments, {segments[-1][1]} announced")
    return block


_RECORD = "id string, type string, page long, refers string, digest string, segment long, total long, block binary"
_PAYLOAD = "id string, type string, page long, refers string, digest string, payload_bytes long"


def _verified(block: bytes, digest: str) -> int:
    payload = body_of(block)
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise WarcError("payload digest differs")
    return len(payload)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; ``segment`` is null where the record is whole."""
    prepare(spark)
    lines = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "type", "page", "refers", "digest", "segment", "total", "block"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                f, block = parse_record(data)
                number = lambda k, f=f: int(f[k]) if f.get(k) else None
                out.append((f.get("warc-segment-origin-id") or f["warc-record-id"], f["warc-type"], number("x-page-id"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:"), number("warc-segment-number"), number("warc-segment-total-length"), block))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return lines.mapInArrow(run, _RECORD)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives: id, type, page, refers, digest, payload_bytes (null for revisits).

    Only segmented records move: they are grouped by origin id.
    """
    records = read_records(spark, path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, digests, blocks = (batch.column(k).to_pylist() for k in (1, 4, 7))
            sizes = [None if k == "revisit" else _verified(b, d) for k, d, b in zip(kinds, digests, blocks)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sizes, pa.int64())], names=["id", "type", "page", "refers", "digest", "payload_bytes"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(4).to_pylist()
            sizes = [_verified(reassemble([(s["segment"], s["total"], s["block"]) for s in parts]), d) for parts, d in zip(batch.column(5).to_pylist(), digests)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sizes, pa.int64())], names=["id", "type", "page", "refers", "digest", "payload_bytes"])

    pages = records.where("segment is null").mapInArrow(whole, _PAYLOAD)
    first = F.col("segment") == 1
    grouped = (
        records.where("segment is not null")
        .groupBy("id")
        .agg(
            F.max(F.when(first, F.col("type"))).alias("type"),
            F.max(F.when(first, F.col("page"))).alias("page"),
            F.max(F.when(first, F.col("refers"))).alias("refers"),
            F.max(F.when(first, F.col("digest"))).alias("digest"),
            F.collect_list(F.struct("segment", "total", "block")).alias("parts"),
        )
        .mapInArrow(joined, _PAYLOAD)
    )
    return pages.unionByName(grouped)


def archive_round_trip(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write ``pages`` to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch.path("archives")
    write_archives(pages, path, scratch)
    found = scratch.table(read_pages(pages.sparkSession, path), "pages")
    scratch.drop("archives")
    revisits = found.where("type = 'revisit'")
    wanted = revisits.groupBy("refers").agg(F.count("*").alias("n"))
    originals = found.where("type = 'response'").select(F.col("id").alias("refers"), F.col("page").alias("rpage"), F.col("payload_bytes").alias("rbytes"))
    originals = scratch.table(wanted.join(originals, "refers"), "originals")
    revisits = looked_up(revisits, originals, ["refers"])
    columns = lambda size, to: [F.col("page").alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), to.alias("refers_to")]
    return (
        found.where("type = 'response'").select(*columns(F.col("payload_bytes"), F.lit(None).cast("long"))).unionByName(revisits.select(*columns(F.col("rbytes"), F.col("rpage"))))
    )
