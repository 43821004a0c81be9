"""WARC archives: a writer with revisits, and a reader that salvages what damaged files still hold.

Writing: a page's payload is its html. Of equal payloads of at least LEAST bytes the page with the largest id is a response, the others
are revisits of it and hold no payload. Records are gzip members of their own (or plain), put together in blocks of about BLOCK bytes,
each after a warcinfo record, and BLOCKS of them make a file, so that a reader's task holds a bounded file. Files are written by Spark's
text writer, whose commit survives lost executors and whose line end here is an empty gzip member (or a record's end).

Reading: a file is read member by member, or version line by version line. Every record is checked: the member's checksum, the
header, its length against the record's end, the digests of block and payload. Where a check fails, the reader looks for the next
valid member or version line and goes on from there; the bytes between are a gap, which is logged with its place and the reason. A record
whose frame is whole but whose digest is wrong is a gap by itself, so what its payload holds is never read as a record.

Null html: empty payload, a response. Null url: one made from the id. Null id: never the response of a group that has ids; where none of
a group has one, all are responses. Rows with the largest id of their group are all responses; a revisit's refers_to is that id. Repeated
rows are a record each. Very long payloads are a block by themselves. An empty table gives an archive without records. Control
characters and blanks in urls are percent-encoded. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned_up, join_counted, scratch_root

#: Payloads of fewer bytes are never revisited.
LEAST = 1000
#: Bytes of a block, and blocks of a file.
BLOCK, BLOCKS = 8 << 20, 8
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the formats.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
#: A gzip member that holds nothing.
NOTHING = bytes.fromhex("1f8b08000000000000ff") + b"\x03\x00" + bytes(8)
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields that every record has.
NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_PAGE_ID = "X-Page-ID"
_FIRST_LINE = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]\r\n")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    """Bare lower-case hexadecimal of a labelled base-32 or hexadecimal digest."""
    value = digest.split(":", 1)[-1]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def record_id(page_id: int | None, payload_key: bytes) -> str:
    """The same for the same page and payload, so that a revisit knows its response's, and a second run gives the same bytes."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'%s/%s' % (str(page_id).encode(), payload_key)).digest()[:16], version=5)}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + END


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, key: bytes, target: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or, where there is a target, a revisit without."""
    fields = [("WARC-Type", "response" if target is None else "revisit"), ("WARC-Record-ID", record_id(page_id, key)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", _sha1(payload)), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        fields.append((_PAGE_ID, str(page_id)))
    if target is not None:
        fields += [("WARC-Refers-To", record_id(target, key)), ("WARC-Profile", SAME_PAYLOAD)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record(fields, http + (payload if target is None else b""))


def _info(date: str) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, b"info")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_targets(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, key (SHA-256 of a payload that may be shared, else null), and for revisits target, the id of the response."""
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    large = rows.where(F.octet_length("payload") >= least).withColumn("key", F.unhex(F.sha2("payload", 256)))
    # Ids and counts combine before the shuffle: a payload of very many pages is a row a task.
    groups = large.groupBy("key").agg(F.max("page_id").alias("target"), F.count("*").alias("rows")).where("rows > 1 and target is not null")
    found = join_counted(large, groups, "key", "rows", "left").withColumn("target", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")))
    small = rows.where(F.octet_length("payload") < least).select("*", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("target"))
    return found.unionByName(small)


def write_warc(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", least: int = LEAST, gzipped: bool = True, date: str = DATE, block: int = BLOCK, blocks: int = BLOCKS) -> None:
    """Write the pages' archive into a new folder."""
    rows = with_targets(pages, id_col, url_col, html_col, least).select("page_id", "url", "payload", "key", "target")

    def pack(batches) -> Iterator[pa.RecordBatch]:
        done = _member if gzipped else bytes
        head = done(_info(date))
        held, size = [], 0

        def out() -> pa.RecordBatch:
            # The writer's line end follows: an empty member, or the end of the last record.
            data = b"".join([head, *held])
            return pa.RecordBatch.from_arrays([pa.array([data if gzipped else data[: -len(END)]], pa.binary())], names=["block"])

        for batch in batches:
            ids, urls, payloads, keys, targets = batch.columns
            for page_id, url, payload, key, target in zip(ids.to_pylist(), urls.to_pylist(), payloads, keys.to_pylist(), targets.to_pylist()):
                payload = payload.as_py()
                held.append(done(page_record(page_id, url, payload, key if key is not None else hashlib.sha256(payload).digest(), target, date)))
                size += len(held[-1])
                if size >= block:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    end = NOTHING if gzipped else END
    lines = rows.mapInArrow(pack, "block binary").select(F.col("block").cast("string").alias("value"))
    with cleaned_up(pages.sparkSession):
        lines.write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("maxRecordsPerFile", blocks).option("compression", "none").text(folder)


# Reading.


class Record(NamedTuple):
    fields: dict[str, str]
    block: bytes


class Bad(Exception):
    """A failed check; end is where the record ends, if its frame is whole."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def _record_at(data: bytes, at: int) -> tuple[Record, int]:
    """The checked record that begins here, and where it ends."""
    first = _FIRST_LINE.match(data, at)
    if not first:
        raise Bad("version")
    # A header without fields would end with the version line's own end.
    head = data.find(END, first.end() - 2)
    if head < 0:
        raise Bad("header")
    fields = {}
    for line in data[first.end() : head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or not NEEDED <= fields.keys():
        raise Bad("header")
    begin, end = head + len(END), head + len(END) + int(length)
    if data[end : end + len(END)] != END:
        raise Bad("length")
    record, end = Record(fields, data[begin:end]), end + len(END)
    said = fields.get("warc-block-digest", "")
    if said.lower().startswith("sha1:") and _hex_or_none(said) != hashlib.sha1(record.block).hexdigest():
        raise Bad("digest", end)
    if fields.get("warc-type", "").lower() == "response" and (said := fields.get("warc-payload-digest", "")).lower().startswith("sha1:") and _hex_or_none(said) != hashlib.sha1(payload_of(record)).hexdigest():
        raise Bad("digest", end)
    return record, end


def _hex_or_none(digest: str) -> str | None:
    try:
        return _hex(digest)
    except ValueError:
        return None


def payload_of(record: Record) -> bytes:
    """What follows the HTTP head, or the whole block where there is none."""
    if not record.fields.get("content-type", "").lower().startswith("application/http"):
        return record.block
    return record.block.partition(END)[2]


def _member_at(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member that begins here, its checksum verified, and where it ends."""
    unpack = zlib.decompressobj(31)
    parts, step = [], 1 << 20
    try:
        for k in range(at, len(data), step):
            parts.append(unpack.decompress(data[k : k + step]))
            if unpack.eof:
                return b"".join(parts), min(k + step, len(data)) - len(unpack.unused_data)
    except zlib.error:
        raise Bad("member") from None
    raise Bad("member")


def salvage(data: bytes) -> Iterator[tuple]:
    """All of a file: ("record", start, end, Record), and ("gap", start, end, reason) for the bytes that no valid record covers.

    Places of records in a gzip member are the member's. Gaps within a member are those of its content, its place before them in the reason.
    """
    view = memoryview(data)
    at, gap, why = 0, None, ""
    while at < len(data):
        end = None
        try:
            if data.startswith(MAGIC, at):
                content, end = _member_at(view, at)
                found = [(*x[:3], f"{x[3]} in member at {at}") if x[0] == "gap" else ("record", at, end, x[3]) for x in _plain(content)]
            else:
                own, end = _record_at(data, at)
                found = [("record", at, end, own)]
        except Bad as e:
            # A whole frame is passed over; else the next member or version line that holds is looked for.
            following = e.end
            if following is None:
                start = _START.search(data, at + 1)
                following = start.start() if start else len(data)
            if gap is None:
                gap, why = at, e.reason
            at = following
            continue
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield "gap", gap, len(data), why


def _plain(content: bytes) -> Iterator[tuple]:
    """The same of a member's content, which has no members itself."""
    at, gap, why = 0, None, ""
    while at < len(content):
        try:
            own, end = _record_at(content, at)
        except Bad as e:
            if gap is None:
                gap, why = at, e.reason
            start = _FIRST_LINE.search(content, at + 1) if e.end is None else None
            at = e.end if e.end is not None else start.start() if start else len(content)
            continue
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        yield "record", at, end, own
        at = end
    if gap is not None:
        yield "gap", gap, len(content), why


_FOUND = "kind string, file string, start long, stop long, reason string, type string, record_id string, refers_to_id string, page_id long, url string, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
#: A reader's task gives its rows away after so many bytes of payloads.
FLUSH = 8 << 20


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record but warcinfo, and one for each gap; kind says which. A file is read by one task, and held by it.

    Records: type, record_id, refers_to_id, page_id, url, payload_bytes and payload_digest (bare hexadecimal SHA-1; of a revisit that of the
    payload it refers to, its payload_bytes null) and payload. Gaps: file, start, stop, reason. See whole() for the revisits' payloads.
    """

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for kind, start, stop, what in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((kind, file, start, stop, what, *[None] * 8))
                    elif (own := _row(what, payloads)) is not None:
                        rows.append((kind, file, start, stop, None, *own))
                        size += len(own[-1] or b"") + 500
                    if size >= FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(read, _FOUND)


def _row(record: Record, payloads: bool) -> tuple | None:
    f = record.fields
    kind = f.get("warc-type", "").lower()
    if kind == "warcinfo":
        return None
    page = f.get(_PAGE_ID.lower(), "")
    payload = None if kind == "revisit" else payload_of(record)
    digest = _hex_or_none(f.get("warc-payload-digest", "")) if payload is None else hashlib.sha1(payload).hexdigest()
    return (kind, f.get("warc-record-id"), f.get("warc-refers-to"), int(page) if re.fullmatch(r"-?\d{1,19}", page) else None, f.get("warc-target-uri"), None if payload is None else len(payload), digest, payload if payloads else None)


def gaps(found: DataFrame) -> DataFrame:
    """The quarantined bytes."""
    return found.where("kind = 'gap'").select("file", "start", "stop", "reason")


def whole(found: DataFrame) -> DataFrame:
    """Records with what their revisits refer to: refers_to is the response's page_id, payload_bytes and payload are the response's.

    A revisit whose response was lost keeps nulls there.
    """
    records = found.where("kind = 'record'").drop("kind", "reason")
    revisits = records.where("type = 'revisit'")
    wanted = revisits.groupBy(F.col("refers_to_id").alias("to_id")).agg(F.count("*").alias("rows"))
    there = records.where("type = 'response'").select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"), F.col("payload").alias("to_payload"))
    # Responses with one record id are equal.
    targets = there.join(wanted, "to_id").dropDuplicates(["to_id"])
    joined = join_counted(revisits.withColumn("to_id", F.col("refers_to_id")), targets, "to_id", "rows", "left")
    same = F.col("to_digest") == F.col("payload_digest")
    resolved = joined.select(*(F.when(same, F.col("to_" + c[len("payload_") :] if c != "payload" else "to_payload")).alias(c) if c in ("payload", "payload_bytes") else F.col(c) for c in records.columns), F.when(same, F.col("refers_to")).alias("refers_to"))
    return records.where("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(resolved)


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
