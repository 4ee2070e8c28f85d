"""WARC archives: a writer with identical-payload revisits, and a reader that splits archives by byte ranges.

Writing. Every record is a gzip member of its own. Members go through Spark's text sink as rows of raw bytes, so files
are committed by Spark and may lie wherever Spark can write. A row ends in the line separator, a zero byte: it takes the
place of the member's own last byte, the highest byte of its length, which is zero up to 16 MiB. Longer members keep
theirs, and a zero byte stands between them and the next, as padding that the reader skips.

Reading. A task gets a byte range of a file. It looks for the gzip magic, decodes the header and the first bytes of each
candidate, and takes it for a member only if they are a WARC header; chance matches inside compressed data fail this. A
member belongs to the range in which it starts and is read to its end, over the range's end if need be.

A payload that doesn't compress may hold whole members, and a range may begin inside it. So ranges of longer files first
report how far the members that start in them reach. A member inside another ends before it, so the furthest reach of a
file's earlier ranges is where its true members go on: a task starts there, and no record comes from inside another one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import has_columns, new_path, stored

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string, digest_ok boolean, archive string, offset long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> bytes:
    """A header value: no line ends, which would end the field."""
    return " ".join(value.split()).encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    digest = digest_of(payload)
    # of an id's different payloads each has a name; rows that are wholly alike share one, as they are one record
    name = lambda i: f"<urn:page:{'' if i is None else i}:{digest}>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    fields = [
        (b"WARC-Type", kind.encode()),
        (b"WARC-Record-ID", name(page_id)),
        (b"WARC-Date", b"1970-01-01T00:00:00Z"),
        *([(b"WARC-Target-URI", _clean(url))] if url is not None else []),
        (b"WARC-Payload-Digest", b"sha1:" + digest.encode()),
        (b"WARC-Payload-Length", b"%d" % len(payload)),
        *([(b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"WARC-Refers-To", name(refers_to))] if kind == "revisit" else []),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"Content-Length", b"%d" % len(block)),
    ]
    head = b"WARC/1.1\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        out, held = [], 0
        for page_id, url, payload, refers in zip(*(b.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
            member = record(page_id.as_py(), url.as_py(), payload.as_py() or b"", "revisit" if refers.is_valid else "response", refers.as_py())
            out.append(member[:-1] if member[-1] == 0 else member)
            held += len(member)
            if held > SPLIT_BYTES:
                yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])
                out, held = [], 0
        yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes pages (page_id, url, payload binary) as an archive directory. Of equal payloads of at least `least` bytes, the record with the smallest page_id is the response and the others revisit it."""
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("sha", F.sha2("payload", 256))
    ids = rows.select("page_id", "sha", F.octet_length("payload").alias("n"))
    first = ids.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter((F.col("copies") > 1) & (F.col("n") >= least)).drop("copies")
    # narrow rows find the response; the payloads are then joined by page, never by payload, which may be one for all
    refers = ids.join(first, ["sha", "n"]).filter("page_id is null or page_id <> first").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("first").alias("refers_to")).distinct()
    joined = rows.join(refers, rows["page_id"].eqNullSafe(refers["p"]) & (rows["sha"] == refers["s"]), "left")
    members = joined.select("page_id", "url", "payload", "refers_to").mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").option("compression", "none").text(path)


class _Tail:
    """Reads a file onwards from a byte, in blocks; forgets what has been passed."""

    def __init__(self, file, at: int, size: int, block: int = 1 << 20):
        self.file, self.start, self.size, self.block = file, at, size, block
        self.data, self.end = b"", at

    def more(self) -> bool:
        got = self.file.read_at(min(self.block, self.size - self.end), self.end) if self.end < self.size else b""
        self.data += got
        self.end += len(got)
        return bool(got)

    def forget(self, upto: int) -> None:
        self.data, self.start = self.data[upto - self.start :], upto


def _begins(tail: _Tail, at: int) -> bool:
    """Whether the first bytes unpacked at byte at, which tail holds, are those of a WARC member."""
    try:
        return zlib.decompressobj(31).decompress(tail.data[at - tail.start :], 7) == b"WARC/1."
    except zlib.error:
        return False


def _member(tail: _Tail, at: int, strict: bool) -> tuple[bytes, int] | None:
    """(content, end) of the WARC member that starts at byte at; None if none does. One that is cut short or damaged behind its first bytes raises; if not strict, it is none, and so is one without a whole header and block."""
    unpack = zlib.decompressobj(31)
    out: list[bytes] = []
    known, pos = 0, at
    while not unpack.eof:
        piece = tail.data[pos - tail.start : pos - tail.start + tail.block]
        if not piece:
            if not tail.more():
                if strict and known == 7:
                    raise ValueError(f"the WARC member at byte {at} is cut short")
                return None
            continue
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            if strict and (known == 7 or _begins(tail, at)):
                raise ValueError(f"the WARC member at byte {at} is damaged: {e}") from e
            return None
        pos += len(piece)
        if known < 7:
            head = b"".join(out)[:7]
            known = len(head)
            if not b"WARC/1.".startswith(head):
                return None
    content = b"".join(out)
    if known < 7 or not (strict or _is_whole(content)):
        return None
    return content, pos - len(unpack.unused_data)


def _is_whole(content: bytes) -> bool:
    """Whether a record's header ends, tells its type and how long its block is, and the block is there."""
    head, end, block = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    length = fields.get(b"content-length", b"")
    return bool(end) and b"warc-type" in fields and length.isdigit() and int(length) <= len(block)


def members_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the members that start in bytes start up to end of the file, where no member is open at start."""
    return ((at, content) for at, content, _ in _walk(file, size, start, end, True))


def reach(file, size: int, start: int, end: int) -> int:
    """Where the furthest of the members ends that start in bytes start up to end of the file, which may lie inside one; 0 if none starts there."""
    return max((stop for _, _, stop in _walk(file, size, start, end, False)), default=0)


def _walk(file, size: int, start: int, end: int, strict: bool) -> Iterator[tuple[int, bytes, int]]:
    tail, at = _Tail(file, start, size), start
    while at < end:
        if at - tail.start > tail.block:
            tail.forget(at)
        found = tail.data.find(MAGIC, at - tail.start)
        if found < 0:
            at = max(at, tail.end - len(MAGIC) + 1)  # a magic may begin in the last bytes
            if not tail.more():
                return
            continue
        at = tail.start + found
        if at >= end:
            return
        member = _member(tail, at, strict)
        if member is None:
            at += 1
            continue
        yield at, *member
        at = member[1]


#: Ids of records that write() has made, with the page's number or nothing.
_OWN = re.compile(rb"<urn:page:(-?\d*):[A-Z2-7]{32}>")


def parse(content: bytes) -> dict:
    """The fields of a record of any type, with its payload; raises on a damaged one of write()'s own.

    What isn't stated is null. Records of HTTP messages have the message's body as payload, others their whole block, and a
    revisit none. A digest that isn't stated is computed; one in SHA-1 is checked, and digest_ok says how that went: in
    other archives bodies may be stored as they were transferred, and digests be those of something else.
    """
    head, _, block = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    text = lambda name: None if (v := fields.get(name)) is None else v.decode("utf-8", "replace")
    whole = lambda v: int(v) if v is not None and v.isdigit() else None
    own = lambda name: _OWN.fullmatch(fields.get(name, b""))
    number = lambda name: int(m[1]) if (m := own(name)) and m[1] else None
    length, kind = whole(fields.get(b"content-length")), text(b"warc-type") or "unknown"
    if length is not None and len(block) < length:
        raise ValueError(f"the block of {text(b'warc-record-id')} is cut short")
    block = block if length is None else block[:length]
    http = fields.get(b"content-type", b"").lower().startswith(b"application/http")
    payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2] if http else block
    name, _, stated = (text(b"warc-payload-digest") or "").partition(":")
    found = None if payload is None else digest_of(payload)
    ok = found == stated.upper() if found and name.lower() == "sha1" and len(stated) == 32 else None
    if ok is False and own(b"warc-record-id"):
        raise ValueError(f"payload of {text(b'warc-record-id')} doesn't have the digest {stated}")
    n = whole(fields.get(b"warc-payload-length")) if payload is None else len(payload)
    return {
        **{"page_id": number(b"warc-record-id"), "url": text(b"warc-target-uri"), "payload_bytes": n, "payload_digest": stated or found, "record_type": kind},
        **{"refers_to": number(b"warc-refers-to"), "payload": payload, "record_id": text(b"warc-record-id"), "refers_to_id": text(b"warc-refers-to"), "digest_ok": ok},
    }


#: Names that Hadoop has for file systems which pyarrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(path: str):
    """The file system and the path in it of a path as Spark lists it."""
    scheme, colon, rest = path.partition(":")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest) if colon else (pafs.LocalFileSystem(), path)


def _read(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload, "record_id", "refers_to_id", "digest_ok", "archive", "offset"]
    kinds = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_id": pa.string(), "digest_ok": pa.bool_(), "archive": pa.string()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names], names=names)

    def run(batches):
        for b in batches:
            for path, size, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "length", "start", "stop")), strict=True):
                system, inner = opened(path)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for offset, content in members_in(file, size, start, end):
                        rows.append(parse(content) | {"archive": path, "offset": offset})
                        held += len(content)
                        if held > SPLIT_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return run


def _reaches(batches):
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("path", "length", "start", "stop")]
        far = []
        for path, size, start, end in zip(*cols, strict=True):
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                far.append(reach(file, size, start, end))
        yield pa.record_batch([b.column("path"), b.column("start"), pa.array(far, pa.int64())], names=["path", "start", "reach"])


def _entered(ranges: DataFrame, total: int) -> DataFrame:
    """ranges with start moved to where the members that start in earlier ranges of the file end. Files of one range have nothing to ask; a row a range is shuffled, and no content."""
    asked = ranges.filter("stop < length").repartition(max(1, total)).mapInArrow(_reaches, "path string, start long, reach long")
    facts = stored(asked, "warc-reaches")
    before = F.max("reach").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    entries = ranges.join(facts, ["path", "start"], "left").withColumn("entry", F.coalesce(before, F.lit(0)))
    return entries.withColumn("start", F.greatest("start", "entry")).filter("start < stop or length = 0").select("path", "length", "start", "stop")


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of an archive directory or file, of any type and with any ids: see RECORD and parse. page_id and refers_to are those of archives that write() has made, null for others, whose ids are in record_id and refers_to_id. A revisit's payload is null, its length and digest are those of the full payload. The rows are the same for every split_bytes; files longer than that are decompressed twice. The path has to be on a file system that pyarrow opens as well: local, HDFS, S3 (also as s3a), GCS or Azure."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content isn't read
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + split_bytes, "length"))
    total = ranges.count()
    if total > files.count():
        ranges = _entered(ranges, total)
    schema = RECORD if with_payload else RECORD.replace(" payload binary,", "")
    return ranges.repartition(max(1, total)).mapInArrow(_read(with_payload), schema)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Writes pages (page_id, url, html) to an archive in the shared folder and reads it back.

    A null html is an empty payload; equal payloads, empty ones too, are stored once. A null page_id comes back null and
    is only referred to if all copies have none - then all are responses. Repeated page_ids keep their rows; rows with
    the smallest page_id of a payload are responses all. Payloads of any length are whole. Other columns are ignored; an
    empty table gives no rows.
    """
    has_columns(pages, ["page_id", "url", "html"])
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("payload")), path)
    return read(spark, path, split_bytes, with_payload)
