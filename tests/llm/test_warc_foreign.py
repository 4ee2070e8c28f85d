"""Archives that others have written: every record type, ids of any kind, digests of any kind or none, for every split size."""

import gzip
import random
import zlib

import pytest

from attestor.llm import warc


def member(kind, record_id, block, **fields):
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *((k.replace("_", "-"), v) for k, v in fields.items()), ("Content-Length", str(len(block)))]
    return gzip.compress(b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head if v is not None) + b"\r\n" + block + b"\r\n\r\n")


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
BODY = b"<p>hello</p>"
RECORDS = [
    member("warcinfo", "<urn:uuid:1>", b"software: x\r\n", Content_Type="application/warc-fields"),
    member("request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://a/"),
    member("response", "<urn:uuid:3>", HTTP + BODY, Content_Type="application/http; msgtype=response", WARC_Target_URI="http://a/", WARC_Payload_Digest="sha1:" + warc.digest_of(BODY)),
    member("response", "<urn:uuid:4>", HTTP + BODY, Content_Type="application/http", WARC_Payload_Digest="sha1:" + warc.digest_of(b"other")),
    member("response", "<urn:uuid:5>", HTTP + BODY, Content_Type="application/http", WARC_Payload_Digest="sha256:abc"),
    member("revisit", "<urn:uuid:6>", HTTP, Content_Type="application/http", WARC_Refers_To="<urn:uuid:3>", WARC_Payload_Digest="sha1:" + warc.digest_of(BODY)),
    member("metadata", "<urn:uuid:7>", b"a: b", Content_Type="text/plain"),
    member("resource", None, b"\x00\xff", Content_Type="image/png"),
]
WANT = [
    ("<urn:uuid:1>", "warcinfo", b"software: x\r\n", None, None),
    ("<urn:uuid:2>", "request", b"", None, None),
    ("<urn:uuid:3>", "response", BODY, True, None),
    ("<urn:uuid:4>", "response", BODY, False, None),
    ("<urn:uuid:5>", "response", BODY, None, None),
    ("<urn:uuid:6>", "revisit", None, None, "<urn:uuid:3>"),
    ("<urn:uuid:7>", "metadata", b"a: b", None, None),
    (None, "resource", b"\x00\xff", None, None),
]


@pytest.mark.parametrize("split", [64, 333, 1 << 20])
def test_every_record(spark, tmp_path, split):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(RECORDS))
    rows = warc.read(spark, str(tmp_path), split).orderBy("offset").collect()
    assert [(r.record_id, r.record_type, None if r.payload is None else bytes(r.payload), r.digest_ok, r.refers_to_id) for r in rows] == WANT
    assert {r.page_id for r in rows} == {None} and rows[2].payload_bytes == len(BODY) and rows[5].payload_bytes is None
    assert rows[6].payload_digest == warc.digest_of(b"a: b") and rows[4].payload_digest == "abc"


def test_own_records_are_checked():
    good = warc.record(7, "http://a/", BODY, "response", None)
    assert warc.parse(gzip.decompress(good))["page_id"] == 7
    with pytest.raises(ValueError, match="digest"):
        warc.parse(gzip.decompress(good).replace(b"hello", b"hallo"))
    with pytest.raises(ValueError, match="cut short"):
        warc.parse(gzip.decompress(good)[:-12])


def stored_member(record_id, block):
    """A member whose block isn't compressed, as those that don't compress are."""
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: {record_id}\r\nContent-Type: image/png\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def noise(n, seed):
    return random.Random(seed).randbytes(n)


NESTED = [
    *RECORDS[:2],
    stored_member("<a>", noise(700, 1) + b"".join(RECORDS[1:4]) + noise(700, 2) + RECORDS[6] + noise(900, 3)),
    RECORDS[2],
    # one that is cut by the packer's own blocks, one that is damaged, and an archive in an archive
    stored_member("<b>", noise(64_000, 4) + stored_member("<inner>", noise(5_000, 5) + RECORDS[3]) + noise(100, 6) + RECORDS[1][:-9] + noise(2_000, 7)),
    stored_member("<c>", stored_member("<d>", stored_member("<e>", noise(300, 8)) + noise(300, 9)) + noise(300, 10)),
    RECORDS[4],
]


@pytest.mark.parametrize("split", [250, 4096, 1 << 16, 1 << 24])
def test_no_record_from_inside_another(spark, tmp_path, split):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(NESTED))
    (tmp_path / "b.warc.gz").write_bytes(NESTED[2])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    rows = warc.read(spark, str(tmp_path), split).orderBy("archive", "offset").collect()
    assert [r.record_id for r in rows] == ["<urn:uuid:1>", "<urn:uuid:2>", "<a>", "<urn:uuid:3>", "<b>", "<c>", "<urn:uuid:5>", "<a>"]
    places = [sum(map(len, NESTED[:i])) for i in range(len(NESTED))]
    assert [r.offset for r in rows] == [*places, 0]


def test_damage_is_found_whatever_the_ranges(spark, tmp_path):
    data = bytearray(b"".join(NESTED[:4]))
    data[len(b"".join(NESTED[:2])) + 900] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    for split in (200, 1 << 20):
        with pytest.raises(Exception, match="damaged"):
            warc.read(spark, str(tmp_path), split).collect()
