"""Ogg as a media column: encoding samples, and a decoder that trusts nothing it has not checked.

The container holds two logical streams, interleaved page by page: raw unsigned 8-bit mono samples, and a data stream
that tells how many of their bytes are the document's own. The decoder verifies each page's checksum (and looks for the
next page where one fails), separates the streams by serial number, puts packets together from lacing values over
page ends, and gives every packet the times that the granule positions, which count samples, have for it. A stream starts
with a page marked as its first; a serial number that comes up again starts another stream. Chained files are links:
each link's first stream of samples counts, one after the other. A stream whose header isn't that of unsigned 8-bit mono
samples at a positive rate gives none and is counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestor.llm.common import has_columns, stored, text_bytes

RATE, UNIT, PACKET = 8000, 192, 3840
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD = struct.Struct("<4sBBqIIIB")
_AUDIO = struct.Struct(">8sHHIIBBHI")
_DATA = struct.Struct("<8sQQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
FEATURES = "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, packet_seconds array<double>, bad_pages long, bad_headers long, payload binary"


def checksum(page: bytes) -> int:
    """The container's CRC (polynomial 04c11db7, most significant bit first, no inversion) by zlib's, which goes the other way about."""
    other = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(other.to_bytes(4, "little").translate(_REVERSED), "big")


def padded(text: bytes) -> bytes:
    """With spaces up to a positive multiple of UNIT."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = struct.pack("<I", checksum(bytes(page)))
    return bytes(page)


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule, page) for packets with their granule positions. The first packet has a page of its own; the others fill pages to 255 segments, so packets run over page ends."""
    out, number = [], 0
    for at_end, group in ((not packets[1:], packets[:1]), (True, packets[1:])):
        lacing, body, done, flags = bytearray(), bytearray(), -1, FIRST if not number else 0
        for i, (packet, granule) in enumerate(group):
            sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
            at = 0
            for j, size in enumerate(sizes):
                if len(lacing) == 255:
                    out.append((done, _page(flags, done, serial, number, bytes(lacing), bytes(body))))
                    number, lacing, body, done = number + 1, bytearray(), bytearray(), -1
                    flags = CONTINUED if j else 0
                lacing.append(size)
                body += packet[at : at + size]
                at += size
            done = granule
            if i == len(group) - 1:
                last = LAST if at_end else 0
                out.append((done, _page(flags | last, done, serial, number, bytes(lacing), bytes(body))))
                number += 1
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The file for a payload of 8-bit samples, of which the first n_bytes are the document's. Equal input, equal file."""
    serial = zlib.crc32(payload, n_bytes & 0xFFFFFFFF)
    head = _AUDIO.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    audio = [(head, 0), *((payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET))]
    data = [(b"ATTRDATA", 0), (_DATA.pack(b"EXTENT  ", n_bytes, len(payload)), 0)]
    sound, facts = pages_of(serial, audio), pages_of(serial ^ 0x5A5A5A5A, data)
    return b"".join(p for _, p in [sound[0], facts[0], facts[1], *sound[1:]])


@dataclass
class Stream:
    serial: int = 0
    link: int = 0
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)
    granule: int = 0
    expected: int = 0
    open: bytearray | None = None
    ended: bool = False
    pages: int = 0
    lost: int = 0

    def times(self, length: Callable[[bytes], int], rate: float) -> list[float | None]:
        """The second at which each packet starts. A page's granule position is where its last whole packet ends; the packets before it end where the next starts, length telling how long one is. Without a position they have none."""
        out, after = [], None
        for packet, end in zip(reversed(self.packets), reversed(self.ends), strict=True):
            after = end if end is not None else after
            after = None if after is None else after - length(packet)
            out.append(None if after is None else after / rate)
        return out[::-1]


@dataclass
class Media:
    streams: list[Stream]
    bad_pages: int

    def _headed(self, magic: bytes) -> list[Stream]:
        return [s for s in self.streams if s.packets and s.packets[0].startswith(magic)]

    @property
    def sounds(self) -> list[Sound]:
        """The samples' streams, the first of each link."""
        first: dict[int, Sound] = {}
        for s in self._headed(b"PCM     "):
            if (x := Sound.of(s)) is not None:
                first.setdefault(s.link, x)
        return list(first.values())

    @property
    def bad_headers(self) -> int:
        """Streams that are named as ours and whose headers can't be read."""
        return sum(Sound.of(s) is None for s in self._headed(b"PCM     ")) + sum(_extent(s) is None for s in self._headed(b"ATTRDATA"))

    @property
    def samples(self) -> bytes:
        return b"".join(p for x in self.sounds for p in x.packets)

    @property
    def seconds(self) -> float:
        return sum((x.seconds for x in self.sounds), 0.0)

    @property
    def packet_seconds(self) -> list[float | None]:
        """When each packet of samples starts, counted from the first link's start."""
        out, before = [], 0.0
        for x in self.sounds:
            out += [None if t is None else before + t for t in x.times]
            before += x.seconds
        return out

    @property
    def n_bytes(self) -> int | None:
        """The documents' own bytes, over all links that tell; None if none does."""
        first: dict[int, int] = {}
        for s in self._headed(b"ATTRDATA"):
            if (n := _extent(s)) is not None:
                first.setdefault(s.link, n)
        return sum(first.values()) if first else None


@dataclass
class Sound:
    """A stream of samples behind its headers."""

    stream: Stream
    rate: int
    headers: int

    @classmethod
    def of(cls, s: Stream) -> Sound | None:
        if len(s.packets[0]) != _AUDIO.size:
            return None
        _, _, _, kind, rate, bits, channels, _, extra = _AUDIO.unpack(s.packets[0])
        return cls(s, rate, 1 + extra) if (kind, bits, channels) == (1, 8, 1) and rate > 0 else None

    @property
    def packets(self) -> list[bytes]:
        return self.stream.packets[self.headers :]

    @property
    def seconds(self) -> float:
        return self.stream.granule / self.rate

    @property
    def times(self) -> list[float | None]:
        return self.stream.times(len, self.rate)[self.headers :]


def _extent(s: Stream) -> int | None:
    """The number of bytes that a data stream gives; None if it doesn't. One beyond 63 bits is none."""
    if len(s.packets) < 2 or len(s.packets[1]) != _DATA.size:
        return None
    name, n, _ = _DATA.unpack(s.packets[1])
    return n if name == b"EXTENT  " and n < 1 << 62 else None


def decode(media: bytes) -> Media:
    """All logical streams in order of their first pages, chained ones too. A page with a wrong checksum or cut short is left out and counted; packets it had a part of are dropped."""
    streams: list[Stream] = []
    now: dict[int, Stream] = {}
    at, bad, link, heading = 0, 0, 0, True
    while True:
        at = media.find(b"OggS", at)
        if at < 0 or at + _HEAD.size > len(media):
            bad += at >= 0
            return Media(streams, bad)
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        body = at + _HEAD.size + count
        lacing = media[at + _HEAD.size : body]
        end = body + sum(lacing)
        if version or len(lacing) < count or end > len(media) or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4
            continue
        first = bool(flags & FIRST)
        if first and streams and (not heading or (serial in now and now[serial].link == link)):
            link += 1  # first pages of a link stand together; one behind other pages, or of a stream that is there, begins the next
        heading = first
        if first or serial not in now:
            now[serial] = Stream(serial, link)
            streams.append(now[serial])
        s = now[serial]
        s.pages += 1
        if number != s.expected:
            s.open, s.lost = None, s.lost + 1
        s.expected = number + 1
        part = s.open if flags & CONTINUED else bytearray()  # None: its beginning is lost
        done = len(s.packets)
        for size in lacing:
            if part is not None:
                part += media[body : body + size]
            body += size
            if size < 255:
                if part is not None:
                    s.packets.append(bytes(part))
                part = bytearray()
        s.open = part if lacing and lacing[-1] == 255 else None
        s.ends += [None] * (len(s.packets) - done)
        if granule >= 0:
            s.granule = granule
            if len(s.packets) > done:
                s.ends[-1] = granule
        s.ended |= bool(flags & LAST)
        at = end


def features(m: Media) -> str:
    """Facts of the container and of the signal, as text."""
    x = np.frombuffer(m.samples, np.uint8).astype(np.float64)
    mean = x.mean() if len(x) else 0.0
    rms = float(np.sqrt(((x - mean) ** 2).mean())) if len(x) else 0.0
    crossings = int(np.count_nonzero(np.diff(np.signbit(x - mean)))) if len(x) else 0
    peak = int(x.max()) if len(x) else 0
    return f"streams={len(m.streams)};pages={sum(s.pages for s in m.streams)};packets={sum(len(s.packets) for s in m.streams)};seconds={m.seconds:.6f};mean={mean:.6f};rms={rms:.6f};peak={peak};crossings={crossings}"


def _encoded(batches):
    for b in batches:
        texts = [x or b"" for x in b.column("bytes").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), pa.array([encode(padded(t), len(t)) for t in texts], pa.binary())], names=["doc_id", "media"])


def _decoded(with_payload: bool):
    def run(batches):
        for b in batches:
            rows = []
            for media in b.column("media"):
                data = media.as_py()
                if data is None:
                    rows.append((None,) * 12)
                    continue
                m = decode(data)
                p = m.samples
                rows.append((m.n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(m), m.seconds, m.packet_seconds, m.bad_pages, m.bad_headers, p))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 12
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "packet_seconds", "bad_pages", "bad_headers", "payload"][: 11 + with_payload]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols[: len(names)], kinds, strict=False))], names=["doc_id", *names])

    return run


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media, the Ogg file of each whole text, however long. Null is as empty; other columns are ignored; repeated rows and null ids keep theirs; an empty table gives no rows."""
    has_columns(docs, ["doc_id", "text"])
    return docs.select("doc_id", text_bytes().alias("bytes")).mapInArrow(_encoded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def media_facts(media: DataFrame, with_payload: bool = False) -> DataFrame:
    """What a media column (doc_id, media) holds, from its bytes alone. A null file gives nulls, an empty one no samples; damaged pages are counted in bad_pages, streams with unreadable headers in bad_headers; of chained files all samples are given and n_bytes is their sum; packet_seconds has the start of each packet of samples, null where no position tells it."""
    has_columns(media, ["doc_id", "media"])
    schema = FEATURES.format(kind=media.schema["doc_id"].dataType.simpleString())
    return media.select("doc_id", "media").mapInArrow(_decoded(with_payload), schema if with_payload else schema.removesuffix(", payload binary"))


def round_trip(docs: DataFrame) -> DataFrame:
    """The texts stored as a media table in the shared folder, read back and described."""
    return media_facts(stored(media_column(docs), "media"))
