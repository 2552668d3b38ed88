"""Ogg media columns: write bytes as packets of two logical streams, and read such files back.

A payload is cut into packets of ``PACKET`` 8-bit samples that go in turn to two logical streams,
whose pages are interleaved in one physical stream. The reader verifies every page's checksum,
reassembles packets from lacing values (also over page ends), demultiplexes the streams by their
serial numbers, and derives each packet's end time from its page's granule position. Merging the
streams by time gives the payload back.

Defined results: a null text is stored as an empty one; equal texts give equal bytes; repeated rows
are stored each; ids may be null; other columns are ignored; texts of any length are stored whole. A damaged page raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.common import id_text, map_batches, written

PACKET = 576
RATE = 8000
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Identifies this library's streams: name, version, channels, rate.
IDENT = struct.Struct("<8sHHI")
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, most significant bit first, no inversion.

    It is zlib's CRC of the bit-reversed bytes with both inversions undone, read backwards.
    """
    crc = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing)
    head[22:26] = checksum(bytes(head) + body).to_bytes(4, "little")
    return bytes(head) + body


def stream_pages(serial: int, packets: list[bytes], page_segments: int) -> Iterator[tuple[int, bytes]]:
    """(time, page) of one logical stream; a granule position counts the stream's samples so far."""
    yield -1, page(FIRST, 0, serial, 0, bytes([IDENT.size]), IDENT.pack(b"colloquy", 1, 1, RATE))
    lacing, whole = bytearray(), b"".join(packets)
    for packet in packets:
        lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
    at = time = 0
    starts = range(0, max(1, len(lacing)), page_segments)
    for number, a in enumerate(starts, 1):
        part = bytes(lacing[a : a + page_segments])
        size = sum(part)
        ends = [at + sum(part[: i + 1]) for i in range(len(part) - 1, -1, -1) if part[i] < 255][:1]
        time = ends[0] if ends else time
        kind = (CONTINUED if a and lacing[a - 1] == 255 else 0) | (LAST if a == starts[-1] else 0)
        yield time, page(kind, time if ends or not part else -1, serial, number, part, whole[at : at + size])
        at += size


def write_ogg(payload: bytes, page_segments: int = 250) -> bytes:
    """A physical stream whose two logical streams take the payload's packets in turn."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    pages = [(time, serial, k, data) for serial in (1, 2) for k, (time, data) in enumerate(stream_pages(serial, packets[serial - 1 :: 2], page_segments))]
    return b"".join(p[3] for p in sorted(pages, key=lambda p: p[:3]))


@dataclass
class LogicalStream:
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of each packet.
    ends: list[int] = field(default_factory=list)
    pages: int = 0
    continued: int = 0
    closed: bool = False
    _partial: list[bytes] = field(default_factory=list)
    _untimed: int = 0

    def add(self, kind: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        if number != self.pages or self.closed or bool(kind & CONTINUED) != bool(self._partial):
            raise ValueError("pages of a logical stream are missing or out of order")
        self.pages, self.closed = self.pages + 1, bool(kind & LAST)
        self.continued += bool(kind & CONTINUED)
        at = 0
        for size in lacing:
            self._partial.append(bytes(body[at : at + size]))
            at += size
            if size < 255:
                self.packets.append(b"".join(self._partial))
                self._partial = []
                self._untimed += 1
        if self._untimed and granule >= 0:
            # the page's position is the end of its last packet; the others end where the next one starts
            ends = [granule]
            for packet in reversed(self.packets[len(self.packets) - self._untimed + 1 :]):
                ends.append(ends[-1] - len(packet))
            self.ends += reversed(ends)
            self._untimed = 0


def read_ogg(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams of a physical stream, by serial number."""
    streams: dict[int, LogicalStream] = {}
    view, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("the last page is cut off")
        mark, version, kind, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        lacing = bytes(view[at + HEADER.size : at + HEADER.size + segments])
        body_at = at + HEADER.size + segments
        end = body_at + sum(lacing)
        if mark != b"OggS" or version or end > len(data):
            raise ValueError(f"no whole page at byte {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            raise ValueError(f"the page at byte {at} has a wrong checksum")
        if kind & FIRST:
            streams[serial] = LogicalStream()
        elif serial not in streams:
            raise ValueError("a stream has no first page")
        streams[serial].add(kind, granule, number, lacing, view[body_at:end])
        at = end
    return streams


def payload_of(streams: dict[int, LogicalStream]) -> bytes:
    """The payload: all packets but the headers, by start time and then by stream."""
    timed = [(end - len(packet), serial, packet) for serial, s in streams.items() for end, packet in zip(s.ends[1:], s.packets[1:], strict=True)]
    return b"".join(x[2] for x in sorted(timed, key=lambda x: x[:2]))


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % PACKET or (0 if raw else PACKET))


def store_ogg(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", page_segments: int = 250) -> DataFrame:
    """Each text as an Ogg file: doc_id, n_bytes, media."""

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        media = [write_ogg(padded(t), page_segments) for t in texts]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(id_text(docs, id_col, text_col), store, "doc_id long, n_bytes long, media binary", rows=256)


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of stored files (doc_id, n_bytes, media)."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, streams int, pages int, packets int, duration_ms double"

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch["media"].to_pylist():
            streams = read_ogg(data)
            payload = payload_of(streams)
            pages, packets = sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values())
            last, over = sum(s.ends[-1] for s in streams.values()), sum(s.continued for s in streams.values())
            feature = f"streams={len(streams)};pages={pages};packets={packets};continued={over};samples={last};ms={last * 1000 // RATE}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(streams), pages, packets, last * 1000 / RATE))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], [f.split()[0] for f in fields.split(", ")])

    return map_batches(media, measure, fields, rows=256)


def ogg_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", page_segments: int = 250, at_rest: bool = True) -> DataFrame:
    """Store every text, read the stored bytes back, and compute features.

    With ``at_rest`` the files are written to the shared folder in between; without it they pass
    from one operator to the next.
    """
    media = store_ogg(docs, id_col=id_col, text_col=text_col, page_segments=page_segments)
    return read_media(written(media, "media") if at_rest else media)
