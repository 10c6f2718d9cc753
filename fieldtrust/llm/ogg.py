"""Media columns in Ogg containers: texts stored as 8-bit samples and read back.

The writer lays packets out as lacing values and checksummed pages of several
logical streams. The reader verifies each page's checksum, reassembles packets
(also over page borders), demultiplexes the streams by serial number and
derives each packet's time from the granule positions.

Edge cases: null text is empty; an empty text is one block of padding; a page
whose checksum fails is skipped and the packet it broke is dropped, as are
bytes between pages; very long texts are many pages; equal texts give equal
containers; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldtrust.llm.common import blocks, lean, text_bytes

#: Samples in a packet, samples a second, serial numbers of the two streams.
BLOCK, RATE, AUDIO, NOTES = 576, 8000, 1, 2
HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC (polynomial 0x04c11db7, most significant bit first,
    from 0). Bits mirrored, that is zlib's CRC without its inversions."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return b"".join((whole[:22], checksum(whole).to_bytes(4, "little"), whole[26:]))


def stream_pages(serial: int, header: bytes, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of a logical stream: the header packet alone on the first page,
    then 255 lacing values a page; packets may go on over page borders."""
    out = [page(2, 0, serial, 0, b"\xff" * (len(header) // 255) + bytes([len(header) % 255]), header)]
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body, at, done, going = b"".join(packets), 0, 0, False
    for i in range(0, max(1, len(lacing)), 255):
        part = lacing[i : i + 255]
        size, ended = sum(part), len(part) - part.count(255)
        done += ended
        kind = going + 4 * (i + 255 >= len(lacing))
        out.append(page(kind, granules[done - 1] if ended else -1, serial, len(out), part, body[at : at + size]))
        at, going = at + size, part[-1:] == b"\xff"
    return out


def multiplex(streams: list[list[bytes]]) -> bytes:
    """First pages first, then the streams' pages in turn."""
    rest = [s[1:] for s in streams]
    turns = max(map(len, rest), default=0)
    return b"".join([s[0] for s in streams] + [s[i] for i in range(turns) for s in rest if i < len(s)])


@dataclass
class Stream:
    header: bytes = b""
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which the packet ended
    pages: int = 0
    part: bytes | None = None  # of a packet that goes on

    def times(self, rate: int = RATE) -> list[int]:
        """Start of each packet in microseconds. A page's granule position is
        the end of its last packet; the packets before it count back."""
        out: list[int] = []
        end = None
        for i in range(len(self.packets) - 1, -1, -1):
            if i == len(self.packets) - 1 or self.granules[i] != self.granules[i + 1]:
                end = self.granules[i]
            end -= len(self.packets[i])
            out.append(end * 1_000_000 // rate)
        return out[::-1]


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int]:
    """Streams by serial number, and the number of damaged pages."""
    streams: dict[int, Stream] = {}
    at, damaged = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + HEAD.size > len(data):
            damaged += 1
            break
        _, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        whole = data[at:end]
        if version or len(lacing) < n or len(whole) < end - at or checksum(b"".join((whole[:22], b"\0\0\0\0", whole[26:]))) != crc:
            damaged += 1
            at += 4
            continue
        s = streams.setdefault(serial, Stream())
        if number != s.pages:  # a page is missing: the open packet can't be completed
            s.part = None
        s.pages = number + 1
        pos, start, skip = at + HEAD.size + n, at + HEAD.size + n, bool(kind & 1) and s.part is None
        begun = s.part if kind & 1 and s.part is not None else b""
        for value in lacing:
            pos += value
            if value < 255:
                packet = begun + data[start:pos]
                if skip:
                    pass
                elif kind & 2 and not s.header:
                    s.header = packet
                else:
                    s.packets.append(packet)
                    s.granules.append(granule)
                begun, start, skip = b"", pos, False
        s.part = (None if skip else begun + data[start:pos]) if lacing[-1:] == b"\xff" else None
        at = end
    return streams, damaged


def store(text: bytes) -> bytes:
    """A text as a container: audio samples and, in a second stream, notes."""
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    samples = text + b"\xff" * (size - len(text))
    packets = [samples[i : i + BLOCK] for i in range(0, size, BLOCK)]
    notes = json.dumps({"n_bytes": len(text)}).encode()
    return multiplex(
        [
            stream_pages(AUDIO, struct.pack("<8sIHH", b"PCM-U8\0\0", RATE, 1, BLOCK), packets, list(range(BLOCK, size + 1, BLOCK))),
            stream_pages(NOTES, b"NOTES\0\0\0", [notes], [size]),
        ]
    )


def noted(notes: Stream | None) -> int | None:
    """The unpadded length that the notes state, none if they can't be read."""
    try:
        stated = json.loads(notes.packets[0])["n_bytes"] if notes and notes.packets else None
    except (ValueError, KeyError, TypeError):
        return None
    return stated if isinstance(stated, int) else None


def load(media: bytes | None) -> tuple[bytes | None, int | None, str | None]:
    """(payload, unpadded length, features) of a stored container: all null for
    null, no payload where the audio stream's header or all of its packets are
    lost, no length where the notes are."""
    if media is None:
        return None, None, None
    streams, damaged = demultiplex(media)
    audio, notes = streams.get(AUDIO), streams.get(NOTES)
    n = noted(notes)
    rate = int.from_bytes(audio.header[8:12], "little") if audio and len(audio.header) >= 12 else 0
    if not rate or not any(audio.packets):
        return None, n, f"streams={len(streams)};damaged={damaged}"
    payload, times = b"".join(audio.packets), audio.times(rate)
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    feature = (
        f"streams={len(streams)};pages={audio.pages + (notes.pages if notes else 0)};damaged={damaged};packets={len(audio.packets)};samples={len(x)}"
        f";last_start_us={times[-1]};duration_us={audio.granules[-1] * 1_000_000 // RATE}"
        f";mean={x.sum() / len(x):.4f};rms={(np.dot(x, x) / len(x)) ** 0.5:.4f};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))}"
    )
    return payload, n, feature


def to_media(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media binary): one container for each text."""
    kind = documents.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(map(store, text_bytes(b.column(text))), pa.binary())], [key, "media"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, media binary")


def from_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, payload binary, n_bytes, feature): containers read back."""
    kind = media.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "media"):
            got = list(map(load, b.column("media").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())], [key, "payload", "n_bytes", "feature"])

    return media.select(key, "media").mapInArrow(run, f"{key} {kind}, payload binary, n_bytes bigint, feature string")


def media_digest(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``from_media(to_media(documents))`` as digests, without sending the
    bytes through Arrow twice. A narrow map."""
    kind = documents.schema[key].dataType.simpleString()
    fields = ["n_bytes bigint", "payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "media_bytes bigint", "media_sha256 string", "feature string"]

    def digest(text: bytes) -> tuple:
        media = store(text)
        payload, n, feature = load(media)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            columns = zip(*map(digest, text_bytes(b.column(text))), strict=True)
            arrays = [pa.array(c, pa.string() if f.endswith("string") else pa.int64()) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), *arrays], [key, *(f.split()[0] for f in fields)])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, {', '.join(fields)}")
