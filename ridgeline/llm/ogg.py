"""Byte payloads stored in and read back from Ogg containers."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import utf8

RATE = 8000  # samples a second
PACKET = 4096  # samples of a packet
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class Corrupt(ValueError):
    """The bytes are no valid Ogg file."""


def checksum(page: bytes) -> int:
    """The container's CRC-32 (polynomial 04C11DB7, most significant bit first, no inversion), by the reflected CRC of flipped bytes."""
    reflected = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + checksum(page).to_bytes(4, "little") + page[26:]


def stream_pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream of (packet, granule position) pairs; the first packet has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), [], -1, FIRST

    def flush(last: bool, then: int) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(_page(flags | (LAST if last else 0), granule, serial, len(pages), bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], -1, then

    for i, (packet, position) in enumerate(packets):
        sizes = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = done = 0
        while at < len(sizes):
            if len(lacing) == 255:
                flush(False, CONTINUED if at else 0)
            part = sizes[at : at + 255 - len(lacing)]
            n = sum(part)
            lacing += part
            body.append(packet[done : done + n])
            at, done = at + len(part), done + n
        granule = position
        if i == 0 and len(packets) > 1:
            flush(False, 0)
    flush(True, 0)
    return pages


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A file of two logical streams, its pages dealt in turn: the payload as 8-bit samples, and notes on its true length.

    Serial numbers derive from the payload, so equal payloads give equal files.
    """
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    samples = [(b"\x01pcm8\0" + struct.pack("<IQ", RATE, len(payload)), 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    a, b = stream_pages(samples, serial), stream_pages([(b"\x01note\0", 0), (b"bytes=%d" % n_bytes, len(payload))], serial | 1)
    return b"".join([a[0], b[0], *(p for pair in zip(a[1:], b[1:]) for p in pair), *a[len(b) :], *b[len(a) :]])


@dataclass
class Stream:
    """A logical stream: whole packets, and the time in microseconds at which each page that ends a packet ends."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    next_page: int = 0
    ended: bool = False

    def times(self, rate: int) -> list[int]:
        return [g * 1_000_000 // rate for g in self.granules]


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams of a file by serial number. Checksums, page order and continuations are verified; Corrupt otherwise."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise Corrupt("a page header is cut off")
        capture, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if capture != b"OggS" or version:
            raise Corrupt("no page starts where one should")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise Corrupt("a page is cut off")
        if checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) != crc:
            raise Corrupt("a page's checksum is wrong")
        if bool(flags & FIRST) != (serial not in streams):
            raise Corrupt("a stream has two first pages or none")
        s = streams.setdefault(serial, Stream())
        if s.ended or number != s.next_page or bool(flags & CONTINUED) != bool(s.open):
            raise Corrupt("a page is missing or repeated")
        s.next_page, s.ended = number + 1, bool(flags & LAST)
        place, size = at + 27 + n, 0
        for x in lacing:
            size += x
            if x < 255:
                s.packets.append(b"".join((*s.open, data[place : place + size])) if s.open else data[place : place + size])
                s.open, place, size = [], place + size, 0
        if size or (n and lacing[-1] == 255):
            s.open.append(data[place : place + size])
        if granule != -1:
            s.granules.append(granule)
        at = end
    if not streams or any(not s.ended or s.open for s in streams.values()):
        raise Corrupt("a stream doesn't end")
    return streams


def decode(data: bytes) -> tuple[bytes, int, dict]:
    """(payload, its unpadded length, features) of a file of encode."""
    streams = demultiplex(data)
    of = {s.packets[0][:6]: s for s in streams.values()}
    if of.keys() != {b"\x01pcm8\0", b"\x01note\0"}:
        raise Corrupt("not the two streams that are stored here")
    samples, notes = of[b"\x01pcm8\0"], of[b"\x01note\0"]
    rate, total = struct.unpack_from("<IQ", samples.packets[0], 6)
    payload = b"".join(samples.packets[1:])
    if len(payload) != total or samples.granules[-1] != total:
        raise Corrupt("samples are missing")
    wave = np.frombuffer(payload, np.uint8)
    counts = np.bincount(wave, minlength=256)
    got = {"streams": len(streams), "pages": sum(s.next_page for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()), "rate": rate, "end_us": samples.times(rate)[-1], "mean": f"{counts @ np.arange(256) / total:.6f}", "peak": int(wave.max()), "levels": int((counts > 0).sum())}
    return payload, int(notes.packets[1].partition(b"=")[2]), got


def media_column(docs: DataFrame, block: int = 64) -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes (null: none), zeros appended up to a positive multiple of block, as an Ogg file."""

    def run(batches):
        for b in batches:
            yield from _in_parts(b.column("doc_id"), b.column("text").to_pylist(), lambda ids, media: [ids, pa.array(media, pa.binary())], ["doc_id", "media"], lambda t: encode(t + bytes(-len(t) % block or (0 if t else block)), len(t)), len)

    return docs.select(F.col("doc_id").cast("long"), utf8().alias("text")).mapInArrow(run, "doc_id long, media binary")


def _in_parts(ids, items, made, names, each, weight, most: int = 32_000_000):
    """Record batches of the results of each item, a new one whenever they weigh most bytes."""
    done, out, size = 0, [], 0
    for i, x in enumerate(items):
        out.append(each(x))
        size += weight(out[-1])
        if size >= most or i == len(items) - 1:
            yield pa.RecordBatch.from_arrays(made(ids.slice(done, len(out)), out), names)
            done, out, size = i + 1, [], 0


def media_features(media: DataFrame) -> DataFrame:
    """What each file of a media column holds: n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 payload bytes),
    media_bytes, media_sha256, feature and error. A file that fails verification, or a null one, gets its error and nulls."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (*[None] * 7, "no media")
        try:
            payload, n, features = decode(data)
        except Corrupt as e:
            return (None, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, str(e))
        return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), ";".join(f"{k}={v}" for k, v in features.items()), None)

    def run(batches):
        for b in batches:
            cols = list(zip(*map(row, b.column("media").to_pylist()), strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
