"""Ogg media columns (operator 2).

A payload is cut into blocks of samples, dealt in turn over two logical streams as packets, and multiplexed page by page
into one physical Ogg stream: page headers with checksums, lacing values and granule positions.  A page carries several
packets, and packets go on over pages.  Reading verifies each page's checksum and sequence number, reassembles packets
from lacing values, demultiplexes the streams, derives each packet's time from granule positions (a page has that of the
last packet that ends on it; those before end as many samples earlier) and puts the samples in order of time.

Defined cases: null text counts as empty, whose payload is 64 zero bytes; damaged, truncated or missing pages raise
OggError with the place; equal texts give equal bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices


#: Fixed values of the container format: page header layout, flags, and the largest lacing value and number of segments.
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
FULL, MOST_SEGMENTS = 255, 255
#: Our sample format: one channel of unsigned 8-bit samples; a block is one packet.
MAGIC, RATE, BLOCK, STREAMS = b"PCM-U8\0\0", 8000, 4096, 2
#: Segments of a page that we write.
PAGE_SEGMENTS = 32

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """What is wrong with a physical stream, and where."""


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, from 0: zlib's over mirrored bits."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    return bytes([FULL]) * (size // FULL) + bytes([size % FULL])


def pages_of(packets: list[tuple[bytes, int]], serial: int, number: int = 0, flags: int = 0, most: int = MOST_SEGMENTS) -> list[bytes]:
    """The pages that carry packets, each with the granule position of its end; a page on which none ends has -1.  FIRST and LAST in flags go to the first and the last page."""
    values, ends, out, at = b"", {}, [], 0
    for packet, granule in packets:
        values += lacing(len(packet))
        ends[len(values) - 1] = granule
    data = b"".join(p for p, _ in packets)
    for first in range(0, len(values), most):
        part = values[first : first + most]
        granule = next((ends[k] for k in range(first + len(part) - 1, first - 1, -1) if k in ends), -1)
        kind = (CONTINUED if first and first - 1 not in ends else 0) | (flags & FIRST if not first else 0) | (flags & LAST if first + most >= len(values) else 0)
        body = data[at : at + sum(part)]
        at += len(body)
        page = HEADER.pack(b"OggS", 0, kind, granule, serial, number + len(out), 0, len(part)) + part + body
        out.append(page[:22] + checksum(page).to_bytes(4, "little") + page[26:])
    return out


def encode(payload: bytes) -> bytes:
    """One physical stream with the payload's blocks dealt over the logical streams; a granule position counts the samples of its stream."""
    seed, heads, rest = zlib.crc32(payload), [], []
    for k in range(STREAMS):
        serial = (seed + k) & 0xFFFFFFFF
        blocks = [payload[i : i + BLOCK] for i in range(k * BLOCK, len(payload), STREAMS * BLOCK)]
        heads += pages_of([(MAGIC + struct.pack("<IHHQ", RATE, k, STREAMS, len(payload)), 0)], serial, 0, FIRST | (0 if blocks else LAST))
        rest.append(pages_of(list(zip(blocks, accumulate(map(len, blocks)))), serial, 1, LAST, PAGE_SEGMENTS))
    return b"".join([*heads, *(page for turn in zip_longest(*rest, fillvalue=b"") for page in turn)])


def packets(media: bytes, samples: Callable[[bytes], int] = len) -> Iterator[tuple[int, bytes, int, int]]:
    """(serial, packet, granule position of its end, page) of each packet, with every page verified; samples tells how many a packet holds."""
    at, expected, parts, ended = 0, {}, {}, set()
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + HEADER.size > len(media):
            raise OggError(f"no page at byte {at}")
        _, version, kind, granule, serial, number, crc, segments = HEADER.unpack_from(media, at)
        values = media[at + HEADER.size : at + HEADER.size + segments]
        size = HEADER.size + segments + sum(values)
        page = media[at : at + size]
        if version or len(values) < segments or len(page) < size:
            raise OggError(f"page at byte {at} is cut off or of another version")
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if bool(kind & FIRST) != (serial not in expected) or number != expected.get(serial, 0) or serial in ended:
            raise OggError(f"page {number} of stream {serial} is out of turn")
        if bool(kind & CONTINUED) != bool(parts.get(serial)):
            raise OggError(f"page {number} of stream {serial}: packet not continued")
        expected[serial], begin, whole = number + 1, HEADER.size + segments, []
        for value in values:
            parts.setdefault(serial, []).append(page[begin : begin + value])
            begin += value
            if value < FULL:
                whole.append(b"".join(parts.pop(serial)))
        later = list(accumulate(map(samples, whole[:0:-1]), initial=0))[::-1]  # samples that end on the page after each packet
        for packet, after in zip(whole, later):
            yield serial, packet, granule if kind & FIRST else granule - after, number
        if kind & LAST:
            ended.add(serial)
        at += size
    if any(parts.values()) or ended != set(expected):
        raise OggError("a stream has no end")


def decode(media: bytes) -> tuple[bytes, dict]:
    """The payload, and what was seen: pages, packets and the time of each packet in seconds."""
    opened, found, pages = {}, [], 0
    for serial, packet, granule, _ in packets(media):
        if serial not in opened:
            if packet[: len(MAGIC)] != MAGIC:
                raise OggError(f"stream {serial} has another format")
            opened[serial] = struct.unpack_from("<IHHQ", packet, len(MAGIC))
        else:
            turn, inside = divmod(granule - len(packet), BLOCK)
            found.append(((turn * STREAMS + opened[serial][1]) * BLOCK + inside, packet))
        pages += 1
    found.sort(key=lambda x: x[0])
    total, at = max((x[3] for x in opened.values()), default=0), 0
    for start, packet in found:
        if start != at:
            raise OggError(f"samples {at} to {start} are missing")
        at += len(packet)
    if at != total or len(opened) != STREAMS:
        raise OggError(f"{at} of {total} samples in {len(opened)} streams")
    rate = next(iter(opened.values()))[0]
    return b"".join(p for _, p in found), {"streams": len(opened), "packets": pages, "times": [s / rate for s, _ in found], "seconds": total / rate}


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of 64, and the bytes before those."""
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64)), len(data)


def features(payload: bytes, seen: dict) -> str:
    """Mean, root mean square and zero crossings of the samples around their middle, and the duration."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(samples))))
    return f"mean={samples.mean():.6f};rms={np.sqrt((samples * samples).mean()):.6f};crossings={crossings};seconds={seen['seconds']:.6f};streams={seen['streams']};packets={seen['packets']};last={seen['times'][-1]:.6f}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: every text as a physical Ogg stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_slices([whole], 256):
                made = [payload_of(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of the payload that the stored media give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 256):
            rows = []
            for media in batch.column(2).to_pylist():
                payload, seen = decode(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, seen)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    return stored.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_ogg_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg and read back."""
    return read_back(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
