"""Media columns: Ogg streams in binary columns.

The writer stores bytes as 8-bit samples of one logical stream, with a second stream that
describes it; the reader verifies the checksum of every page, demultiplexes logical streams by
serial number, reassembles packets from lacing values (also across pages) and derives a timestamp
for each page from its granule position, here the count of samples up to its end.

Defined results: null and empty texts are stored as 64 zero bytes; any length is stored whole, in
pages of at most 255 segments; equal texts give equal media; damaged media raise an error that names
what is wrong (a checksum, a lost page, a cut page); extra columns stay; an existing column named
like an added one is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_udf

RATE = 8000
PACKET = 4080  # sixteen segments of 255 bytes and one that ends the packet
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445  # serial numbers
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIII B".replace(" ", ""))
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, not reflected, from 0: zlib's CRC of mirrored bytes, mirrored."""
    got = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(got.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    out = head + lacing + body
    return out[:22] + checksum(out).to_bytes(4, "little") + out[26:]


def lace(sizes: list[int]) -> bytes:
    return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)


def paged(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one stream: the first packet alone, the others filled into pages of up to 255 segments. packets: (bytes, granule at the end)."""
    head, rest = packets[0], packets[1:]
    out = [page(serial, 0, head[1], FIRST | LAST * (not rest), lace([len(head[0])]), head[0])]
    lacing = lace([len(p) for p, _ in rest])
    body = b"".join(p for p, _ in rest)
    ends, total = [], 0
    for p, granule in rest:
        total += len(p) // 255 + 1
        ends.append((total, granule))
    done = at = k = 0
    while done < len(lacing):
        values = lacing[done : done + 255]
        size = sum(values)
        granule, last = -1, done + len(values)
        while k < len(ends) and ends[k][0] <= last:
            granule = ends[k][1]
            k += 1
        flags = CONTINUED * (done > 0 and lacing[done - 1] == 255) | LAST * (last == len(lacing))
        out.append(page(serial, len(out), granule, flags, values, body[at : at + size]))
        done, at = last, at + size
    return out


def write(payload: bytes, rate: int = RATE) -> bytes:
    """An Ogg file of 8-bit samples, with a stream of notes."""
    samples = [(b"\x80pcm8" + struct.pack("<IHI", rate, 1, len(payload)), 0)]
    samples += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    notes = [(b"\x81note" + struct.pack("<I", SAMPLES), 0), (f"bytes={len(payload)}".encode(), len(payload))]
    a, b = paged(SAMPLES, samples), paged(NOTES, notes)
    return b"".join([a[0], b[0], *a[1:], *b[1:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[tuple[int, int]] = field(default_factory=list)  # packets complete, granule position
    next: int = 0
    open: list[bytes] = field(default_factory=list)
    ended: bool = False


class DamagedMedia(ValueError):
    pass


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; every page verified."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise DamagedMedia(f"cut page header at {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise DamagedMedia(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + n]
        size = sum(lacing)
        end = at + 27 + n + size
        if len(lacing) < n or end > len(data):
            raise DamagedMedia(f"cut page at {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise DamagedMedia(f"checksum of the page at {at}")
        if flags & FIRST:
            if serial in streams:
                raise DamagedMedia(f"stream {serial} begins twice")
            streams[serial] = Stream()
        s = streams.get(serial)
        if s is None or s.ended or number != s.next or bool(flags & CONTINUED) != bool(s.open):
            raise DamagedMedia(f"a page of stream {serial} is missing before {at}")
        s.next += 1
        pos, start = at + 27 + n, at + 27 + n
        for v in lacing:
            pos += v
            if v < 255:
                s.open.append(data[start:pos])
                s.packets.append(b"".join(s.open) if len(s.open) > 1 else s.open[0])
                s.open, start = [], pos
        if pos > start or (lacing and lacing[-1] == 255):
            s.open.append(data[start:pos])
        s.times.append((len(s.packets), granule))
        s.ended = bool(flags & LAST)
        at = end
    for serial, s in streams.items():
        if not s.ended or s.open:
            raise DamagedMedia(f"stream {serial} doesn't end")
    return streams


def payload_of(streams: dict[int, Stream]) -> bytes:
    s = streams[SAMPLES]
    out = b"".join(s.packets[1:])
    if len(out) != struct.unpack_from("<I", s.packets[0], 11)[0] or s.times[-1][1] != len(out):
        raise DamagedMedia("samples are missing")
    return out


def feature(payload: bytes, streams: dict[int, Stream]) -> str:
    """Duration, packets, level, share of zero crossings and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256) - 128.0
    n = len(x)
    p = counts[counts > 0] / n
    high = x >= 128
    rate = struct.unpack_from("<I", streams[SAMPLES].packets[0], 5)[0]
    return f"seconds={streams[SAMPLES].times[-1][1] / rate:.4f};packets={len(streams[SAMPLES].packets) - 1};mean={counts @ values / n:.4f};rms={np.sqrt(counts @ values**2 / n):.4f};crossings={np.count_nonzero(high[1:] != high[:-1])};entropy={-(p * np.log2(p)).sum():.4f}"


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def _encode(raw: np.ndarray, starts: np.ndarray) -> dict:
    whole = raw.tobytes()
    return {"media": [write(padded(whole[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]}


def _decode(raw: np.ndarray, starts: np.ndarray) -> dict:
    whole = raw.tobytes()
    out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        media = whole[a:b]
        streams = read(media)
        payload = payload_of(streams)
        for k, v in (("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-64:])), ("media_bytes", len(media)), ("media_sha256", hashlib.sha256(media).hexdigest()), ("feature", feature(payload, streams))):
            out[k].append(v)
    return out


def store(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds `media`: the text's UTF-8 bytes, padded, as an Ogg file."""
    return documents.withColumn("media", texts_udf(_encode, "media binary")(F.col(text)).media)


def describe(stored: DataFrame, media: str = "media") -> DataFrame:
    """Reads `media` and adds what its payload holds."""
    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    got = stored.withColumn("_media", texts_udf(_decode, kind)(F.col(media)))
    return got.withColumns({c.split()[0]: F.col(f"_media.{c.split()[0]}") for c in kind.split(", ")}).drop("_media")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return describe(store(documents).select("doc_id", n, "media")).drop("media")
