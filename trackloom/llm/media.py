"""MPEG audio columns: bytes carried in valid frames, and a reader of any MPEG audio stream.

Stored form of a payload (`wrap`): an ID3v2.3 tag with the lengths and the payload's CRC-32, a
Xing frame (frame and byte counts and the 100-entry table of a variable-bitrate file), then
MPEG-1 Layer III frames of silence (32 kHz, mono, checksums on) whose side information says that
no bits are used for sound; what is left of each frame, its ancillary data, holds the payload.
The last frame takes the lowest bitrate with room for the rest. A frame's own checksum covers
its header and side information; the CRC-32 covers the payload. Beside the bytes stand the
exact duration (samples and their rate) and the offset of every frame.

The reader (`parse`) skips tags, resynchronises after foreign bytes, checks that frames
follow one another, takes free format by the distance of its frames, verifies the checksums of
all three layers, reads Xing and VBRI tables, and gives exact durations in samples and the offset
of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), Hz by version.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
NAMES = {3: "1", 2: "2", 0: "2.5"}


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """Polynomial 0x8005, from 0xFFFF, over the first so many bits (all)."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        top = crc >> 15 ^ data[k >> 3] >> (7 - (k & 7)) & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    checked: bool
    kbps: int  # 0: free format
    hertz: int
    mono: bool
    bound: int  # subbands below it have an allocation of their own for each channel
    size: int  # 0: free format
    pad: int  # bytes
    samples: int
    side: int  # bytes of Layer III side information

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.hertz


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The frame header in 4 bytes; None if they are none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    rate, tone, pad, mode = raw[2] >> 4, raw[2] >> 2 & 3, raw[2] >> 1 & 1, raw[3] >> 6
    if version == 1 or layer == 4 or rate == 15 or tone == 3 or raw[3] & 3 == 2:
        return None
    first, mono = version == 3, mode == 3
    kbps, hertz = KBPS[first, layer][rate], HERTZ[version][tone]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    pad *= 4 if layer == 1 else 1
    size = 0 if not rate else 12000 * kbps // hertz * 4 + pad if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    side = (17 if mono else 32) if first else (9 if mono else 17)
    bound = 4 * (raw[3] >> 4 & 3) + 4 if mode == 1 else 32
    return Header(version, layer, not raw[1] & 1, kbps, hertz, mono, bound, size, pad, samples, side if layer == 3 else 0)


def allocation(h: Header, kbps: int) -> list[int]:
    """Bits of a Layer II allocation for each subband. Fixed values of ISO 11172-3, tables
    B.2a to B.2d, and 13818-3, table B.1."""
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = kbps if h.mono else kbps // 2
    if each < 56:
        return [4] * 2 + [3] * (10 if h.hertz == 32000 else 6)
    if each < 96 or h.hertz == 48000:
        return [4] * 11 + [3] * 12 + [2] * 4
    return [4] * 11 + [3] * 12 + [2] * 7


def _bit(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at >> 3 : (at + n + 7 >> 3)], "big") >> (-(at + n) & 7) & (1 << n) - 1


def protected_bits(frame: bytes, h: Header, kbps: int) -> int:
    """How many bits after the checksum it covers: Layer III side information, Layer I
    allocations, Layer II allocations and the selection of scale factors."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * (h.bound * channels + (32 - h.bound) * (1 if h.bound < 32 else channels))
    at, used = 48, 0
    for sb, n in enumerate(allocation(h, kbps)):
        own = channels if sb < h.bound else 1
        for _ in range(own):
            used += (_bit(frame, at, n) > 0) * (channels if own < channels else 1)
            at += n
    return at - 48 + 2 * used


def checksum_holds(frame: bytes, h: Header) -> bool:
    kbps = h.kbps or 8 * len(frame) * h.hertz // (1000 * h.samples)  # of free format, by the size
    bits = protected_bits(frame, h, kbps)
    return crc16(frame[2:4] + frame[6 : 6 + (bits + 7 >> 3)], 16 + bits) == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    frames: list[int] = field(default_factory=list)  # offset of every sound frame
    sizes: list[int] = field(default_factory=list)
    kbps: dict[int, int] = field(default_factory=dict)  # frames of each bitrate
    samples: int = 0
    kind: Header | None = None
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None  # of a Xing, Info or VBRI frame
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes that belong to no frame and no tag

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        return Fraction(self.samples, self.kind.hertz) if self.kind else Fraction(0)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Bytes of the tag at `at`; its text frames go to tags."""
    size = _syncsafe(data[at + 6 : at + 10]) + 10 + 10 * bool(data[at + 5] & 0x10)
    end, pos, major = min(len(data), at + size), at + 10, data[at + 3]
    while pos + 10 <= end and data[pos : pos + 1].isalnum():
        name = data[pos : pos + 4].decode("latin-1")
        n = _syncsafe(data[pos + 4 : pos + 8]) if major >= 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
        body = data[pos + 10 : min(end, pos + 10 + n)]
        if name.startswith("T") and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key.rstrip("\0")] = value.rstrip("\0")
        pos += 10 + n
    return size


def _table(frame: bytes, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in a frame; None if it holds sound."""
    at = 4 + 2 * h.checked + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out, flags, at = {"kind": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                part = frame[at : at + n]
                out[key] = list(part) if key == "toc" else int.from_bytes(part, "big")
                at += n
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", frame[40:62])
        toc = [int.from_bytes(frame[62 + width * i : 62 + width * (i + 1)], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "quality": quality, "each": each}
    return None


def _free_size(data: bytes, at: int, h: Header, end: int) -> int:
    """Bytes of a free-format frame without its padding: the distance to the next header of its
    kind, if a third one follows in step or the stream ends there; 0: there is none."""
    p = at + 4
    while (p := data.find(data[at : at + 2], p, min(end, at + 1 << 16))) > 0:
        after, size = header(data[p : p + 4]), p - at - h.pad
        if after is not None and after.kind == h.kind and not after.size:
            third = p + size + after.pad
            last = header(data[third : third + 4]) if third + 4 <= end else None
            if third == end or (last is not None and last.kind == h.kind and not last.size):
                return size
        p += 1
    return 0


def parse(data: bytes) -> Stream:
    out, at, end, free = Stream(), 0, len(data), 0
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["id3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    first = True
    while at + 4 <= end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at += _id3v2(data, at, out.tags)
            continue
        h = header(data[at : at + 4])
        if h is not None and not h.size:
            free = free or _free_size(data, at, h, end)
        size = 0 if h is None else h.size or (free and free + h.pad)
        fits = bool(size) and at + size <= end
        if fits and out.kind and h.kind != out.kind.kind:
            fits = False
        if fits and not out.kind and at + size + 4 <= end:  # not yet in step: a second header must follow
            after = header(data[at + size : at + size + 4])
            fits = after is not None and after.kind == h.kind
        if not fits:
            step = min(p if p >= 0 else end for p in (data.find(b"\xff", at + 1, end), data.find(b"ID3", at + 1, end)))
            out.skipped += step - at
            at = step
            continue
        frame = data[at : at + size]
        if h.checked:
            good = checksum_holds(frame, h)
            out.crc_good += good
            out.crc_bad += not good
        out.kind = out.kind or h
        table = _table(frame, h) if first and h.layer == 3 else None
        if table:
            out.table = table
        else:
            out.frames.append(at)
            out.sizes.append(size)
            out.kbps[h.kbps] = out.kbps.get(h.kbps, 0) + 1
            out.samples += h.samples
        first = False
        at += size
    out.skipped += max(0, end - at)
    return out


def seek(stream: Stream, seconds: Fraction) -> int:
    """The offset of the frame that sounds at a time."""
    if not stream.frames:
        return 0
    n = int(seconds * stream.kind.hertz) // stream.kind.samples
    return stream.frames[min(max(n, 0), len(stream.frames) - 1)]


def _silent(rate: int) -> tuple[bytes, int]:
    """(header, checksum and side information of a silent frame, room for other bytes)."""
    head = bytes([0xFF, 0xFA, rate << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    h = header(head)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, h.size - 23


SILENT = [None, *[_silent(k) for k in range(1, 15)]]
ROOMS = [s[1] for s in SILENT[1:]]


def _text(key: str, value: str) -> bytes:
    body = b"\0" + key.encode("latin-1") + b"\0" + value.encode("latin-1")
    return b"TXXX" + len(body).to_bytes(4, "big") + b"\0\0" + body


def wrap(payload: bytes, n_bytes: int) -> bytes:
    """The stored form of a payload."""
    front, room = SILENT[14]
    frames = [front + payload[a : a + room] for a in range(0, len(payload) // room * room, room)]
    rest = payload[len(frames) * room :]
    if rest:
        rate = next(k for k, r in enumerate(ROOMS, 1) if r >= len(rest))
        frames.append(SILENT[rate][0] + rest + bytes(ROOMS[rate - 1] - len(rest)))
    sound = b"".join(frames)
    front, size = SILENT[8]  # 112 kbit/s: room for the whole table
    total = len(front) + size + len(sound)
    # Byte 256 * x stands for place x of the file; a percentile's frame begins at its offset.
    starts = [len(front) + size + k * 1440 for k in range(len(frames))]
    toc = bytes(min(255, 256 * starts[min(len(frames) - 1, len(frames) * p // 100)] // total) for p in range(100))
    xing = b"Xing" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc + bytes(4)
    texts = _text("n_bytes", str(n_bytes)) + _text("payload_bytes", str(len(payload))) + _text("payload_crc32", f"{zlib.crc32(payload):08x}")
    n = len(texts)
    tag = b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + texts
    return tag + front + xing + bytes(size - len(xing)) + sound


def unwrap(media: bytes) -> tuple[bytes, Stream]:
    """The payload, and what the stream is; an error if any byte of it isn't as it was stored."""
    s = parse(media)
    try:
        left, parts = int(s.tags["payload_bytes"]), []
        for at, size in zip(s.frames, s.sizes, strict=True):
            part = media[at + 23 : at + min(size, 23 + left)]
            parts.append(part)
            left -= len(part)
        payload = b"".join(parts)
        whole = not left and not s.crc_bad and not s.skipped and zlib.crc32(payload) == int(s.tags["payload_crc32"], 16)
    except (KeyError, ValueError):
        whole = False
    if not whole:
        raise ValueError("the stored audio is damaged")
    return payload, s


def feature(s: Stream, payload: bytes) -> str:
    """A short description of the stream and of its samples, the payload read as unsigned 8-bit
    ones: sum, sum of squares about the middle, crossings of the middle, checksum. Equal texts
    have equal ones; those of different texts differ but for chance."""
    if s.kind is None:
        return "no audio"
    d = s.duration
    rates = ",".join(f"{k}x{n}" for k, n in sorted(s.kbps.items()))
    offsets = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.frames))
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    sound = f"sum={x.sum()} energy={(x * x).sum()} crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))} crc32={zlib.crc32(payload):08x}"
    return (
        f"mpeg{NAMES[s.kind.version]}-layer{s.kind.layer} {s.kind.hertz}Hz {'mono' if s.kind.mono else 'stereo'} frames={len(s.frames)} samples={s.samples} "
        f"seconds={d.numerator}/{d.denominator} kbps={rates} table={s.table['kind'] if s.table else 'none'} crc={s.crc_good}/{s.crc_good + s.crc_bad} seek={offsets:08x} {sound}"
    )


STORED = "doc_id long, n_bytes long, media binary, samples long, hertz int, seek array<long>"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, media, samples and hertz (the exact duration is their
    quotient), seek (the offset of every frame of 1152 samples).

    Null and empty texts are 64 bytes 0; the payload is the UTF-8 bytes and bytes 0 up to a
    positive multiple of 64. Texts may be of any length; each of repeated rows is stored; a null
    doc_id stays null; an empty table gives none. Extra columns aren't read.
    """

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "text", 4 << 20):
                raw = list(common.texts(b.column(1)))
                media = [wrap(t + bytes(-len(t) % 64 if t else 64), len(t)) for t in raw]
                streams = [parse(m) for m in media]
                columns = [b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())]
                columns += [pa.array([s.samples for s in streams], pa.int64()), pa.array([s.kind.hertz for s in streams], pa.int32()), pa.array([s.frames for s in streams], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "samples", "hertz", "seek"])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(common.tidy(run), STORED)


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, hertz int, seek array<long>"


def read(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: lengths, digests, feature, duration and frame offsets, which
    must be those that stand beside them. Repeated rows each give theirs; no rows: none."""
    names = [c.strip().split(" ")[0] for c in READ.split(",")]

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "media", 4 << 20):
                rows = []
                beside = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
                for d, media, known in zip(b.column(0).to_pylist(), common.texts(b.column(1)), beside, strict=True):
                    payload, s = unwrap(media)
                    if known != (s.samples, s.kind.hertz, s.frames):
                        raise ValueError("the stored duration or frame offsets are wrong")
                    rows.append((d, int(s.tags["n_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s, payload), s.samples, s.kind.hertz, s.frames))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return stored.select("doc_id", "media", "samples", "hertz", "seek").mapInArrow(common.tidy(run), READ)


def op5_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    stored = common.materialize(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "audio")
    return read(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "hertz", "seek")
