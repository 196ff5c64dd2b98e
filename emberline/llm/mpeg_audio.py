"""MPEG audio columns: frames, tags, variable-bitrate tables and checksums, read from stored bytes.

``parse`` reads a stream as a player would: it steps over ID3v2, APE and ID3v1 tags, finds a frame header and trusts it only when
a second header of the same stream follows (or the stream ends there), resynchronises after damage, reads the Xing/Info or
VBRI table of the first frame, and verifies the CRC of protected frames. Durations are exact: samples over sampling rate. Frame
offsets are where a player can seek.

``carry`` stores arbitrary bytes losslessly: a tag with their number, an Info frame with frame count, byte count and
seek table, then MPEG-1 layer III frames at 48 kHz, mono, protected, whose side information is empty (silence) and whose body is the
payload as ancillary data. All frames but the last have the largest size; the last has the smallest that holds the rest.

Defined results: a null text is empty; a payload is padded with blanks to a positive multiple of the unit; equal texts give equal
bytes; a stream without frames has no duration and no offsets; damaged frames are counted and skipped, but a stored payload that is no
longer whole is an error; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: kbit/s by (MPEG-1?, layer) and index, and sampling rates of MPEG-1.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
CRC_POLYNOMIAL = 0x8005
SIDE_INFORMATION = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}


@dataclass(frozen=True)
class Header:
    """One frame header; ``same`` is what all frames of a stream share."""

    mpeg1: bool
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    same: tuple


@lru_cache(maxsize=4096)
def read_header(four: bytes) -> Header | None:
    """The header in four bytes; None if they are no valid header. Free-format frames are not accepted."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    mpeg1 = version == 3
    hertz = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    kbps, padding = BITRATES[mpeg1, layer][index], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or mpeg1 else 576
    size = (12000 * kbps // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + padding
    return Header(mpeg1, layer, not four[1] & 1, kbps, hertz, four[3] >> 6 == 3, size, samples, (version, layer, hertz))


@lru_cache(maxsize=4096)
def frame_crc(covered: bytes) -> int:
    """The 16-bit checksum of the format over the protected bytes."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def synchsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def read_id3(data: bytes) -> tuple[int, dict[str, str]]:
    """End of the ID3v2 tags at the start, and their text frames."""
    at, tags = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and all(b < 0x80 for b in data[at + 6 : at + 10]):
        version, end = data[at + 3], at + 10 + synchsafe(data[at + 6 : at + 10])
        place = at + 10
        while version in (3, 4) and place + 10 <= min(end, len(data)) and data[place]:
            name = data[place : place + 4].decode("latin-1")
            raw = data[place + 4 : place + 8]
            size = synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
            body = data[place + 10 : min(place + 10 + size, end)]
            if name.startswith("T") and body:
                kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                parts = body[1:].decode(kind, "replace").rstrip("\0").split("\0")
                if name == "TXXX" and len(parts) > 1:
                    tags[f"TXXX:{parts[0]}"] = parts[1]
                else:
                    tags[name] = parts[0]
            place += 10 + size
        at = end + (10 if data[at + 5] & 0x10 else 0)
    return min(at, len(data)), tags


def possible_ends(data: bytes, begin: int) -> list[int]:
    """Where the frames may end: at the end, or where ID3v1 and APE tags at the end would begin. A frame's body may look like such a tag."""
    ends = [len(data)]
    if len(data) - begin >= 128 and data[-128:-125] == b"TAG":
        ends.append(len(data) - 128)
    for end in list(ends):
        if end - begin >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
            size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
            ends.append(max(begin, end - size - (32 if flags & 0x80000000 else 0)))
    return sorted(set(ends))


@dataclass
class Stream:
    """What a stream holds. ``offsets`` are those of the audio frames; the table frame, if any, is not one of them."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    layer: int = 0
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    bad_checksums: int = 0
    skipped_bytes: int = 0
    table: dict | None = None

    @property
    def duration(self) -> Fraction | None:
        return Fraction(self.samples, self.rate) if self.rate else None

    def seek(self, seconds: Fraction) -> int | None:
        """Offset of the frame that plays at a time."""
        if not self.offsets:
            return None
        per_frame = Fraction(self.samples, len(self.offsets) * self.rate)
        return self.offsets[max(0, min(int(seconds / per_frame), len(self.offsets) - 1))]


def body_start(header: Header) -> int:
    """First byte after header, checksum and (layer III) side information."""
    side = SIDE_INFORMATION[header.mpeg1, header.mono] if header.layer == 3 else 0
    return 4 + 2 * header.protected + side


def read_table(frame: bytes, header: Header) -> dict | None:
    """The Xing/Info or VBRI table of a frame."""
    if header.layer != 3:
        return None
    at = 4 + 2 * header.protected + SIDE_INFORMATION[header.mpeg1, header.mono]
    # encoders leave the checksum out of the place they count from
    for place in dict.fromkeys((at, at - 2 * header.protected)):
        if frame[place : place + 4] in (b"Xing", b"Info"):
            flags, where, table = int.from_bytes(frame[place + 4 : place + 8], "big"), place + 8, {"kind": frame[place : place + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name], where = int.from_bytes(frame[where : where + 4], "big"), where + 4
            if flags & 4:
                table["seek"] = list(frame[where : where + 100])
            return table
    if frame[36:40] == b"VBRI":
        size, count = struct.unpack(">II", frame[46:54])
        entries, scale, width, per = struct.unpack(">HHHH", frame[54:62])
        raw = frame[62 : 62 + entries * width]
        steps = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), width)] if width else []
        return {"kind": "VBRI", "frames": count, "bytes": size, "steps": steps, "frames_per_step": per}
    return None


def parse(data: bytes) -> Stream:
    """All facts of a stream of MPEG audio. Tags at the end are told from a frame's body by where the last complete frame ends."""
    begin, tags = read_id3(data)
    out, ends, same, synced = Stream(tags=tags), possible_ends(data, begin), None, False
    at, end, last, framed = begin, len(data), begin, 0
    while at + 4 <= end:
        header = read_header(data[at : at + 4])
        after = at + header.size if header is not None else end
        good = header is not None and (same is None or header.same == same) and after <= end
        if good and after not in ends and (not synced or any(at < e < after for e in ends)):
            following = read_header(data[after : after + 4])
            good = following is not None and following.same == header.same
        if not good:
            if synced and at in ends:
                break
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            at = end if nxt < 0 else nxt
            continue
        first, synced, same = same is None, True, header.same
        frame = data[at : at + header.size]
        out.rate, out.layer = header.rate, header.layer
        if header.protected and header.layer == 3:
            out.checked += 1
            out.bad_checksums += frame_crc(frame[2:4] + frame[6 : body_start(header)]) != int.from_bytes(frame[4:6], "big")
        table = read_table(frame, header) if first else None
        if table is not None:
            out.table = table
        else:
            out.offsets.append(at)
            out.sizes.append(header.size)
            out.samples += header.samples
            out.bitrates.add(header.kbps)
        at = last = after
        framed += header.size
    out.skipped_bytes = min(e for e in ends if e >= last) - begin - framed
    return out


CARRIER = [(kbps, 144 * 1000 * kbps // 48000, bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))) for index, kbps in enumerate(BITRATES[True, 3]) if kbps]


def carrier_head(four: bytes) -> bytes:
    side = bytes(17)
    return four + frame_crc(four[2:4] + side).to_bytes(2, "big") + side


def carry(payload: bytes) -> bytes:
    """A stream whose frames hold the payload."""
    largest, head_size = CARRIER[-1], 23
    room = largest[1] - head_size
    count = max(1, -(-len(payload) // room))
    rest = len(payload) - (count - 1) * room
    last = next(c for c in CARRIER if c[1] - head_size >= rest)
    head, tail = carrier_head(largest[2]), carrier_head(last[2])
    frames = [head + payload[i * room : (i + 1) * room] for i in range(count - 1)]
    frames.append((tail + payload[(count - 1) * room :]).ljust(last[1], b"\0"))
    sizes = [largest[1]] * (count - 1) + [last[1]]
    info = next(c for c in CARRIER if c[1] >= head_size + 120)
    total = info[1] + sum(sizes)
    seek = bytes(min(255, (info[1] + largest[1] * (count * p // 100)) * 256 // total) for p in range(100))
    table = (carrier_head(info[2]) + b"Info" + struct.pack(">III", 7, count, total) + seek).ljust(info[1], b"\0")
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = len(tag)
    safe = bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127))
    return b"".join([b"ID3\x03\0\0", safe, tag, table, *frames])


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes ``carry`` stored: ancillary data of the frames, up to the length the tag tells; it is an error if fewer are left."""
    size = int(stream.tags.get("TXXX:payload_bytes", 0))
    view = memoryview(data)
    payload = b"".join([view[at + 23 : at + n] for at, n in zip(stream.offsets, stream.sizes, strict=True)])[:size]
    if len(payload) < size:
        raise ValueError(f"the stream holds {len(payload)} of {size} payload bytes")
    return payload


def stored(docs: DataFrame, unit: int = 192) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as MPEG audio."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [carry(r + b" " * (max(1, -(-len(r) // unit)) * unit - len(r))) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {kind}, n_bytes long, media binary")


FACTS = (
    "frames long, samples long, rate int, layer int, duration string, seek_offsets array<long>, checked long, bad_checksums long, skipped_bytes long, "
    "table_frames long, min_kbps int, max_kbps int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
)


def facts(data: bytes) -> dict:
    """The facts of a stored stream, every frame offset among them."""
    stream = parse(data)
    payload = payload_of(data, stream)
    return {
        "frames": len(stream.offsets),
        "samples": stream.samples,
        "rate": stream.rate,
        "layer": stream.layer,
        "duration": str(stream.duration) if stream.rate else None,
        "seek_offsets": stream.offsets,
        "checked": stream.checked,
        "bad_checksums": stream.bad_checksums,
        "skipped_bytes": stream.skipped_bytes,
        "table_frames": (stream.table or {}).get("frames"),
        "min_kbps": min(stream.bitrates, default=None),
        "max_kbps": max(stream.bitrates, default=None),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(data),
        "media_sha256": hashlib.sha256(data).hexdigest(),
    }


def with_facts(media: DataFrame) -> DataFrame:
    """Reads the column ``media`` (binary; null gives null facts) and adds ``facts``; the bytes themselves are dropped."""
    kept = [c for c in media.columns if c != "media"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if raw is None else facts(raw) for raw in (batch.column("media")[i].as_py() for i in range(batch.num_rows))]
            kind = pa.struct([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split() for x in FACTS.split(", "))])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(rows, kind)], [*kept, "facts"])

    shape = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept)
    return media.mapInArrow(read, f"{shape}, facts struct<{', '.join(':'.join(x.split()) for x in FACTS.split(', '))}>")
