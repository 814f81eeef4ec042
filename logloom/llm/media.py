"""Media columns: MPEG audio that carries a byte payload losslessly, and the parser that reads it back.

A payload goes into the main data of MPEG-1 layer III frames (48 kHz, mono, protected by checksums) whose side information
says that no part of it is sound: players hear silence, and readers get the bytes. Frame sizes vary, so the stream opens
with a variable-bitrate table. A tag in front of it holds the payload's length and checksum.

The parser assumes nothing of that: it skips tags at either end, resynchronises on frame headers that are confirmed by
the next one, checks the checksums of layers I and III (those of layer II, which cover a part whose length depends on tables, are counted as
unchecked), reads Xing and VBRI tables with their seek points, and gives the exact number of samples and the offset of every frame.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import over_column, with_id_column

# Fixed values of the MPEG audio frame header (ISO/IEC 11172-3 and 13818-3): kbit/s by index 1 to 14, Hz by index 0 to 2.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

UNIT = 64
_SIDE = bytes(17)
_HEAD = 4 + 2 + len(_SIDE)
_SIZES = [144 * 1000 * rate // 48000 for rate in BITRATES[1, 3]]
_ROOM = [size - _HEAD for size in _SIZES]


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, most significant bit first."""
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


_checks: dict[bytes, int] = {}


def _check(covered: bytes) -> int:
    """crc16 of the covered bytes. Streams repeat few of them, so the last ones are remembered."""
    found = _checks.get(covered)
    if found is None:
        if len(_checks) > 4096:
            _checks.clear()
        found = _checks[covered] = crc16(covered)
    return found


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    size: int
    samples: int
    side: int


_headers: dict[bytes, Header | None] = {}


def header(data: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames count as none."""
    if data not in _headers:
        if len(_headers) > 65536:
            _headers.clear()
        _headers[data] = _parse_header(data)
    return _headers[data]


def _parse_header(h: bytes) -> Header | None:
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(h[1] >> 3 & 3)
    layer = 4 - (h[1] >> 1 & 3)
    which, speed = h[2] >> 4, h[2] >> 2 & 3
    if version is None or layer == 4 or which in (0, 15) or speed == 3:
        return None
    kbit = BITRATES[1 if version == 1 else 2, layer][which - 1]
    rate, padding, mono = SAMPLE_RATES[version][speed], h[2] >> 1 & 1, h[3] >> 6 == 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbit // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not h[1] & 1, kbit, rate, size, samples, side)


def _frame_head(which: int) -> bytes:
    h = bytes([0xFF, 0xFA, which + 1 << 4 | 1 << 2, 0xC0])
    return h + struct.pack(">H", crc16(h[2:] + _SIDE)) + _SIDE


_HEADS = [_frame_head(k) for k in range(14)]


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def padded(data: bytes) -> bytes:
    """`data` with bytes 0 up to a positive multiple of the unit."""
    return data + bytes(max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write(payload: bytes) -> bytes:
    """The MPEG audio stream that carries a payload."""
    full, rest = divmod(len(payload), _ROOM[-1])
    kinds = [13] * full + ([bisect_left(_ROOM, rest)] if rest else [])
    frames, at = [], 0
    for k in kinds:
        part = payload[at : at + _ROOM[k]]
        at += len(part)
        frames += (_HEADS[k], part) if len(part) == _ROOM[k] else (_HEADS[k], part, bytes(_ROOM[k] - len(part)))
    sizes = [_SIZES[k] for k in kinds]
    table = 9  # a frame of 480 bytes: room for the Xing table
    total = _SIZES[table] + sum(sizes)
    toc = bytes(min(255, 256 * (_SIZES[table] + _SIZES[13] * (p * len(sizes) // 100)) // total) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    first = _HEADS[table] + xing + bytes(_ROOM[table] - len(xing))
    owner = b"payload\0" + struct.pack(">QI", len(payload), zlib.crc32(payload))
    tag = b"PRIV" + _syncsafe(len(owner)) + b"\0\0" + owner
    return b"".join([b"ID3\4\0\0", _syncsafe(len(tag)), tag, first, *frames])


@dataclass
class Parsed:
    """`samples` without the frame of the variable-bitrate table. `offsets`: of all sound frames. `toc`: the 100 points of a Xing table; `seek`: the
    offsets that a VBRI table gives, counted from its frame. `skipped`: bytes between frames."""

    tags: dict[str, bytes] = field(default_factory=dict)
    table: str = ""
    table_frames: int = -1
    toc: bytes = b""
    seek: list[int] = field(default_factory=list)
    unchecked: int = 0
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)

    def payload(self, data: bytes) -> bytes:
        """The bytes in the frames' main data, cut to the length in the payload tag; a wrong checksum is an error."""
        out = b"".join([data[a:b] for a, b in self.spans])
        own = self.tags.get("PRIV:payload")
        if own is not None:
            size, check = struct.unpack(">QI", own)
            out = out[:size]
            if len(out) != size or zlib.crc32(out) != check:
                raise ValueError("the payload's checksum does not fit")
        return out


def _frame_body(body: bytes, flags: int, old: bool) -> bytes:
    """What a tag's frame holds, without unsynchronisation and compression; as it is if that can't be undone."""
    if not old and flags & 0x02:
        body = body.replace(b"\xff\0", b"\xff")
    packed = flags & (0x80 if old else 0x08)
    if packed or not old and flags & 0x01:
        body = body[4:]  # the size before compression
    try:
        return zlib.decompress(body) if packed else body
    except zlib.error:
        return body


def _read_tags(data: bytes, out: Parsed) -> tuple[int, int]:
    """Where frames begin and end between the tags at both ends. A tag at the end counts until `parse` finds a whole frame over its start."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        size = _unsafe(data[start + 6 : start + 10])
        old, flags = data[start + 3] < 4, data[start + 5]
        tag = data[start + 10 : min(end, start + 10 + size)]
        if old and flags & 0x80:
            tag = tag.replace(b"\xff\0", b"\xff")  # unsynchronised as a whole
        i = 0
        if flags & 0x40 and len(tag) >= 4:  # an extended header, whose size counts itself in the newer version only
            i = 4 + struct.unpack(">I", tag[:4])[0] if old else _unsafe(tag[:4])
        while i + 10 <= len(tag) and tag[i] != 0:
            width = struct.unpack(">I", tag[i + 4 : i + 8])[0] if old else _unsafe(tag[i + 4 : i + 8])
            name, body = tag[i : i + 4].decode("latin-1"), _frame_body(tag[i + 10 : i + 10 + width], tag[i + 9], old)
            if name == "PRIV" and b"\0" in body:
                owner, body = body.split(b"\0", 1)
                name = f"PRIV:{owner.decode('latin-1')}"
            out.tags[name] = body
            i += 10 + width
        start = start + 10 + size + (10 if data[start + 5] & 0x10 else 0)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end : end + 128]
    return min(start, end), end


def parse(data: bytes) -> Parsed:
    """Tags, tables, frames, checksums, duration and seek offsets of any MPEG audio bytes; bytes that fit nothing are skipped."""
    out = Parsed()
    i, end = _read_tags(data, out)
    synced = False
    while i + 4 <= end:
        h = header(data[i : i + 4])
        if h is not None and not synced and i + h.size < end:  # a header after a gap counts only if another follows it
            after = header(data[i + h.size : i + h.size + 4])
            h = h if _alike(after, h) else None
        if h is not None and i < end < i + h.size and _whole(data, i, h):  # what looked like a tag lies in this frame
            end = len(data)
            del out.tags["ID3v1"]
        if h is None or i + h.size > end:
            synced = False
            nxt = data.find(b"\xff", i + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - i
            i = nxt
            continue
        synced = True
        body = i + 4 + 2 * h.protected
        if h.protected and h.layer == 2:
            out.unchecked += 1
        elif h.protected:
            out.checked += 1
            covered = h.side if h.layer == 3 else _allocation(data[i + 3])
            out.bad += _check(data[i + 2 : i + 4] + data[body : body + covered]) != struct.unpack(">H", data[i + 4 : i + 6])[0]
        at = body + h.side
        if not out.offsets and not out.table and _read_table(data, i, at, h, out):
            i += h.size
            continue
        out.rate = out.rate or h.rate
        out.samples += h.samples
        out.offsets.append(i)
        out.bitrates.add(h.bitrate)
        out.spans.append((at, i + h.size))
        i += h.size
    out.skipped += max(0, end - i)
    return out


def _allocation(modes: int) -> int:
    """Bytes of a layer I frame's bit allocation: four bits for each subband and channel, one for both from the bound of joint stereo on."""
    mode, bound = modes >> 6, 4 * ((modes >> 4 & 3) + 1)
    return 16 if mode == 3 else 16 + bound // 2 if mode == 1 else 32


def _alike(a: Header | None, b: Header) -> bool:
    return a is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _whole(data: bytes, i: int, h: Header) -> bool:
    """Whether a frame at i ends with the data or before another frame. One cut short by a tag does neither."""
    stop = i + h.size
    return stop == len(data) or _alike(header(data[stop : stop + 4]), h)


def _read_table(data: bytes, i: int, at: int, h: Header, out: Parsed) -> bool:
    if data[at : at + 4] in (b"Xing", b"Info"):
        flags, at2 = struct.unpack(">I", data[at + 4 : at + 8])[0], at + 8
        out.table, out.rate = data[at : at + 4].decode(), h.rate
        if flags & 1:
            out.table_frames = struct.unpack(">I", data[at2 : at2 + 4])[0]
            at2 += 4
        at2 += 4 * bool(flags & 2)
        out.toc = data[at2 : at2 + 100] if flags & 4 else b""
        return True
    if h.layer == 3 and data[i + 36 : i + 40] == b"VBRI":
        out.table, out.rate = "VBRI", h.rate
        out.table_frames = struct.unpack(">I", data[i + 50 : i + 54])[0]
        entries, scale, width, _ = struct.unpack(">HHHH", data[i + 54 : i + 62].ljust(8, b"\0"))
        steps = [int.from_bytes(data[k : k + width], "big") * scale for k in range(i + 62, min(i + 62 + entries * width, i + h.size - width + 1), width)] if 1 <= width <= 4 else []
        out.seek = list(accumulate(steps))
        return True
    return False


def features(found: Parsed) -> str:
    """A short text of what was read: equal bytes give equal texts."""
    d = found.duration
    return (
        f"mp3 rate={found.rate} frames={len(found.offsets)} samples={found.samples} seconds={d.numerator}/{d.denominator} table={found.table or 'none'}:{found.table_frames}"
        f" kbit={min(found.bitrates, default=0)}-{max(found.bitrates, default=0)} checked={found.checked} bad={found.bad} skipped={found.skipped}"
        f" seek={zlib.crc32(struct.pack(f'>{len(found.offsets)}I', *found.offsets)):08x}"
    )


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): the text of each row as UTF-8, padded, in an MPEG audio stream. Null text counts as empty.
    doc_id may be null or repeat; other columns are ignored."""

    def work(texts):
        data = [(t or "").encode("utf-8") for t in texts]
        return [len(x) for x in data], [write(padded(x)) for x in data]

    return over_column(with_id_column(docs), "text", work, "n_bytes long, media binary")


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """What the parser reads in a column of MPEG audio, after the columns there are: payload, samples, sample_rate, duration_us,
    seek_offsets (of all frames), feature. A null is read as no bytes."""

    def work(values):
        rows = []
        for data in values:
            data = data or b""
            found = parse(data)
            rows.append((found.payload(data), found.samples, found.rate, int(found.duration * 1_000_000), found.offsets, features(found)))
        return list(zip(*rows, strict=True))

    return over_column(media, column, work, "payload binary, samples long, sample_rate long, duration_us long, seek_offsets array<int>, feature string", keep=True)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, samples, duration_us,
    n_frames: one row for each row of `docs`, from the payload as read back."""
    read = read_media(to_media(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "samples",
        "duration_us",
        F.size("seek_offsets").cast("long").alias("n_frames"),
    )
