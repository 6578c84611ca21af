"""Media columns: MPEG audio streams as bytes, and what can be computed from them.

Parsing. Frames are found by resynchronising: a header's sync bits, version, layer, bit rate, sampling
rate and emphasis must be valid, and the stream must go on behind it with a like header, a tag or its
end; a candidate that fails is stepped over, and the bytes skipped are counted. ID3v2 (with its
unsynchronised size), ID3v1 and APE tags are read and left out. A first frame that holds a Xing, Info
or VBRI table describes the stream and is no audio. CRC-16 of protected frames is verified over the header and what the layer protects: the bit allocation
(I), bit allocation and scale factor selection (II), the side information (III). Frames of free format, whose
header names no bit rate, are no frames here. Durations are exact: samples and sampling rate as whole numbers, and every
frame's byte offset is kept for seeking.

Storing. `store` carries any payload losslessly inside a valid stream: MPEG-2 layer III, 16 kHz, mono,
CRC-protected, of frames with main_data_begin 0 and part2_3_length 0, i.e. silence, whose main data
are ancillary bytes: 576 payload bytes to a frame of 576 samples, one for each sample. The frames'
bit rate varies (144 to 160 kbit/s by turns), and a Xing table with frames, bytes and 100 seek points
and an ID3v2 tag with the payload's length and CRC-32 stand in front. `load` reads them back.

Defined results: a null text is empty and stored as 576 bytes of 255; a null, empty or alien media
value has no frames, duration 0 and its length as skipped bytes; equal payloads give equal bytes;
repeated rows are stored one by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c

#: Payload bytes to a frame, which is also its number of samples.
UNIT = 576

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bit rate index, for (MPEG-1 or not, layer); Hz by index.
RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLING = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    """A frame header: version 1, 2 or 2.5; layer 1 to 3; length in bytes with the header."""

    version: float
    layer: int
    protected: bool
    kbps: int
    hz: int
    padding: int
    mono: bool
    samples: int
    length: int

    @property
    def kind(self) -> tuple:
        """What stays the same through a stream."""
        return self.version, self.layer, self.hz

    @property
    def side_bytes(self) -> int:
        """Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """The header in 4 bytes, or None."""
    if raw in _headers:
        return _headers[raw]
    found = None
    if len(raw) == 4 and raw[0] == 0xFF and raw[1] >> 5 == 7:
        version = {0: 2.5, 2: 2.0, 3: 1.0}.get(raw[1] >> 3 & 3)
        layer = 4 - (raw[1] >> 1 & 3)
        rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
        if version and layer < 4 and 0 < rate < 15 and hz < 3 and raw[3] & 3 != 2:
            kbps = RATES[1 if version == 1 else 2, layer][rate - 1]
            sampling = SAMPLING[hz] // {1.0: 1, 2.0: 2, 2.5: 4}[version]
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
            pad = raw[2] >> 1 & 1
            length = (12 * kbps * 1000 // sampling + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // sampling + pad
            found = Header(version, layer, not raw[1] & 1, kbps, sampling, pad, raw[3] >> 6 == 3, samples, length)
    if len(_headers) < 100_000:
        _headers[raw] = found
    return found


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()
_crcs: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 and start 0xFFFF, as frames use it."""
    known = _crcs.get(data)
    if known is not None:
        return known
    x = 0xFFFF
    for byte in data:
        x = (x << 8 & 0xFFFF) ^ _CRC[x >> 8 ^ byte]
    if len(_crcs) < 10_000:
        _crcs[data] = x
    return x


def crc16_bits(data: bytes, bits: int) -> int:
    """The same over the first `bits` bits."""
    x = crc16(data[: bits // 8])
    for i in range(bits % 8):
        x = (x << 1 & 0xFFFF) ^ (0x8005 if x >> 15 ^ (data[bits // 8] >> 7 - i & 1) else 0)
    return x


# Fixed values of ISO/IEC 11172-3 (tables 3-B.2) and 13818-3 (table B.1): how many subbands of layer II have an allocation of how many bits.
_ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


def protected_bits(raw: bytes, h: Header, data: bytes) -> int:
    """How many bits behind the checksum it protects, in layers I and II; `data` is what stands there. raw: the header."""
    mode, extension = raw[3] >> 6, raw[3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    if h.layer == 1:
        widths = [4] * 32
    else:
        each = h.kbps // channels
        if h.version != 1:
            table = "lsf"
        elif each <= 48:
            table = "d" if h.hz == 32000 else "c"
        else:
            table = "a" if h.hz == 48000 or each <= 80 else "b"
        widths = [w for n, w in _ALLOCATION[table] for _ in range(n)]
    bound = min(len(widths), 4 * (extension + 1)) if mode == 1 else len(widths)  # subbands from there on share one allocation
    bits = sum(w * (channels if sb < bound else 1) for sb, w in enumerate(widths))
    if h.layer == 1:
        return bits
    value, at, chosen = int.from_bytes(data[: (bits + 7) // 8].ljust((bits + 7) // 8, b"\0"), "big") >> -bits % 8, bits, 0
    for sb, w in enumerate(widths):
        for _ in range(channels if sb < bound else 1):
            at -= w
            if value >> at & (1 << w) - 1:
                chosen += 1 if sb < bound else channels
    return bits + 2 * chosen


def _checks(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum is that of what it protects."""
    want, raw, rest = int.from_bytes(data[at + 4 : at + 6], "big"), data[at : at + 4], data[at + 6 : at + h.length]
    if h.layer == 3:
        return crc16(raw[2:] + rest[: h.side_bytes]) == want
    bits = protected_bits(raw, h, rest)
    return bits <= 8 * len(rest) and crc16_bits(raw[2:] + rest[: bits // 8 + 1], 16 + bits) == want


@dataclass
class Stream:
    """What `parse` finds."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    hz: int = 0
    version: float = 0
    layer: int = 0
    kbps: set[int] = field(default_factory=set)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    kinds_of_tag: list[str] = field(default_factory=list)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    table_seek: list[int] = field(default_factory=list)
    frames: list[tuple[int, int]] = field(default_factory=list)  # (first byte of main data, end of frame)


def _size7(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """The end of an ID3v2 tag at `at`; its text frames go to out.tags."""
    end = at + 10 + _size7(data[at + 6 : at + 10])
    footer = 10 if data[at + 5] & 0x10 else 0
    version, pos = data[at + 3], at + 10
    out.kinds_of_tag.append(f"id3v2.{version}")
    while version in (3, 4) and pos + 10 <= min(end, len(data)) and data[pos]:
        name = data[pos : pos + 4].decode("latin-1")
        raw = data[pos + 4 : pos + 8]
        n = _size7(raw) if version == 4 else int.from_bytes(raw, "big")
        body = data[pos + 10 : min(pos + 10 + n, end)]
        if name[:1] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value
        pos += 10 + n
    return min(end + footer, len(data))


def _tag_at(data: bytes, at: int, out: Stream | None) -> int:
    """The end of a tag that starts at `at`, or `at` if there is none."""
    lead = data[at : at + 8]
    if lead[:3] == b"ID3" and at + 10 <= len(data) and max(data[at + 6 : at + 10]) < 128:
        return _id3v2(data, at, out if out is not None else Stream())
    if lead[:3] == b"TAG" and at + 128 == len(data):
        if out is not None:
            out.kinds_of_tag.append("id3v1")
            for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
                if value := data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip():
                    out.tags.setdefault(name, value)
        return len(data)
    if lead == b"APETAGEX" and at + 32 <= len(data):
        n = int.from_bytes(data[at + 12 : at + 16], "little")
        is_header = data[at + 23] & 0x20
        if out is not None:
            out.kinds_of_tag.append("ape")
        return min(at + 32 + (n if is_header else 0), len(data))
    return at


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame at `at` is a table of the stream; its values go to out."""
    where = at + 4 + (2 if h.protected else 0) + h.side_bytes
    for pos in dict.fromkeys((where, at + 4 + h.side_bytes)):
        if (kind := data[pos : pos + 4]) in (b"Xing", b"Info"):
            flags, pos = int.from_bytes(data[pos + 4 : pos + 8], "big"), pos + 8
            out.table = kind.decode()
            if flags & 1:
                out.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 2:
                out.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
            if flags & 4:
                out.table_seek = list(data[pos : pos + 100])
            return True
    pos = at + 36
    if data[pos : pos + 4] == b"VBRI":
        out.table = "VBRI"
        out.table_bytes, out.table_frames = int.from_bytes(data[pos + 10 : pos + 14], "big"), int.from_bytes(data[pos + 14 : pos + 18], "big")
        n, scale, width = (int.from_bytes(data[pos + k : pos + k + 2], "big") for k in (18, 20, 22))
        rows = data[pos + 26 : pos + 26 + n * width]
        out.table_seek = [int.from_bytes(rows[i : i + width], "big") * scale for i in range(0, len(rows), max(1, width))]
        return True
    return False


def parse(data: bytes) -> Stream:
    """Tags, tables, frames and checksums of a stream of any quality."""
    out, at, size, kind, in_sync = Stream(), 0, len(data), None, True
    ahead = {b"\xff": -1, b"ID3": -1, b"APETAGEX": -1}  # where each start was last found, so that none is searched for twice
    while at < size:
        h = header(data[at : at + 4])
        if h is not None and (kind is None or h.kind == kind) and at + h.length <= size:
            end = at + h.length
            # a frame met out of sync must have a like header, a tag or the end behind it
            after = header(data[end : end + 4])
            if (in_sync and kind is not None) or end == size or (after is not None and after.kind == h.kind) or _tag_at(data, end, None) > end:
                main = at + 4 + (2 if h.protected else 0) + h.side_bytes
                if h.protected:
                    good = _checks(data, at, h)
                    out.crc_good += good
                    out.crc_bad += not good
                if kind is None:
                    kind, out.version, out.layer, out.hz = h.kind, h.version, h.layer, h.hz
                    if _table(data, at, h, out):
                        at = end
                        continue
                out.offsets.append(at)
                out.frames.append((main, end))
                out.samples += h.samples
                out.kbps.add(h.kbps)
                at, in_sync = end, True
                continue
        if (end := _tag_at(data, at, out)) > at:
            at = end
            continue
        # out of sync: go to the next place where a frame or a tag may start
        out.resyncs += in_sync
        in_sync = False
        for start, k in ahead.items():
            if k <= at:
                ahead[start] = k if (k := data.find(start, at + 1)) >= 0 else size
        found = min(ahead.values())
        if size - 128 > at and data[size - 128 : size - 125] == b"TAG":
            found = min(found, size - 128)
        out.skipped += found - at
        at = found
    return out


def offset_at(s: Stream, seconds: Fraction | int) -> int:
    """The byte offset of the frame that sounds at a time: frames of a stream are equally long in samples."""
    if not s.offsets or not 0 <= seconds * s.hz < s.samples:
        raise ValueError("the stream has no such time")
    return s.offsets[int(seconds * s.hz) // (s.samples // len(s.offsets))]


# -- a payload in a stream -----------------------------------------------------------------------


def _frame_header(kbps: int) -> bytes:
    return bytes([0xFF, 0b11110010, RATES[2, 3].index(kbps) + 1 << 4 | 2 << 2, 0b11000000])


_SIDE = bytes(9)
_KBPS = (144, 160)
_LEAD = {k: (h := _frame_header(k)) + crc16(h[2:] + _SIDE).to_bytes(2, "big") + _SIDE for k in _KBPS}
_FILL = {k: bytes(header(_frame_header(k)).length - len(_LEAD[k]) - UNIT) for k in _KBPS}
_FRAME = {k: header(_frame_header(k)).length for k in _KBPS}


def padded(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of the unit."""
    return raw + b"\xff" * ((-len(raw) % UNIT) or (0 if raw else UNIT))


def _id3_tag(values: dict[str, str]) -> bytes:
    frames = b""
    for key, value in values.items():
        body = b"\x03" + key.encode() + b"\0" + value.encode()
        frames += b"TXXX" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + b"\0\0" + body
    return b"ID3\x04\0\0" + bytes(len(frames) >> s & 127 for s in (21, 14, 7, 0)) + frames


def store(payload: bytes, n_bytes: int | None = None) -> bytes:
    """A stream that carries the payload, whose length is a positive multiple of the unit."""
    n = len(payload) // UNIT
    if len(payload) % UNIT or not n:
        raise ValueError("a payload is a positive multiple of the unit")
    parts, ends, total = [], [], _FRAME[_KBPS[0]]
    for i in range(n):
        k = _KBPS[i & 1]
        parts += (_LEAD[k], payload[i * UNIT : (i + 1) * UNIT], _FILL[k])
        ends.append(total)
        total += _FRAME[k]
    seek = bytes(min(255, 256 * ends[i * n // 100] // total) for i in range(100))
    table = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    lead = _LEAD[_KBPS[0]]
    first = lead + table + bytes(_FRAME[_KBPS[0]] - len(lead) - len(table))
    tag = _id3_tag({"payload_bytes": str(len(payload) if n_bytes is None else n_bytes), "payload_crc32": f"{zlib.crc32(payload):08x}"})
    return b"".join((tag, first, *parts))


def load(media: bytes, stream: Stream | None = None) -> bytes:
    """The payload that `store` put into the stream, checked against the tag's CRC-32."""
    s = stream or parse(media)
    payload = b"".join([media[main : main + UNIT] for main, _ in s.frames])
    if s.crc_bad or s.skipped or f"{zlib.crc32(payload):08x}" != s.tags.get("payload_crc32"):
        raise ValueError("the stored payload is damaged")
    return payload


def feature(s: Stream) -> str:
    """A stream in words: format, exact duration, bit rates, table, checksums, tags, faults."""
    if not s.offsets:
        return f"none skipped={s.skipped}"
    seek = "ok" if s.table_frames == len(s.offsets) else "none" if s.table_frames is None else "differs"
    return (
        f"mpeg{s.version:g}-layer{s.layer} {s.hz}Hz frames={len(s.offsets)} samples={s.samples} seconds={s.samples}/{s.hz} "
        f"kbps={min(s.kbps)}-{max(s.kbps)} table={s.table or 'none'}:{seek} crc={s.crc_good}/{s.crc_good + s.crc_bad} "
        f"tags={','.join(s.kinds_of_tag) or 'none'} resyncs={s.resyncs} skipped={s.skipped}"
    )


# -- columns -------------------------------------------------------------------------------------


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in c.slices(whole):
            raw = [t.encode("utf-8", "surrogatepass") for t in c.texts(b)]
            media = [store(padded(r), len(r)) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=[b.schema.names[0], "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each row's text in UTF-8, padded, as a media column."""
    c.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store, T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


FEATURES = {
    "media_bytes": T.LongType(),
    "media_sha256": T.StringType(),
    "feature": T.StringType(),
    "n_frames": T.LongType(),
    "n_samples": T.LongType(),
    "sample_rate": T.IntegerType(),
    "seek_offsets": T.ArrayType(T.LongType()),
}
PAYLOAD = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType()}


def _features(batches: Iterator[pa.RecordBatch], media_col: str, payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("sample_rate", pa.int32()), ("seek_offsets", pa.list_(pa.int64()))])
    if payload:
        schema = pa.schema([*schema, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())])
    for whole in batches:
        for b in c.slices(whole):
            found = []
            for media in b.column(media_col):
                data = media.as_py() or b""
                s = parse(data)
                row = [len(data), hashlib.sha256(data).hexdigest(), feature(s), len(s.offsets), s.samples, s.hz, s.offsets]
                if payload:
                    back = load(data, s)
                    row += [len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:])]
                found.append(row)
            columns = list(zip(*found)) or [()] * len(schema)
            kept = [n for n in b.schema.names if n != media_col]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.names.index(n)) for n in kept), *(pa.array(x, f.type) for x, f in zip(columns, schema))], names=[*kept, *schema.names]
            )


def with_features(rows: DataFrame, media_col: str = "media", payload: bool = False) -> DataFrame:
    """The rows with FEATURES in place of their media column, and with `payload` also those of what `store` put there."""
    c.ship(rows.sparkSession)
    new = FEATURES | (PAYLOAD if payload else {})
    rows = rows.drop(*new)
    fields = [f for f in rows.schema.fields if f.name != media_col]
    return rows.mapInArrow(lambda it: _features(it, media_col, payload), T.StructType([*fields, *(T.StructField(n, k) for n, k in new.items())]))


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column of store_texts written as a table, and with_features of what is read back from there."""
    return with_features(c.materialize(store_texts(docs, id_col, text_col), "media", compression="zstd"), payload=True)
