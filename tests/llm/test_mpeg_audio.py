import hashlib
import random
import zlib

import pytest

from lakeweave.llm import mpeg_audio as m
from lakeweave.llm import queries


def frame(kbps=128, hz=0, pad=0, protect=False, body=b"", version=3, layer=1, mode=0):
    """A frame of MPEG-1 layer III unless told otherwise, with a right CRC if protected."""
    rates = m.RATES[1 if version == 3 else 2, 4 - layer]
    raw = bytes([0xFF, 0xE0 | version << 3 | layer << 1 | (not protect), rates.index(kbps) + 1 << 4 | hz << 2 | pad << 1, mode << 6])
    h = m.header(raw)
    side = bytes(h.side_bytes)
    out = raw + (m.crc16(raw[2:] + side).to_bytes(2, "big") if protect else b"") + side + body
    return out + bytes(h.length - len(out))


def test_lengths_of_known_frames():
    assert m.header(bytes.fromhex("fffb9000")).length == 417  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert m.header(bytes.fromhex("fffb9200")).length == 418
    assert m.header(bytes.fromhex("fffd9000")).length == 522  # layer II, 160 kbit/s
    assert m.header(bytes.fromhex("ffff9000")).length == 312  # layer I, 288 kbit/s
    assert m.header(bytes.fromhex("fff35000")).length == 130  # MPEG-2, 40 kbit/s, 22.05 kHz
    for bad in ("fffbf000", "fffb0000", "fffb9c00", "ffeb9000", "fff99000", "fffb9002", "fefb9000", "fffb90"):
        assert m.header(bytes.fromhex(bad)) is None


def test_crc_is_the_bitwise_remainder():
    def bitwise(data):
        x = 0xFFFF
        for byte in data:
            for i in range(7, -1, -1):
                x = (x << 1 & 0xFFFF) ^ (0x8005 if (x >> 15) ^ (byte >> i & 1) else 0)
        return x

    rng = random.Random(1)
    for n in range(40):
        data = rng.randbytes(n)
        assert m.crc16(data) == bitwise(data)


def test_stream_with_tags_tables_faults_and_garbage():
    text = b"\x03A title"
    tag = b"TIT2" + bytes([0, 0, 0, len(text)]) + b"\0\0" + text
    id3 = b"ID3\x04\0\0" + bytes([0, 0, 0, len(tag)]) + tag
    xing = frame(body=b"Xing" + (3).to_bytes(4, "big") + (6).to_bytes(4, "big") + (2508).to_bytes(4, "big"))
    good = [frame(protect=True), frame(160, pad=1), frame()]
    broken = bytearray(frame(protect=True))
    broken[4] ^= 1
    noise = b"\xff\xfb\x90junk\xff\xff" * 9
    tail = [frame(), frame(96)]
    v1 = b"TAG" + b"Old title".ljust(125, b"\0")
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)
    data = id3 + xing + b"".join(good) + bytes(broken) + noise + b"".join(tail) + ape + v1
    s = m.parse(data)
    assert s.tags["TIT2"] == "A title" and s.tags["title"] == "Old title" and s.kinds_of_tag == ["id3v2.4", "ape", "id3v1"]
    assert (s.table, s.table_frames, s.table_bytes) == ("Xing", 6, 2508)
    assert len(s.offsets) == 6 and s.samples == 6 * 1152 and s.hz == 44100
    assert (s.crc_good, s.crc_bad) == (1, 1) and s.resyncs == 1 and s.skipped == len(noise)
    at = len(id3) + len(xing)
    for want in (*good, bytes(broken)):
        assert s.offsets[good.index(want) if want in good else 3] == at
        at += len(want)
    assert s.kbps == {96, 128, 160}


def test_vbri():
    body = b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (5000).to_bytes(4, "big") + (12).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 6]) + bytes([1, 0, 2, 0])
    lead = frame()[: 36]
    first = (lead + body).ljust(417, b"\0")
    s = m.parse(first + frame() * 2)
    assert (s.table, s.table_bytes, s.table_frames, s.table_seek) == ("VBRI", 5000, 12, [256, 512])
    assert len(s.offsets) == 2


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 200_000])
def test_round_trip(n):
    rng = random.Random(n)
    for raw in (rng.randbytes(n), b"\xff" * n, (b"\xff\xf2\xd8\xc0" * n)[:n]):
        payload = m.padded(raw)
        assert len(payload) % 576 == 0 and len(payload) >= max(576, n) and payload[:n] == raw and set(payload[n:]) <= {255}
        media = m.store(payload, n)
        s = m.parse(media)
        assert m.load(media, s) == payload
        assert s.table_frames == len(s.offsets) == len(payload) // 576 and s.samples == len(payload) and not s.skipped
        assert s.table_bytes == len(media) - s.offsets[0] + m._FRAME[144]
        damaged = bytearray(media)
        damaged[s.frames[-1][0]] ^= 1
        with pytest.raises(ValueError):
            m.load(bytes(damaged))


def test_resynchronises_after_any_cut():
    media = m.store(m.padded(random.Random(3).randbytes(6000)))
    s = m.parse(media)
    for at in (s.offsets[3] + 1, s.offsets[5] + 100, s.offsets[-1] - 7):
        cut = m.parse(media[at:])
        assert [o + at for o in cut.offsets] == [o for o in s.offsets if o >= at]


def test_query_equals_the_definition(spark, sf_dir):
    rows = queries.queries()["op1_mpeg_audio"](spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.n_samples == len(payload) and len(r.seek_offsets.split(",")) == r.n_frames == len(payload) // 576
        assert by_text.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "x" * 300_000, None)], "doc_id long, text string, media string")
    rows = m.with_features(m.store_texts(docs), payload=True).collect()
    assert sorted(r.payload_bytes for r in rows) == [576, 576, 576, 300_096] and len({r.media_sha256 for r in rows}) == 2
    assert sorted(map(str, rows)) == sorted(map(str, m.store_and_read(docs).collect()))
    alien = spark.createDataFrame([(1, None, "x"), (2, bytearray(b""), "x"), (3, bytearray(b"no audio \xff\xfb here"), "x")], "id long, media binary, feature string")
    got = {r.id: r for r in m.with_features(alien).collect()}
    assert [(got[i].n_frames, got[i].feature) for i in (1, 2, 3)] == [(0, "none skipped=0"), (0, "none skipped=0"), (0, "none skipped=16")]
    assert m.with_features(m.store_texts(docs.limit(0)), payload=True).count() == 0


def test_seeking():
    from fractions import Fraction

    s = m.parse(m.store(m.padded(bytes(576 * 10))))
    assert m.offset_at(s, 0) == s.offsets[0] and m.offset_at(s, Fraction(576, 16000)) == s.offsets[1]
    assert m.offset_at(s, Fraction(5759, 16000)) == s.offsets[9] and m.offset_at(s, Fraction(575, 16000)) == s.offsets[0]
    for bad in (Fraction(5760, 16000), -1):
        with pytest.raises(ValueError):
            m.offset_at(s, bad)


def bitwise_crc(bits):
    x = 0xFFFF
    for b in bits:
        x = (x << 1 & 0xFFFF) ^ (0x8005 if (x >> 15) ^ b else 0)
    return x


# Allocation widths by subband.
WIDTHS = {
    "b": [4] * 11 + [3] * 12 + [2] * 7,
    "a": [4] * 11 + [3] * 12 + [2] * 4,
    "c": [4] * 2 + [3] * 6,
    "d": [4] * 2 + [3] * 10,
    "lsf": [4] * 4 + [3] * 7 + [2] * 19,
    "layer I": [4] * 32,
}


@pytest.mark.parametrize(
    ("head", "table", "channels", "bound"),
    [
        ("fffca000", "b", 2, 30),  # layer II, 192 kbit/s, 44.1 kHz, stereo
        ("fffca050", "b", 2, 8),  # the same, joint stereo from subband 8 on
        ("fffc44c0", "a", 1, 27),  # 64 kbit/s, 48 kHz, mono
        ("fffc28c0", "d", 1, 12),  # 48 kbit/s, 32 kHz, mono
        ("fffc10c0", "c", 1, 8),  # 32 kbit/s, 44.1 kHz, mono
        ("fff48040", "lsf", 2, 4),  # MPEG-2, joint stereo from subband 4 on
        ("fffe80c0", "layer I", 1, 32),
        ("fffe8060", "layer I", 2, 12),
    ],
)
def test_checksums_of_layers_one_and_two(head, table, channels, bound):
    rng = random.Random(head)
    raw = bytes.fromhex(head)
    h = m.header(raw)
    assert h.layer == (1 if table == "layer I" else 2) and h.protected
    frames = []
    for _ in range(6):
        allocation, chosen = [], 0
        for sb, w in enumerate(WIDTHS[table]):
            for _ in range(channels if sb < bound else 1):
                v = rng.choice([0, rng.randrange(1 << w)])
                allocation += [v >> i & 1 for i in reversed(range(w))]
                chosen += (1 if sb < bound else channels) * (v > 0)
        selection = [rng.randrange(2) for _ in range(0 if table == "layer I" else 2 * chosen)]
        told = [int(b) for x in raw[2:] for b in f"{x:08b}"] + allocation + selection
        body = allocation + selection
        body += [rng.randrange(2) for _ in range(8 * (h.length - 6) - len(body))]
        frames.append(raw + bitwise_crc(told).to_bytes(2, "big") + int("".join(map(str, body)), 2).to_bytes(h.length - 6, "big"))
    s = m.parse(b"".join(frames))
    assert (len(s.offsets), s.crc_good, s.crc_bad) == (6, 6, 0)
    hurt = bytearray(b"".join(frames))
    hurt[2 * h.length + 5] ^= 1
    hurt[4 * h.length + 7] ^= 128
    s = m.parse(bytes(hurt))
    assert (len(s.offsets), s.crc_good, s.crc_bad) == (6, 4, 2)
