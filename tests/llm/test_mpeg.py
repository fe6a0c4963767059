import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from junctura.llm import mpeg, queries
from tests.llm.edges import documents, nothing


def payload_of(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def test_edges(spark):
    docs = documents(spark)
    got = mpeg.describe(mpeg.store(docs)).collect()
    want = []
    for r in docs.collect():
        p, n = payload_of(r.text)
        want.append((r.doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.crc_good == r.crc_checked == r.frames and r.skipped_bytes == 0 and r.table_ok for r in got)
    assert all(r.duration_samples == 1152 * r.frames and len(r.frame_offsets) == r.frames for r in got)
    assert mpeg.describe(mpeg.store(nothing(spark))).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_round_trip(seed):
    rng = random.Random(seed)
    p = rng.randbytes(64 * rng.randint(1, 400)) if seed % 2 else b"\xff\xfb" * 32 * rng.randint(1, 300)
    found = mpeg.decode(mpeg.encode(p))
    assert found["payload"] == p and found["skipped"] == 0
    assert all(mpeg.encode(p)[o] == 0xFF for o in found["offsets"])


def test_resynchronises():
    clean = mpeg.encode(b"x" * 64 * 200)
    frames = mpeg.decode(clean)["offsets"]
    cut = frames[3]
    found = mpeg.decode(clean[:cut] + b"\x00garbage\xff\x00" * 5 + clean[cut:])
    assert found["frames"] == len(frames) and found["skipped"] == 50
    spoiled = bytearray(clean)
    spoiled[frames[2] + 8] ^= 1  # inside what the CRC covers
    with_error = mpeg.decode(bytes(spoiled))
    assert with_error["crc_good"] == with_error["crc_checked"] - 1
    assert mpeg.decode(b"no audio at all")["frames"] == 0
    assert mpeg.decode(b"")["skipped"] == 0


def test_foreign_streams(spark):
    # MPEG-2 layer III, 64 kbit/s, 22050 Hz, stereo, without a CRC, behind an ID3v2.3 tag and before an ID3v1 tag
    head = bytes([0xFF, 0xF3, 8 << 4, 0x00])
    size = 576 * 125 * 64 // 22050
    tag = b"ID3\x03\x00\x00" + mpeg.sevens(10 + 5, 4) + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\0song"
    data = tag + (head + bytes(size - 4)) * 10 + b"TAG" + bytes(125)
    x = mpeg.decode(data)
    assert (x["frames"], x["rates"], x["skipped"], x["payload"], x["duration"]) == (10, {22050: 5760}, 0, None, Fraction(5760, 22050))
    assert x["tags"]["TIT2"] == b"\0song"
    media = spark.createDataFrame([(1, bytearray(data)), (2, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in mpeg.describe(media).collect()}
    assert got[1].frames == 10 and got[1].payload_sha256 is None and got[2].frames == 0


def test_checksum_and_headers():
    # the value of this CRC (polynomial 0x8005, from all ones, not reflected) for the usual test text
    assert mpeg.crc16(b"123456789") == 0xAEE7
    assert mpeg.crc16(b"\x12\x34\x50", 20) == mpeg.crc16(b"\x12\x34\x5f", 20) != mpeg.crc16(b"\x12\x34\x6f", 20)
    assert mpeg.header(bytes([0xFF, 0xFB, 0x90, 0x00]))[:5] == (417, 1152, 44100, 32, False)
    assert mpeg.header(b"\xff\xff\xff\xff") is None


def bits_crc(bits):
    """The CRC bit by bit, as the standard draws it."""
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 & 1) != bit else 0)) & 0xFFFF
    return crc


def as_bits(data):
    return [b >> 7 - i & 1 for b in data for i in range(8)]


@pytest.mark.parametrize(
    ("head", "cover"),
    [
        # Layer I, 32 kHz, 128 kbit/s: stereo 64 allocations of 4 bits, mono 32, joint from sub-band 8 on 40
        (bytes([0xFF, 0xFE, 0x48, 0x00]), 256), (bytes([0xFF, 0xFE, 0x48, 0xC0]), 128), (bytes([0xFF, 0xFE, 0x48, 0x50]), 160),
        # Layer II, mono, 44.1 kHz, 192 kbit/s: table b, all 30 sub-bands allocated: 94 bits, then 60
        (bytes([0xFF, 0xFC, 0xA0, 0xC0]), 94 + 60),
        # Layer II, mono, 48 kHz, 32 kbit/s: table c, 26 bits for 8 sub-bands, then 16
        (bytes([0xFF, 0xFC, 0x14, 0xC0]), 26 + 16),
    ],
)
def test_checksums_of_layers_one_and_two(head, cover):
    h = mpeg.header(head)
    body = bytes([0xFF]) * (h.size - 6)
    assert mpeg.checked_bits(h, body) == cover
    crc = bits_crc(as_bits(head[2:]) + as_bits(body)[:cover]).to_bytes(2, "big")
    found = mpeg.decode((head + crc + body) * 3 + (head + bytes(2) + body))
    assert (found["frames"], found["crc_checked"], found["crc_good"]) == (4, 4, 3)


def test_vbri_and_changing_rates():
    head = bytes([0xFF, 0xFB, 0x90, 0xC0])  # 44.1 kHz, 128 kbit/s, mono
    size = mpeg.header(head).size
    vbri = b"VBRI" + bytes(6) + (3000).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes([0, 3, 0, 2, 0, 2, 0, 1]) + b"\0\1\0\2\0\3"
    first = head + bytes(32) + vbri
    other = bytes([0xFF, 0xFB, 0x98, 0xC0])  # 32 kHz
    data = first + bytes(size - len(first)) + (head + bytes(size - 4)) * 5 + (other + bytes(mpeg.header(other).size - 4)) * 2
    found = mpeg.decode(data)
    assert found["table"] == {"kind": "VBRI", "frames": 7, "bytes": 3000, "toc": [2, 4, 6], "at": 0}
    assert found["rates"] == {44100: 5 * 1152, 32000: 2 * 1152} and found["duration"] == Fraction(5 * 1152, 44100) + Fraction(2 * 1152, 32000)
    row = dict(zip(mpeg.DESCRIBED, mpeg.row_of(data), strict=True))
    assert row["table_ok"] and row["sample_rate"] is None and row["seek_places"] == [2, 4, 6] and row["frame_offsets"][0] == size


def test_unsynchronised_tags():
    body = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0\xff\xe0a"
    spread = body.replace(b"\xff", b"\xff\0")
    assert mpeg.read_id3(b"ID3\x03\0\x80" + mpeg.sevens(len(spread), 4) + spread)[1] == {"TIT2": b"\0\xff\xe0a"}
    one = b"TIT2" + mpeg.sevens(5, 4) + b"\0\x02" + b"\0\xff\0\xe0a"
    assert mpeg.read_id3(b"ID3\x04\0\0" + mpeg.sevens(len(one), 4) + one)[1] == {"TIT2": b"\0\xff\xe0a"}


def test_a_lone_header_is_no_frame():
    assert mpeg.decode(b"\xff\xfb\x90\xc0" + b"text" * 500)["frames"] == 0


def by_hand(payload):
    """The frames that hold a payload, from the format's rules: 1417 bytes in each, and the smallest that takes the rest."""
    sizes = [9 * k // 2 for k in (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)]
    rest = len(payload) % 1417
    each = [1440] * (len(payload) // 1417) + ([min(s for s in sizes if s - 23 >= rest)] if rest else [])
    return len(each), [sum(each[:i]) for i in range(len(each))]


def test_query(spark, sf):
    got = queries.QUERIES["op8_mpeg"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    seen = {}
    for r in got:
        p, n = payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert seen.setdefault(texts[r.doc_id], r.feature) == r.feature
        frames, starts = by_hand(p)
        first = r.frame_offsets[0]
        assert r.frames == frames and r.frame_offsets == [first + s for s in starts] and r.duration_samples == 1152 * frames
        assert f"frames={frames} samples={1152 * frames} hz=32000 crc={frames}/{frames} table=true skipped=0 " in r.feature
