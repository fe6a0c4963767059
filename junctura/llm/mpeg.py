"""MPEG audio columns: bytes kept losslessly in Layer III frames, and a reader of frames, tags and seek tables.

A payload travels as the ancillary bytes of silent frames: 320 kbit/s mono at 32 kHz, the last frame as small as holds
the rest, each with its CRC-16. Before them stand an ID3v2.4 tag, whose extended header has the CRC-32 of the tag, and
a frame with a Xing table: frames, bytes and 100 places to seek.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import column, stored, text_of

# Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz by version bits, samples in a frame, bytes of side info.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}  # by (MPEG-1?, mono?)
#: Fixed values of Layer II: bits of allocation by sub-band, in runs of (bits, sub-bands), for the tables B.2a to B.2d and LSF.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "lsf": ((4, 4), (3, 7), (2, 19)),
}
OWNER = b"junctura\0"


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The CRC of frame headers: polynomial x^16 + x^15 + x^2 + 1, from all ones. bits: how many of the data's count."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        crc ^= byte << 8
        for i in range(8):
            if i == left:  # what was put in beyond the last bit comes out again
                return (crc ^ (byte << 8 + i)) & 0xFFFF
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        left -= 8
        if left <= 0:
            break
    return crc


class Head(NamedTuple):
    """What a frame's header says. bound: the first sub-band of a joint stereo frame that both channels share, 32 without."""

    size: int
    samples: int
    hertz: int
    side: int
    crc: bool
    version: int
    layer: int
    kbits: int
    channels: int
    bound: int


@lru_cache(4096)
def header(four: bytes) -> Head | None:
    """None if this is no header."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    one, hz, mode = version == 3, HERTZ[version][hertz], four[3] >> 6
    kbits, samples, pad = KBITS[one, layer][rate - 1], SAMPLES[one, layer], four[2] >> 1 & 1
    size = (12000 * kbits // hz + pad) * 4 if layer == 1 else samples * 125 * kbits // hz + pad
    bound = 4 * (1 + (four[3] >> 4 & 3)) if mode == 1 else 32
    return Head(size, samples, hz, SIDE[one, mode == 3] if layer == 3 else 0, not four[1] & 1, version, layer, kbits, 1 if mode == 3 else 2, bound)


def checked_bits(h: Head, after: bytes) -> int:
    """How many bits after the CRC it covers, besides the header's last two bytes; ``after`` are the bytes there.

    Side information in Layer III, the allocation of bits in Layer I, and in Layer II also the selection of scale factors,
    two bits for each sub-band and channel that has an allocation.
    """
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        bound = min(h.bound, 32)
        return 4 * (32 if h.channels == 1 else bound * 2 + 32 - bound)
    each = h.kbits // h.channels
    if h.version != 3:
        table = "lsf"
    elif each < 56:
        table = "d" if h.hertz == 32000 else "c"
    else:
        table = "a" if h.hertz == 48000 or each <= 80 else "b"
    widths = [bits for bits, n in ALLOCATION[table] for _ in range(n)]
    text, at, used = int.from_bytes(after[:64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(widths):
        shared = h.channels == 2 and band >= h.bound
        for _ in range(1 if shared else h.channels):
            value = text >> 512 - at - width & (1 << width) - 1
            used += (h.channels if shared else 1) * (value > 0)
            at += width
    return at + 2 * used


def synced(data: bytes, at: int, end: int) -> int:
    """The next place from at on where a frame begins that one of its kind, or the end, follows; end if there is none."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        h = header(data[at : at + 4])
        if h and at + h.size <= end:
            follows = header(data[at + h.size : at + h.size + 4])
            if at + h.size == end or follows and follows[5:7] == h[5:7]:
                return at
        at += 1
    return end


def sevens(n: int, size: int) -> bytes:
    """A number in bytes of seven bits."""
    return bytes(n >> 7 * i & 127 for i in range(size - 1, -1, -1))


def unsevens(data: bytes) -> int:
    n = 0
    for x in data:
        n = n << 7 | x
    return n


def id3(frames: bytes) -> bytes:
    extended = sevens(12, 4) + b"\x01\x20\x05" + sevens(zlib.crc32(frames), 5)
    return b"ID3\x04\x00\x40" + sevens(len(extended) + len(frames), 4) + extended + frames


def joined(data: bytes, unsynchronised: bool) -> bytes:
    """The bytes without those that keep a reader from taking them for a frame's header."""
    return data.replace(b"\xff\0", b"\xff") if unsynchronised else data


def read_id3(data: bytes) -> tuple[int, dict[str, bytes], bool | None]:
    """(bytes of the tag, its frames by name, whether its CRC-32 holds: None if it has none)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}, None
    four, whole = data[3] == 4, bool(data[5] & 0x80)
    end, at, good = 10 + unsevens(data[6:10]), 0, None
    body = joined(data[10:end], whole and not four)
    if four and data[5] & 0x40:
        at = unsevens(body[:4])
        if body[5] & 0x20:
            good = unsevens(body[7:12]) == zlib.crc32(body[at:])
    elif data[3] == 3 and data[5] & 0x40:
        size = int.from_bytes(body[:4], "big")
        at = 4 + size
        if size >= 10 and body[4] & 0x80:
            good = int.from_bytes(body[10:14], "big") == zlib.crc32(body[at : len(body) - int.from_bytes(body[6:10], "big")])
    found: dict[str, bytes] = {}
    number = unsevens if four else lambda x: int.from_bytes(x, "big")
    while at + 10 <= len(body) and body[at]:
        size, flags = number(body[at + 4 : at + 8]), body[at + 9]
        value = joined(body[at + 10 : at + 10 + size], four and (whole or bool(flags & 2)))
        found.setdefault(body[at : at + 4].decode("latin-1"), value[4:] if four and flags & 1 else value)
        at += 10 + size
    return end + 10 * bool(four and data[5] & 0x10), found, good


def seek_table(frame: bytes, main: int) -> dict | None:
    """What a frame without sound says of the whole stream: kind, frames, bytes and places to seek; None if it is audio.

    toc: 100 shares of the bytes in 256ths for Xing and Info; for VBRI the bytes of equal numbers of frames.
    """
    if frame[main : main + 4] in (b"Xing", b"Info") and len(frame) >= main + 8:
        flags, at, numbers = int.from_bytes(frame[main + 4 : main + 8], "big"), main + 8, []
        for bit in (1, 2):
            numbers.append(int.from_bytes(frame[at : at + 4], "big") if flags & bit else None)
            at += 4 * bool(flags & bit)
        return {"kind": frame[main : main + 4].decode(), "frames": numbers[0], "bytes": numbers[1], "toc": list(frame[at : at + 100]) if flags & 4 else []}
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, count, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        toc = [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(entries)]
        return {"kind": "VBRI", "frames": count, "bytes": size, "toc": toc}
    return None


def _silent(kbits: int, crc: bool) -> bytes:
    two = bytes([(KBITS[True, 3].index(kbits) + 1) << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    return b"\xff\xfa" + two + crc16(two + side).to_bytes(2, "big") + side if crc else b"\xff\xfb" + two + side


_HEADS = {9 * k // 2 - 23: _silent(k, True) for k in KBITS[True, 3]}  # by the bytes that a frame has room for
_MOST = max(_HEADS)


def encode(payload: bytes, n_bytes: int | None = None) -> bytes:
    """The payload as an MPEG audio stream. n_bytes: how many of its bytes are no padding."""
    cut = [payload[i : i + _MOST] for i in range(0, len(payload), _MOST)]
    frames = []
    for part in cut:
        room = _MOST if len(part) == _MOST else min(r for r in _HEADS if r >= len(part))
        frames.append(_HEADS[room] + part + bytes(room - len(part)))
    sizes = [len(x) for x in frames]
    body = b"".join(frames)
    first = _silent(32, False)
    total = 144 + len(body)
    starts, at = [], 144
    for s in sizes:
        starts.append(at)
        at += s
    toc = bytes(min(255, starts[i * len(starts) // 100] * 256 // total) if starts else 0 for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    private = OWNER + struct.pack(">QQI", len(payload) if n_bytes is None else n_bytes, len(payload), zlib.crc32(payload))
    tag = id3(b"PRIV" + sevens(len(private), 4) + b"\0\0" + private)
    return tag + first + xing + bytes(144 - len(first) - len(xing)) + body


def decode(data: bytes) -> dict:
    """What a stream says and holds: frames, samples by rate, offsets of the frames, checksums, tags, table and payload.

    A frame counts where one of its kind, or the end, follows, or where it follows one of its kind; bytes that belong to
    no frame are passed over (skipped). The payload is what this module's frames carry, None in other streams; samples
    leave out the frame of the table.
    """
    at, tags, tag_ok = read_id3(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    offsets, parts, rates, skipped, good, checked, table, kind = [], [], {}, 0, 0, 0, None, None
    while at < end:
        h = header(data[at : at + 4])
        if h is None or at + h.size > end or (h[5:7] != kind and synced(data, at, end) != at):
            to = synced(data, at + 1, end)
            skipped += to - at
            at, kind = to, None
            continue
        kind, frame = h[5:7], data[at : at + h.size]
        main = 4 + 2 * h.crc + h.side
        if not offsets and table is None and (found := seek_table(frame, main)):
            table = found | {"at": at}
            at += h.size
            continue
        if h.crc:
            bits = checked_bits(h, frame[6:])
            checked += 1
            good += crc16(frame[2:4] + frame[6 : 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(frame[4:6], "big")
        offsets.append(at)
        parts.append(frame[main:])
        rates[h.hertz] = rates.get(h.hertz, 0) + h.samples
        at += h.size
    out = {"frames": len(offsets), "rates": rates, "duration": sum((Fraction(n, hz) for hz, n in rates.items()), Fraction(0)), "offsets": offsets, "skipped": skipped, "crc_checked": checked, "crc_good": good, "tags": tags, "tag_ok": tag_ok, "table": table, "payload": None, "n_bytes": None}
    if (private := tags.get("PRIV", b"")).startswith(OWNER):
        out["n_bytes"], size, crc = struct.unpack(">QQI", private[len(OWNER) :])
        payload = b"".join(parts)[:size]
        if len(payload) != size or zlib.crc32(payload) != crc:
            raise ValueError("the stream doesn't hold the payload that its tag states")
        out["payload"] = payload
    return out


def padded(data: bytes, unit: int = 64) -> bytes:
    """data and bytes 0 up to a multiple of the unit, one unit at least."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A table (id, media) in the shared folder: each text, padded, as an MPEG stream.

    Null texts count as empty, which gives one unit of padding; long texts make long streams. Repeated rows are stored
    each for itself, equal texts alike. Other columns are not read, whatever their names. An empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(padded(x), len(x)) for x in raw], pa.binary())], names=[id_column, "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(column(id_column), text_of(text_column).alias("_text"))
    return stored(rows.mapInArrow(run, f"`{id_column}` {kind}, media binary"), "mpeg")


#: Columns of describe(), with their types.
DESCRIBED = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "frames": "long",
    "duration_samples": "long", "sample_rate": "long", "duration_numerator": "long", "duration_denominator": "long", "crc_checked": "long", "crc_good": "long", "skipped_bytes": "long",
    "table_kind": "string", "table_ok": "boolean", "seek_places": "array<long>", "tag_ok": "boolean", "tags": "array<string>", "frame_offsets": "array<long>",
}


def row_of(data: bytes | None) -> tuple:
    """The values of DESCRIBED."""
    data = data or b""
    x = decode(data)
    p, t, rates = x["payload"], x["table"], x["rates"]
    table_ok = t["frames"] == x["frames"] and (t["bytes"] is None or t["at"] + t["bytes"] <= len(data)) if t and t["frames"] is not None else None
    own = (x["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) if p is not None else (None,) * 4
    time = (sum(rates.values()), next(iter(rates)) if len(rates) == 1 else None, x["duration"].numerator, x["duration"].denominator)
    return (
        *own, len(data), hashlib.sha256(data).hexdigest(), x["frames"], *time, x["crc_checked"], x["crc_good"], x["skipped"],
        t and t["kind"], table_ok, t["toc"] if t else [], x["tag_ok"], sorted(x["tags"]), x["offsets"],
    )


def describe(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row per row of media: what its stream says, exact durations and frame offsets, and digests of its bytes.

    duration_numerator / duration_denominator is the duration in seconds, exactly, also where the rate changes;
    sample_rate is null then. frame_offsets has the first byte of each audio frame, seek_places what a Xing, Info or VBRI
    table says, tags the names of the tag's frames. Null and foreign media are read as far as frames are found; their
    payload columns are null. Equal media, and so repeated rows, get equal values; long media are read whole. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[row_of(v.as_py()) for v in batch.column(1)], strict=True)) or [[] for _ in DESCRIBED]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, arrow[t]) for c, t in zip(cols, DESCRIBED.values(), strict=True)]], names=[id_column, *DESCRIBED])

    kind = media.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, " + ", ".join(f"{n} {t}" for n, t in DESCRIBED.items())
    return media.select(column(id_column), column(media_column)).mapInArrow(run, schema)
