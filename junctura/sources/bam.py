"""BAM files as a data source of Spark: read in splits of any size, written as a file for each partition.

A file is a row of BGZF blocks, gzip members that state their size. A split has the records that begin in the blocks that
begin in it. Paths are those that Arrow's file systems open (local folders, HDFS, object stores).
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "sample string, read_name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, tags array<string>"
ARROW = pa.schema([("sample", pa.string()), ("read_name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("tags", pa.list_(pa.string()))])

#: Fixed values of the format: CIGAR letters and sequence letters by code, number types of tags, bins by level.
OPS = "MIDNSHP=X"
LETTERS = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
MAGIC, GZIP, HEAD = b"BAM\1", b"\x1f\x8b\x08\x04", struct.Struct("<iiiBBHHHiiii")

_TO_LETTERS = str.maketrans("0123456789abcdef", LETTERS)
_TO_DIGITS = {ord(c): f"{i:x}" for i, c in enumerate(LETTERS)}
_BLOCK = 65_280


def block_size(data: bytes, at: int) -> int:
    """Bytes of the BGZF block that begins here; 0 if none does, or its head isn't all there."""
    if data[at : at + 4] != GZIP or len(data) < at + 12:
        return 0
    i, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while i + 6 <= min(end, len(data)):
        if data[i : i + 4] == b"BC\2\0":
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + struct.unpack_from("<H", data, i + 2)[0]
    return 0


def first_block(f: pa.NativeFile, start: int) -> int | None:
    """Where the first block from here on begins, told by its head and its checksum; None if there is none."""
    f.seek(start)
    data = f.read(2 << 16)
    at = data.find(GZIP)
    while 0 <= at < 1 << 16:
        size = block_size(data, at)
        if size and at + size <= len(data):
            try:
                zlib.decompress(data[at : at + size], 31)
                return start + at
            except zlib.error:
                pass
        at = data.find(GZIP, at + 1)
    return None


def blocks(f: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of the blocks from one on."""
    f.seek(at)
    data, i = b"", 0
    while True:
        if len(data) - i < 1 << 16:
            data, i = data[i:] + f.read(1 << 20), 0
        if i == len(data):
            return
        size = block_size(data, i)
        if not size or i + size > len(data):
            raise ValueError(f"no whole BGZF block at byte {at}")
        yield at, zlib.decompress(data[i : i + size], 31)
        i, at = i + size, at + size


class Window:
    """Inflated bytes of a file from a block on, as far as asked for; ``stop`` is where the blocks of later splits begin."""

    def __init__(self, f: pa.NativeFile, at: int, end: int):
        self.more, self.end, self.data, self.base, self.stop = blocks(f, at), end, bytearray(), 0, None
        self.starts: list[tuple[int, int]] = []

    def get(self, u: int, n: int) -> bytes:
        """n bytes from place u on, fewer at the end of the file."""
        while self.base + len(self.data) < u + n:
            offset, letters = next(self.more, (None, b""))
            if self.stop is None and (offset is None or offset >= self.end):
                self.stop = self.base + len(self.data)
            if offset is None:
                break
            self.starts.append((self.base + len(self.data), offset))
            self.data += letters
        return bytes(self.data[u - self.base : u - self.base + n])

    def block_of(self, u: int) -> int:
        """Where in the file the block that has place u begins."""
        self.get(u, 1)
        return max(offset for place, offset in self.starts if place <= u)

    def forget(self, u: int) -> None:
        if u - self.base > 1 << 20:
            del self.data[: u - self.base]
            self.base = u


def header(w: Window) -> tuple[list[tuple[str, int]], int]:
    """The references (name, length), and where the first record begins in a window from byte 0 on."""
    if w.get(0, 4) != MAGIC:
        raise ValueError("not a BAM file")
    u = 8 + struct.unpack("<i", w.get(4, 4))[0]
    (n,) = struct.unpack("<i", w.get(u, 4))
    u, found = u + 4, []
    for _ in range(n):
        (k,) = struct.unpack("<i", w.get(u, 4))
        x = w.get(u + 4, k + 4)
        found.append((x[: k - 1].decode(), struct.unpack("<i", x[k:])[0]))
        u += 8 + k
    return found, u


def next_record(w: Window, u: int, references: list[tuple[str, int]]) -> int | None:
    """Where the record behind the one at u begins, None if there can be no record at u."""
    head = w.get(u, HEAD.size)
    if len(head) < HEAD.size:
        return None
    size, ref, pos, k, _, _, n, _, letters, mate, mate_pos, _ = HEAD.unpack(head)
    inside = all(-1 <= r < len(references) and -1 <= p <= (references[r][1] if r >= 0 else 1 << 31) for r, p in ((ref, pos), (mate, mate_pos)))
    if not inside or k < 2 or letters < 0 or size < 32 + k + 4 * n + (letters + 1) // 2 + letters:
        return None
    name = w.get(u + HEAD.size, k)
    if len(name) < k or name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    cigar = w.get(u + HEAD.size + k, 4 * n)
    if len(cigar) < 4 * n or any(c & 15 >= len(OPS) for c in cigar[::4]):
        return None
    return u + 4 + size


def first_record(w: Window, references: list[tuple[str, int]], chain: int = 8) -> int | None:
    """The first place from which so many records, or all up to the end of the file, follow one another; None if the split has none."""
    u = w.base
    while w.get(u, 1) and (w.stop is None or u < w.stop):
        v, n = next_record(w, u, references), 1
        while v is not None and n < chain and w.get(v, 1):
            v, n = next_record(w, v, references), n + 1
        if v is not None:
            return u
        u += 1
    return None


def _number(x: float) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


def tags_of(data: bytes) -> list[str]:
    """The tags as SAM writes them."""
    found, i = [], 0
    while i + 3 < len(data):
        name, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind == "A":
            value, i = chr(data[i]), i + 1
        elif kind in "ZH":
            j = data.index(0, i)
            value, i = data[i:j].decode(errors="replace"), j + 1
        elif kind == "B":
            sub, (n,) = chr(data[i]), struct.unpack_from("<i", data, i + 1)
            form = struct.Struct(f"<{n}{NUMBERS[sub]}")
            value, i = ",".join([sub, *map(_number, form.unpack_from(data, i + 5))]), i + 5 + form.size
        else:
            form = struct.Struct(f"<{NUMBERS[kind]}")
            value, i, kind = _number(form.unpack_from(data, i)[0]), i + form.size, "f" if kind == "f" else "i"
        found.append(f"{name}:{kind}:{value}")
    return found


def record_row(data: bytes, sample: str, references: list[tuple[str, int]]) -> tuple:
    """A row of SCHEMA of a record with its size in front."""
    _, ref, pos, k, mapq, _, n, flag, letters, _, _, _ = HEAD.unpack_from(data)
    at = HEAD.size + k
    ops = struct.unpack_from(f"<{n}I", data, at)
    name, packed = data[HEAD.size : at - 1].decode(), (letters + 1) // 2
    at += 4 * n
    seq = data[at : at + packed].hex().translate(_TO_LETTERS)[:letters]
    tags = tags_of(data[at + packed + letters :])
    if n == 2 and ops[0] == letters << 4 | OPS.index("S") and ops[1] & 15 == OPS.index("N"):  # a CIGAR of over 65,535 parts is a tag
        long = next((t for t in tags if t.startswith("CG:B:I,")), None)
        if long:
            tags.remove(long)
            ops = [int(x) for x in long[7:].split(",")]
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops)
    return sample, name, flag, references[ref][0] if ref >= 0 else "*", pos + 1, mapq, cigar or "*", seq or "*", tags


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", 32 << 20))

    def partitions(self) -> list[Split]:
        system, path = _opened(self.path)
        found = system.get_file_info(path)
        if found.type == files.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == files.FileType.Directory:
            listed = [x for x in system.get_file_info(files.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith(".bam") and not x.base_name.startswith((".", "_"))]
        else:
            listed = [found]
        return [Split(x.path, i, min(i + self.split, x.size)) for x in sorted(listed, key=lambda x: x.path) for i in range(0, x.size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        sample = partition.path.rsplit("/", 1)[-1].removesuffix(".bam")
        with system.open_input_file(partition.path) as f:
            w = Window(f, 0, partition.end)
            references, u = header(w)
            if partition.start:
                at = first_block(f, partition.start)
                if at is None or at >= partition.end:
                    return
                if at > w.block_of(u):  # else this split begins within the header
                    w = Window(f, at, partition.end)
                    u = first_record(w, references)
                    if u is None:
                        return
            rows, held = [], 0
            while (head := w.get(u, 4)) and (w.stop is None or u < w.stop):
                size = 4 + struct.unpack("<i", head)[0] if len(head) == 4 else 4
                data = w.get(u, size)
                if len(data) < size:
                    raise ValueError(f"{partition.path} ends within a record")
                rows.append(record_row(data, sample, references))
                u, held = u + size, held + size
                w.forget(u)
                if len(rows) == 4096 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def _opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _tag(text: str) -> bytes:
    name, kind, value = text.split(":", 2)
    head = name.encode() + kind.encode()
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value.encode()[:1]
    if kind == "B":
        sub, *values = value.split(",")
        return head + sub.encode() + struct.pack(f"<i{len(values)}{NUMBERS[sub]}", len(values), *[float(x) if sub == "f" else int(x) for x in values])
    if kind == "f":
        return head + struct.pack("<f", float(value))
    x = int(value)
    return name.encode() + (b"i" + struct.pack("<i", x) if x < 1 << 31 else b"I" + struct.pack("<I", x))


def _ops(cigar: str) -> list[int]:
    found, n = [], 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            found.append(n << 4 | OPS.index(c))
            n = 0
    return found


def row_record(row, places: dict[str, int]) -> bytes:
    """A record, its size in front, of a row with the columns of SCHEMA; qualities are left open, mates are unknown."""
    none = lambda x: None if x in (None, "*") else x
    ops, seq = _ops(none(row.cigar) or ""), none(row.seq) or ""
    tags = b"".join(_tag(t) for t in row.tags or [])
    span = sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X")
    ref, pos = places[row.chrom] if none(row.chrom) else -1, (row.pos or 0) - 1
    level = next((first + (pos >> shift) for shift, first in BINS if pos >> shift == (pos + max(span, 1) - 1) >> shift), 0) if pos >= 0 else 4680
    if len(ops) > 65_535:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | OPS.index("S"), span << 4 | OPS.index("N")]
    digits = "".join(_TO_DIGITS.get(ord(c), "f") for c in seq.upper())
    body = (row.read_name or "*").encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes.fromhex(digits + "0" * (len(digits) % 2)) + b"\xff" * len(seq) + tags
    name = len((row.read_name or "*").encode()) + 1
    return HEAD.pack(32 + len(body), ref, pos, name, row.mapq if row.mapq is not None else 255, level & 0xFFFF, len(ops), row.flag or 0, len(seq), -1, -1, 0) + body


def packed_block(data: bytes) -> bytes:
    """A BGZF block of at most 65,280 bytes; that of none ends a file."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return GZIP + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    path: str


class BamWriter(DataSourceWriter):
    """A file for each partition, under a name of its own until all are written."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.references = json.loads(options["references"])

    def write(self, iterator) -> Written:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        path = f"{folder}/_{uuid.uuid4().hex}.bam"
        places = {name: i for i, (name, _) in enumerate(self.references)}
        text = "@HD\tVN:1.6\tSO:unknown\n" + "".join(f"@SQ\tSN:{name}\tLN:{length}\n" for name, length in self.references)
        data = bytearray(MAGIC + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(places)))
        for name, length in self.references:
            data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
        with system.open_output_stream(path) as out:
            for record in itertools.chain((row_record(row, places) for row in iterator), (b"",)):
                data += record
                while len(data) >= _BLOCK:
                    out.write(packed_block(bytes(data[:_BLOCK])))
                    del data[:_BLOCK]
            out.write((packed_block(bytes(data)) if data else b"") + packed_block(b""))
        return Written(path)

    def commit(self, messages) -> None:
        system, folder = _opened(self.path)
        if self.overwrite:
            for x in system.get_file_info(files.FileSelector(folder, allow_not_found=True)):
                if x.is_file and x.path.endswith(".bam") and not x.base_name.startswith("_"):
                    system.delete_file(x.path)
        for m in messages:
            if m is not None:
                head, name = m.path.rsplit("/", 1)
                system.move(m.path, f"{head}/part-{name[1:]}")

    def abort(self, messages) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class BamSource(DataSource):
    """spark.read.format("bam").load(path), df.write.format("bam").option("references", json).save(path)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options, overwrite)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """The columns of tables.read_sam of a BAM file, or of the ``.bam`` files in a folder; the sample is the file's name.

    A split that begins within a file takes as its first record the first place from which eight records, or all up to the
    end, follow one another with references, places, names and CIGARs that can be. Records may be of any length.
    """
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("splitBytes", split_bytes).load(path)


def write_bam(rows: DataFrame, path: str, references: list[tuple[str, int]], mode: str = "append") -> None:
    """Writes (read_name, flag, chrom, pos, mapq, cigar, seq, tags) into a folder, a file for each partition.

    Null or ``*`` chrom, cigar and seq are as in SAM. Names in chrom must be among the references (name, length). Letters of
    seq that the format lacks become N.
    """
    rows.sparkSession.dataSource.register(BamSource)
    columns = ["read_name", "flag", "chrom", "pos", "mapq", "cigar", "seq", "tags"]
    rows.select(*columns).write.format("bam").option("references", json.dumps(references)).mode(mode).save(path)
