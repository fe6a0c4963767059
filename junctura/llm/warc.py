"""WARC archives of web pages, and a normaliser for archives that are one gzip stream.

Archives are tables (archive, part, data) of pieces in order, so Spark's commit protocol writes them, any store that Spark
reaches holds them, and no row holds more than a piece. The normaliser inflates each archive's stream once, in blocks,
rewrites every record as a gzip member of its own and writes a sidecar index with each member's offset and length, by
which single records are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, small, stored, text_of

_BLOCK = 1 << 20
_PART = 4 << 20


def decide(pages: DataFrame, id_column: str, url_column: str, html_column: str, least_bytes: int, broadcast_groups: int = 500_000) -> DataFrame:
    """(_id, _url, _html, _digest, _first) of pages; _first: the smallest id with an equal payload of least_bytes or more."""
    rows = pages.select(column(id_column).alias("_id"), column(url_column).alias("_url"), text_of(html_column).alias("_html")).withColumn("_digest", F.sha2("_html", 256))
    same = (
        rows.where(F.octet_length("_html") >= least_bytes).groupBy(F.col("_digest").alias("_d"))
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d", "_first")
    )
    same = checkpoint(same)
    if same.count() <= broadcast_groups:
        same = F.broadcast(same)
    return rows.join(same, rows["_digest"] == same["_d"], "left").drop("_d")


def record(page: str | None, url: str | None, html: bytes, digest: str, first: str | None, date: str) -> bytes:
    """A response record, or a revisit record if there is an id to refer to: its HTTP headers stand without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if first is not None else http + html
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{quote(page or '', safe='')}>",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{quote(first, safe='')}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    least_bytes: int = 100,
    archive_bytes: int = 4 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """(archive, part, data): a record for each row of pages, in archives that are one gzip stream each, cut to pieces.

    An archive is closed when it has archive_bytes before compression; a longer page makes a longer one.
    Of pages with equal payloads of at least least_bytes, those with the smallest id are responses (rows that repeat that
    id all are), others revisit it. Null payloads are empty. A page without an id is written, but isn't referred to.
    Other columns are not read, whatever their names. An empty table makes no archives.
    """
    rows = decide(pages, id_column, url_column, html_column, least_bytes)
    first = F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first").cast("string"))
    rows = rows.select(F.col("_id").cast("string").alias("a"), F.col("_url").cast("string").alias("b"), F.col("_html").alias("c"), F.col("_digest").alias("d"), first.alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, part = TaskContext.get().partitionId(), 0, 0
        packer, out, size, held = zlib.compressobj(1, wbits=31), [], 0, 0

        def put(last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{number:06d}-{made:06d}"]), pa.array([part], pa.int32()), pa.array([b"".join([*out, packer.flush() if last else b""])], pa.binary())], names=["archive", "part", "data"])

        for batch in batches:
            for page, url, html, digest, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page, url, html.encode("utf-8", "surrogatepass"), digest, to, date)
                out.append(packer.compress(data))
                size, held = size + len(data), held + len(out[-1])
                if size >= archive_bytes:
                    yield put(True)
                    packer, out, size, held, made, part = zlib.compressobj(1, wbits=31), [], 0, 0, made + 1, 0
                elif held >= _PART:
                    yield put(False)
                    out, held, part = [], 0, part + 1
        if size:
            yield put(True)

    return stored(rows.mapInArrow(run, "archive string, part int, data binary"), "warc", "none")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) of .warc.gz files: their lines in order, inflated by Spark as it reads, so a file may be of any size.

    A gzip stream is never split, so each file's lines are in one partition; normalise(..., packed=False) takes them.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.input_file_name().alias("archive"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"))


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks of what a gzip stream in pieces holds; members that follow are read on."""
    unpacker, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            if unpacker.eof:  # what follows a member is the next one, or padding
                piece = piece.lstrip(b"\0")
                if not piece:
                    break
                unpacker = zlib.decompressobj(31)
            begun = True
            block = unpacker.decompress(piece, _BLOCK)
            yield block
            piece = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            while len(block) == _BLOCK and not piece and not unpacker.eof:
                block = unpacker.decompress(b"", _BLOCK)
                yield block
                piece = unpacker.unused_data
    if begun and not unpacker.eof:
        raise ValueError("the gzip stream is cut short")


def fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name."""
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) one by one; no more than a record and a block is held."""
    buffer = bytearray()
    need: tuple[dict[str, str], int] | None = None
    for block in blocks:
        buffer += block
        at = 0
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                named = fields(bytes(buffer[at:end]))
                need = named, end + 4 - at + int(named["content-length"]) + 4
            named, size = need
            if len(buffer) - at < size:
                break
            yield named, bytes(buffer[at : at + size])
            at, need = at + size, None
        del buffer[:at]
    if buffer.strip():
        raise ValueError("a record is cut short")


def normalise(archives: DataFrame, packed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(archives, sidecar): each record a gzip member of its own; (archive, part, record, offset, start, length) of each member.

    archives: (archive, part, data), or (archive, data) with an archive in a row; other columns are not read. offset counts
    from the archive's beginning, start from its part's. An archive without records, or an empty table, gives no rows;
    one that is cut short raises an error. packed = False: the rows are already inflated and in order (read_lines).
    """
    rows = archives
    if packed:
        rows = archives.select("archive", F.col("part") if "part" in archives.columns else F.lit(0).alias("part"), "data").repartition("archive").sortWithinPartitions("archive", "part")

    def put(name: str, part: int, members: list[bytes], index: list[dict]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("record", pa.string()), ("offset", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)], names=["archive", "part", "data", "index"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((name.as_py(), data.as_py()) for batch in batches for name, data in zip(batch.column(0), batch.column(1), strict=True))
        for name, own in groupby(pieces, lambda x: x[0]):
            blocks = (data for _, data in own if data)
            members, index, part, begin, size = [], [], 0, 0, 0
            for named, whole in records(inflate(blocks) if packed else blocks):
                packer = zlib.compressobj(1, wbits=31)
                members.append(packer.compress(whole) + packer.flush())
                index.append({"record": named.get("warc-record-id"), "offset": begin + size, "start": size, "length": len(members[-1])})
                size += len(members[-1])
                if size >= _PART:
                    yield put(name, part, members, index)
                    members, index, part, begin, size = [], [], part + 1, begin + size, 0
            if members:
                yield put(name, part, members, index)

    index = "array<struct<record:string,offset:long,start:long,length:long>>"
    done = stored(rows.select("archive", "data").mapInArrow(run, f"archive string, part int, data binary, index {index}"), "warc-members", "none")
    sidecar = stored(done.select("archive", "part", F.inline("index")), "warc-index")
    return done.select("archive", "part", "data"), sidecar


def read_members(archives: DataFrame, sidecar: DataFrame, broadcast_members: int = 1_000_000) -> DataFrame:
    """(page, url, payload, payload_bytes, digest, record_type, refers_to), each member of the sidecar read at its offset.

    A response whose payload doesn't have the digest that its header states raises an error. The payload of a revisit
    is null; its length is that of its HTTP headers. Repeated records are read each for itself; members that the sidecar
    doesn't name are not read. Empty tables give an empty result. The sidecar goes to all tasks up to
    broadcast_members; beyond that both tables are shuffled by archive and part.
    """
    schema = "page string, url string, payload binary, payload_bytes long, digest string, record_type string, refers_to string"
    places = sidecar.groupBy(F.col("archive").alias("_a"), F.col("part").alias("_p")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("index"))
    if sidecar.count() <= broadcast_members:
        places = F.broadcast(places)
    archives = archives.join(places, (F.col("archive") == F.col("_a")) & (F.col("part") == F.col("_p")))

    def name(x: str | None) -> str | None:
        return unquote(x[1:-1].removeprefix("urn:page:")) or None if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index in zip(batch.column(0), batch.column(1), strict=True):
                view, out = memoryview(data.as_buffer()), []
                for x in index.as_py():
                    whole = zlib.decompress(view[x["start"] : x["start"] + x["length"]], 31)
                    head, _, rest = whole.partition(b"\r\n\r\n")
                    named = fields(head)
                    http, _, body = rest[: int(named["content-length"])].partition(b"\r\n\r\n")
                    digest = named["warc-payload-digest"].removeprefix("sha256:")
                    payload = body if named["warc-type"] == "response" else None
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{named['warc-record-id']} doesn't have its digest")
                    length = int(fields(http).get("content-length", len(body)))
                    out.append((name(named["warc-record-id"]), named.get("warc-target-uri"), payload, length, digest, named["warc-type"], name(named.get("warc-refers-to"))))
                cols = list(zip(*out, strict=True)) or [[] for _ in range(7)]
                kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page", "url", "payload", "payload_bytes", "digest", "record_type", "refers_to"])

    return archives.select("data", "index").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 100) -> tuple[DataFrame, DataFrame]:
    """Write the pages as whole-stream archives and normalise these: (archives, sidecar)."""
    return normalise(write_archives(pages, id_column, url_column, html_column, least_bytes))
