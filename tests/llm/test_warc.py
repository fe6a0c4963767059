import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from junctura.llm import queries, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("_html", "_digest", "_first", "_d", "archive", "part", "data", "page", "index", "a.b")})


ROWS = [
    (5, "http://a/x y", "<p>" + "q" * 200),
    (3, None, "<p>" + "q" * 200),
    (3, "http://again", "<p>" + "q" * 200),
    (1, "http://short", "tiny"),
    (2, "http://short", "tiny"),
    (7, "http://null", None),
    (8, "http://é", ""),
    (9, "http://long", "é" * 300_000),
    (None, "http://noid", "<p>" + "q" * 200),
]


def brute(rows):
    first = defaultdict(list)
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h].append(i)
    out = []
    for i, _, h in rows:
        to = min(first[h]) if first.get(h) else None
        revisit = to is not None and i != to
        data = (h or "").encode()
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    table = pages(spark, ROWS)
    archives, sidecar = warc.archive_pages(table)
    number = lambda x: None if x is None else int(x)
    for most in (1_000_000, 0):  # both ways of reading
        got = warc.read_members(archives, sidecar, most).collect()
        assert sorted(((number(r.page), r.payload_bytes, r.digest, r.record_type, number(r.refers_to)) for r in got), key=repr) == brute(ROWS)
    check_members(archives, sidecar)


def check_members(archives, sidecar):
    whole = defaultdict(bytes)
    for r in sorted(archives.collect(), key=lambda r: (r.archive, r.part)):
        whole[r.archive] += r.data
    for name, data in whole.items():
        own = sorted((x.offset, x.length) for x in sidecar.where(F.col("archive") == name).collect())
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        for at, n in own:
            assert zlib.decompress(data[at : at + n], 31).startswith(b"WARC/1.")
        assert gzip.decompress(data).count(b"WARC-Record-ID") == len(own)


def test_pieces_are_bounded(spark):
    rows = [(i, f"http://{i}", random.Random(i).randbytes(40_000).hex()) for i in range(150)]
    archives, sidecar = warc.normalise(warc.write_archives(pages(spark, rows).repartition(1), archive_bytes=64 << 20))
    assert archives.count() > 1 and archives.select("archive").distinct().count() == 1
    assert {len(r.data) < (5 << 20) for r in archives.collect()} == {True}
    check_members(archives, sidecar)
    assert sorted(int(r.page) for r in warc.read_members(archives, sidecar).collect()) == list(range(150))


def test_files_of_any_size(spark, tmp_path):
    one = warc.record("1", "http://x", b"hello\n\xff\r\nworld", hashlib.sha256(b"hello\n\xff\r\nworld").hexdigest(), None, "2020-01-01T00:00:00Z")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one * 5))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    archives, sidecar = warc.normalise(warc.read_lines(spark, str(tmp_path)), packed=False)
    assert sorted(r.n for r in sidecar.groupBy("archive").agg(F.count("*").alias("n")).collect()) == [2, 5]
    assert {bytes(r.payload) for r in warc.read_members(archives, sidecar).collect()} == {b"hello\n\xff\r\nworld"}
    check_members(archives, sidecar)


def test_nothing(spark):
    archives, sidecar = warc.archive_pages(pages(spark, []))
    assert warc.read_members(archives, sidecar).count() == 0 and sidecar.count() == 0


def test_foreign_archives(spark):
    one = warc.record("1", "http://x", b"hello", hashlib.sha256(b"hello").hexdigest(), None, "2020-01-01T00:00:00Z")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [("whole", gzip.compress(info + one * 3)), ("members", b"".join(gzip.compress(x) for x in (info, one))), ("empty", gzip.compress(b""))]
    _, sidecar = warc.normalise(spark.createDataFrame(rows, "archive string, data binary"))
    assert {r.archive: r.n for r in sidecar.groupBy("archive").agg(F.count("*").alias("n")).collect()} == {"whole": 4, "members": 2}
    cut = spark.createDataFrame([("cut", gzip.compress(one)[:-20])], "archive string, data binary")
    with pytest.raises(Exception, match="cut short"):
        warc.normalise(cut)


def test_query(spark, sf, same_as_sql):
    same_as_sql(queries.QUERIES["op5_warc"](spark, sf), queries.SQL["op5_warc"])


def test_both_ways_of_finding_first_copies(spark):
    table = pages(spark, ROWS)
    one, two = (sorted(((r._id, r._first, r._digest) for r in warc.decide(table, "page_id", "url", "html", 100, most).collect()), key=repr) for most in (500_000, 0))
    assert one == two
