import random
import struct

import pytest
from pyspark.sql import functions as F

from junctura.sources import bam, tables

REFS = [("chr1", 1_000_000), ("chrX", 50_000)]
COLUMNS = ["read_name", "flag", "chrom", "pos", "mapq", "cigar", "seq", "tags"]


def some_rows(n, long=0):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        k = long if long and i % 7 == 3 else rnd.randrange(1, 150)
        seq = "".join(rnd.choice("ACGTN") for _ in range(k))
        tags = [f"NM:i:{rnd.randrange(-5, 9)}", "XA:A:q", f"SA:Z:chrX,{i},+,5S9M,60,1;", "XB:B:s,1,-2,300", "XF:f:0.5", "XH:H:1AE3", "XU:i:4000000000"][: rnd.randrange(8)]
        rows.append((f"r{i}", rnd.choice([0, 4, 16, 2048]), rnd.choice(["chr1", "chrX"]), rnd.randrange(1, 50_000), rnd.randrange(61), f"{k}M", seq, tags))
    rows += [("open", 4, "*", 0, 0, "*", "*", []), ("gone", 4, "*", 0, 0, "*", "ACG", []), ("odd", 0, "chr1", 1_000_000, 255, "1S2=1X3I4D5N2H1P", "ACGTACG", [])]
    return rows


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("split", [777, 20_000, 65_536, 1 << 25])
def test_bam_of_any_split(spark, tmp_path, split):
    rows = some_rows(3000)
    df = spark.createDataFrame(rows, "read_name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, tags array<string>").repartition(2)
    bam.write_bam(df, str(tmp_path / "x"), REFS)
    got = bam.read_bam(spark, str(tmp_path / "x"), split)
    assert as_rows(got) == sorted(rows)
    assert got.rdd.getNumPartitions() > 2 or split > 65_536
    assert got.select("sample").distinct().count() == 2


def test_records_longer_than_splits(spark, tmp_path):
    rows = some_rows(60, long=300_000)
    df = spark.createDataFrame(rows, "read_name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, tags array<string>").coalesce(1)
    bam.write_bam(df, str(tmp_path / "x"), REFS)
    assert as_rows(bam.read_bam(spark, str(tmp_path / "x"), 30_000)) == sorted(rows)


def test_as_its_sam(spark, tmp_path):
    lines = spark.createDataFrame([("\t".join([n, str(f), c, str(p), str(m), g, "*", "0", "0", s, "*", *t]),) for n, f, c, p, m, g, s, t in some_rows(500)], "value string")
    sam = tables.parse_sam(lines)
    bam.write_bam(sam, str(tmp_path / "x"), REFS)
    bam.write_bam(sam, str(tmp_path / "x"), REFS, "overwrite")
    assert as_rows(bam.read_bam(spark, str(tmp_path / "x"), 5000)) == as_rows(sam)


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([], "read_name string, flag int, chrom string, pos long, mapq int, cigar string, seq string, tags array<string>")
    bam.write_bam(df.union(spark.createDataFrame([(None, None, None, None, None, None, None, None)], df.schema)), str(tmp_path / "x"), REFS)
    assert as_rows(bam.read_bam(spark, str(tmp_path / "x"))) == [("*", 0, "*", 0, 255, "*", "*", [])]
    bam.write_bam(df, str(tmp_path / "y"), [(f"contig{i}", 10) for i in range(20_000)])  # a header over many splits
    assert bam.read_bam(spark, str(tmp_path / "y"), 20_000).count() == 0
    with pytest.raises(Exception, match="nothing"):
        bam.read_bam(spark, str(tmp_path / "nothing")).count()
    (tmp_path / "cut.bam").write_bytes(bam.packed_block(bam.MAGIC + struct.pack("<ii", 0, 0) + struct.pack("<i", 500)))
    with pytest.raises(Exception, match="ends within a record"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).count()


def test_many_cigar_parts():
    class Row:
        read_name, flag, chrom, pos, mapq, cigar, seq, tags = "x", 0, "chr1", 5, 9, "1M1I" * 40_000, "A" * 80_000, ["NM:i:1"]

    got = bam.record_row(bam.row_record(Row, {"chr1": 0}), "s", REFS)
    assert got == ("s", "x", 0, "chr1", 5, 9, Row.cigar, Row.seq, ["NM:i:1"])


def test_regions(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(f"r{i}", rnd.choice(["chr1", "chr2"]), 7000 if i % 3 == 0 else rnd.randrange(1, 100_000), rnd.choice(["50M", "20M5000N30M", "10S4=3X2D1I5M", "*", None])) for i in range(4000)]
    rows += [("none", None, None, None), ("none", "chr1", None, "5M")]
    df = spark.createDataFrame(rows, "read_name string, chrom string, pos long, cigar string")
    tables.write_sorted(df, str(tmp_path / "s"), 16)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "s/rows")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 700  # a third of all reads begin at one place

    span = {"50M": 50, "20M5000N30M": 5050, "10S4=3X2D1I5M": 14, "*": 1, None: 1}
    for chrom, start, end in [("chr1", 7000, 7000), ("chr2", 30_000, 31_000), ("chr1", 1, 100_000), ("chr3", 1, 9), ("chr1", 200_000, 300_000)]:
        got = tables.read_region(spark, str(tmp_path / "s"), chrom, start, end)
        want = [r for r in rows if r[1] == chrom and r[2] is not None and r[2] <= end and r[2] + span[r[3]] > start]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert len(tables.read_region(spark, str(tmp_path / "s"), "chr2", 80_000, 80_100).inputFiles()) <= 3
