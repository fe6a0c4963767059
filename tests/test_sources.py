import gzip
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from junctura.operators import models
from junctura.sources import predictions, sequences, tables


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">NM_777001.2 QRS9 [organism=Homo sapiens] [GeneID=12] [transcript=4]\nacgt\nACG\n\n>chr2 second\r\nTTT\r\n")
    (tmp_path / "b.fa").write_text(">only\nGG\n>empty\n")
    got = {r.name: r.seq for r in sequences.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"NM_777001.2": "ACGTACG", "chr2": "TTT", "only": "GG", "empty": ""}
    genes = sequences.anchors(sequences.read_fasta(spark, str(tmp_path / "a.fa")))
    assert {r.anchored_gene for r in genes.collect()} == {"QRS9", "chr2"}
    assert [r.anchored_gene for r in sequences.anchors(sequences.read_fasta(spark, str(tmp_path / "a.fa")), lines(spark, "QRS9  ", "", "ABL1")).collect()] == ["QRS9"]
    sequences.write_fasta(sequences.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert {r.name: r.seq for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == {"NM_777001.2": "ACGTACG", "chr2": "TTT"}


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i}/1 extra\nACGT{'A' * (i % 5)}\n+\n{'@' * (4 + i % 5)}\n" for i in range(2000))
    (tmp_path / "cell1_1.fastq").write_text(text)
    (tmp_path / "cell1_2.fastq").write_text(text)
    (tmp_path / "cell2_1.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "cell2_2.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "lone_1.fastq").write_text(text)
    (tmp_path / "mixed_1.fastq").write_text(text)
    (tmp_path / "mixed_2.fq").write_text(text)
    pairs = sequences.find_fastq_pairs(spark, str(tmp_path)).collect()
    assert sorted(p["sample"] for p in pairs) == ["cell1", "cell2"] and all("_1." in p.first and "_2." in p.second for p in pairs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")  # records divided between splits
    try:
        for name, sample in (("cell1_1.fastq", "cell1"), ("cell2_2.fq.gz", "cell2")):
            got = sequences.read_fastq(spark, str(tmp_path / name)).collect()
            assert sorted((r.read_name, len(r.seq), len(r.qual)) for r in got) == sorted((f"r{i}", 4 + i % 5, 4 + i % 5) for i in range(2000))
            assert {(r["sample"], r.mate) for r in got} == {(sample, 1 if "_1" in name else 2)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 1000])
def test_records_of_lines(size):
    """Lines in batches of any size, splits that begin and end within a record, two files behind each other."""
    table = [(f"f{f}", i, f"{f}/{i}") for f, lines in ((0, range(2, 23)), (1, range(0, 8)), (0, range(41, 43))) for i in lines]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table[i : i + size], strict=True)], names=["path", "place", "value"]) for i in range(0, len(table), size)]
    got = [tuple(r.values()) for b in sequences.records(iter(batches)) for r in b.to_pylist()]
    want = []
    for f, records in ((0, range(6)), (1, range(2)), (0, (10,))):
        own = {i for p, i, _ in table if p == f"f{f}"}
        want += [(f"f{f}", r, *[f"{f}/{4 * r + k}" if 4 * r + k in own else None for k in (0, 1, 3)], all(4 * r + k in own for k in range(4))) for r in records]
    assert got == want
    assert list(sequences.records(iter([]))) == []


def test_only_divided_records_are_shuffled(spark, tmp_path):
    rows = [f"@r{i}/1\n{'ACGT' * 10}\n+\n{'I' * 40}\n" for i in range(3000)]
    (tmp_path / "c_1.fastq").write_text("".join(rows))
    for size in ("9001", "50003", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sequences.read_fastq(spark, str(tmp_path / "c_1.fastq"))
            assert {(r.read_name, r.seq, len(r.qual)) for r in got.collect()} == {(f"r{i}", "ACGT" * 10, 40) for i in range(3000)} and got.count() == 3000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gtf(spark):
    attrs = 'gene_id "G1"; gene_name "A"; transcript_type "protein_coding";'
    table = lines(
        spark, "##comment", f"chr1\tsrc\texon\t10\t20\t.\t+\t.\t{attrs}", f"chr1\tsrc\tgene\t1\t99\t.\t-\t.\t{attrs}", 'chr1\tsrc\texon\t30\t40\t.\t+\t.\tgene_id "G2"; transcript_biotype "unprocessed_pseudogene";',
        'chr1\tsrc\texon\t50\t60\t.\t+\t.\tgene_id "G3";', "chr1\tsrc\texon\tx\t60\t.\t+\t.\tgene_id", "",
    )
    got = tables.parse_gtf(table)
    assert sorted((r.start, r.end, r.gene_id, r.gene_name) for r in tables.real_genes(got).collect()) == [(10, 20, "G1", "A"), (50, 60, "G3", "G3")]
    assert [(r.start, r.strand) for r in tables.parse_gtf(table, "gene").collect()] == [(1, "-")]


def test_alignments(spark, tmp_path):
    (tmp_path / "cellA.sam").write_text("@HD\tVN:1\nr1\t99\tchr1\t5\t60\t10M\t=\t9\t1\tACGTACGTAC\t*\tSA:Z:chr2,7,+,5S5M,60,0;\tNM:i:0\nbroken line\n")
    row = tables.read_sam(spark, str(tmp_path)).first()
    assert (row["sample"], row.read_name, row.flag, row.pos, row.tags) == ("cellA", "r1", 99, 5, ["SA:Z:chr2,7,+,5S5M,60,0;", "NM:i:0"])
    assert tables.parse_sam(tables.sam_lines(spark.createDataFrame([("q", "c", 7, "4M", "ACGT")], "read_name string, chrom string, pos long, cigar string, seq string"))).first().pos == 7
    psl = "59\t1\t0\t0\t0\t0\t0\t0\t-\tq1\t60\t0\t60\tchr1\t1000\t99\t159\t1\t60,\t0,\t99,"
    got = tables.read(spark, _text(tmp_path, "psLayout version 3\n\nmatch\tmis\n-----\n" + psl), tables.parse_psl).collect()
    assert [(r.matches, r.strand, r["query"], r.t_start, r.t_end) for r in got] == [(59, "-", "q1", 99, 159)]
    bed = spark.createDataFrame([("c", 5, 9, "n", "-")], "chrom string, start long, end long, name string, strand string")
    assert tuple(tables.parse_bed(tables.bed_lines(bed, strand="strand")).first()) == ("c", 5, 9, "n", "-")


def _text(tmp_path, text):
    p = tmp_path / "lines.txt"
    p.write_text(text)
    return str(p)


def test_lists(spark):
    assert sorted(map(tuple, tables.parse_homologs(lines(spark, "A\tB;C;", "B\tA;A", "bad", "")).collect())) == [("A", "B"), ("A", "C"), ("B", "A")]
    assert [tuple(r) for r in tables.parse_labelled(lines(spark, "acgtH\tA->B", "")).collect()] == [("ACGTH", "A->B")]
    cells = [""] * 22
    cells[0], cells[7], cells[9], cells[20], cells[21] = "A->B", "x", "y", "A^1:100:+", "B^2:200:-"
    header = "\t".join(f"h{i}" for i in range(22))
    got = tables.parse_known(lines(spark, header, "\t".join(cells), "\t".join(cells))).collect()
    assert [(r.fusion, r.gene_left, r.left.chrom, r.left.pos, r.right.strand) for r in got] == [("A->B", "A", "chr1", 100, "-")]


def test_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "A--B", "A", "A:1", "B", "c:2", 0.5, 3, 4, ["r1", "r2"], [], "")], "sample string, fusion_gene string, anchored_gene string, x_clip string, partner_gene string, y_clip string, natural_score double, spanning_count long, breakpoint_count long, spanning_reads array<string>, split_reads array<string>, other_positions string")
    predictions.write_tsv(rows, str(tmp_path / "p"))
    back = predictions.read_tsv(spark, str(tmp_path / "p"))
    assert back.drop("other_positions").collect() == rows.drop("other_positions").collect()
    seqs = spark.createDataFrame([("ACGTH", "A->B")], "seq string, name string")
    predictions.write_sequences(seqs, str(tmp_path / "s"))
    predictions.write_sequences(seqs, str(tmp_path / "s"))
    assert tables.read(spark, str(tmp_path / "s"), tables.parse_labelled).count() == 2


def test_finished_stages_are_read(spark, tmp_path):
    at, made = str(tmp_path / "t"), []

    def make(n):
        def run():
            made.append(n)
            return spark.range(n)

        return run

    assert predictions.stage(spark, make(3), at, "a").count() == 3
    assert predictions.stage(spark, make(99), at, "a").count() == 3 and made == [3]  # not even called
    assert predictions.stage(spark, make(99), at, "b").count() == 99  # other inputs
    next((tmp_path / "t").glob("*/*/_SUCCESS")).unlink()
    assert {predictions.stage(spark, make(5), at, x).count() for x in "ab"} in ({5, 3}, {5, 99})  # one wasn't finished
    two = lambda: (spark.range(1), spark.range(2))
    assert [x.count() for x in predictions.stages(spark, two, at, "c", ("one", "two"))] == [1, 2]
    next((tmp_path / "t").glob("inputs-c/two/_SUCCESS")).unlink()
    assert [x.count() for x in predictions.stages(spark, lambda: two()[::-1], at, "c", ("one", "two"))] == [2, 1]


def test_inputs_are_told_by_their_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq").write_text("one")
    (tmp_path / "other").write_text("x")
    paths = [str(tmp_path / "in"), str(tmp_path / "other"), str(tmp_path / "missing")]
    first = predictions.digest(spark, paths, ("k", 11))
    assert predictions.digest(spark, paths, ("k", 11)) == first != predictions.digest(spark, paths, ("k", 12))
    (tmp_path / "in" / "a.fastq").write_text("more")  # the same name, another length
    second = predictions.digest(spark, paths, ("k", 11))
    os.utime(tmp_path / "in" / "a.fastq", (1, 1))
    third = predictions.digest(spark, paths, ("k", 11))
    (tmp_path / "in" / "b.fastq").write_text("")
    assert len({first, second, third, predictions.digest(spark, paths, ("k", 11))}) == 4


def test_training_and_scoring(spark):
    import random

    rng = random.Random(2)
    seq = lambda mid: "".join(rng.choices("ACGT", k=95)) + mid + "H" + "".join(rng.choices("ACGT", k=100))
    rows = [(seq("GGGGG"), "p", 1) for _ in range(150)] + [(seq("ATATA"), "n", 0) for _ in range(220)]
    table = models.split(spark.createDataFrame(rows, "seq string, name string, label int"))
    counts = {(r.label, r.part): r["count"] for r in table.groupBy("label", "part").count().collect()}
    assert counts == {(0, "train"): 105, (1, "train"): 105, (0, "test"): 45, (1, "test"): 45}
    model = models.train(table.where("part = 'train'"))
    found = models.evaluate(models.score(table.where("part = 'test'"), model)).first()
    assert found.accuracy > 0.9 and found.auc > 0.95
    assert models.cross_validate(table.where("part = 'train'"), 3)[0][1] > 0.9
    lengths = models.score_by(table, lambda batch: [len(x) / 201 for x in batch])
    assert lengths.agg(F.min("natural_score")).first()[0] == 1.0


def test_junction_sequences(spark):
    from junctura.operators import chimeras, intervals, junctions
    from junctura.plans import planted

    t = planted.tables(spark)
    chunks = intervals.chunked(t["genome"])
    second = planted.transcript("P1")
    start = 2000 + 8000 + planted.INTRON + 1
    best = spark.createDataFrame([("s", "ANC", "c", "MS", planted.CUT, "chr2", start, "+")], "sample string, anchored_gene string, candidate string, type string, target long, chrom string, other long, strand string")
    got = junctions.scoring_sequences(best, t["anchor"], t["exons"], chunks).first().seq
    anchor = planted.transcript("ANC")
    assert got == anchor[planted.CUT - 100 : planted.CUT] + "H" + second[planted.EXON : planted.EXON + 100]

    known = spark.createDataFrame([("P0->P1", "P0", "P1", ("chr2", 2000 + planted.EXON, "+"), ("chr2", start, "+"))], "fusion string, gene_left string, gene_right string, left struct<chrom:string,pos:long,strand:string>, right struct<chrom:string,pos:long,strand:string>")
    got = junctions.positives(known, t["exons"], chunks).first()
    assert got.seq == planted.transcript("P0")[planted.EXON - 100 : planted.EXON] + "H" + second[planted.EXON : planted.EXON + 100]

    at = 2000 + planted.EXON - 59  # sixty bases to the end of P0's first exon, then P1's second exon
    read = planted.transcript("P0")[planted.EXON - 60 : planted.EXON] + second[planted.EXON : planted.EXON + 40]
    aln = spark.createDataFrame([("r", 0, "chr2", at, "60M40S", read, [f"SA:Z:chr2,{start},+,60S40M,60,0;"])], "read_name string, flag int, chrom string, pos long, cigar string, seq string, tags array<string>")
    far = chimeras.distant(chimeras.chimeric(aln), 1000)
    # P0 and P1 share no three first letters
    pairs = chimeras.gene_pairs(far, t["exons"], ["ANC"], spark.createDataFrame([], "gene string, homolog string"))
    got = junctions.negatives(pairs, t["exons"], chunks, spark.createDataFrame([], "read_name string")).first()
    assert got.seq[100] == "H" and got.seq[:100] == planted.transcript("P0")[planted.EXON - 100 : planted.EXON] and got.seq[101:] == second[planted.EXON : planted.EXON + 100]
    assert got.name == "P0->P1"
