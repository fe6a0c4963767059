"""Sources and sinks as queries: lines are made from the driver's tables, written where a format is a file, and read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators import models, pairs
from junctura.plans.catalogue import ALN, EV, IV, SEQS, aln, ev, iv, query, seqs, table
from junctura.session import shared_folder
from junctura.sources import bam, predictions, tables
from junctura.sources import sequences as fasta


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _line(*fields: Column | str) -> Column:
    return F.concat_ws("\t", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in fields])


def _fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA file of the documents' letters, written and read; headers hold an accession, a name and a plain word."""
    d = F.col("doc_id").cast("string")
    path = _new_path(spark, "fasta")
    fasta.write_fasta(seqs(spark, sf_dir).select(F.concat(F.lit("NM_"), d, F.lit(".1 LOCUS"), d, F.lit(" transcript")).alias("name"), "seq"), path)
    return fasta.read_fasta(spark, path)


@query(f"WITH {SEQS} SELECT 'NM_' || doc_id || '.1' AS name, 'LOCUS' || doc_id AS gene, length(seq) AS letters, md5(seq) AS digest FROM seqs")
def fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fasta(spark, sf_dir).select("name", fasta.gene_of_header(F.col("description")).alias("gene"), F.length("seq").cast("long").alias("letters"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"WITH {SEQS} SELECT 'LOCUS' || doc_id AS anchored_gene, md5(seq) AS digest FROM seqs WHERE doc_id % 3 = 0")
def gene_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose names a list has; the list has blanks behind names and blank lines."""
    d = F.col("doc_id")
    names = table(spark, sf_dir, "documents").select(F.when(d % 3 == 0, F.concat(F.lit("LOCUS"), d.cast("string"), F.lit("  "))).when(d % 3 == 1, " ").otherwise("").alias("value"))
    return fasta.anchors(_fasta(spark, sf_dir), names).select("anchored_gene", F.md5(F.col("seq").cast("binary")).alias("digest"))


_ENDS = "['.fastq', '.fastq.gz', '.fq', '.fq.gz']"


@query(f"""WITH f AS (SELECT p_partkey // 2 AS c, p_partkey % 2 + 1 AS mate, '/d/r' || (p_partkey // 2) // 50 || '/cell' || p_partkey // 2 || '_' || (p_partkey % 2 + 1) || {_ENDS}[(p_partkey // 2) % 4 + 1] AS path FROM part WHERE p_partkey % 7 <> 0)
SELECT 'cell' || c AS sample, max(path) FILTER (mate = 1) AS "first", max(path) FILTER (mate = 2) AS "second" FROM f GROUP BY c HAVING count(*) = 2""")
def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, mate = F.expr("p_partkey div 2"), F.col("p_partkey") % 2 + 1
    ending = F.get(F.array(*[F.lit(x) for x in fasta.PAIR_ENDS]), (c % 4).cast("int"))
    s = lambda x: x.cast("string")
    path = F.concat(F.lit("/d/r"), s(F.expr("p_partkey div 2 div 50")), F.lit("/cell"), s(c), F.lit("_"), s(mate), ending)
    return fasta.fastq_pairs(table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(path.alias("path")))


@query("""SELECT 'chr' || l_suppkey AS chrom, l_orderkey AS "start", l_orderkey + CAST(l_quantity AS BIGINT) AS "end", CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'ENSG' || l_partkey AS gene_id, 'name' || l_partkey AS gene_name FROM lineitem WHERE l_linenumber = 1""")
def gtf_gene_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey").cast("string")
    feature = F.when(F.col("l_linenumber") == 1, "gene").otherwise("exon")
    attributes = F.concat(F.lit('gene_id "ENSG'), p, F.lit('"; gene_name "name'), p, F.lit('";'))
    x = table(spark, sf_dir, "lineitem")
    line = _line(F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), "src", feature, F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_quantity").cast("long"), ".", F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-"), ".", attributes)
    return tables.parse_gtf(x.select(line.alias("value")), "gene").select("chrom", "start", "end", "strand", "gene_id", "gene_name")


@query(f"""WITH {IV} SELECT 'chr' || chrom AS chrom, "start", "end", 'n' || p AS name, CASE WHEN s % 2 = 0 THEN '+' ELSE '-' END AS strand FROM iv""")
def bed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = iv(spark, sf_dir).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "start", "end", F.concat(F.lit("n"), F.col("p").cast("string")).alias("name"), F.when(F.col("s") % 2 == 0, "+").otherwise("-").alias("strand"))
    head = spark.createDataFrame([("track name=x",), ("#a\tb\tc",)], "value string")
    return tables.parse_bed(head.unionByName(tables.bed_lines(x, strand="strand")))


@query(f"WITH {ALN} SELECT 'r' || read AS read_name, CAST(0 AS INTEGER) AS flag, 'chr1' AS chrom, pos, CAST(60 AS INTEGER) AS mapq, cigar, CAST(160 AS INTEGER) AS letters FROM aln")
def sam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = aln(spark, sf_dir).withColumns({"read_name": F.concat(F.lit("r"), F.col("read").cast("string")), "chrom": F.lit("chr1")})
    return tables.parse_sam(tables.sam_lines(x)).select("read_name", "flag", "chrom", "pos", "mapq", "cigar", F.length("seq").alias("letters"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments on five chromosomes, with the sequence of a line's part as letters of the genome and two tags."""
    s = lambda x: F.col(x).cast("string")
    names = {"read_name": F.concat(F.lit("r"), s("read"), F.lit("."), s("n")), "chrom": F.concat(F.lit("chr"), (F.col("p") % 5).cast("string")), "mapq": (F.col("p") % 61).cast("int")}
    seq = F.translate(F.upper(F.conv(s("p"), 10, 4)), "0123", "ACGT")
    return aln(spark, sf_dir).withColumns({**names, "seq": seq, "tags": F.array(F.concat(F.lit("NM:i:"), s("n")), F.concat(F.lit("SA:Z:chr1,"), s("p"), F.lit(",+,20M;")))})


_PLACED = """t AS (SELECT *, 'r' || read || '.' || n AS read_name, 'chr' || p % 5 AS chrom, CAST(p % 61 AS INTEGER) AS mapq FROM aln)"""


@query(f"WITH {ALN}, {_PLACED} SELECT read_name, CAST(flag AS INTEGER) AS flag, chrom, pos, mapq, cigar, translate(to_base(p, 4), '0123', 'ACGT') AS seq, 'NM:i:' || n || ' SA:Z:chr1,' || p || ',+,20M;' AS tags FROM t")
def bam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as BAM files and read again in splits of 100,000 bytes."""
    path = _new_path(spark, "bam")
    bam.write_bam(_placed(spark, sf_dir), path, [(f"chr{i}", (1 << 31) - 1) for i in range(5)])
    return bam.read_bam(spark, path, 100_000).drop("sample").withColumn("tags", F.array_join("tags", " "))


@query(rf"""WITH {ALN}, {_PLACED}, x AS (SELECT *, greatest(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\d+)[MDN=X]', 1), lambda v: CAST(v AS BIGINT))), 0), 1) AS span FROM t)
SELECT chrom, read_name, pos, cigar FROM x WHERE (chrom = 'chr1' AND pos <= 9000 AND pos + span > 3000) OR (chrom = 'chr3' AND pos <= 40000 AND pos + span > 9990)""")
def region_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments sorted by place into files with an index, and the reads of two regions."""
    path = _new_path(spark, "sorted")
    tables.write_sorted(_placed(spark, sf_dir).select("read_name", "chrom", "pos", "cigar", "seq"), path)
    regions = [tables.read_region(spark, path, *r) for r in (("chr1", 3000, 9000), ("chr3", 9990, 40_000))]
    return regions[0].unionByName(regions[1]).select("chrom", "read_name", "pos", "cigar")


@query(f"WITH {SEQS} SELECT md5(seq) AS digest, lang AS name FROM seqs WHERE seq <> ''")
def labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = seqs(spark, sf_dir).select(_line(F.lower("seq"), F.concat(F.coalesce("lang", F.lit("")), F.lit(" "))).alias("value"))
    return tables.parse_labelled(lines).select(F.md5(F.col("seq").cast("binary")).alias("digest"), F.nullif("name", F.lit("")).alias("name"))


_KNOWN = """k AS (SELECT 'G' || l_suppkey % 20 AS a, 'H' || l_suppkey % 7 AS b, 't' || l_linenumber AS c7, 'e' || l_orderkey % 50 AS c9, 'chr' || (l_suppkey % 22 + 1) AS lc, l_partkey AS lp, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS ls,
 'chr' || (l_partkey % 22 + 1) AS rc, l_orderkey AS rp, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS rs FROM lineitem),
g AS (SELECT a, b, c7, c9, min((lc, lp, ls, rc, rp, rs)) AS f FROM k GROUP BY ALL)"""


@query(f"WITH {_KNOWN} SELECT a || '->' || b AS fusion, a AS gene_left, b AS gene_right, f[1] || ':' || f[2] || ':' || f[3] AS left_place, f[4] || ':' || f[5] || ':' || f[6] AS right_place FROM g")
def known_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: x.cast("string")
    plus = lambda x: F.when(F.col(x) % 2 == 0, "+").otherwise("-")
    name = F.concat(F.lit("G"), s(F.col("l_suppkey") % 20), F.lit("->H"), s(F.col("l_suppkey") % 7))
    left = F.concat(F.lit("x^"), s(F.col("l_suppkey") % 22 + 1), F.lit(":"), s(F.col("l_partkey")), F.lit(":"), plus("l_partkey"))
    right = F.concat(F.lit("y^"), s(F.col("l_partkey") % 22 + 1), F.lit(":"), s(F.col("l_orderkey")), F.lit(":"), plus("l_orderkey"))
    line = _line(name, *"123456", F.concat(F.lit("t"), s(F.col("l_linenumber"))), "8", F.concat(F.lit("e"), s(F.col("l_orderkey") % 50)), *["-"] * 10, left, right)
    head = spark.createDataFrame([("\t".join(["Fusion"] + ["c"] * 21),)], "value string")
    got = tables.parse_known(head.unionByName(table(spark, sf_dir, "lineitem").select(line.alias("value"))))
    place = lambda n: F.concat_ws(":", f"{n}.chrom", s(F.col(f"{n}.pos")), f"{n}.strand").alias(f"{n}_place")
    return got.select("fusion", "gene_left", "gene_right", place("left"), place("right"))


@query(f"WITH {EV} SELECT CAST(sample AS VARCHAR) AS sample, fusion AS fusion_gene, score AS natural_score, spanning AS spanning_count, split AS breakpoint_count, CAST(id % 3 AS INTEGER) AS names FROM ev")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written as a table with headings and read again, lists of reads included."""
    reads = F.slice(F.array(F.concat(F.lit("a"), F.col("id").cast("string")), F.lit("b")), F.lit(1), (F.col("id") % 3).cast("int"))
    x = ev(spark, sf_dir).select(F.col("sample").cast("string").alias("sample"), F.col("fusion").alias("fusion_gene"), F.col("score").alias("natural_score"), F.col("spanning").alias("spanning_count"), F.col("split").alias("breakpoint_count"), reads.alias("spanning_reads"))
    path = _new_path(spark, "predictions")
    predictions.write_tsv(x, path)
    return predictions.read_tsv(spark, path).select("sample", "fusion_gene", "natural_score", "spanning_count", "breakpoint_count", F.size("spanning_reads").alias("names"))


@query(f"WITH {SEQS}, s AS (SELECT left(seq, 60) AS seq, lang FROM seqs WHERE seq <> '' AND lang IS NOT NULL) SELECT seq, lang AS name, count(*) * 2 AS n FROM s GROUP BY ALL")
def sequence_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sequences appended twice to one table, as samples append theirs."""
    x = seqs(spark, sf_dir).where("seq <> '' AND lang IS NOT NULL").select(F.left("seq", F.lit(60)).alias("seq"), F.col("lang").alias("name"))
    path = _new_path(spark, "sequences")
    for _ in range(2):
        predictions.write_sequences(x, path)
    return tables.read(spark, path, tables.parse_labelled).groupBy("seq", "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang AS name, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM documents")
def labelled_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("name"))
    return models.labelled(d.where("seq % 2 = 0"), d.where("seq % 2 <> 0")).withColumnRenamed("seq", "doc_id")


@query("SELECT a.l_orderkey, a.l_partkey, b.l_partkey AS mate_l_partkey, b.l_suppkey AS mate_l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2")
def mate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    first, second = x.where("l_linenumber = 1").select("l_orderkey", "l_partkey"), x.where("l_linenumber = 2").select("l_orderkey", "l_partkey", "l_suppkey")
    return pairs.mates(first, second, ("l_orderkey",))
