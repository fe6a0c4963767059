"""Formats of lines: GTF, SAM, PSL, BED, homolog lists, labelled sequences, known junctions, gene lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of transcripts that make no gene model, besides all pseudogenes.
NO_GENE = ("artifact", "protein_coding_LoF")


def _fields(value: Column, sep: str = "\t") -> Column:
    return F.split(value, sep)


def _at(fields: Column, i: int, kind: str = "string") -> Column:
    x = F.get(fields, F.lit(i))
    return x if kind == "string" else x.try_cast(kind)


def attribute(attributes: Column, name: str) -> Column:
    """A named attribute of a GTF line, null if it isn't there."""
    return F.nullif(F.regexp_extract(attributes, rf'(?:^|;\s*){name} "?([^";]*)"?', 1), F.lit(""))


def parse_gtf(lines: DataFrame, feature: str = "exon", column: str = "value") -> DataFrame:
    """(chrom, feature, start, end, strand, gene_id, gene_name, transcript_type). A gene without a name has its id."""
    f = _fields(F.col(column))
    rows = lines.where(~F.col(column).startswith("#")).select(_at(f, 0).alias("chrom"), _at(f, 2).alias("feature"), _at(f, 3, "long").alias("start"), _at(f, 4, "long").alias("end"), _at(f, 6).alias("strand"), _at(f, 8).alias("_a"))
    a = F.col("_a")
    rows = rows.where((F.col("feature") == feature) & F.col("start").isNotNull() & F.col("end").isNotNull())
    gene = attribute(a, "gene_id")
    return rows.select("chrom", "feature", "start", "end", "strand", gene.alias("gene_id"), F.coalesce(attribute(a, "gene_name"), gene).alias("gene_name"), F.coalesce(attribute(a, "transcript_type"), attribute(a, "transcript_biotype")).alias("transcript_type"))


def real_genes(features: DataFrame) -> DataFrame:
    """Features that aren't of pseudogenes and the like; those without a type stay."""
    kind = F.coalesce(F.col("transcript_type"), F.lit(""))
    return features.where(~F.contains(kind, F.lit("pseudogene")) & ~kind.isin(*NO_GENE))


def parse_sam(lines: DataFrame, sample: Column | None = None, column: str = "value") -> DataFrame:
    """(sample, read_name, flag, chrom, pos, mapq, cigar, seq, tags); header lines and lines of too few fields go."""
    f = _fields(F.col(column))
    rows = lines.where(~F.col(column).startswith("@")).withColumn("_f", f).where(F.size("_f") >= 11)
    x = F.col("_f")
    return rows.select((sample if sample is not None else F.lit("")).alias("sample"), _at(x, 0).alias("read_name"), _at(x, 1, "int").alias("flag"), _at(x, 2).alias("chrom"), _at(x, 3, "long").alias("pos"), _at(x, 4, "int").alias("mapq"), _at(x, 5).alias("cigar"), _at(x, 9).alias("seq"), F.slice(x, F.lit(12), F.greatest(F.size(x) - 11, F.lit(0))).alias("tags"))


def parse_psl(lines: DataFrame, column: str = "value") -> DataFrame:
    """(matches, strand, query, q_size, q_start, q_end, target, t_start, t_end); lines that don't begin with a number go."""
    f = _fields(F.col(column))
    rows = lines.where(F.col(column).rlike(r"^\d+\s")).withColumn("_f", f)
    x = F.col("_f")
    return rows.select(_at(x, 0, "int").alias("matches"), _at(x, 8).alias("strand"), _at(x, 9).alias("query"), _at(x, 10, "int").alias("q_size"), _at(x, 11, "int").alias("q_start"), _at(x, 12, "int").alias("q_end"), _at(x, 13).alias("target"), _at(x, 15, "long").alias("t_start"), _at(x, 16, "long").alias("t_end"))


def parse_bed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(chrom, start, end, name, strand): places from 1, both included."""
    f = _fields(F.col(column))
    rows = lines.withColumn("_f", f).where((F.size("_f") >= 3) & ~F.col(column).rlike("^(#|track|browser)"))
    x = F.col("_f")
    return rows.select(_at(x, 0).alias("chrom"), (_at(x, 1, "long") + 1).alias("start"), _at(x, 2, "long").alias("end"), _at(x, 3).alias("name"), F.coalesce(_at(x, 5), _at(x, 4)).alias("strand"))


def bed_lines(rows: DataFrame, name: str = "name", strand: str | None = None) -> DataFrame:
    """(value): BED lines of (chrom, start, end), which count from 1."""
    tail = ["0", F.col(strand)] if strand else []
    return rows.select(F.concat_ws("\t", "chrom", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), name, *[F.lit(t) if isinstance(t, str) else t for t in tail]).alias("value"))


def sam_lines(rows: DataFrame) -> DataFrame:
    """(value): SAM lines of (read_name, chrom, pos, cigar, seq) with flag 0 and mapping quality 60."""
    star, zero = F.lit("*"), F.lit("0")
    return rows.select(F.concat_ws("\t", "read_name", zero, "chrom", F.col("pos").cast("string"), F.lit("60"), "cigar", star, zero, zero, "seq", star).alias("value"))


def parse_homologs(lines: DataFrame, column: str = "value", inner: str = ";") -> DataFrame:
    """(gene, homolog): an edge for each name in the list behind a gene; blanks go."""
    f = _fields(F.col(column))
    rows = lines.select(_at(f, 0).alias("gene"), F.explode(F.split(_at(f, 1), inner)).alias("homolog"))
    return rows.where("gene <> '' AND homolog <> ''").distinct()


def parse_labelled(lines: DataFrame, column: str = "value") -> DataFrame:
    """(seq, name) of labelled junction sequences, upper-cased."""
    f = _fields(F.col(column))
    return lines.select(F.upper(F.trim(_at(f, 0))).alias("seq"), F.trim(_at(f, 1)).alias("name")).where("seq <> ''")


def parse_known(lines: DataFrame, column: str = "value") -> DataFrame:
    """(fusion, gene_left, gene_right, left, right) of a table of known fusions, each side struct<chrom, pos, strand>.

    Rows count once for each fusion and the two columns that tell its events apart; the header has no places and goes.
    """
    f = _fields(F.col(column))

    def side(i: int) -> Column:
        p = F.split(F.get(F.split(_at(f, i), r"\^"), F.lit(1)), ":")
        return F.struct(F.concat(F.lit("chr"), F.get(p, F.lit(0))).alias("chrom"), F.get(p, F.lit(1)).try_cast("long").alias("pos"), F.trim(F.get(p, F.lit(2))).alias("strand"))

    names = F.split(_at(f, 0), "->")
    rows = lines.select(_at(f, 0).alias("fusion"), F.get(names, F.lit(0)).alias("gene_left"), F.get(names, F.lit(1)).alias("gene_right"), _at(f, 7).alias("_c7"), _at(f, 9).alias("_c9"), side(20).alias("left"), side(21).alias("right"))
    rows = rows.where("left.pos IS NOT NULL AND right.pos IS NOT NULL")
    g = rows.groupBy("fusion", "_c7", "_c9").agg(F.min(F.struct("gene_left", "gene_right", "left", "right")).alias("_f"))
    return g.select("fusion", "_f.*")


def read(spark: SparkSession, path: str, parse, **options) -> DataFrame:
    """The rows that a parser of this module makes of the lines of a path, a list of paths or a glob."""
    return parse(spark.read.text(path), **options)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM files; the sample is the file's name without its ending."""
    lines = spark.read.text(path)
    return parse_sam(lines, F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.sam)?(?:\.gz)?$", 1))


def reference_span(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def write_sorted(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Alignments (read_name, chrom, pos, cigar, others) in the order of their places, a range of places a file, and an index.

    Reads that begin at one place are divided by their names, so no file grows with a hot place. The index has a row for each
    file and chrom: the first place, and the last that a read of the file covers. A null cigar covers one base. Null
    chroms and places come first; no region has them.
    """
    last = F.col("pos") + F.greatest(F.coalesce(reference_span(F.col("cigar")), F.lit(1)), F.lit(1)) - 1
    order = [F.col("chrom"), F.col("pos"), F.xxhash64("read_name")]
    placed = rows.withColumn("last", last)
    dealt = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    made = rows.sparkSession.read.parquet(f"{path}/rows").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "chrom", "pos", "last")
    index = made.groupBy("file", "chrom").agg(F.min("pos").alias("first"), F.max("last").alias("last"))
    index.repartitionByRange("chrom", "first").sortWithinPartitions("chrom", "first").write.parquet(f"{path}/index")


def read_region(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """The rows of write_sorted that cover a base from start to end, both included; only files that may have one are opened."""
    meets = lambda first: (F.col("chrom") == chrom) & (F.col(first) <= end) & (F.col("last") >= start)
    found = spark.read.parquet(f"{path}/index").where(meets("first")).select("file").distinct().collect()
    rows = spark.read.parquet(*[f"{path}/rows/{r.file}" for r in found]) if found else spark.read.parquet(f"{path}/rows").where("false")
    return rows.where(meets("pos")).drop("last")
