"""FASTA and FASTQ."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from junctura.session import checkpoint

#: Header tokens that name no gene.
ACCESSION = r"^[a-zA-Z]+_\d+\.\d+"
PLAIN_WORDS = ("gene", "specie", "trans", "for", "homo", "sapiens")

#: Endings of the two files of a pair.
PAIR_ENDS = (".fastq", ".fastq.gz", ".fq", ".fq.gz")


def gene_of_header(header: Column) -> Column:
    """The first token of a FASTA header (without '>') that is no accession and has none of the plain words in it."""
    plain = "(?i)" + "|".join(PLAIN_WORDS)
    return F.get(F.filter(F.split(header, " "), lambda t: ~t.rlike(ACCESSION) & ~t.rlike(plain)), F.lit(0))


def parse_fasta(records: DataFrame, column: str = "value") -> DataFrame:
    """(name, description, seq) of records that were split at line starts with '>'. Letters are upper-cased."""
    text = F.regexp_replace(F.regexp_replace(F.col(column), "\r", ""), "^>", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.contains(text, F.lit("\n")), F.substring(text, F.length(head) + 2, F.lit((1 << 31) - 1))).otherwise("")
    rows = records.select(F.trim(head).alias("description"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))
    return rows.where("description <> '' OR seq <> ''").select(F.substring_index("description", " ", 1).alias("name"), "description", "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, whatever file it is in; large files are split between records."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def anchors(fasta: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(anchored_gene, seq): gene names from headers; with names (a column value) only those listed, blanks passed over."""
    rows = fasta.select(gene_of_header(F.col("description")).alias("anchored_gene"), "seq")
    if names is None:
        return rows
    listed = names.select(F.rtrim("value").alias("anchored_gene")).where("anchored_gene <> ''").distinct()
    return rows.join(listed, "anchored_gene", "left_semi")


def write_fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def sample_of(path: Column) -> Column:
    """struct<sample, mate> of a FASTQ path, null for other paths."""
    file = F.element_at(F.split(path, "/"), -1)
    sample, mate = F.regexp_extract(file, r"^(\S+)_([12])\.(?:fastq|fq)(?:\.gz)?$", 1), F.regexp_extract(file, r"^(\S+)_([12])\.(?:fastq|fq)(?:\.gz)?$", 2)
    return F.when(sample != "", F.struct(sample.alias("sample"), mate.cast("int").alias("mate")))


def fastq_pairs(files: DataFrame, path: str = "path") -> DataFrame:
    """(sample, first, second): paths of pairs with the same folder, stem and ending; files without a partner go."""
    x = files.select(F.col(path).alias("p"), sample_of(F.col(path)).alias("s"), F.regexp_extract(F.col(path), r"(\.(?:fastq|fq)(?:\.gz)?)$", 1).alias("ending"), F.regexp_extract(F.col(path), "^(.*/)?[^/]*$", 1).alias("folder")).where("s IS NOT NULL")
    g = x.groupBy("folder", F.col("s.sample").alias("sample"), "ending").agg(F.max(F.when(F.col("s.mate") == 1, F.col("p"))).alias("first"), F.max(F.when(F.col("s.mate") == 2, F.col("p"))).alias("second"))
    return g.where("first IS NOT NULL AND second IS NOT NULL").select("sample", "first", "second")


def find_fastq_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """fastq_pairs() of a folder, which Spark lists without reading the files, in the order of their paths."""
    return fastq_pairs(spark.read.format("binaryFile").option("pathGlobFilter", "*_[12].f*q*").load(folder).select("path")).orderBy("first")


READ = "sample string, mate int, read_name string, seq string, qual string"


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, record, head, seq, qual, whole) of lines (path, place, value): four lines in a row are a record.

    Records that miss lines, as the rest is in another split, have whole = false.
    """
    rest = None
    for batch in _and_none(batches):
        both = [x for x in (rest, batch) if x is not None and x.num_rows]
        if not both:
            continue
        table = pa.Table.from_batches(both).combine_chunks()
        place = table.column("place").to_numpy()
        path = table.column("path").combine_chunks()
        record = place // 4
        other = pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero((np.diff(record) != 0) | other) + 1))
        ends = np.append(starts[1:], len(place))
        if batch is not None:  # the last record may go on in the next batch
            rest = table.slice(int(starts[-1])).to_batches()[0]
            starts, ends = starts[:-1], ends[:-1]
        of = np.repeat(np.arange(len(starts)), ends - starts)
        value, k = table.column("value").combine_chunks(), place[: len(of)] % 4
        cells = []
        for line in (0, 1, 3):
            at = np.full(len(starts), -1)
            at[of[k == line]] = np.flatnonzero(k == line)
            cells.append(value.take(pa.array(at, mask=at < 0)))
        first = pa.array(starts)
        yield pa.RecordBatch.from_arrays([path.take(first), pa.array(record[starts]), *cells, pa.array(ends - starts == 4)], names=["path", "record", "head", "seq", "qual", "whole"])


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def read_fastq(spark: SparkSession, path: str | list[str], broadcast_splits: int = 100_000) -> DataFrame:
    """(sample, mate, read_name, seq, qual). Records have four lines each, and may be divided between splits of a file.

    A line's number is its place in its split, which is a range of bytes of the file, plus the lines of the splits before.
    Spark reads a split's lines in order and one after the other, so their ids rise by one. The splits' counts go to all
    tasks up to broadcast_splits of them; beyond that lines are shuffled by split. Records are put together where their
    lines are; of others only those are shuffled that are divided between splits.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    at = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = checkpoint(at.select(F.col("path").alias("_p"), F.col("split").alias("_s"), "low", before.alias("before")))
    at = F.broadcast(at) if at.count() <= broadcast_splits else at
    numbered = lines.join(at, (F.col("path") == F.col("_p")) & (F.col("split") == F.col("_s")))
    place = F.col("line") - F.col("low") + F.col("before")
    found = numbered.select("path", place.alias("place"), "value").mapInArrow(records, "path string, record long, head string, seq string, qual string, whole boolean")
    # only records that are divided between splits are shuffled
    whole, parts = found.where("whole"), found.where("NOT whole")
    joined = parts.groupBy("path", "record").agg(*[F.max(c).alias(c) for c in ("head", "seq", "qual")])
    g = whole.select("path", "record", "head", "seq", "qual").unionByName(joined).withColumn("s", sample_of(F.col("path")))
    name = F.regexp_replace(F.substring_index(F.substring("head", F.lit(2), F.lit(1 << 30)), " ", 1), "/[12]$", "")
    return g.where("head IS NOT NULL AND seq IS NOT NULL").select("s.sample", "s.mate", name.alias("read_name"), "seq", "qual")
