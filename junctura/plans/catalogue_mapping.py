"""Queries of the mapper over the driver's texts as sequences: passages of benchmark in documents, whole and with gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators import mapping
from junctura.plans.catalogue import SEQ, SEQS, as_sequence, query, seqs, table


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), as_sequence(F.col("text")).alias("seq"))


def as_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a chromosome."""
    return seqs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chrom"), "seq")


PASSAGES = f"b AS (SELECT item_id, {SEQ} AS p FROM benchmark)"


@query(f"""WITH {SEQS}, {PASSAGES} SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, CAST(doc_id AS VARCHAR) AS doc_id, s AS strand
FROM b, seqs, (VALUES ('+'), ('-')) v(s) WHERE contains(seq, CASE s WHEN '+' THEN p ELSE translate(reverse(p), 'ATGC', 'TACG') END)""")
def map_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage to the letter, on either strand: hits of the whole passage without a change."""
    hits = mapping.map_queries(passages(spark, sf_dir), as_genome(spark, sf_dir), most=None)
    return hits.where("matches = q_size AND t_gap = 0").select(F.col("query").alias("item_id"), F.col("chrom").alias("doc_id"), "strand").distinct()


@query(f"""WITH {SEQS}, {PASSAGES} SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(item_id % 20 + 1 AS INTEGER) AS gap FROM b, seqs WHERE contains(seq, p)""")
def map_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage from the middle of which 1 to 20 letters were taken, found again as a gap of that size."""
    gap = (F.col("query").cast("long") % 20 + 1).cast("int")
    half = F.floor(F.length("seq") / 2).cast("int")
    short = passages(spark, sf_dir).select("query", F.concat(F.left("seq", half), F.substring(F.col("seq"), half + gap + 1, F.lit(1 << 30))).alias("seq"), gap.alias("gap"))
    # letters were taken, none changed; fewer may be left than a gap costs, and short passages score under 30 beside a long gap
    found = mapping.map_queries(short.select("query", "seq"), as_genome(spark, sf_dir), most=None, min_score=0, whole=True, mismatch=-100)
    hits = found.join(short.select("query", "gap"), "query")
    return hits.where("t_gap = gap AND q_gap = 0 AND matches = q_size AND strand = '+'").select(F.col("query").alias("item_id"), F.col("chrom").alias("doc_id"), "gap").distinct()


@query(f"""WITH {SEQS}, c AS (SELECT doc_id, unnest(range(0, length(seq), 1000)) AS k, seq FROM seqs)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(k // 1000 AS INTEGER) AS piece, substr(seq, k + 1, 1300) AS seq FROM c""")
def genome_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 1,000 letters with 300 of what follows."""
    return mapping.cut(as_genome(spark, sf_dir), 1000, 300).withColumnRenamed("chrom", "doc_id")
