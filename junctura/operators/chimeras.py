"""Chimeric reads: alignments with a supplementary part in another gene, from which artificial junctions are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import revcomp
from junctura.operators.exons import lookup
from junctura.session import checkpoint


def supplementary(tags: Column) -> Column:
    """struct<chrom, pos, strand, cigar> of the first entry of the SA tag, null without one."""
    tag = F.get(F.filter(tags, lambda t: t.startswith("SA:Z:")), F.lit(0))
    parts = F.split(F.get(F.split(F.substring(tag, F.lit(6), F.lit(1 << 30)), ";"), F.lit(0)), ",")
    one = F.struct(F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("pos"), F.get(parts, F.lit(2)).alias("strand"), F.get(parts, F.lit(3)).alias("cigar"))
    return F.when(tag.isNotNull(), one)


def shape(cigar: Column) -> Column:
    """'MS' or 'SM' of a CIGAR with exactly these two parts, else null."""
    return F.when(cigar.rlike(r"^\d+M\d+S$"), "MS").when(cigar.rlike(r"^\d+S\d+M$"), "SM")


def part(cigar: Column, op: str) -> Column:
    return F.regexp_extract(cigar, rf"(\d+){op}", 1).try_cast("int")


def chimeric(alignments: DataFrame, overlap: int = 5) -> DataFrame:
    """Reads whose two parts add up: one M+S, the other S+M, matched and clipped lengths at most ``overlap`` apart.

    alignments: read_name, flag, chrom, pos, cigar, seq, tags. Returned: read_name, read_length, seq, reverse, x and y (struct<chrom,
    pos, right, shape>; right is the place after the match), plus (bases in both parts).
    """
    # exploded, so that what uses it doesn't parse the tags again
    x = alignments.select("*", F.explode(F.array(supplementary(F.col("tags")))).alias("_y")).where("_y IS NOT NULL")
    xs, ys = shape(F.col("cigar")), shape(F.col("_y.cigar"))
    xm, ym, y_clip = part(F.col("cigar"), "M"), part(F.col("_y.cigar"), "M"), part(F.col("_y.cigar"), "S")
    x = x.where((xs != ys) & (F.abs(xm - y_clip) <= overlap))
    return x.select(
        "read_name", F.length("seq").alias("read_length"), "seq", (F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("reverse"),
        F.struct(F.col("chrom"), F.col("pos").cast("long").alias("pos"), (F.col("pos") + xm).cast("long").alias("right"), xs.alias("shape")).alias("x"),
        F.struct(F.col("_y.chrom").alias("chrom"), F.col("_y.pos").alias("pos"), (F.col("_y.pos") + ym).alias("right"), ys.alias("shape"), F.col("_y.strand").alias("strand")).alias("y"),
        F.greatest(F.lit(0), xm - y_clip).alias("plus"),
    )


def distant(rows: DataFrame, least: int = 10_000) -> DataFrame:
    """Rows whose parts are on two chromosomes or at least this far apart."""
    return rows.where(~((F.col("x.chrom") == F.col("y.chrom")) & (F.abs(F.col("x.pos") - F.col("y.pos")) < least)))


def one_family(a: Column, b: Column) -> Column:
    """Gene names that are not told apart: immunoglobulins, unnamed genes, and names that begin with the same three letters."""
    odd = a.rlike("^(IG|ENSG)") | b.rlike("^(IG|ENSG)")
    return odd | ((F.length(a) >= 3) & (F.length(b) >= 3) & (F.left(a, F.lit(3)) == F.left(b, F.lit(3))))


def unordered_pairs(rows: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """Of rows with the same two values, in whatever order, the one that comes first in ``order``."""
    rest = [c for c in rows.columns if c not in order]
    g = rows.groupBy(F.least(a, b).alias("_low"), F.greatest(a, b).alias("_high")).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return g.select(*[F.col(f"_f.{c}").alias(c) for c in rows.columns])


def without_homologs(rows: DataFrame, edges: DataFrame, a: str = "gene_x", b: str = "gene_y") -> DataFrame:
    """Rows whose genes are not on an edge (gene, homolog), in the direction from a to b."""
    e = edges.select(F.col("gene").alias("_g"), F.col("homolog").alias("_h")).distinct()
    return rows.join(e, (rows[a] == e["_g"]) & (rows[b] == e["_h"]), "left_anti")


def gene_pairs(rows: DataFrame, exons: DataFrame, anchored: list[str], homologs: DataFrame) -> DataFrame:
    """Distant chimeric reads with gene_x, gene_y: two genes, neither anchored, of two families, no homologs; a read a pair."""
    x = lookup(rows.withColumns({"chrom": F.col("x.chrom"), "_s": F.col("x.pos"), "_e": F.col("x.pos") + 1}), exons, start="_s", end="_e").withColumn("gene_x", F.col("exon.gene_name")).drop("exon")
    x = checkpoint(x.where("gene_x <> ''"))
    x = lookup(x.withColumns({"chrom": F.col("y.chrom"), "_s": F.col("y.pos"), "_e": F.col("y.pos") + 1}), exons, start="_s", end="_e").withColumn("gene_y", F.col("exon.gene_name")).drop("exon", "chrom", "_s", "_e")
    names = [n.upper() for n in anchored]
    x = x.where("gene_x <> '' AND gene_y <> '' AND gene_x <> gene_y").where(~F.col("gene_x").isin(names) & ~F.col("gene_y").isin(names))
    x = x.where(~one_family(F.col("gene_x"), F.col("gene_y")))
    return unordered_pairs(without_homologs(x, homologs), "gene_x", "gene_y", ["read_name"])


def ends(rows: DataFrame) -> DataFrame:
    """rows with first, second: struct<gene, chrom, pos> of both sides of the junction in reading order, and read_seq.

    Where the two parts overlap, the second part is shortened by the overlap.
    """
    x, y, plus = F.col("x"), F.col("y"), F.col("plus")
    side = lambda g, c, p: F.struct(F.col(g).alias("gene"), c.alias("chrom"), p.cast("long").alias("pos"))
    y_plus = F.col("y.strand") == "+"
    head, back = x["shape"] == "MS", F.col("reverse")
    y_left = F.when(y_plus, y["pos"] + plus).otherwise(y["right"] - plus)
    y_back = F.when(y_plus, y["right"] - plus).otherwise(y["pos"] + plus)
    y_tail = F.when(y_plus, y["pos"]).otherwise(y["right"] - plus)
    x_left = F.when(y_plus, x["pos"]).otherwise(x["right"])
    own_right, own_left = side("gene_x", x["chrom"], x["right"]), side("gene_x", x["chrom"], x_left)
    own_pos = side("gene_x", x["chrom"], x["pos"])
    to = lambda p: side("gene_y", y["chrom"], p)
    first = F.when(head & ~back, own_right).when(head & back, to(y_back)).when(~head & ~back, to(y["right"] - plus)).otherwise(own_pos)
    second = F.when(head & ~back, to(y_left)).when(head & back, own_right).when(~head & ~back, own_left).otherwise(to(y_tail))
    return rows.withColumns({"first": first, "second": second, "read_seq": F.when(back, revcomp("seq")).otherwise(F.col("seq"))})
