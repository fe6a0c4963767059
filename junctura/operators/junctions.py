"""Junction sequences for training and scoring: letters on both sides of a breakpoint, along the exons of the genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import anchor_sides, junction, revcomp
from junctura.operators.chimeras import ends
from junctura.operators.exons import walk
from junctura.operators.intervals import extract


def flank(spots: DataFrame, exons: DataFrame, chunks: DataFrame, key: list[str], length: int = 100) -> DataFrame:
    """spots (key, chrom, pos) with left_seq, right_seq: spliced letters before the position, and from it on."""
    walked = walk(spots, exons, length)
    out = spots
    for side in ("left", "right"):
        parts = walked.select(*key, "chrom", F.posexplode(side).alias("_i", "_p")).select(*key, "chrom", "_i", (F.col("_p.start") + 1).alias("start"), F.col("_p.end").alias("end"))
        got = extract(parts, chunks, [*key, "_i"]).groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "seq"))), lambda x: x["seq"]), "").alias(f"{side}_seq"))
        out = out.join(got, key, "left").withColumn(f"{side}_seq", F.upper(F.coalesce(f"{side}_seq", F.lit(""))))
    return out


def partner_place(kind: Column, strand: Column, other: Column) -> Column:
    """The position from which the partner is walked: behind the breakpoint where the partner's part ends there."""
    return other + F.when((kind == "SM") == (strand == "+"), 1).otherwise(0)


def scoring_sequences(best: DataFrame, anchor: DataFrame, exons: DataFrame, chunks: DataFrame, key: tuple[str, ...] = ("sample", "anchored_gene", "candidate"), length: int = 100) -> DataFrame:
    """(key, seq): for each candidate's best position (type, target, chrom, other, strand) the letters around its junction.

    On the partner's minus strand its sides are exchanged and complemented. anchor: anchored_gene, seq.
    """
    k = list(key)
    spots = best.withColumn("pos", partner_place(F.col("type"), F.col("strand"), F.col("other")))
    x = flank(spots, exons, chunks, k, length).join(anchor.select("anchored_gene", F.col("seq").alias("_anchor")), "anchored_gene")
    minus = F.col("strand") == "-"
    left = F.when(minus, revcomp("right_seq")).otherwise(F.col("left_seq"))
    right = F.when(minus, revcomp("left_seq")).otherwise(F.col("right_seq"))
    own = anchor_sides("_anchor", "target", "type", length)
    seq = F.when(F.col("type") == "MS", junction(own["left"], right, length)).otherwise(junction(left, own["right"], length))
    return x.select(*k, seq.alias("seq"))


def negatives(pairs: DataFrame, exons: DataFrame, chunks: DataFrame, contiguous: DataFrame, length: int = 100) -> DataFrame:
    """(seq, name): junctions of chimeric reads (chimeras.gene_pairs), as they arise by chance in the laboratory.

    contiguous: read_name of reads that one place of the genome explains; they go.
    """
    x = ends(pairs.join(contiguous.select("read_name").distinct(), "read_name", "left_anti"))
    side = lambda n: flank(x.select("read_name", f"{n}.chrom", F.col(f"{n}.pos").alias("pos")), exons, chunks, ["read_name"], length)
    a = side("first").select("read_name", F.col("left_seq").alias("_l"))
    b = side("second").select("read_name", F.col("right_seq").alias("_r"))
    rows = x.select("read_name", F.concat_ws("->", "first.gene", "second.gene").alias("name")).join(a, "read_name").join(b, "read_name")
    return rows.where("_l <> '' AND _r <> ''").select(junction("_l", "_r", length).alias("seq"), "name")


def positives(known: DataFrame, exons: DataFrame, chunks: DataFrame, length: int = 100) -> DataFrame:
    """(seq, name): junctions of known fusions (tables.parse_known). A side on the minus strand is walked the other way."""
    rows = known.withColumn("_id", F.concat_ws("|", "fusion", "left.chrom", F.col("left.pos").cast("string"), "right.chrom", F.col("right.pos").cast("string")))
    rows = rows.dropDuplicates(["_id"])
    out = rows.select("_id", F.col("fusion").alias("name"))
    for n in ("left", "right"):
        plus = F.col(f"{n}.strand") == "+"
        # the breakpoint's own base belongs to the junction on either side
        at = F.col(f"{n}.pos") + F.when(plus == F.lit(n == "left"), 1).otherwise(0)
        got = flank(rows.select("_id", f"{n}.chrom", at.alias("pos"), plus.alias("_plus")), exons, chunks, ["_id"], length)
        before, after = F.col("left_seq"), F.col("right_seq")
        seq = F.when(F.col("_plus"), before if n == "left" else after).otherwise(revcomp(after if n == "left" else before))
        out = out.join(got.select("_id", seq.alias(f"_{n}")), "_id")
    return out.where("_left <> '' AND _right <> ''").select(junction("_left", "_right", length).alias("seq"), "name")
