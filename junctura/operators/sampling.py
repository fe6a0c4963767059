"""Samples that can be drawn again: balanced splits, halving chains, read numbers for a coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions.sequences import filled, lacking, masked
from junctura.operators.ranks import global_rank


def balanced_split(rows: DataFrame, label: str, order: list[Column | str], train_percent: int = 70) -> DataFrame:
    """rows with part: 'train' or 'test'. Of each label as many rows are taken as the rarest has, in the given order.

    The order must tell rows apart. Rows without a label go.
    """
    rows = rows.where(F.col(label).isNotNull())
    least = rows.groupBy(label).count().agg(F.min("count")).scalar()
    ranked = global_rank(rows, [label], order, "_rank")
    cut = F.floor(least * train_percent / 100)
    part = F.when(F.col("_rank") <= cut, "train").when(F.col("_rank") <= least, "test")
    return ranked.withColumn("part", part).where("part IS NOT NULL").drop("_rank")


def halving_chain(rows: DataFrame, by: list[str], order: list[Column | str], steps: int = 7) -> DataFrame:
    """rows with level: the last of ``steps`` halvings (1, 2, ...) that still has the row; 0 if the first drops it.

    A halving keeps the first n div 2 rows in the given order. Mates of a pair are one row of this table, so they stay
    together. The sample at step s is where level >= s.
    """
    n = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(rows, by, order, "_rank").join(n, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    level = sum(((F.col("_rank") <= F.floor(F.col("_n") / F.lit(2**s))).cast("int") for s in range(1, steps + 1)), F.lit(0))
    return ranked.withColumn("level", level).drop("_rank", "_n", *[f"_{c}" for c in by])


def pairs_for_coverage(length: Column, coverage: Column, read_length: int = 101) -> Column:
    """How many read pairs cover a sequence so many times."""
    return F.floor(coverage * length / (2 * read_length)).cast("long")


def masked_alike(positive: DataFrame, negative: DataFrame, size: int, order: list[Column | str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(positive, negative) with sequences of one size: negatives filled with N, and of each positive as many letters masked
    as the negative of the same place lacks, so that lengths don't tell the labels apart.

    Places are those of the order, which must tell rows of either apart. Positives beyond the number of negatives, and those
    whose negative lacks nothing, stay as they are.
    """
    lack = global_rank(negative.withColumn("_lack", lacking(seq, size)), [], order, "_nr").where("_lack > 0").select("_nr", "_lack")
    placed = global_rank(positive, [], order, "_nr").join(lack, "_nr", "left")
    text = F.coalesce(masked(seq, F.coalesce("_lack", F.lit(0))), F.col(seq))
    return placed.withColumn(seq, text).select(*positive.columns), negative.withColumn(seq, filled(seq, size))
