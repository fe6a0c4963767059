"""Ranks within groups of any size, and what is computed from ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.operators.intervals import carried, in_ranges
from junctura.session import checkpoint


def global_rank(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) within their group in the given order, which must tell rows apart.

    A group may hold all rows: they are dealt out by range of (by, order), ranked within each range, and moved up by what
    the ranges before it hold of their group. Only (range, group) counts are gathered by group.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.withColumns({f"_o{i}": c for i, c in enumerate(cols)})
    os = [f"_o{i}" for i in range(len(cols))]
    # checkpointed, so that both uses see the same ranges
    dealt = checkpoint(keyed.repartitionByRange(*by, *os).withColumn("_part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*os))
    counts = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]]
    ranked = dealt.withColumn("_local", local).join(counts, same)
    return ranked.select(*[F.col(c) for c in rows.columns], (F.col("_local") + F.col("_before")).alias(name))


def auc(rows: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, positives, negatives, auc): the chance that a positive scores over a negative, ties counted half.

    Only the distinct scores are put in order, in ranges, to each of which the negatives of the ranges before it are
    carried on; of a group with one label only, auc is null. A table without rows gives no groups, and one null row
    without by.
    """
    group = list(by) or ["_all"]
    at = rows.withColumn("_all", F.lit(0)).groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    dealt = in_ranges(at, group, [score])
    own = Window.partitionBy("_part", *group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.join(carried(dealt, group, "_n", F.sum), ["_part", *group], "left")
    below = F.coalesce(F.sum("_n").over(own), F.lit(0)) + F.coalesce("_carried", F.lit(0))
    won = before.withColumn("_won", F.col("_p") * (2 * below + F.col("_n")))
    g = won.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum("_won").alias("_won"))
    return g.select(*by, "positives", "negatives", (F.col("_won") / F.nullif(2 * F.col("positives") * F.col("negatives"), F.lit(0))).alias("auc"))


def accuracy(label: Column, predicted: Column) -> Column:
    return F.avg((label == predicted).cast("int"))


def mode_of(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, n): each group's most frequent value, the least of those that tie."""
    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*by, F.col("_b.v").alias(value), (-F.col("_b.m")).alias("n"))


def running_share(rows: DataFrame, by: list[str], seq: str, letters: str = "ATGC") -> DataFrame:
    """(by, at, share_<letter>...): at each place (from 1) each letter's share of all letters up to it. by names one row."""
    spots = rows.select(*by, F.posexplode(F.split(seq, "")).alias("_i", "_l")).where("_l <> ''").withColumn("at", F.col("_i") + 1)
    upto = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return spots.select(*by, "at", *[(F.sum((F.col("_l") == x).cast("int")).over(upto) / F.col("at")).alias(f"share_{x}") for x in letters])


def folds(rows: DataFrame, order: list[Column | str], k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with fold, 0 to k - 1, dealt out in turn in the given order within each ``by``."""
    ranked = global_rank(rows, list(by), order, "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")
