"""Interval joins, islands and sequences of intervals. Coordinates count from 1 and include both ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from junctura.functions.sequences import revcomp
from junctura.session import checkpoint


def binned(df: DataFrame, start: str, end: str, size: int, name: str = "_bin") -> DataFrame:
    """A row for each bin that the interval touches. Intervals that end before they start touch none."""
    bins = F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))
    return df.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(bins))


def overlap_pairs(a: DataFrame, b: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", size: int = 1 << 14, prefix: str = "b_") -> DataFrame:
    """Each pair of overlapping intervals of a and b once; columns of b get the prefix.

    Both sides are filed by bins, which gives an equi-join; a pair counts in the bin of its first common base.
    """
    right = binned(b.select(*[F.col(c).alias(prefix + c) for c in b.columns]), prefix + start, prefix + end, size, "_rbin")
    left = binned(a, start, end, size, "_lbin")
    cond = (
        (F.col(chrom) == F.col(prefix + chrom)) & (F.col("_lbin") == F.col("_rbin"))
        & (F.col(start) <= F.col(prefix + end)) & (F.col(end) >= F.col(prefix + start))
        & (F.col("_lbin") == F.floor(F.greatest(F.col(start), F.col(prefix + start)) / size))
    )
    return left.join(right, cond).drop("_lbin", "_rbin")


def _touched(a: DataFrame, b: DataFrame, chrom: str, start: str, end: str, size: int) -> DataFrame:
    """The distinct intervals of a that overlap one of b."""
    spots = a.select(F.col(chrom).alias("_c"), F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    other = binned(b.select(F.col(chrom).alias("_oc"), F.col(start).alias("_os"), F.col(end).alias("_oe")).distinct(), "_os", "_oe", size, "_ob")
    cond = (F.col("_c") == F.col("_oc")) & (F.col("_bin") == F.col("_ob")) & (F.col("_s") <= F.col("_oe")) & (F.col("_e") >= F.col("_os"))
    return binned(spots, "_s", "_e", size).join(other, cond, "left_semi").select("_c", "_s", "_e").distinct()


def overlapping(a: DataFrame, b: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", size: int = 1 << 14, how: str = "left_semi") -> DataFrame:
    """The rows of a that overlap an interval of b; with how = left_anti those that don't."""
    hit = _touched(a, b, chrom, start, end, size)
    return a.join(hit, (a[chrom] == hit["_c"]) & (a[start] == hit["_s"]) & (a[end] == hit["_e"]), how)


def islands(df: DataFrame, by: list[str], start: str = "start", end: str = "end", slack: int = 0) -> DataFrame:
    """(by, island, start, end, n): maximal unions of intervals that overlap, touch, or lie within slack of each other.

    Equal intervals are counted first. The others are dealt out by ranges of (by, start, end), so that no task has all
    rows of a group; how far the ranges before it reach, and how many islands they begin, are carried on to each range.
    island counts from 1 in each group.
    """
    rows = df.groupBy(*by, F.col(start).alias("start"), F.col(end).alias("end")).agg(F.count(F.lit(1)).alias("n"))
    dealt = in_ranges(rows, by, ["start", "end"])
    own = Window.partitionBy("_part", *by).orderBy("start", "end")
    reach = carried(dealt, by, "end", F.max)
    x = dealt.join(reach, ["_part", *by], "left")
    before = F.greatest(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    x = x.withColumn("_new", F.coalesce((F.col("start") > before + slack).cast("int"), F.lit(1))).drop("_carried")
    return numbered(x, by, own, "island").groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def in_ranges(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows dealt out by ranges of (by, order), with the range's number as _part; checkpointed, so that it stays the same."""
    return checkpoint(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))


def carried(dealt: DataFrame, by: list[str], column: str, over: Callable[[str], Column]) -> DataFrame:
    """(_part, by, _carried): the sum or maximum of a column over all ranges of the group before this one; null in the first.

    Only one row for each range and group is put in order.
    """
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("_part", *by).agg(over(column).alias("_each"))
    return each.select("_part", *by, over("_each").over(w).alias("_carried"))


def numbered(marked: DataFrame, by: list[str], own: WindowSpec, name: str) -> DataFrame:
    """marked (in_ranges, with _new 0 or 1) with a number that _new raises, from 1 in each group."""
    marked = checkpoint(marked)
    before = carried(marked, by, "_new", F.sum)
    local = F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_local", local).join(before, ["_part", *by], "left").withColumn(name, F.col("_local") + F.coalesce("_carried", F.lit(0))).drop("_local", "_carried", "_new", "_part")


def runs(df: DataFrame, chrom: str, label: str, order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(chrom, label, run, start, end, n): islands of rows that follow each other in order with the same label.

    Another label's row in between ends a run even where the intervals overlap. For annotation tables: a chromosome is
    one group.
    """
    w = Window.partitionBy(chrom).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_turn", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_turn").over(upto))
    inner = Window.partitionBy(chrom, "_run").orderBy(*order)
    before = F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("_new").over(upto))
    return x.groupBy(chrom, label, "run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))


def gap_components(df: DataFrame, by: list[str], position: str, gap: int = 3) -> DataFrame:
    """The distinct positions of each group with a component: neighbours at most gap apart share one, in chains.

    Positions are dealt out by ranges, and the last one before each range is carried on, as in islands.
    """
    dealt = in_ranges(df.select(*by, position).distinct(), by, [position])
    own = Window.partitionBy("_part", *by).orderBy(position)
    x = dealt.join(carried(dealt, by, position, F.max), ["_part", *by], "left")
    before = F.coalesce(F.lag(position).over(own), F.col("_carried"))
    x = x.withColumn("_new", F.coalesce((F.col(position) - before > gap).cast("int"), F.lit(1))).drop("_carried")
    return numbered(x, by, own, "component").select(*by, position, "component")


def near_pairs(df: DataFrame, same: list[str], near: dict[str, int], order: Column | str) -> DataFrame:
    """Pairs of rows a, b (structs) with equal ``same`` columns and every ``near`` column less than its distance apart.

    The first near column is filed by bins of its distance, each row beside its neighbours' bins, so a pair is found
    once. order tells the rows of a pair apart: a comes before b.
    """
    (first, reach), *rest = near.items()
    key = F.floor(F.col(first) / reach)
    left = df.select(F.struct("*").alias("a"), *[F.col(c).alias(f"_a{c}") for c in same], key.alias("_bin"))
    right = df.select(F.struct("*").alias("b"), *[F.col(c).alias(f"_b{c}") for c in same], F.explode(F.array(key - 1, key, key + 1)).alias("_obin"))
    cond = F.col("_bin") == F.col("_obin")
    for c in same:
        cond &= F.col(f"_a{c}") == F.col(f"_b{c}")
    for c, d in near.items():
        cond &= F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) < d
    name = order if isinstance(order, str) else None
    cond &= F.col(f"a.{name}") < F.col(f"b.{name}")
    return left.join(right, cond).select("a", "b")


def pieces(seq: str, size: int) -> Column:
    """The letters in pieces of one size, the last one shorter: cut in a single pass over the sequence."""
    return F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def chunked(genome: DataFrame, size: int = 1 << 14) -> DataFrame:
    """(chrom, chunk, seq): sequences cut to pieces, for joins by place."""
    rows = genome.where(F.length("seq") > 0).select("chrom", F.posexplode(pieces("seq", size)).alias("chunk", "seq"))
    return rows.select("chrom", F.col("chunk").cast("long").alias("chunk"), "seq")


def extract(intervals: DataFrame, chunks: DataFrame, key: list[str], size: int = 1 << 14, strand: str | None = None) -> DataFrame:
    """intervals with seq: the letters of [start, end], from the other strand where strand is '-'.

    key identifies a row of intervals. Parts beyond the ends of a chromosome are missing from seq; a chromosome that
    isn't there gives an empty one.
    """
    own = F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size)))
    parts = intervals.where("start <= end").select(*key, F.col("chrom").alias("_c"), "start", "end", own.alias("_k"))
    joined = parts.join(chunks, (F.col("_c") == chunks["chrom"]) & (F.col("_k") == chunks["chunk"]))
    base = F.col("_k") * size
    low = F.greatest(F.col("start") - base, F.lit(1))
    high = F.least(F.col("end") - base, F.lit(size))
    piece = F.substring("seq", low.cast("int"), (high - low + 1).cast("int"))
    whole = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), piece.alias("s")))).alias("_p"))
    seq = F.coalesce(F.array_join(F.transform("_p", lambda x: x["s"]), ""), F.lit(""))
    if strand:
        seq = F.when(F.col(strand) == "-", revcomp(seq)).otherwise(seq)
    return intervals.join(whole, key, "left").withColumn("seq", seq).drop("_p")
