"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each row is repeated a Poisson number of times whose mean is the target repetition rate of its source; the number is
the inverse of the Poisson distribution at a number in [0, 1) that a hash of the seed and the id gives. The copies are
dealt out and sorted by a second hash, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, columns, small

#: Seeded hashes use the first 13 hex digits of an MD5: 52 bits, which a double holds exactly.
UNIT = 1 << 52


def seeded(seed: int, *columns: Column) -> Column:
    """A whole number in [0, 2^52) from the seed and the columns, a null as the empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long")


def repetition_rates(docs: DataFrame, source_column: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): how often a row of the source is repeated on average.

    weights: the sources' shares of the result; sources that it doesn't name get none. Without weights a source weighs
    the number of its rows to the power of temperature. The result has epochs times the rows of docs on average.
    """
    n = docs.groupBy(column(source_column).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    n = n.withColumn("_w", weight)
    weights_sum, rows_sum = n.agg(F.sum("_w")).scalar(), n.agg(F.sum("_n")).scalar()
    rate = F.col("_w") / F.nullif(weights_sum, F.lit(0.0)) * rows_sum * F.lit(float(epochs)) / F.col("_n")
    return n.select("_source", "_n", F.coalesce(rate, F.lit(0.0)).alias("_rate"))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k with u < P(X <= k), X of a Poisson distribution with this mean.

    The sum over k runs until it passes u, or until what is left of the distribution is below the resolution of u.
    Rates over 500 are split into equal parts by the caller.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.when(u < a["c"], a).otherwise(F.struct(k.alias("k"), p.alias("p"), (a["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda a: a["k"])


def drawn(docs: DataFrame, id_column: str, source_column: str, weights: dict[str | None, float] | None, temperature: float, epochs: float, seed: int, broadcast_sources: int) -> DataFrame:
    """(_row, _copy, _key) in a global shuffle: each row, as a struct, as often as its number says; copies count from 0."""
    rates = repetition_rates(docs, source_column, weights, temperature, epochs)
    # the sum of independent Poisson numbers is one: large rates are drawn in parts, where exp(-rate) is no zero
    rates = small(checkpoint(rates), broadcast_sources).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / 500)).cast("int"))
    # a row travels as one struct, so that its columns' names can't clash
    rows = docs.select(F.struct(*columns(docs)).alias("_row"), column(id_column).alias("_id"), column(source_column).alias("_key"))
    u = lambda i: seeded(seed, F.col("_id"), i) / F.lit(float(UNIT))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda i: poisson_inverse(u(i), F.col("_rate") / F.col("_parts")))
    count = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    joined = rows.join(rates, F.col("_key").eqNullSafe(F.col("_source"))).select("_row", "_id", count.alias("_count"))
    copies = joined.where("_count > 0").select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_copy"))
    out = copies.select("_row", "_copy", seeded(seed + 1, F.col("_id"), F.col("_copy")).alias("_key"))
    return out.repartition("_key").sortWithinPartitions("_key")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    broadcast_sources: int = 200_000,
) -> DataFrame:
    """docs with each row repeated, and two columns more: copy (from 0) and shuffle_key, by which the rows are to be read.

    Rows of one id (repeated rows, null ids) get the same count. A null source is a source. Weights must not be
    negative; a source of weight 0 goes. Columns of docs named copy or shuffle_key are replaced (see replicated); others
    stay as they are, whatever their names, texts null, empty or long included. An empty table gives an empty result.
    The rates go to all tasks up to broadcast_sources of them; beyond that rows are shuffled by source.
    """
    docs = docs.drop("copy", "shuffle_key")
    out = drawn(docs, id_column, source_column, weights, temperature, epochs, seed, broadcast_sources)
    return out.select("_row.*", F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key"))


def replicated(
    docs: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    broadcast_sources: int = 200_000,
) -> DataFrame:
    """The rows of mix() in their order with the columns of docs and no others; everything else is as there."""
    return drawn(docs, id_column, source_column, weights, temperature, epochs, seed, broadcast_sources).select("_row.*")
