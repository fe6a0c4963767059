"""Importance resampling towards a target corpus: position tables of words, n-grams by window, gains by hashed bucket.

A document's words are exploded with their places; ``lead`` over a document's places sets the following words beside each
word, one more for each order, and what they make together is hashed to a bucket. A bucket's gain is the log ratio of its
share in the target to its share in the documents, a document's weight the mean gain of its n-grams. Adding a Gumbel
number of the document's own to the weight and drawing the highest scores is drawing without replacement by importance.

Texts are shuffled once, whole, by row, so that the exploded words stay where their window needs them; the table of
positions keeps a bucket for each order and word, and it is written once and read by column.
"""

from __future__ import annotations

import uuid
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.common import checkpoint, column, keep_rows, remove, shared_folder, text_of
from junctura.operators.ranks import global_rank

#: What stands between words: ASCII but for digits and letters (A-Z are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; A-Z and no other letters are lower-cased."""
    return F.array_remove(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), BETWEEN), "")


def positions(docs: DataFrame, id_column: str, text_column: str, orders: int, buckets: int, part_bytes: int = 16 << 20) -> DataFrame:
    """(_row, _id, _b1, ... by order): for each word of a row of docs the buckets of the n-grams that begin there.

    A bucket is null where too few words follow; a row without words has one line of nulls. Texts are dealt out by row to
    parts of about part_bytes of text, so a part's words can be sorted in memory.
    """
    text = text_of(text_column)
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // part_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), column(id_column).alias("_id"), text.alias("_text")).repartition(parts, "_row")
    spots = rows.select("_row", "_id", F.posexplode_outer(words(F.col("_text"))).alias("_at", "_word"))
    place = Window.partitionBy("_row").orderBy("_at")
    following = [F.lead("_word", k).over(place).alias(f"_w{k}") for k in range(1, orders)]
    beside = spots.select("_row", "_id", F.col("_word").alias("_w0"), *following)

    def bucket(n: int) -> Column:
        gram = F.crc32(F.concat_ws(" ", *[f"_w{k}" for k in range(n)])) % buckets
        return F.when(F.col(f"_w{n - 1}").isNotNull(), gram).cast("int")

    return beside.select("_row", "_id", *[bucket(n).alias(f"_b{n}") for n in range(1, orders + 1)])


def bucket_counts(table: DataFrame, orders: int) -> DataFrame:
    """(_bucket, _n): how many n-grams of a position table are in each bucket; each order reads its own column."""
    each = [table.where(F.col(f"_b{n}").isNotNull()).groupBy(F.col(f"_b{n}").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")) for n in range(1, orders + 1)]
    return reduce(DataFrame.unionByName, each).groupBy("_bucket").agg(F.sum("_n").alias("_n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(_bucket, _gain) for all buckets: thousandths of the log ratio of the shares in target and source, a count of one added."""
    s = source.select("_bucket", F.col("_n").alias("_s"))
    t = target.select("_bucket", F.col("_n").alias("_t"))
    both = s.join(t, "_bucket", "full").select(F.col("_bucket").cast("int").alias("_bucket"), F.coalesce("_s", F.lit(0)).cast("double").alias("_s"), F.coalesce("_t", F.lit(0)).cast("double").alias("_t"))
    both = checkpoint(both)  # at most a row for each bucket
    total_s, total_t = both.agg(F.coalesce(F.sum("_s"), F.lit(0.0)), F.coalesce(F.sum("_t"), F.lit(0.0))).first()
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_bucket")).join(F.broadcast(both), "_bucket", "left")
    s, t = F.coalesce("_s", F.lit(0.0)), F.coalesce("_t", F.lit(0.0))
    ratio = ((t + 1) * F.lit(float(total_s + buckets))) / ((s + 1) * F.lit(float(total_t + buckets)))
    return every.select("_bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("_gain"))


def document_weights(table: DataFrame, gain: DataFrame, orders: int) -> DataFrame:
    """(_row, _id, _words, n_features, weight) of a position table; the gains, a row for each bucket, go to all tasks."""
    for n in range(1, orders + 1):
        table = table.join(F.broadcast(gain.select(F.col("_bucket").alias(f"_b{n}"), F.col("_gain").alias(f"_g{n}"))), f"_b{n}", "left")
    summed = table.groupBy("_row").agg(
        F.first("_id").alias("_id"), F.count("_b1").alias("_words"), reduce(Column.__add__, [F.count(f"_b{n}") for n in range(1, orders + 1)]).alias("n_features"),
        reduce(Column.__add__, [F.coalesce(F.sum(f"_g{n}"), F.lit(0)) for n in range(1, orders + 1)]).alias("_sum"),
    )
    mean = F.when(F.col("n_features") > 0, F.floor(F.col("_sum") / F.col("n_features"))).otherwise(0)
    return summed.select("_row", "_id", "_words", "n_features", mean.cast("long").alias("weight"))


def gumbel(seed: int, of: Column) -> Column:
    """A Gumbel number of the seed and a column (null as the empty text), in floored thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(of.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text: str = "text",
    orders: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank.

    rank is 1, 2, 3, ... for the drawn rows, in the order of their scores, and null for others. Of the rows with at least
    least_words words percent of a hundred (floored) are drawn; ties go to the smaller id (null last), then to any row.

    Null and empty texts have no features and weight 0, and are drawn only if least_words is 0; long ones are read whole.
    Repeated rows each have a row and a rank of their own, with equal scores. Target texts that are null or empty add
    nothing; an empty target gives the gains of one. Other columns are not read, whatever their names. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/positions-{uuid.uuid4().hex}"
    positions(docs, id_column, text_column, orders, buckets).write.option("compression", "zstd").parquet(at)
    table = spark.read.parquet(at)
    aim = target.select(F.lit(0).alias("_none"), column(target_text).alias("_aim"))
    gain = checkpoint(gains(bucket_counts(table, orders), bucket_counts(positions(aim, "_none", "_aim", orders, buckets), orders), buckets))
    weighed = checkpoint(document_weights(table, gain, orders))
    remove(spark, at)

    able = F.col("_words") >= least_words
    scored = weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("_id")))
    drawn = percent * weighed.where(able).count() // 100
    ranked = global_rank(scored, [], [(~able).cast("int"), -F.col("score"), F.col("_id").isNull(), "_id", "_row"], "_rank")
    rank = F.when(able & (F.col("_rank") <= drawn), F.col("_rank").cast("long"))
    return ranked.select(F.col("_id").alias(id_column), "n_features", "weight", "score", rank.alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that resample() draws, with their columns as they were; rows that share an id go or stay together."""
    found = resample(docs, target, id_column, **options)
    return keep_rows(docs, found.select(column(id_column).alias(id_column), F.col("rank").isNotNull().alias("kept")), id_column)
