"""Helpers that the operators share: stored tables, bounded samples, joins with frequent keys, row filters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.session import checkpoint, remove, shared_folder

__all__ = ["bounded_sample", "checkpoint", "column", "columns", "held_out", "join_frequent", "keep_rows", "remove", "shared_folder", "small", "small_batches", "stored", "text_of", "unit_hash"]


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a new Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Python workers get at most so many rows at once, unless the session says otherwise.

    Whole texts are some kilobytes each; batches of Spark's 10,000 rows would take tens of megabytes several times over, in
    the executor outside its heap as well as in each worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def text_of(name: str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0. A null id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(column(id_column).cast("string")) % folds == 0, F.lit(True))


def unit_hash(*of: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, those whose key has the least hashes; all rows where there are no more than that.

    For fitting classifiers only. The key must tell rows apart; the same keys are chosen however the rows are dealt out.
    A filter on the hash leaves few more than ``most`` rows before these are put in order.
    """
    total = rows.count()
    if total <= most:
        return rows
    h = unit_hash(column(key), seed=seed)
    return rows.where(h < (most + 6 * most**0.5 + 20) / total).orderBy(h, column(key)).limit(most)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, which has been checkpointed, marked for broadcast if it has at most ``most`` rows; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= most else df


def join_frequent(rows: DataFrame, table: DataFrame, key: str, weight: str, share: int = 2000) -> DataFrame:
    """rows joined to table, which has a row for each key of rows, on a column that both have.

    weight: how many rows have the key. Keys of more than 1 in ``share`` of all rows, of which there can't be more than
    share, go to all tasks; only rows of the others are shuffled, so no key brings a task more than that part of them.
    Both sides are read twice and should be checkpointed.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    often = F.broadcast(table.where(F.col(weight) * share > total))
    rest = rows.join(often.select(key), key, "left_anti").join(table.where(F.col(weight) * share <= total), key)
    return rows.join(often, key).unionByName(rest)


def keep_rows(docs: DataFrame, decisions: DataFrame, id_column: str = "doc_id", broadcast_ids: int = 500_000) -> DataFrame:
    """The rows of docs whose id has a row with kept = true in decisions (columns: the id, kept).

    Ids are compared null-safely. Only the ids to drop are joined, as an anti-join: they are sent to all tasks while
    there are at most broadcast_ids, so that texts stay where they are, and shuffled beyond that.
    """
    out = (
        decisions.groupBy(column(id_column).alias("_dropped_id"))
        .agg(F.max(F.col("kept").cast("int")).alias("_any"))
        .where(F.col("_any") == 0)
        .select("_dropped_id")
    )
    out = small(checkpoint(out), broadcast_ids)
    return docs.join(out, docs[f"`{id_column}`"].eqNullSafe(out["_dropped_id"]), "left_anti")
