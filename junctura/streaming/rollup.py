"""The rollup over cells as a streaming aggregation: predictions arrive, sums per fusion are kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from junctura.operators.evidence import balanced
from junctura.plans import catalogue
from junctura.session import checkpoint, remove, shared_folder


def sums(predictions: DataFrame, by: list[str], spanning: str = "spanning_count", split: str = "breakpoint_count") -> DataFrame:
    """by, spanning_count, breakpoint_count, cell_count: what a stream can sum row by row, in bounded state for each fusion."""
    return predictions.groupBy(*by).agg(F.sum(spanning).alias("spanning_count"), F.sum(split).alias("breakpoint_count"), F.count(F.lit(1)).alias("cell_count"))


def windowed(predictions: DataFrame, by: list[str], time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """sums() in tumbling windows; rows of windows that ended more than ``late`` before the newest row are left out, and these
    windows leave the state. So written by keep_changes (in complete mode Spark would keep all windows).
    """
    return sums(predictions.withWatermark(time, late), [*by, F.window(time, width).alias("window")], "spanning", "split")


def keep_changes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the totals that a micro-batch changed to path/batch=<number>; a batch that runs again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The totals after the last batch: of each key the row of the newest batch that changed it."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*by, "batch")]
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col("batch").cast("long")).alias("_last"))
    return newest.select(*by, *[F.col(f"_last.{c}").alias(c) for c in rest])


def _run(stream: DataFrame, by: list[str]) -> DataFrame:
    """The totals of a stream of sums after all that there is has been read, in micro-batches."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
    query = keep_changes(stream, f"{at}/totals", f"{at}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    found = checkpoint(latest(spark, f"{at}/totals", by))
    remove(spark, at)
    return found


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of predictions, balanced ones."""
    still = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(still.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    whole = lambda x: F.floor(x).cast("long")
    v = F.col("value")
    rows = source.select(F.col("event_type").alias("fusion"), F.col("ts").cast("timestamp").alias("ts"), (whole(v) % 30).alias("spanning"), (whole(v * 3) % 30).alias("split"))
    return rows.where(balanced(F.col("spanning"), F.col("split")))


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of predictions, balanced ones summed by type."""
    return _run(sums(_arriving(spark, sf_dir), ["fusion"], "spanning", "split"), ["fusion"])


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums in windows of an hour."""
    found = _run(windowed(_arriving(spark, sf_dir), ["fusion"]), ["fusion", "window"])
    return found.select("fusion", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "spanning_count", "breakpoint_count", "cell_count")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_rollup": stream_rollup, "stream_windows": stream_windows}
_KEPT = f"WITH {catalogue.EV}, k AS (SELECT ev.*, ts FROM ev JOIN events ON id = event_id WHERE spanning + split > 0 AND spanning * 10 >= split AND split * 10 >= spanning)"
SQL = {
    "stream_rollup": f"{_KEPT} SELECT fusion, CAST(sum(spanning) AS BIGINT) AS spanning_count, CAST(sum(split) AS BIGINT) AS breakpoint_count, count(*) AS cell_count FROM k GROUP BY fusion",
    "stream_windows": f"{_KEPT} SELECT fusion, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, CAST(sum(spanning) AS BIGINT) AS spanning_count, CAST(sum(split) AS BIGINT) AS breakpoint_count, count(*) AS cell_count FROM k GROUP BY ALL",
}
