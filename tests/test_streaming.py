"""Sums over cells as files arrive one by one."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from junctura.streaming import rollup

SCHEMA = "fusion string, ts timestamp, spanning long, split long"


def arriving(spark, folder, batches):
    """A stream of the batches, a file and a micro-batch each, in this order."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/tmp-{i}")
        part = next((folder / f"tmp-{i}").glob("part-*"))
        part.rename(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/*.parquet")


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def run(stream, tmp_path, by):
    query = rollup.keep_changes(stream, f"{tmp_path}/totals", f"{tmp_path}/state")
    query.awaitTermination()
    assert query.exception() is None
    return query, rollup.latest(stream.sparkSession, f"{tmp_path}/totals", by)


def test_late_rows_are_left_out_and_closed_windows_leave(spark, tmp_path):
    batches = [[("A--B", at(3, h, 5), 1, 2)] for h in range(8)]
    batches.insert(5, [("A--B", at(1, 0), 100, 100), ("A--B", at(3, 4, 30), 1, 1)])  # two days late, and in time
    query, found = run(rollup.windowed(arriving(spark, tmp_path / "in", batches), ["fusion"]), tmp_path, ["fusion", "window"])
    got = {r.window.start: (r.spanning_count, r.breakpoint_count, r.cell_count) for r in found.collect()}
    assert got == {at(3, h): ((2, 3, 2) if h == 4 else (1, 2, 1)) for h in range(8)}
    progress = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 1
    assert max(p["numRowsTotal"] for p in progress) <= 3 and len(progress) >= 9


def test_totals_are_those_of_all_batches(spark, tmp_path):
    batches = [[(f"g{i % 3}", at(1, 0), i, 1), ("all", at(1, 0), 1, 1)] for i in range(6)]
    _, found = run(rollup.sums(arriving(spark, tmp_path / "in", batches), ["fusion"], "spanning", "split"), tmp_path, ["fusion"])
    assert {r.fusion: (r.spanning_count, r.cell_count) for r in found.collect()} == {"g0": (3, 2), "g1": (5, 2), "g2": (7, 2), "all": (6, 6)}


def test_a_query_goes_on_where_it_stopped(spark, tmp_path):
    """More files after a query has ended: the next one reads these only, and sums go on from the kept state."""
    stream = arriving(spark, tmp_path / "in", [[("A", at(1, 0), 1, 1)], [("A", at(1, 0), 2, 1)]])
    run(rollup.sums(stream, ["fusion"], "spanning", "split"), tmp_path, ["fusion"])
    spark.createDataFrame([("A", at(1, 1), 10, 1), ("B", at(1, 1), 5, 5)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/tmp-9")
    next((tmp_path / "in" / "tmp-9").glob("part-*")).rename(tmp_path / "in" / "9.parquet")
    query, found = run(rollup.sums(stream, ["fusion"], "spanning", "split"), tmp_path, ["fusion"])
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2
    assert {r.fusion: r.spanning_count for r in found.select("fusion", F.col("spanning_count")).collect()} == {"A": 13, "B": 5}
