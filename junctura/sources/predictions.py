"""Tables of predictions, one sample or many, and what is summed over samples."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.session import exists, listed

#: The reported columns' headings.
HEADINGS = {
    "sample": "Cell_name", "fusion_gene": "Fusion_gene", "anchored_gene": "Anchored_gene_X", "x_clip": "X_clip_location", "partner_gene": "Partner_gene_Y", "y_clip": "Y_clip_location",
    "natural_score": "Natural_score", "spanning_count": "Spanning_read_count", "breakpoint_count": "Breakpoint_read_count", "spanning_reads": "Spanning_reads", "split_reads": "Breakpoint_reads",
    "other_positions": "Other_positions", "cell_count": "Single_cells_count", "cells": "Single_cells_name",
}


def write_tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated with headings; arrays of reads are joined with semicolons."""
    cols = [F.array_join(c, ";").alias(HEADINGS.get(c, c)) if t.startswith("array") else F.col(c).alias(HEADINGS.get(c, c)) for c, t in rows.dtypes]
    rows.select(*cols).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions that write_tsv() wrote, columns by name; reads are arrays again."""
    back = {v: k for k, v in HEADINGS.items()}
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    rows = rows.select(*[F.col(c).alias(back.get(c, c)) for c in rows.columns])
    kinds = {"natural_score": "double", "spanning_count": "long", "breakpoint_count": "long", "cell_count": "long"}
    for c in rows.columns:
        if c in kinds:
            rows = rows.withColumn(c, F.col(c).cast(kinds[c]))
        elif c in ("spanning_reads", "split_reads"):
            rows = rows.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ";")))
    return rows


def write_sequences(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Labelled junction sequences, one a line; later samples are appended."""
    rows.select("seq", "name").write.mode(mode).option("sep", "\t").csv(path)


def digest(spark: SparkSession, paths: list[str], settings: object = None) -> str:
    """What tells the inputs of a stage apart: every file below the paths with its length and time, and the settings."""
    files = sorted(f for p in paths for f in listed(spark, p))
    return hashlib.sha256(repr((files, settings)).encode()).hexdigest()[:16]


def stages(spark: SparkSession, make: Callable[[], tuple[DataFrame, ...]], path: str, inputs: str, names: tuple[str, ...]) -> tuple[DataFrame, ...]:
    """The tables of a stage: read if an earlier run finished all of them for the same inputs, else made and written first.

    make is called only then, so that nothing of a finished stage runs again, steps that run when they are called included.
    inputs: a digest(); it is part of the tables' folder, so other inputs get another one. Spark marks a table as finished
    (_SUCCESS) when the whole job has succeeded, so what is read is complete.
    """
    at = {name: f"{path}/inputs-{inputs}/{name}" for name in names}
    if not all(exists(spark, f"{x}/_SUCCESS") for x in at.values()):
        for name, df in zip(names, make(), strict=True):
            df.write.mode("overwrite").parquet(at[name])
    return tuple(spark.read.parquet(x) for x in at.values())


def stage(spark: SparkSession, make: Callable[[], DataFrame], path: str, inputs: str) -> DataFrame:
    """stages() of one table."""
    return stages(spark, lambda: (make(),), path, inputs, ("table",))[0]
