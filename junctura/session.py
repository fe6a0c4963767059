"""Sessions, checkpoints, and sending the package to executors that don't have it."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def session(app: str = "junctura", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf has further settings with dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # files of checkpoints go when nothing refers to them
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application.

    Workers on this machine that find it in PYTHONPATH need nothing.
    """
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    found = str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) and sc.master.startswith("local")
    if sc.applicationId in _sent or found or not package.is_dir():
        return
    _sent.add(sc.applicationId)
    at = tempfile.mkdtemp(prefix="junctura-")  # Spark serves the file as long as the application runs
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    copy = Path(at, "tree", package.name)
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(f"{at}/{package.name}", "zip", copy.parent))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine (tests) a temporary one is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the checkpoints and shuffles that nothing refers to, now and not when the driver's memory happens to run short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _file_system(spark, path)
    return files.exists(at)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of the last change) of the files below a path or pattern, wherever Spark's file systems have it."""
    at, files = _file_system(spark, path)
    out = []
    for found in files.globStatus(at) or []:
        below = files.listFiles(found.getPath(), True)
        while below.hasNext():
            f = below.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a step has written, wherever Spark's file systems have it; nothing happens if it isn't there."""
    at, files = _file_system(spark, path)
    files.delete(at, True)
