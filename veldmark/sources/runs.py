"""Snapshots of inputs, and runs that can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.operators.errors import FormatError


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files of a folder; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, error_code) of files that are not what they were: changed, gone or new."""
    x, y = before.alias("x"), after.alias("y")
    both = x.join(y, F.col("x.path") == F.col("y.path"), "full_outer")
    same = F.col("x.length").eqNullSafe(F.col("y.length")) & F.col("x.modificationTime").eqNullSafe(F.col("y.modificationTime"))
    code = F.when(F.col("y.path").isNull(), "input_missing").when(F.col("x.path").isNull(), "input_new").otherwise("input_changed")
    return both.where(~same).select(F.coalesce("x.path", "y.path").alias("path"), code.alias("error_code"))


def cancellable(spark: SparkSession, action: Callable, is_cancelled: Callable[[], bool], poll: float = 0.5):
    """The result of ``action()``; its Spark jobs end once ``is_cancelled()`` is true, and nothing is committed.

    Checked before the first job too, as a conversion is before it reads its input.
    """
    if is_cancelled():
        raise FormatError("cancelled", "cancelled")
    tag, done, hit = f"veldmark-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch():
        while not done.wait(poll):
            if is_cancelled():
                hit.set()
                spark.sparkContext.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        return action()
    except Exception as e:
        if hit.is_set():
            raise FormatError("cancelled", "cancelled") from e
        raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)
