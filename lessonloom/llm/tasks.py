"""Arrow tasks whose functions live in this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lessonloom
from lessonloom.functions.ranks import unused

_shipped: dict[str, tempfile.TemporaryDirectory] = {}  # kept while the application may fetch


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 1024  # whole texts are long rows; Spark's own default is 10,000


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors through Spark's own file server, once per
    application, and keep Arrow batches of texts small if the session left them at the default."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, ROWS_PER_BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(lessonloom.__file__)))
    folder = tempfile.TemporaryDirectory()
    path = os.path.join(folder.name, "lessonloom_tasks.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for at, _, names in os.walk(os.path.join(root, "lessonloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    bundle.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = folder


def _tidy(run):
    """``run``, whose worker gives back at the end of a task what it no longer uses."""

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(run), schema)


@contextmanager
def block_batches(spark: SparkSession, rows: int = 64):
    """Small Arrow batches while jobs over packed blocks run, whose rows are large."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def set_aside(df: DataFrame, name: str) -> tuple[DataFrame, list[Column]]:
    """``df`` without a column called ``name``, and the columns that give it back as it was."""
    other = unused(df, name)
    clashing = {c: other for c in df.columns if c.lower() == name.lower()}
    return df.withColumnsRenamed(clashing), [F.col(clashing.get(c, c)).alias(c) for c in df.columns]
