"""Session defaults for local runs, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lessonloom", master: str | None = None) -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.lessonloom.textPartitions", "8")
        )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else a folder
    below the session's warehouse, which all executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


# Folders made in the present scope, and where they lie; of this thread's own call chain only.
_scopes: ContextVar[tuple[list[tuple[str, str]], ...]] = ContextVar("scopes", default=())
_homes: ContextVar[tuple[str, ...]] = ContextVar("homes", default=())


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the present :func:`scratch` folder, else in :func:`shared_dir`."""
    home = _homes.get()[-1] if _homes.get() else shared_dir(spark)
    path = f"{home}/lessonloom-{label}-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append((label, path))
    return path


@contextmanager
def scratch_scope() -> Iterator[list[tuple[str, str]]]:
    """Collects (label, path) of the scratch folders made while it is open."""
    made: list[tuple[str, str]] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A folder for everything written while it is open, deleted at its end.

    What must outlive it is written with :func:`lasting`.
    """
    path = fresh_dir(spark, "scratch")
    token = _homes.set((*_homes.get(), path))
    try:
        yield
    finally:
        _homes.reset(token)
        drop_dir(spark, path)


def lasting(df: DataFrame, label: str) -> DataFrame:
    """``df`` written outside the present :func:`scratch` folder and read back."""
    token = _homes.set(_homes.get()[:-1])
    try:
        return written(df, label)
    finally:
        _homes.reset(token)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs meanwhile are deleted when it has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, and values that depend on
    how rows were laid out (row numbers, range bounds) stay as they were. The
    shuffle files it took are deleted, as nothing can need them any more.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rows(df: DataFrame, label: str, row: str = "_row") -> DataFrame:
    """``df`` written with a unique, stable number per row.

    A column of that name in ``df`` is replaced.
    """
    from pyspark.sql import functions as F

    return written(df.withColumn(row, F.monotonically_increasing_id()), label)
