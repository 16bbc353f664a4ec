"""Numbered commits of a stored folder.

Data is written to a folder of its attempt and becomes visible with a marker: a
small JSON file in ``commits`` named by its number. A marker is written aside and
renamed, and a rename to a number that is taken fails. So of two writers one gets
the number, and the other learns that something was committed meanwhile. The file
system must refuse to rename onto an existing file, as HDFS does.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "n BIGINT, kind STRING, name STRING, attempt STRING, upto BIGINT"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows."""
    fields = T.StructType.fromDDL(schema)
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def read_commits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per commit, as of now: later commits do not change the returned table."""
    try:
        return spark.read.schema(COMMIT).json(f"{folder}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, COMMIT)


def history(spark: SparkSession, folder: str, after: int = -1) -> list[Row]:
    """The commits numbered above ``after``, in order: a small row per load, delete or append."""
    rows = read_commits(spark, folder).where(F.col("n") > after)
    return rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns)))).first()[0]


def publish(spark: SparkSession, folder: str, n: int, **fields) -> bool:
    """Make commit ``n`` unless there is one already; whether it was made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    aside, marker = path(f"{folder}/commits/.{uuid.uuid4().hex}"), path(f"{folder}/commits/{n:012d}.json")
    system = aside.getFileSystem(conf)
    system.mkdirs(marker.getParent())
    out = system.create(aside, False)
    out.write(bytearray(json.dumps({"n": n, **fields}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(aside, marker, plain)
    except Py4JJavaError as error:
        system.delete(aside, False)
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def append_commit(spark: SparkSession, folder: str, **fields) -> int:
    """Make the next commit, whatever was committed meanwhile; its number."""
    n = max((c["n"] for c in history(spark, folder)), default=-1) + 1
    while not publish(spark, folder, n, **fields):
        n += 1
    return n
