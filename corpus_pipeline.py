"""The training-data pipeline: clean, deduplicate, mix and pack ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written and reread as the next one's docs.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lessonloom.llm import mixing, packing, radix, simhash, toxicity
from lessonloom.session import drop_dir, lasting, scratch, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# Scratch folders of the last stage that was called on its own in this thread.
_called = threading.local()


def _forget(spark: SparkSession) -> None:
    for path in getattr(_called, "folders", ()):
        drop_dir(spark, path)
    _called.folders = ()


def stage(function):
    """A stage that first deletes the scratch folders of the stage called before it,
    whose result has been written and reread by then. :func:`run` calls the bare
    functions and owns their folders itself."""

    @wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _forget(spark)
        with scratch_scope() as made:
            result = function(spark, docs, sf_dir)
        if function is not STAGES[-1][1].__wrapped__:  # no stage follows that reads the last one's result
            _called.folders = tuple(path for _, path in made)
        return result

    return staged


@stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return radix.drop_exact_duplicates(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return simhash.drop_near_duplicates(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to the square root of their present weights."""
    return mixing.mix(docs).select(*docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each but the last written and reread.

    A stage's scratch folders go as soon as its output is written, and its input
    when nothing reads it any more; only what the result reads stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, function in STAGES[:-1]:
        with scratch(spark):
            result = function.__wrapped__(spark, docs, sf_dir)
            with scratch_scope() as made:
                docs = lasting(result, name)
        if before is not None:
            drop_dir(spark, before)
        before = made[-1][1]
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)


# The classifier and the fingerprints cannot be put in SQL; tests/llm compares
# every stage with a brute-force version.
ORACLE_SQL = None
