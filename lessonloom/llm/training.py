"""Bounded samples of labelled documents, and models fitted in one task."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lessonloom.llm.tasks import map_batches
from lessonloom.session import written


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label is ever learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str, text: str) -> DataFrame:
    """``y, text, weight`` of at most ``most`` labelled rows outside the held-out fold.

    The rows with the smallest hashed ids are taken, half of them from the rows
    with label 1 and half from those with label 0 if both have enough. Rows with
    null id or label are not used; of a doc_id that occurs more than once the text
    with the smallest hash is. ``weight`` is the number of rows with the same label for
    each row taken, so that weighted rows have the label shares of the whole table.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    narrow = known.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y"))
    order = F.xxhash64("_id", F.lit(91))
    chosen = narrow.where("y = 1").orderBy(order).limit(most // 2).union(
        narrow.where("y = 0").orderBy(order).limit(most - most // 2)
    )
    taken = written(chosen, "sample")  # at most ``most`` narrow rows
    shares = taken.groupBy("y").agg(F.count(F.lit(1)).alias("_taken")).join(narrow.groupBy("y").count(), "y")
    shares = written(shares.select("y", (F.col("count") / F.col("_taken")).alias("weight")), "shares")
    chosen = taken.groupBy("_id").agg(F.min("y").alias("y")).join(shares, "y")
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "y", "weight").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return written(met.orderBy(F.xxhash64("_id", "text")), "sample")


def fitted(sample: DataFrame, fit):
    """``fit(labels, texts, weights)`` run in one task over a bounded sample; returns the model."""

    def run(batches):
        y, texts, weights = [], [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            weights += batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(y, texts, weights))], pa.binary())], names=["model"])

    one = sample.coalesce(1).sortWithinPartitions(F.xxhash64("_id", "text")).select("y", "text", "weight")
    found = map_batches(one, run, "model BINARY").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [], [])
