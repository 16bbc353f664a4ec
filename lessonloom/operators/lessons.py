"""The lesson store: an append-only change log and the state derived from it.

A log row has ``id, op ('save' | 'delete'), ts, seq`` and, for a save, the
lesson's columns. Plain Parquet has no delete, so a delete is one more row and
the store is the latest row per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.functions.text import missing, or_default
from lessonloom.schemas import LESSON_LOG


def save_event(valid: DataFrame, id_from: list[str], ts: Column, seq: Column) -> DataFrame:
    """Log rows for validated lesson bodies.

    The id hashes ``id_from``, which must tell one request from the next, so a
    retried batch writes the ids it wrote before while two saves of the same
    lesson stay two rows. A missing sub-strand takes the strand's name.
    """
    return valid.select(
        F.sha2(F.concat_ws("\u001f", *(F.col(c).cast("string") for c in id_from)), 256).alias("id"),
        F.lit("save").alias("op"),
        ts.alias("ts"),
        seq.alias("seq"),
        F.col("indicatorCode").alias("indicator_code"),
        "subject",
        "grade",
        "strand",
        or_default(F.col("subStrand"), F.col("strand")).alias("sub_strand"),
        F.col("teacherNotes").alias("teacher_notes"),
        F.col("visualPrompts").alias("visual_prompts"),
        F.col("studentReading").alias("student_reading"),
    )


def delete_event(ids: DataFrame, ts: Column, seq: Column) -> tuple[DataFrame, DataFrame]:
    """Log rows for deletes, and the rejected requests that name no id."""
    good = ids.where(~missing(F.col("id").cast("string")))
    bad = ids.where(missing(F.col("id").cast("string"))).withColumn(
        "error", F.lit("Lesson ID is required")
    )
    return good.select("id", F.lit("delete").alias("op"), ts.alias("ts"), seq.alias("seq")), bad


def append_log(events: DataFrame, path: str) -> None:
    """Add rows to the log. Nothing is deduplicated or rewritten."""
    events.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; a delete has nulls for the lesson's columns."""
    return spark.read.schema(LESSON_LOG).parquet(path)


def latest_per_id(log: DataFrame) -> DataFrame:
    """The latest log row of each id by ``(ts, seq)``, deletes included.

    A maximum combines before the shuffle, so an id with a third of all
    events costs one row per task. Deleting an unknown id leaves a delete.
    """
    payload = [c for c in log.columns if c != "id"]
    return (
        log.groupBy("id")
        .agg(F.max_by(F.struct(*payload), F.struct("ts", "seq")).alias("_last"))
        .select("id", "_last.*")
    )


def lesson_state(log: DataFrame) -> DataFrame:
    """The lessons that exist now."""
    return latest_per_id(log).where(F.col("op") == "save").drop("op")


def filter_lessons(state: DataFrame, subject: str | None = None, grade: str | None = None) -> DataFrame:
    """Only the given filters apply; null and empty mean no filter."""
    if subject:
        state = state.where(F.col("subject") == subject)
    if grade:
        state = state.where(F.col("grade") == grade)
    return state


def list_lessons(state: DataFrame, subject: str | None = None, grade: str | None = None) -> DataFrame:
    """Newest first; the id makes the order total."""
    return filter_lessons(state, subject, grade).orderBy(F.desc("created_at"), "id")


def lesson_by_id(state: DataFrame, lesson_id) -> DataFrame:
    """One lesson; the predicate reaches the scan. Empty when there is none."""
    return state.where(F.col("id") == lesson_id).limit(1)


def without_lesson(state: DataFrame, lesson_id) -> DataFrame:
    """A listing after one lesson was removed from it."""
    return state.where(F.col("id") != lesson_id)


def count_lessons(state: DataFrame, subject: str | None = None, grade: str | None = None) -> DataFrame:
    """Number of lessons; reads only the filtered columns. ``badge`` caps at 99+."""
    n = F.count(F.lit(1))
    badge = F.when(n > 99, "99+").otherwise(n.cast("string"))
    return filter_lessons(state, subject, grade).agg(n.alias("lessons"), badge.alias("badge"))


def short_date(ts: Column) -> Column:
    """``3 Sept 2024``: British short form, where September has four letters."""
    return F.regexp_replace(F.date_format(ts, "d MMM yyyy"), "Sep ", "Sept ")


def long_date(ts: Column) -> Column:
    """``3 September 2024``."""
    return F.date_format(ts, "d MMMM yyyy")
