"""The stored lesson log with snapshots.

Every append is a numbered commit with a folder of its own. A compaction merges the
last snapshot with the appends after it into a new one, the latest row of every id,
and commits it with the number up to which it reaches. Readers merge the snapshot
that reaches farthest with the appends numbered above it, so they read each
superseded row at most once more after a compaction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession

from lessonloom.operators.lessons import latest_per_id
from lessonloom.schemas import LESSON_LOG
from lessonloom.session import drop_dir
from lessonloom.sources.commits import append_commit, empty, history


def append(events: DataFrame, path: str) -> int:
    """Add rows to the log; the number of the commit. Nothing is rewritten."""
    attempt = uuid.uuid4().hex
    events.write.parquet(_part(path, attempt))
    return append_commit(events.sparkSession, path, kind="append", name="", attempt=attempt)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each id, deletes included, as of now."""
    return _merged(spark, path, history(spark, path))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The lessons that exist now."""
    return read_latest(spark, path).where("op = 'save'").drop("op")


def compact(spark: SparkSession, path: str) -> int | None:
    """Write a snapshot of the log as it is now; its commit's number.

    Deletes stay in it, so that an event that arrives late cannot bring a lesson
    back. Appends made meanwhile are numbered above what the snapshot reaches and
    stay to be merged. None if nothing was appended since the last snapshot.
    """
    past = history(spark, path)
    snapshot, later = _parts(past)
    if not later:
        return None
    attempt = uuid.uuid4().hex
    _merged(spark, path, past).write.parquet(_snapshot(path, attempt))
    return append_commit(spark, path, kind="snapshot", name="", attempt=attempt, upto=later[-1]["n"])


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the appends and snapshots that the last snapshot replaces; how many.

    For when no reader that began before that snapshot is still at work.
    """
    past = history(spark, path)
    last, later = _parts(past)
    if last is None:
        return 0
    needed = {last["n"], *(c["n"] for c in later)}
    gone = [c for c in past if c["n"] not in needed]
    for commit in gone:
        # The marker goes first: data without a marker is never read.
        drop_dir(spark, f"{path}/commits/{commit['n']:012d}.json")
        drop_dir(spark, (_snapshot if commit["kind"] == "snapshot" else _part)(path, commit["attempt"]))
    return len(gone)


def _part(path: str, attempt: str) -> str:
    return f"{path}/parts/{attempt}"


def _snapshot(path: str, attempt: str) -> str:
    return f"{path}/snapshots/{attempt}"


def _parts(past: list[Row]) -> tuple[Row | None, list[Row]]:
    """The snapshot that reaches farthest, and the appends that it does not reach."""
    last = max((c for c in past if c["kind"] == "snapshot"), key=lambda c: (c["upto"], c["n"]), default=None)
    upto = -1 if last is None else last["upto"]
    return last, [c for c in past if c["kind"] == "append" and c["n"] > upto]


def _merged(spark: SparkSession, path: str, past: list[Row]) -> DataFrame:
    last, later = _parts(past)
    folders = [_part(path, c["attempt"]) for c in later]
    folders += [] if last is None else [_snapshot(path, last["attempt"])]
    if not folders:
        return empty(spark, LESSON_LOG)
    return latest_per_id(spark.read.schema(LESSON_LOG).parquet(*folders))
