"""The stored standards tree: four Parquet tables, one partition per load and attempt.

Loads and deletes are numbered commits (``commits.py``). A row is there if the last
commit of its load names its attempt and no later commit deletes its subject. Every
row carries the key of its subject, so a delete is one tombstone per subject, and
the whole subtree goes by one anti join wherever it is read. What an attempt that
broke off left behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lessonloom.operators.ingest import insert_new_subtrees
from lessonloom.schemas import INDICATORS, REJECTED, STRANDS, SUB_STRANDS, SUBJECTS
from lessonloom.session import drop_dir
from lessonloom.sources.commits import append_commit, history, publish, read_commits, read_or_empty

LEVELS = {
    "subjects": SUBJECTS,
    "strands": STRANDS,
    "sub_strands": SUB_STRANDS,
    "indicators": INDICATORS,
}
STORED = "root STRING, load STRING, attempt STRING"


def _loads(commits: DataFrame) -> DataFrame:
    """``load, attempt, n``: the last commit of every load."""
    last = commits.where("kind = 'load'").groupBy(F.col("name").alias("load"))
    return last.agg(F.max_by("attempt", "n").alias("attempt"), F.max("n").alias("n"))


def _deleted(spark: SparkSession, folder: str, commits: DataFrame) -> DataFrame:
    """``root, gone``: the last commit that deleted each subject."""
    rows = read_or_empty(spark, f"{folder}/tombstones", "root STRING, attempt STRING")
    committed = rows.join(commits.where("kind = 'delete'").select("attempt", "n"), "attempt")
    return committed.groupBy("root").agg(F.max("n").alias("gone"))


def _read(spark: SparkSession, folder: str, level: str, commits: DataFrame) -> DataFrame:
    """Rows of the committed attempt of every load whose subject was not deleted since."""
    rows = read_or_empty(spark, f"{folder}/{level}", f"{LEVELS[level]}, {STORED}")
    loaded = rows.join(_loads(commits), ["load", "attempt"])
    kept = loaded.join(_deleted(spark, folder, commits), "root", "left").where("gone IS NULL OR gone < n")
    return kept.select(*[c for c in rows.columns if c not in ("root", "attempt")])


def read_tree(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables as of now, over all committed loads and deletes."""
    commits = read_commits(spark, folder)
    return {level: _read(spark, folder, level, commits).drop("load") for level in LEVELS}


def read_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """What committed loads left out for want of a key: ``level, parent, name, load``."""
    rows = read_or_empty(spark, f"{folder}/rejected", f"{REJECTED}, load STRING, attempt STRING")
    return rows.join(_loads(read_commits(spark, folder)), ["load", "attempt"], "left_semi").drop("attempt")


def load_standards(
    spark: SparkSession,
    docs: DataFrame,
    folder: str,
    order: str,
    load: str,
    created_at: Column | None = None,
) -> int:
    """Add the new subjects among ``docs`` to the stored tree; the number of the commit.

    ``load`` names the batch. It is checked against the other loads committed when it
    begins and writes to a folder of its own. If others have committed by its end, it
    is checked against those too: it begins anew if they brought a slug or code that
    it brings as well, deleted something, or repeated this load, and takes the next
    number otherwise. So of loads that run at the same time the result is that of
    running them one after the other. Repeating a load replaces what it wrote before;
    a load that broke off hides nothing from the loads after it.
    """
    while True:
        past = history(spark, folder)
        attempt = _attempt(spark, docs, folder, order, load, created_at)
        seen = past[-1]["n"] if past else -1
        while not publish(spark, folder, seen + 1, kind="load", name=load, attempt=attempt):
            later = history(spark, folder, seen)
            if _clash(spark, folder, load, attempt, later):
                break
            seen = later[-1]["n"]
        else:
            return seen + 1
        for level in (*LEVELS, "rejected"):
            drop_dir(spark, _part(folder, level, load, attempt))


def _part(folder: str, level: str, load: str, attempt: str) -> str:
    return f"{folder}/{level}/load={load}/attempt={attempt}"


def _attempt(spark: SparkSession, docs: DataFrame, folder: str, order: str, load: str, created_at: Column | None) -> str:
    """Write what ``docs`` add to the tree as it is now; the name of the attempt."""
    commits = read_commits(spark, folder)
    others = {level: _read(spark, folder, level, commits).where(F.col("load") != load) for level in ("subjects", "indicators")}
    new = insert_new_subtrees(others["subjects"], docs, order, others["indicators"], rooted=True)
    stamp = F.current_timestamp() if created_at is None else created_at
    new["subjects"] = new["subjects"].withColumn("created_at", stamp.cast("timestamp_ntz"))
    new["indicators"] = new["indicators"].drop("source_order")
    attempt = uuid.uuid4().hex
    for level, df in new.items():
        df.write.parquet(_part(folder, level, load, attempt))
    return attempt


def _clash(spark: SparkSession, folder: str, load: str, attempt: str, later: list[Row]) -> bool:
    """Whether commits made meanwhile could have changed what this attempt wrote."""
    if any(c["kind"] != "load" or c["name"] == load for c in later):
        return True
    for level, key in (("subjects", "slug"), ("indicators", "code")):
        read = spark.read.schema(LEVELS[level])
        mine = read.parquet(_part(folder, level, load, attempt)).select(key)
        theirs = read.parquet(*[_part(folder, level, c["name"], c["attempt"]) for c in later]).select(key)
        if not mine.join(theirs, key, "left_semi").isEmpty():
            return True
    return False


def delete_subjects(spark: SparkSession, folder: str, ids: DataFrame, name: str) -> bool:
    """Delete subjects and all that hangs below them from the stored tree.

    ``ids`` has one column ``id``; ids that are not there change nothing. ``name``
    names the delete: one that is committed already is not repeated, so that a retry
    spares a subject loaded again in between. Nothing of a delete that broke off is
    seen. Whether it was committed now.
    """
    if any(c["kind"] == "delete" and c["name"] == name for c in history(spark, folder)):
        return False
    attempt = uuid.uuid4().hex
    roots = ids.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("root")).distinct()
    roots.write.parquet(f"{folder}/tombstones/attempt={attempt}")
    append_commit(spark, folder, kind="delete", name=name, attempt=attempt)
    return True
