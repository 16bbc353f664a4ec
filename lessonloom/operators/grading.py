"""Quiz answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grade_answers(answers: DataFrame, options: DataFrame) -> DataFrame:
    """Only the first answer to a question counts; it is graded by its option.

    ``answers``: session, question, label, ts, seq. ``options``: question,
    label, is_correct. An answer that matches no option is wrong.
    """
    first = answers.groupBy("session", "question").agg(
        F.min_by("label", F.struct("ts", "seq")).alias("label")
    )
    return first.join(options, ["question", "label"], "left").select(
        "session",
        "question",
        "label",
        F.coalesce("is_correct", F.lit(False)).alias("is_correct"),
    )


def scores(graded: DataFrame) -> DataFrame:
    """Right answers and answered questions per session."""
    return graded.groupBy("session").agg(
        F.count_if("is_correct").alias("correct"), F.count(F.lit(1)).alias("answered")
    )
